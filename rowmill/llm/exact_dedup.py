"""Exact duplicates by two-pass Bloom filtering.

Every text is read once, for its SHA-256; the narrow table of ids and hashes is
stored.  The first pass counts, up to two, how many rows set each of the two bits
that a hash has in a Bloom filter of ``BITS_A_ROW`` bits a row; bits that two rows
or more set make up the second filter, kept as bitmaps of 32,768 bits.  The second
pass tests each row: one whose two bits are not both in the second filter has a
text that no other row has, and passes straight to the result.  Only the others
(all repeated texts, and about one in seventy of the rest) are grouped by hash.

The filter is sent to every task, so its size is bounded: a filter has at most
``MAX_BITS`` bits, and a larger table is dealt by hash to several rounds, each with
a filter of its own; nothing else changes.  Counts are added up before they are
shuffled, and hot groups meet their rows by ``hot.attach``.

A null text is empty, and empty texts are equal.  Of equal texts the row with the
largest id stays, a null id counting as smallest; of rows that repeat both id and
text one stays.  An empty table gives an empty result.  Other columns are not
read (``exact_groups``) or kept as they are, whatever their names (``deduplicated``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.hot import attach
from rowmill.llm.stored import stored

BITS_A_ROW, MAX_BITS, MAP = 16, 1 << 31, 32_768


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _number(sha: Column, at: int) -> Column:
    """The 56 bits of a hash from byte ``at`` on, as a long."""
    return F.conv(F.hex(F.substring(sha, at, 7)), 16, 10).cast("long")


def _places(bits: int) -> list[Column]:
    """The two bits of a row's hash."""
    return [_number(F.col("sha"), at) % bits for at in (1, 8)]


def repeated_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """First pass: bucket and bitmap of the bits that two rows or more set."""
    counts = hashes.select(F.explode(F.array(*_places(bits))).alias("bit")).groupBy("bit").count().where("count >= 2")
    dealt = counts.select(F.expr(f"bit div {MAP}").alias("bucket"), (F.col("bit") % MAP).alias("bit")).repartition("bucket")
    return stored(dealt.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")))


def suspect(hashes: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Second pass: ``hashes`` with the flag ``again``, false where the hash is surely alone."""
    names, again = hashes.columns, F.lit(True)
    for i, place in enumerate(_places(bits)):
        side = F.broadcast(filters.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        hashes = hashes.withColumn(f"_p{i}", place)
        hashes = hashes.join(side, F.expr(f"_p{i} div {MAP} = _b{i}"), "left")
        at = F.col(f"_p{i}") % MAP
        byte = F.conv(F.hex(F.substring(F.col(f"_m{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        again = again & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return hashes.select(*names, again.alias("again"))


def _tested(hashes: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Both passes over ``hashes`` (column sha, others kept), a filter for each round."""
    rounds = max(1, -(-n * BITS_A_ROW // max_bits))
    bits = max(MAP, -(-n * BITS_A_ROW // rounds))
    dealt = hashes.withColumn("_round", _number(F.col("sha"), 15) % rounds)
    of = [dealt.where(F.col("_round") == r).drop("_round") for r in range(rounds)] if rounds > 1 else [hashes]
    return reduce(DataFrame.unionByName, (suspect(h, repeated_bits(h, bits), bits) for h in of))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id (the id of the row that stays),
    group_size, kept and text_sha256 (hexadecimal)."""
    hashes = stored(df.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    n = hashes.count()
    tested = _tested(hashes, n, max_bits)
    some = stored(tested.where("again").drop("again"))
    groups = stored(some.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")))
    repeated = attach(some, groups, ["sha"], "group_size", n).select("doc_id", "sha", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"))
    alone = tested.where(~F.col("again")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: rows whose text is surely
    alone are never shuffled, and of the others only those with a group's largest id."""
    rows = df.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), digest(F.col(text)).alias("sha"))
    tested = _tested(rows, df.count(), max_bits)
    some = tested.where("again")
    groups = stored(some.groupBy("sha").agg(F.max(F.struct("_id")).alias("_top")).select(F.col("sha").alias("_sha"), "_top"))
    once = some.groupBy("sha", "_id").agg(F.first("_row").alias("_row"))
    stay = once.join(groups, (F.col("sha") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_top._id")), "left_semi")
    return tested.where(~F.col("again")).select("_row.*").unionByName(stay.select("_row.*"))
