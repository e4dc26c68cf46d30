"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents one after another, are cut into blocks of
``BLOCK`` words.  A mix as long as the corpus is a row of slots, each of which
takes one block.  The slots of all sources are laid on one line, by the sources'
targets, and dealt to output shards in the order of a hash of their places: each
shard's source counts are a multinomial draw under the condition that the shards
together have the sources' totals.  The mix is ordered by shard and slot.  The
slots of a source go through its blocks in passes; in each pass the slot numbers
are mapped to block numbers by a pseudorandom permutation of their own, and blocks
are joined by index.  A permutation is ROUNDS of swap-or-not (Hoang, Morris and
Rogaway 2012), a bijection of 0 .. n-1 for any n, with keys hashed from source and
pass.

Targets: source k, by code point with null last, weighs as ``weights`` repeats;
a target that would pass ``limit`` times its source stops there and the excess
goes to the others by weight.

Null and empty texts have size 0 and are never taken; texts of any length are read
whole; repeated rows and null keys each have their own place, equal keys by size
and text; a source without words has target 0; an empty table gives an empty
result.  Only key, text and source are read, so extra columns of any name are no
matter; ``rebuilt`` carries them on (its own names begin with two underscores).

Windows over sources have one row a source, and those over bins one row for
DEAL_ROWS slots; they are broadcast up to BROADCAST_ROWS rows and joined beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.stored import shared_folder, stored

BLOCK, SHARD, WEIGHTS, LIMIT, RUN, ROUNDS = 128, 4096, (5, 2, 1), 3, 65_536, 24
BUCKET_ROWS, DEAL_ROWS, BROADCAST_ROWS = 2_000, 16_384, 200_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(i: Column, n: Column, *salt: Column) -> Column:
    """The image of i under a permutation of 0 .. n-1 that ``salt`` names.

    In each round a number and its partner (they add up to the round's key, modulo
    n) change places or not, as a hash of the larger one says."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *salt), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *salt), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, turn)


def sendable(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; as it is beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def source_targets(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row a source: source, n_rows, source_size, target; from rows source, size.

    What is windowed here has one row a source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(k, F.lit(len(weights))) + 1).cast("int")))
    # sources stop in the order of limit * size / weight; those before a row in that order have stopped
    s = s.withColumn("stop", limit * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("rate", (total - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("w").over(after))
    # from the first row whose stop is not reached on, the rate is that row's
    free = F.when(F.col("stop") >= F.col("rate") * F.col("w"), F.col("rate"))
    s = s.withColumn("level", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "n_rows", "source_size", F.when(F.col("level").isNull(), F.col("stop").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def placed(sized: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rows of ``sized`` with the number of words of their source before them (at).

    Running sums are taken in buckets of about BUCKET_ROWS rows, dealt by hash,
    and offset by the totals of the buckets before, so no task holds a source."""
    n = F.greatest(F.ceil(F.col("n_rows") / BUCKET_ROWS), F.lit(1))
    rows = sized.join(sendable(targets), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit(9)), n))
    own = Window.partitionBy("source", "bucket").orderBy(F.col(key), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("outer"))
    return rows.join(buckets, rows.source.eqNullSafe(F.col("s")) & (rows.bucket == F.col("b"))).withColumn("at", F.col("inner") + F.col("outer")).drop("s", "b", "inner", "outer", "bucket", "n_rows")


def slots(targets: DataFrame, block: int = BLOCK, shard: int = SHARD, limit: int = LIMIT) -> DataFrame:
    """The mix: source, ordinal, pass, block, words (taken from the block's start), part (whether
    the pass takes only some of its source's blocks), slot and shard.

    Slots are made in runs, so a source with many gives many tasks work."""
    t = targets.where("source_size > 0")
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    passes = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(limit))
    t = t.withColumn("passes", passes).withColumn("rest", F.greatest(F.round(F.col("target") - F.col("passes") * F.col("source_size")), F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.when(F.col("passes") >= limit, 0).otherwise(F.col("rest")))
    t = t.withColumn("part", F.least(F.ceil(F.col("rest") / block), F.col("n_blocks"))).withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.col("part"))
    line = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    t = t.withColumn("first", F.coalesce(F.sum("n_slots").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n_slots").over(Window.partitionBy()))
    n_all = t.agg(F.max("all")).head()[0] or 0
    runs = t.where("n_slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / RUN))))
    # a stated number of tasks: by size alone these few short rows would be put into one
    runs = runs.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("source"), F.col("run"))
    s = runs.withColumn("ordinal", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n_slots")) - 1)))
    s = s.withColumn("pass", F.floor(F.col("ordinal") / F.col("n_blocks"))).withColumn("i", F.col("ordinal") - F.col("pass") * F.col("n_blocks"))
    to = permuted(F.col("i"), F.col("n_blocks"), F.col("source"), F.col("pass"))
    last = (F.col("pass") == F.col("passes")) & (F.col("i") == F.col("part") - 1)
    words = F.when(last, F.least(F.lit(block).cast("long"), F.col("rest") - (F.col("part") - 1) * block)).otherwise(F.lit(block).cast("long"))
    s = s.select("source", "ordinal", "pass", to.alias("block"), words.alias("words"), (F.col("pass") == F.col("passes")).alias("part"), (F.col("first") + F.col("ordinal")).alias("line"), "all")
    return dealt(s, n_all).withColumn("shard", F.floor(F.col("slot") / shard)).drop("line", "all")


def dealt(s: DataFrame, n_all: int) -> DataFrame:
    """``s`` with the rank (slot) of each place on the line by its hash.

    Ranks are taken in bins of the hash of about DEAL_ROWS rows, offset by the
    counts of the bins before; only those counts, one row a bin, are in one task."""
    s = s.withColumn("key", F.shiftrightunsigned(F.xxhash64("line", F.lit(104_729)), 33))
    s = s.withColumn("bin", F.shiftright(F.col("key") * F.ceil(F.col("all") / DEAL_ROWS), 31))
    few = F.broadcast if n_all <= DEAL_ROWS * BROADCAST_ROWS else lambda x: x
    before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = s.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("bin").alias("b"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("key", "line"))
    ranked = s.withColumn("rank", rank)
    return ranked.join(few(bins), ranked.bin == F.col("b")).withColumn("slot", F.col("before") + F.col("rank") - 1).drop("b", "before", "rank", "bin", "key")


def shard_counts(s: DataFrame) -> DataFrame:
    """How many slots, and words, of each source are in each output shard."""
    return s.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("words").alias("n_words"))


def laid_out(docs: DataFrame, no: Column, key: str, text: str, source: str, weights, limit: int) -> tuple[DataFrame, DataFrame]:
    """(placed rows under their numbers ``no``, targets).

    Sizes (a few numbers a row) are written to the checkpoint folder once."""
    shared_folder(docs.sparkSession)
    sized = docs.select(no.alias("no"), F.col(key), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.xxhash64(text).alias("tie")).checkpoint()
    targets = source_targets(sized, weights, limit).checkpoint()
    return placed(sized, targets, key).checkpoint(), targets


def covered(rows: DataFrame, block: int) -> DataFrame:
    """Every row once for each block that it has words in."""
    return rows.where("size > 0").select("no", "source", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights=WEIGHTS, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """key, size, source, source_size, target, taken, shard and slot for every row of ``docs``.

    ``taken`` counts the words of the row that the mix takes, repeats included; its
    shard and slot are the first that take any, and the rows are in their order,
    those that are not taken at the end."""
    rows, targets = laid_out(docs, F.monotonically_increasing_id(), key, text, source, weights, limit)

    uses = slots(targets, block, limit=limit).groupBy("source", "block").agg(F.sum(F.when(F.col("words") == block, 1).otherwise(0)).alias("full"), F.max(F.when(F.col("words") < block, F.col("words")).otherwise(0)).alias("head"), F.min(F.when(F.col("words") == block, F.col("slot"))).alias("full_slot"), F.min(F.when(F.col("words") < block, F.col("slot"))).alias("head_slot"))
    cover = covered(rows, block)
    begin = F.greatest(F.col("at"), F.col("block") * block) - F.col("block") * block
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    u = uses.select(F.col("source").alias("us"), F.col("block").alias("ub"), "full", "head", "full_slot", "head_slot")
    # the planner takes slots for as few as the sources they come from: without the hint it would broadcast them
    hit = cover.join(u.hint("merge"), cover.source.eqNullSafe(F.col("us")) & (F.col("block") == F.col("ub")))
    in_head = F.greatest(F.least(end, F.col("head")) - begin, F.lit(0))
    slot = F.least("full_slot", F.when(in_head > 0, F.col("head_slot")))
    taken = hit.select("no", (F.col("full") * (end - begin) + in_head).alias("t"), slot.alias("slot")).groupBy("no").agg(F.sum("t").alias("taken"), F.min("slot").alias("slot"))
    out = rows.join(taken, "no", "left").select(key, "size", "tie", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.floor(F.col("slot") / shard).alias("shard"), "slot")
    return out.orderBy(F.asc_nulls_last("shard"), F.asc_nulls_last("slot"), F.col(key), "size", "tie")


def drawn(rows: DataFrame, s: DataFrame, block: int = BLOCK) -> DataFrame:
    """What slots ``s`` take of the rows: no, slot, at, start and n (words of the row).

    A pass through all blocks takes each row whole, in the slot of the block it
    begins in.  Of a pass through some, blocks of a row that lie next to each other
    are one piece, in the slot of the first."""
    taken = s.select(F.col("source").alias("us"), F.col("block").alias("ub"), "part", "words", "slot")
    same = lambda r, t: r.join(t.hint("merge"), r.source.eqNullSafe(F.col("us")) & (r.block == F.col("ub")))
    begins = rows.where("size > 0").withColumn("block", F.floor(F.col("at") / block))
    whole = same(begins, taken.where("not part")).select("no", "slot", "at", F.lit(0).cast("long").alias("start"), F.col("size").alias("n"))
    start = F.greatest(F.col("at"), F.col("block") * block) - F.col("at")
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words")) - F.col("at")
    some = same(covered(rows, block), taken.where("part")).select("no", "slot", "at", start.alias("start"), end.alias("end")).where("end > start")
    order = Window.partitionBy("no").orderBy("start")
    some = some.withColumn("new", F.coalesce((F.lag("end").over(order) != F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    some = some.groupBy("no", "at", "run").agg(F.min_by("slot", "start").alias("slot"), F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.unionByName(some.select("no", "slot", "at", "start", (F.col("end") - F.col("start")).alias("n")))


def cut_out(text: Column, start: Column, n: Column, words: Column) -> Column:
    """Words start .. start + n - 1 of a text that is cut into ``words``, white space as it was."""
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    first = F.when(start == 0, 1).otherwise(start + 1 + lead)
    return F.array_join(F.slice(words, first.cast("int"), (n + F.when(start == 0, lead).otherwise(0)).cast("int")), "")


def rebuilt(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """The mixed corpus in the columns of ``docs``.

    A row appears whole for each pass that takes its source whole; of a pass that
    takes some blocks, each piece of the row follows as a text of its own, cut at
    the words drawn, its white space as it was.  Texts are in the order of shards
    and slots, so repeats of a row lie apart.  Rows are stored once, so that their
    numbers hold."""
    docs = stored(docs.withColumn("__no", F.monotonically_increasing_id()))
    rows, targets = laid_out(docs, F.col("__no"), key, text, source, WEIGHTS, LIMIT)
    taken = drawn(rows, slots(targets, block), block).groupBy(F.col("no").alias("__n")).agg(F.collect_list(F.struct("slot", "at", "start", "n")).alias("__p"))
    out = docs.join(taken, F.col("__no") == F.col("__n")).withColumn("__size", words_in(F.col(text)))
    # a text is cut into words once for all its pieces: one-element array as a name for the words
    words = F.when(F.exists("__p", lambda p: p.n < F.col("__size")), F.split(F.col(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"))
    one = lambda p, w: F.struct(p.slot.alias("slot"), p["at"].alias("at"), p.start.alias("start"), F.when(p.n < F.col("__size"), cut_out(F.col(text), p.start, p.n, w)).otherwise(F.col(text)).alias("text"))
    pieces = F.flatten(F.transform(F.array(words), lambda w: F.transform("__p", lambda p: one(p, w))))
    out = out.select(*(f"`{c}`" for c in docs.columns if c not in (text, "__no")), F.explode(pieces).alias("__x")).orderBy("__x.slot", "__x.at", "__x.start").withColumn(text, F.col("__x.text"))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns if c != "__no"))
