"""Prefix trie of conversations by fixed-length block hashing.

A turn is known by a digest of role and text; with its position it gives two 64-bit
numbers, and a prefix is known by the XOR of the numbers of its turns, so prefixes
of any length come from sums over windows and no conversation is ever held in one
row.  Conversations are cut into blocks of ``BLOCK`` turns and grouped by the prefix
before a block and the prefix after it.  Below a prefix that only one block follows,
the block's turns are nodes with that group's counts.  Only where different blocks
follow the same prefix (siblings diverge, or some conversation ends inside) are the
turn boundaries of these different blocks, not of their conversations, grouped again.

Counts over subtrees need no descent.  The smallest member of a node is also that of
the nodes on its own way down, so every node belongs to the chain of one
conversation; what a subtree sums up is what the chains of its members sum up, less
the part of the node's own chain that lies above it.

Rows without ``conv_id`` take no part.  Turns are ordered by ``turn``, null first, and
those that repeat a number by digest.  A null role or text is empty.  Every row counts,
repeated ones too.  An empty table gives no nodes, not even a root.  Other columns are not read.
A conversation, a first turn or a whole conversation's copies may hold any share of
the rows: order within a conversation goes by range buckets and window segments of
bounded size, and hot groups meet their rows by ``hot.attach``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.hot import attach
from rowmill.llm.stored import stored

#: Turns of a block; rows of a window segment.
BLOCK, SEGMENT = 4, 1024


def _number(sha: Column, at: int) -> Column:
    return F.conv(F.substring(sha, at, 15), 16, 10).cast("long")


def turns_of(df: DataFrame) -> DataFrame:
    """conv, pos (from 0), d1, d2 (digest of role and text) and bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    own = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    own = stored(own.select("conv", "turn", _number(F.col("sha"), 1).alias("d1"), _number(F.col("sha"), 16).alias("d2"), "bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]
    dealt = stored(own.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("conv", "part").count().select("conv", "part", F.sum("count").over(before).alias("earlier"))
    # of each part, only its first conversation can have begun before it: one row a part at most
    placed = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order)) - 1)
    placed = placed.join(F.broadcast(earlier.where("earlier > 0")), ["conv", "part"], "left")
    return placed.select("conv", (F.col("n") + F.coalesce("earlier", F.lit(0))).alias("pos"), "d1", "d2", "bytes")


def rebuilt(turns: DataFrame, base: Column, head: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` turns of another (``base``), then go on
    with their own turns after their first ``head``: (conv, pos, d1, d2, bytes) and (conv, length).

    ``base`` and ``head`` are over column conv; a base has few conversations."""
    sizes = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    convs = sizes.withColumns({"base": base, "head": head})
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    got = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = stored(convs.select("conv", "base", "head", "n", (got - F.col("head")).alias("shift"), (got + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")))
    own = attach(turns, convs.select("conv", "head", "shift", "n"), ["conv"], "n", turns.count()).where("pos >= head")
    own = own.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "d1", "d2", "bytes")
    heads = turns.where(F.col("pos") < longest_head).withColumnRenamed("conv", "base")
    lent = heads.join(convs.select("conv", "base", "head"), "base").where("pos < head").select("conv", "pos", "d1", "d2", "bytes")
    return own.unionByName(lent), convs.select("conv", "length")


def _earlier_segments(df: DataFrame, key: str, totals: list[Column]) -> DataFrame:
    """key, seg and what ``totals`` (aggregates named s1, s2 ...) give over the segments before."""
    w = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, "seg").agg(*totals)
    fold = F.bit_xor if "s2" in sums.columns else F.sum
    return sums.select(key, "seg", *(fold(c).over(w).alias(f"e{c[1:]}") for c in sums.columns if c not in (key, "seg")))


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv, b, p1, p2 (prefix before the block), q1, q2 (after it) and its turns."""
    z = [F.xxhash64(F.lit(i), "d1", "d2", "pos").alias(f"z{i}") for i in (1, 2)]
    rows = turns.select("conv", "pos", *z, "bytes").withColumn("b", F.expr(f"pos div {BLOCK}"))
    out = rows.groupBy("conv", "b").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.array_sort(F.collect_list(F.struct("pos", "z1", "z2", "bytes"))).alias("turns"))
    out = stored(out.withColumn("seg", F.expr(f"b div {SEGMENT}")))
    here = Window.partitionBy("conv", "seg").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = _earlier_segments(out, "conv", [F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2")]).where("seg > 0")
    out = out.withColumns({f"c{i}": F.bit_xor(f"x{i}").over(here) for i in (1, 2)}).join(earlier, ["conv", "seg"], "left")
    q = {i: F.col(f"c{i}").bitwiseXOR(F.coalesce(f"e{i}", F.lit(0))) for i in (1, 2)}
    return stored(out.select("conv", "b", *(q[i].bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)), *(q[i].alias(f"q{i}") for i in (1, 2)), "turns"))


KIND, NODE = ["b", "p1", "p2", "q1", "q2"], ["depth", "r1", "r2"]


def kinds_of(blocks: DataFrame) -> DataFrame:
    """Different blocks: their key, n (conversations), least (smallest of these), turns, and
    ``siblings``, how many follow the same prefix (null where it is the only one)."""
    kinds = stored(blocks.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.first("turns").alias("turns")))
    forks = stored(kinds.groupBy("b", "p1", "p2").agg(F.count(F.lit(1)).alias("siblings")).where("siblings > 1"))
    return stored(attach(kinds, forks, ["b", "p1", "p2"], "siblings", kinds.count()))


def by_node(kinds: DataFrame, measures: list[Column]) -> DataFrame:
    """Nodes (depth, r1, r2), their parent's prefix (u1, u2), bytes and the measures."""
    upto = lambda i, k: f"aggregate(slice(turns, 1, {k}), p{i}, (a, t) -> a ^ t.z{i})"
    fields = {f"{name}{i}": upto(i, k) for name, k in (("r", "k"), ("u", "k - 1")) for i in (1, 2)}
    fields = {"depth": f"b * {BLOCK} + k", **fields, "bytes": "element_at(turns, k).bytes"}
    step = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    each = F.expr(f"inline(transform(sequence(1, size(turns)), k -> named_struct({step})))")
    values = [c for c in kinds.columns if c not in (*KIND, "turns", "siblings")]
    plain, forked = (kinds.where(cond).select(*values, each) for cond in ("siblings IS NULL", "siblings IS NOT NULL"))
    merged = forked.groupBy(*NODE).agg(F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("bytes").alias("bytes"), *measures)
    return plain.select(*merged.columns).unionByName(merged)


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, r1, r2 and SHA-256 of the node's conv ids, ascending and comma-joined.

    Ids are dealt by node and id to range parts and joined there; a node's strings, one a part,
    then pass in order through one running hash, so that no task holds a node's ids."""
    dealt = ends.repartitionByRange(*NODE, "conv").withColumn("part", F.spark_partition_id())
    runs = dealt.groupBy(*NODE, "part").agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    runs = runs.repartition(*(F.col(c) for c in NODE)).sortWithinPartitions(*NODE, "part")

    def digests(batches):
        node, running = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key == node:
                    running.update(b",")
                else:
                    if running:
                        done.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256()
                running.update(ids.encode())
            yield _table(done)
        if running:
            yield _table([(*node, running.hexdigest())])

    return runs.mapInArrow(digests, "depth long, r1 long, r2 long, ends_sha256 string")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*NODE, "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the conversations ``convs`` (conv, length) with turns ``turns``."""
    turns = stored(turns)
    blocks = blocks_of(turns)
    kinds = kinds_of(blocks)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")).where("n > 0").select(zero.alias("depth"), zero.alias("r1"), zero.alias("r2"), none.alias("u1"), none.alias("u2"), zero.alias("bytes"), "n", "least")
    nodes = stored(by_node(kinds, [F.sum("n").alias("n"), F.min("least").alias("least")]).unionByName(top))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("r1"), F.col("u2").alias("r2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"]).withColumn("w", (F.col("n") - 1) * F.col("bytes"))
    nodes = stored(nodes.withColumn("seg", F.expr(f"depth div {SEGMENT}")))

    # chains: a node's conversation is its smallest member
    chains = nodes.groupBy(F.col("least").alias("conv")).agg(F.sum("w").alias("chain_w"), F.count_if(F.col("n_children") == 0).alias("chain_leaf"))
    scalars = convs.join(chains, "conv").select("conv", "chain_w", "chain_leaf", F.expr(f"(length + {BLOCK - 1}) div {BLOCK}").alias("n_blocks"))
    per_block = attach(blocks.select("conv", *KIND), stored(scalars), ["conv"], "n_blocks", blocks.count())
    sums = [F.sum("chain_w").alias("chain_w"), F.sum("chain_leaf").alias("chain_leaf")]
    per_kind = kinds.drop("n", "least").join(per_block.groupBy(*KIND).agg(*sums), KIND)
    whole = chains.agg(*sums).select(zero.alias("depth"), zero.alias("r1"), zero.alias("r2"), "chain_w", "chain_leaf")
    below = by_node(per_kind, sums).select(*NODE, "chain_w", "chain_leaf").unionByName(whole)

    above = Window.partitionBy("least", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = _earlier_segments(nodes, "least", [F.sum("w").alias("s1")]).where("seg > 0")
    nodes = nodes.withColumn("above", F.coalesce(F.sum("w").over(above), zero)).join(earlier, ["least", "seg"], "left")
    nodes = nodes.join(below, NODE).withColumn("saved_tokens", F.coalesce("chain_w", zero) - F.col("above") - F.coalesce("e1", zero))

    ends = turns.groupBy("conv").agg(*(F.bit_xor(F.xxhash64(F.lit(i), "d1", "d2", "pos")).alias(f"r{i}") for i in (1, 2)))
    ends = convs.join(ends, "conv", "left").select(F.col("length").cast("long").alias("depth"), *(F.coalesce(f"r{i}", zero).alias(f"r{i}") for i in (1, 2)), "conv")
    nodes = stored(nodes.join(ends_digest(ends), NODE, "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]))
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("r1").alias("u1"), F.col("r2").alias("u2"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("fan"))
    out = attach(nodes, stored(parents), ["depth", "u1", "u2"], "fan", nodes.count())
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("chain_leaf").alias("n_leaves"), "saved_tokens", "ends_sha256")


def rebuilt_trie(df: DataFrame) -> DataFrame:
    """The trie of ``conversations``, each rebuilt on the head of another: conversation c begins
    with the first crc32(c) % 9 turns of conversation c - c % 5."""
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("long")
    turns, convs = rebuilt(stored(turns_of(df)), F.col("conv") - F.col("conv") % 5, head, 8)
    return trie(turns, convs)
