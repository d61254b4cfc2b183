"""Prefix trie of conversations with subtree totals by parallel tree contraction.

Conversations that begin alike share the nodes of their common beginning. ``rebuild`` gives every conversation
the beginning of its block's first one, ``trie`` names every distinct beginning by its smallest member, and
``contract`` adds up whole subtrees in rounds of joins:

* rake: a node without children hands its sums to its parent and is finished;
* compress: a node with a single child is taken out of its chain, its parent becomes its child's, and it
  remembers that child. Of a node, its parent and its child at most one goes in a round: the one whose depth has
  the lowest lowest bit (ties by hash), which halves a chain of consecutive depths in every round;
* re-expansion: a node that was taken out has its own sums, those of nodes taken out before it on the way to its
  child, and all of its child's. Children that were taken out
  later are followed by doubling, so recovering every total costs the logarithm of the number of rounds.

The number of rounds grows with the logarithm of the number of nodes, for a chain as for a bush. Each round is a
written table. No conversation is ever gathered: rows are sorted by range, a conversation that spans several
ranges is numbered and its hashes are added up range by range. A beginning is known by four sums of 32-bit parts
of MD5 over (depth, role, text), so two different ones are confused once in 2**128. Children are counted and
added up before the shuffle, so a root or a first turn with very many children is no hot task. The members that
end at a node are packed into strings by ranges first; a hash over one node's members is sequential, and its
last step streams those strings in bounded memory.

Null role or text count as empty. Rows with a null conv_id take no part. Turns are ordered by turn, null
first, ties by the MD5 of role and text; repeated rows are turns of their own. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegrid.llm.common import table
from tidegrid.session import cut

BLOCK, HEADS = 100, 6
PARTS = ["s1", "s2", "s3", "s4"]
BLOB = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()


def _head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("bigint")


def rebuild(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per rebuilt turn (conv_id, part, depth, said, chars, last) and one per conversation (conv_id, size).

    ``part`` numbers the ranges of rows in the order of depth within a conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = talks.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.md5(F.concat_ws(":", F.length(role), role, text).cast("binary")).alias("said"), F.length(text).cast("bigint").alias("chars"))
    rows = cut(said.repartitionByRange("conv_id", "turn", "said").withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    counts = cut(counts.withColumn("before", before))
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.withColumn("b", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", _head(F.col("conv_id")))
    firsts = sizes.where(f"conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("b"), F.col("n").alias("there"))
    convs = convs.join(firsts, "b", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(convs.select("conv_id", "b", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "said"))
    placed = rows.withColumn("within", within).join(counts.select("conv_id", "part", "before").join(convs, "conv_id"), ["conv_id", "part"])
    placed = placed.withColumn("at", F.col("within") + F.col("before"))
    placed = cut(placed.where(f"at > h OR conv_id % {BLOCK} = 0 AND at < {HEADS}").select("conv_id", "part", "at", "h", "k", "size", "said", "chars"))
    own = placed.where("at > h").withColumn("depth", F.col("at") - F.col("h") + F.col("k"))
    heads = placed.where(f"conv_id % {BLOCK} = 0 AND at < {HEADS}").select(F.col("conv_id").alias("b"), F.col("at").alias("depth"), "said", "chars")
    heads = convs.where("k > 0").select("conv_id", "b", "k", "size").join(heads, "b").where("depth <= k").withColumn("part", F.lit(-1))
    turns = own.unionByName(heads, allowMissingColumns=True)
    return turns.select("conv_id", "part", "depth", "said", "chars", (F.col("depth") == F.col("size")).alias("last")), convs.select("conv_id", "size")


def beginnings(turns: DataFrame) -> DataFrame:
    """``turns`` with the sums that name the beginning up to each turn (s1 to s4) and the one before it (q1 to q4)."""
    digest = F.md5(F.concat_ws(":", "depth", "said").cast("binary"))
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"m{i + 1}") for i in range(4)]
    rows = cut(turns.select("conv_id", "part", "depth", "chars", "last", *parts))
    whole = rows.groupBy("conv_id", "part").agg(*(F.sum(f"m{i}").alias(f"t{i}") for i in range(1, 5)))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    whole = whole.select("conv_id", "part", *((F.sum(f"t{i}").over(earlier) - F.col(f"t{i}")).alias(f"t{i}") for i in range(1, 5)))
    along = Window.partitionBy("conv_id", "part").orderBy("depth")
    sums = rows.select("*", *(F.sum(f"m{i}").over(along).alias(f"r{i}") for i in range(1, 5))).join(whole, ["conv_id", "part"])
    return cut(sums.select("conv_id", "depth", "chars", "last", *((F.col(f"r{i}") + F.col(f"t{i}")).alias(f"s{i}") for i in range(1, 5)),
                           *((F.col(f"r{i}") + F.col(f"t{i}") - F.col(f"m{i}")).alias(f"q{i}") for i in range(1, 5))))


def trie(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (c, d, pc, n_convs, chars) named by smallest member and depth, and (c, d, conv_id) of the conversations that end at each."""
    turns, convs = rebuild(talks)
    rows = beginnings(turns)
    top = convs.agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0")
    key = ["depth", *PARTS]
    named = cut(rows.groupBy(*key).agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.max(f"q{i}").alias(f"q{i}") for i in range(1, 5))))
    above = named.select(F.col("c").alias("pc"), (F.col("depth") + 1).alias("depth"), *(F.col(f"s{i}").alias(f"q{i}") for i in range(1, 5)))
    first = top.first()
    smallest = first["c"] if first else None
    root = top.select("c", F.lit(0).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("pc"), "n_convs", F.lit(0).cast("bigint").alias("chars"))
    deep = named.where("depth > 1").join(above, ["depth", *(f"q{i}" for i in range(1, 5))])
    columns = ["c", F.col("depth").alias("d"), "pc", "n_convs", "chars"]
    nodes = root.unionByName(named.where("depth = 1").withColumn("pc", F.lit(smallest).cast("bigint")).select(*columns)).unionByName(deep.select(*columns))
    ends = rows.where("last").select("conv_id", *key).join(named.select("c", *key), key).select("c", F.col("depth").alias("d"), "conv_id")
    ends = ends.unionByName(convs.where("size = 0").select(F.lit(smallest).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("d"), "conv_id"))
    return cut(nodes), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """(c, d, ends_sha256): the hash of the sorted, comma-joined conv_ids that end at a node."""
    def pack(batches):
        now, first, held, size = None, None, [], 0
        for batch in batches:
            for c, d, conv in zip(*(batch[x].to_pylist() for x in ("c", "d", "conv_id"))):
                if held and ((c, d) != now or size >= BLOB):
                    yield now, first, held
                    held, size = [], 0
                if not held:
                    now, first = (c, d), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield now, first, held

    def packed(batches):
        rows = []
        for (c, d), first, held in pack(batches):
            rows.append((c, d, first, ",".join(held).encode()))
            if len(rows) == 4096 or len(rows[-1][3]) >= BLOB // 2:
                yield _batch(rows, ["c", "d", "first", "ids"])
                rows = []
        if rows:
            yield _batch(rows, ["c", "d", "first", "ids"])

    def digest(batches):
        now, state, rows = None, None, []
        for batch in batches:
            for c, d, ids in zip(*(batch[x].to_pylist() for x in ("c", "d", "ids"))):
                if (c, d) == now:
                    state.update(b"," + ids)
                    continue
                if now:
                    rows.append((*now, state.hexdigest()))
                now, state = (c, d), hashlib.sha256(ids)
            if len(rows) >= 4096:
                yield _batch(rows, ["c", "d", "ends_sha256"])
                rows = []
        if now:
            yield _batch([*rows, (*now, state.hexdigest())], ["c", "d", "ends_sha256"])

    spread = ends.repartitionByRange("c", "d", "conv_id").sortWithinPartitions("c", "d", "conv_id").mapInArrow(packed, "c bigint, d bigint, first bigint, ids binary")
    return spread.repartition("c", "d").sortWithinPartitions("c", "d", "first").mapInArrow(digest, "c bigint, d bigint, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"ids": pa.binary(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(column, types.get(name, pa.int64())) for name, column in zip(names, zip(*rows))], names)


def _lower(x: str, y: str) -> Column:
    """Whether depth ``x`` goes before depth ``y``; the root (0) goes last."""
    low = [F.when(F.col(c) == 0, F.lit((1 << 63) - 1)).otherwise(F.col(c).bitwiseAND(-F.col(c))) for c in (x, y)]
    tie = [F.xxhash64(F.col(c)) for c in (x, y)]
    return (low[0] < low[1]) | (low[0] == low[1]) & (tie[0] < tie[1])


def contract(nodes: DataFrame) -> DataFrame:
    """(c, d, n_children, n_leaves, total): the leaves and the sum of ``w`` of every node's subtree, from ``nodes(c, d, pc, w)``.

    A node is known by (c, d); its parent is (pc, d - 1), null for a root. ``ew`` and ``el`` are the sums of nodes
    taken out between a node and its present parent: they are handed on with the node's own.
    """
    none = F.lit(0).cast("bigint")
    live = cut(nodes.select("c", "d", "pc", F.when(F.col("pc").isNotNull(), F.col("d") - 1).alias("pd"), "w", none.alias("l"), none.alias("ew"), none.alias("el"), F.lit(False).alias("leaf")))
    children, finished, taken = None, [], []
    while not live.isEmpty():
        leaf = F.col("leaf")
        below = live.where("pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            F.count_if(~leaf).alias("kids"), F.sum(F.when(leaf, F.col("w") + F.col("ew"))).alias("more_w"), F.sum(F.when(leaf, F.col("l") + F.col("el"))).alias("more_l"),
            F.max(F.when(~leaf, F.struct(F.col("c").alias("uc"), F.col("d").alias("ud"), F.col("ew").alias("uw"), F.col("el").alias("ul")))).alias("child"))
        kids = F.coalesce("kids", F.lit(0))
        # A node whose children are all raked, or that never had any, is a leaf from now on.
        step = live.where(~leaf).join(below, ["c", "d"], "left").select(
            "c", "d", "pc", "pd", (F.col("w") + F.coalesce("more_w", F.lit(0))).alias("w"), (F.coalesce("more_l", F.lit(0)) + F.col("l")).alias("l"), "ew", "el", kids.alias("kids"), "child.*")
        if children is None:
            step = step.withColumn("l", F.when(F.col("kids") == 0, 1).otherwise(F.col("l")))
        out = (F.col("kids") == 1) & F.col("pc").isNotNull() & _lower("d", "pd") & _lower("d", "ud")
        step = cut(step.withColumn("out", F.coalesce(out, F.lit(False))))
        if children is None:
            children = step.select("c", "d", F.col("kids").alias("n_children"))
        finished.append(live.where("leaf").select("c", "d", "w", "l"))
        gone = step.where("out")
        taken.append(gone.select("c", "d", (F.col("w") + F.col("uw")).alias("w"), (F.col("l") + F.col("ul")).alias("l"), "uc", "ud"))
        moved = gone.select(F.col("uc").alias("c"), F.col("ud").alias("d"), F.col("pc").alias("qc"), F.col("pd").alias("qd"), (F.col("w") + F.col("ew")).alias("qw"), (F.col("l") + F.col("el")).alias("ql"))
        stay = step.where("NOT out").join(moved, ["c", "d"], "left")
        live = cut(stay.select("c", "d", F.coalesce("qc", "pc").alias("pc"), F.coalesce("qd", "pd").alias("pd"), "w", "l",
                               (F.col("ew") + F.coalesce("qw", none)).alias("ew"), (F.col("el") + F.coalesce("ql", none)).alias("el"), (F.col("kids") == 0).alias("leaf")))
    if children is None:
        return nodes.select("c", "d", F.lit(0).cast("bigint").alias("n_children"), F.lit(0).cast("bigint").alias("n_leaves"), F.col("w").alias("total"))
    return expand(_union(finished), _union(taken), len(taken)).join(children, ["c", "d"]).select("c", "d", "n_children", F.col("l").alias("n_leaves"), F.col("w").alias("total"))


def expand(finished: DataFrame, taken: DataFrame, rounds: int) -> DataFrame:
    """Totals (c, d, w, l) of all nodes: ``taken`` ones add those of the child (uc, ud) they remember.

    A child that was taken out went in a later round, so no chain of children is longer than ``rounds``.
    """
    known = finished.select("c", "d", "w", "l", F.lit(None).cast("bigint").alias("uc"), F.lit(None).cast("bigint").alias("ud"))
    known = cut(known.unionByName(taken))
    for _ in range(rounds.bit_length()):
        child = known.select(F.col("c").alias("uc"), F.col("d").alias("ud"), F.col("w").alias("cw"), F.col("l").alias("cl"), F.col("uc").alias("nc"), F.col("ud").alias("nd"))
        done = known.where("uc IS NULL")
        known = cut(known.where("uc IS NOT NULL").join(child, ["uc", "ud"]).select("c", "d", (F.col("w") + F.col("cw")).alias("w"), (F.col("l") + F.col("cl")).alias("l"), F.col("nc").alias("uc"), F.col("nd").alias("ud")).unionByName(done))
    return known.select("c", "d", "w", "l")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prefix_trie(talks: DataFrame) -> DataFrame:
    """One row per node with its members, children and subtree totals."""
    nodes, ends = trie(talks)
    totals = contract(nodes.withColumn("w", (F.col("n_convs") - 1) * F.col("chars")))
    out = nodes.join(totals, ["c", "d"]).join(ends_digest(ends), ["c", "d"], "left")
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("total").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
