"""Exact nearest neighbours with a per-day cap, without forming all pairs as rows.

Library vectors are assigned to the nearest of a fixed number of pivots (cells). A query first
searches its own cell; the k-th diverse distance found there bounds the answer, and the triangle
inequality then rules out every cell whose ball lies farther away. Cells are cut into blocks of
bounded size and queries into batches of bounded size; a task compares one block with one batch by a
matrix product, measures only the pairs within the query's limit and emits about ``k`` rows per query. A hot
cell only means more blocks; small groups share a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.operators.sizing import join_keys
from tidegrid.session import cut

PIVOTS = 64          # most cells a library is cut into
CELL_ROWS = 2048     # library rows per cell aimed at; fewer cells for a small library
BLOCK_ROWS = 16384
BATCH_ROWS = 32768
SMALL_ROWS = 4096    # groups up to this size share a task
BIN_ROWS = 65536     # rows of such a task aimed at
DIRECT = 512         # library rows compared without a matrix product
CELLS = 1 << 21      # numbers held at once inside a task
ROUNDING = 1e-10     # relative, far above the rounding of a product of vectors


def _rms(matrix, row):
    import numpy as np
    return np.sqrt(np.mean(np.square(matrix - row), axis=1))


def pick_pivots(library: DataFrame, item: str, vector: str, count: int = PIVOTS) -> list[list[float]]:
    """A fixed number of vectors in hash order: a bounded top-k, the only thing the driver sees."""
    rows = library.select(vector).orderBy(F.xxhash64(F.col(item).cast("string")), item).limit(count).collect()
    return [[float(x) for x in r[0]] for r in rows]


def pivot_distances(df: DataFrame, vector: str, pivots: Sequence[Sequence[float]]) -> DataFrame:
    """RMS distance of every row to every pivot, vectorised per Arrow batch."""
    table = [list(p) for p in pivots]

    @F.pandas_udf("array<double>")
    def measure(column):
        import numpy as np
        import pandas as pd
        base = np.asarray(table, dtype=float)
        rows = np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.empty((0, base.shape[1]))
        out = np.stack([_rms(rows, p) for p in base], axis=1) if len(rows) else np.empty((0, len(base)))
        return pd.Series(list(out))

    measure = measure.asNondeterministic()
    return df.withColumn("_pd", measure(F.col(vector).cast("array<double>")))


def _matrix(column):
    import pyarrow as pa
    flat = column.combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _distances(matrix, asked, cols, rows):
    """Distance of each named pair, from differences, a slice of pairs at a time."""
    import numpy as np
    step = max(1, CELLS // max(1, matrix.shape[1]))
    parts = [np.sqrt(np.mean(np.square(matrix[cols[i:i + step]] - asked[rows[i:i + step]]), axis=1)) for i in range(0, len(cols), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _pick(dist, ids, days, own, k: int, per_day: int) -> list[int]:
    """Places of the ``k`` nearest, at most ``per_day`` of a day; ``ids`` ascend, so ties go to the smaller one."""
    import numpy as np
    used, taken = {}, []
    for i in np.argsort(dist, kind="stable"):
        if (own is not None and ids[i] == own) or used.get(days[i], 0) >= per_day:
            continue
        used[days[i]] = used.get(days[i], 0) + 1
        taken.append(i)
        if len(taken) == k:
            break
    return taken


def _search_block(matrix, ids, days, asked, names, limit, k: int, per_day: int):
    """Pairs (query, item, distance) of a block that hold each query's ``k`` nearest diverse items up to its limit.

    Few items are compared one by one. Among many, a query without a limit gets one from an evenly spread part of
    the block; one matrix product then leaves the pairs whose squared distance, less its rounding error, is within the
    limit, and only these are measured. ``names`` is None where a query may find itself.
    """
    import numpy as np
    n, d = matrix.shape
    everything = np.arange(n)
    own = lambda q: None if names is None else names[q]
    center = matrix.mean(axis=0) if n else 0.0
    near, far = matrix - center, asked - center
    with np.errstate(over="ignore", invalid="ignore"):
        square, weight = np.einsum("ij,ij->i", far, far), np.einsum("ij,ij->i", near, near)
    few = n <= DIRECT or not (np.isfinite(square).all() and np.isfinite(weight).all())
    near = None if few else np.column_stack([near, -weight * (1 - ROUNDING) / 2])
    found = []
    step = max(1, CELLS // max(1, n))
    for start in range(0, len(asked), step):
        part = np.arange(start, min(start + step, len(asked)))
        if few:
            dist = _distances(matrix, asked, np.tile(everything, len(part)), np.repeat(part, n)).reshape(len(part), n)
            for q, row in zip(part, dist):
                taken = _pick(row, ids, days, own(q), k, per_day)
                found.append((np.full(len(taken), q), np.asarray(taken, dtype=int), row[taken]))
            continue
        bound = limit[part]
        spread = everything[:: max(1, n // DIRECT)]
        for i in np.flatnonzero(np.isinf(bound)):
            row = _distances(matrix, asked, spread, np.full(len(spread), part[i]))
            taken = _pick(row, ids[spread], days[spread], own(part[i]), k, per_day)
            if len(taken) == k:
                bound[i] = row[taken[-1]]
        product = np.column_stack([far[part], np.ones(len(part))]) @ near.T
        least = (square[part] * (1 - ROUNDING) - d * bound * bound * (1 + 1e-9) - 1e-300) / 2
        rows, cols = np.nonzero(product >= least[:, None])
        dist = _distances(matrix, asked, cols, part[rows])
        kept = dist <= bound[rows] * (1 + 1e-12)
        if names is not None:
            kept &= ids[cols] != names[part[rows]]
        rows, cols, dist = rows[kept], cols[kept], dist[kept]
        ends = np.searchsorted(rows, np.arange(len(part) + 1))
        crowded = np.diff(ends) > 2 * k
        few_rows = ~crowded[rows]   # left to the selection over all blocks
        found.append((part[rows[few_rows]], cols[few_rows], dist[few_rows]))
        for i in np.flatnonzero(crowded):
            own_rows = slice(ends[i], ends[i + 1])
            taken = _pick(dist[own_rows], ids[cols[own_rows]], days[cols[own_rows]], None, k, per_day)
            found.append((np.full(len(taken), part[i]), cols[own_rows][taken], dist[own_rows][taken]))
    return found


def _compare(keys: Sequence[str], k: int, per_day: int, skip_self: bool):
    """Each group (cell, block, batch) of a bin in turn; a bin holds one large group or many small ones."""
    places = ("_id", "block", "batch")

    def groups(table):
        import numpy as np
        codes = [table[c].to_numpy() for c in places]
        order = np.lexsort(codes[::-1])
        changed = np.zeros(len(order), dtype=bool)
        changed[:1] = True
        for c in codes:
            changed[1:] |= c[order][1:] != c[order][:-1]
        starts = np.flatnonzero(changed)
        return {tuple(int(c[order[i]]) for c in codes): order[i:j] for i, j in zip(starts, [*starts[1:], len(order)])}

    def run(left, right):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        right = right.rename_columns([c.removeprefix("_right_") for c in right.column_names]).sort_by("item_id")
        found = [(np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0))]
        if len(left) and len(right):
            asked, matrix = _matrix(left["vector"]), _matrix(right["vector"])
            names, ids = left["query_id"].to_pandas().to_numpy(), right["item_id"].to_pandas().to_numpy()
            days = pd.factorize(right["day"].to_pandas(), use_na_sentinel=False)[0]
            limit = left["_limit"].to_pandas().fillna(float("inf")).to_numpy(dtype=float)
            library = groups(right)
            for place, mine in groups(left).items():
                theirs = library.get(place)
                if theirs is None:
                    continue
                theirs = np.sort(theirs)   # by item
                for q, i, dist in _search_block(matrix[theirs], ids[theirs], days[theirs], asked[mine], names[mine] if skip_self else None,
                                                limit[mine], k, per_day):
                    found.append((mine[q], theirs[i], dist))
        q, i, dist = (np.concatenate([f[c] for f in found]) for c in range(3))
        head, tail = left.select(["query_id", *keys]).take(pa.array(q)), right.select(["item_id", "day"]).take(pa.array(i))
        return pa.table([head["query_id"], tail["item_id"], tail["day"], pa.array(dist, pa.float64()), *[head[c] for c in keys]],
                        names=["query_id", "item_id", "day", "distance", *keys])
    return run


def _diverse(candidates: DataFrame, keys: Sequence[str], k: int, per_day: int) -> DataFrame:
    """Cap per day, then keep the nearest k; ties go to the smaller item id."""
    order = ["distance", "item_id"]
    day = Window.partitionBy(*keys, "query_id", "day").orderBy(*order)
    top = Window.partitionBy(*keys, "query_id").orderBy(*order)
    capped = candidates.withColumn("_d", F.row_number().over(day)).filter(F.col("_d") <= per_day).drop("_d")
    return capped.withColumn("neighbor_rank", F.row_number().over(top)).filter(F.col("neighbor_rank") <= k)


def diverse_top_k(distances: DataFrame, query: Sequence[str], item: str, day: str, distance: str, k: int,
                  per_day: int) -> DataFrame:
    """The same selection on a ready distance table."""
    table = distances.withColumnsRenamed({item: "item_id", day: "day", distance: "distance"})
    renamed = table.withColumn("query_id", F.lit(0))
    return _diverse(renamed, query, k, per_day).drop("query_id").withColumnsRenamed(
        {"item_id": item, "day": day, "distance": distance})


def nearest_neighbors(queries: DataFrame, library: DataFrame, keys: Sequence[str], *, query: str, item: str,
                      vector: str, day: str, k: int, per_day: int, skip_self: bool = False, pivots: int | None = None,
                      block_rows: int = BLOCK_ROWS, batch_rows: int | None = None) -> DataFrame:
    """``keys, query_id, item_id, day, distance, neighbor_rank`` of the k nearest, at most ``per_day`` of a day.

    An empty library has no neighbours to give: no rows.
    """
    keys = list(keys)
    lib = library.select(*keys, F.col(item).alias("item_id"), F.col(day).alias("day"), F.col(vector).alias("vector"))
    # Cells serve the largest library; keys with few rows are searched whole.
    if pivots is None:
        most = lib.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        pivots = max(1, min(PIVOTS, most // CELL_ROWS))
    table = pick_pivots(lib, "item_id", "vector", pivots)
    if not table:
        none = lambda c: F.lit(None).cast(lib.schema[c].dataType).alias(c)
        found = queries.limit(0).select(*keys, F.col(query).alias("query_id"), none("item_id"), none("day"))
        return found.withColumns({"distance": F.lit(0.0), "neighbor_rank": F.lit(0)})
    home = F.array_position("_pd", F.array_min("_pd")).cast("int") - 1
    lib = pivot_distances(lib, "vector", table).withColumn("cell", home).withColumn("_near", F.array_min("_pd"))
    lib = cut(lib.drop("_pd"))
    cells = lib.groupBy(*keys, "cell").agg(F.max("_near").alias("radius"), F.count(F.lit(1)).alias("_n"))
    # At most ``pivots`` rows per key, of known size once written.
    cells = cells.withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
    cells = cut(cells.withColumn("_id", F.monotonically_increasing_id()))
    blocks = (join_keys(lib, cells.select(*keys, "cell", "_blocks", "_id"), [*keys, "cell"])
              .withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.col("_blocks")).cast("int"))
              .select("_id", "block", "item_id", "day", "vector"))

    qs = queries.select(*keys, F.col(query).alias("query_id"), F.col(vector).alias("vector"))
    qs = cut(pivot_distances(qs, "vector", table))
    spark = qs.sparkSession
    asked, held = qs.count(), lib.count()
    # Small query sets still give every core a batch; large ones are bounded by BATCH_ROWS.
    batch_rows = batch_rows or max(64, min(BATCH_ROWS, asked // (2 * spark.sparkContext.defaultParallelism)))
    schema = ", ".join([f"query_id {qs.schema['query_id'].dataType.simpleString()}",
                        f"item_id {lib.schema['item_id'].dataType.simpleString()}",
                        f"day {lib.schema['day'].dataType.simpleString()}", "distance double",
                        *[f"{key} {qs.schema[key].dataType.simpleString()}" for key in keys]])

    def search(routed: DataFrame, copies: int) -> DataFrame:
        """``routed``: (keys, query_id, vector, cell, _limit), up to ``copies`` rows a query. Block x batch tasks of bounded size."""
        load = routed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("_asked"))
        place = join_keys(load, cells.select(*keys, "cell", "_blocks", "_id", "_n"), [*keys, "cell"])
        place = cut(place.withColumn("_batches", F.ceil(F.col("_asked") / batch_rows).cast("int")))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        bins = -(-(held + copies * asked) // BIN_ROWS) + int(spark.conf.get("spark.sql.shuffle.partitions"))
        shared = F.pmod(F.xxhash64("_id"), F.lit(bins))
        bin_of = F.when(F.col("_n") + F.col("_asked") <= SMALL_ROWS, shared).otherwise(F.xxhash64("_id", "block", "batch"))
        left = (join_keys(routed, place, [*keys, "cell"])
                .withColumn("batch", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.col("_batches")).cast("int"))
                .select(*keys, "query_id", "vector", "_limit", "_id", "_n", "_asked", "batch", upto("_blocks").alias("block"))
                .withColumn("_bin", bin_of).drop("_n", "_asked"))
        right = (blocks.join(place.select("_id", "_batches", "_n", "_asked"), "_id")
                 .select("item_id", "day", "vector", "_id", "block", "_n", "_asked", upto("_batches").alias("batch"))
                 .withColumn("_bin", bin_of).drop("_n", "_asked"))
        right = right.withColumnsRenamed({c: f"_right_{c}" for c in ("_id", "block", "batch", "_bin")})
        # Few bytes, much arithmetic: a fixed partition count keeps AQE from merging these tasks.
        tasks = min(bins, 4000)
        left, right = left.repartition(tasks, "_bin"), right.repartition(tasks, "_right__bin")
        return left.groupBy("_bin").cogroup(right.groupBy("_right__bin")).applyInArrow(
            _compare(keys, k, per_day, skip_self), schema=schema)

    # Pass one: the nearest non-empty cell of the query's own key.
    # Each query meets the few cell summaries of its key, never the vectors themselves.
    near = cells.select(*keys, "cell", "radius")
    if keys:
        meet = lambda df: join_keys(df, near, keys)
    else:   # at most ``pivots`` rows: literals
        known = F.array(*[F.struct(F.lit(c.cell).alias("cell"), F.lit(c.radius).alias("radius")) for c in near.collect()])
        meet = lambda df: df.select("*", F.inline(known))
    to = F.element_at("_pd", F.col("cell") + 1)
    ranked = meet(qs.drop("vector")).withColumn("_to", to)
    own = cut(ranked.groupBy(*keys, "query_id").agg(F.min_by("cell", F.struct("_to", "cell")).alias("cell")))
    first = cut(search(join_keys(qs.drop("_pd"), own, [*keys, "query_id"]).withColumn("_limit", F.lit(None).cast("double")), 1))
    if len(table) == 1:
        return _diverse(first, keys, k, per_day)
    best = _diverse(first, keys, k, per_day)
    limit = (best.groupBy(*keys, "query_id").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_k"))
             .select(*keys, "query_id", F.when(F.col("_k") == k, F.col("_far")).alias("_limit")))
    # Pass two: every other cell whose ball can still hold a closer vector; queries learn their limit before they are copied.
    reach = join_keys(qs, own.withColumnRenamed("cell", "_own"), [*keys, "query_id"])
    reach = meet(join_keys(reach, limit, [*keys, "query_id"], "left"))
    slack = F.col("_limit") * (1 + 1e-9) + 1e-12
    other = reach.filter((F.col("cell") != F.col("_own")) & (F.col("_limit").isNull() | (to - F.col("radius") <= slack)))
    second = search(other.select(*keys, "query_id", "vector", "cell", "_limit"), len(table))
    return _diverse(first.unionByName(second), keys, k, per_day)


def blend_neighbors(neighbors: DataFrame, trajectories: DataFrame, keys: Sequence[str], epsilon: float) -> DataFrame:
    """Inverse-distance weighted future of the neighbours, per query and horizon.

    ``trajectories``: keys, item_id, horizon_minutes, value.
    """
    keys = list(keys)
    w = F.lit(1.0) / F.greatest("distance", F.lit(epsilon))
    joined = join_keys(neighbors.withColumn("_w", w), trajectories, [*keys, "item_id"])
    return joined.groupBy(*keys, "query_id", "horizon_minutes").agg(
        (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("prediction"))


def neighbor_diagnostics(neighbors: DataFrame, keys: Sequence[str], epsilon: float) -> DataFrame:
    w = F.lit(1.0) / F.greatest("distance", F.lit(epsilon))
    return neighbors.withColumn("_w", w).groupBy(*keys, "query_id").agg(
        F.min("distance").alias("nearest_distance"), F.avg("distance").alias("mean_neighbor_distance"),
        F.max("distance").alias("maximum_neighbor_distance"),
        (F.sum("_w") * F.sum("_w") / F.sum(F.col("_w") * F.col("_w"))).alias("effective_neighbor_count"),
        F.count_distinct("day").alias("unique_source_days"))
