"""Exact k nearest neighbours in feature space, as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.operators.ranking import top_per
from landspan.session import cut

#: Rows of queries and cells per task of the join, and the most tasks.
TASK_ROWS, MOST_TASKS = 200_000, 8_192
#: A key whose pairs are at most so many times its rows is answered by all of them.
FEW = 96
#: Pairs of a task, and of a key that is not cut into parts.
TASK_PAIRS, KEY_PAIRS = 2_000_000, 20_000_000


def nearest_k(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    dims: Sequence[str],
    k: int,
    qid: str,
    pid: str,
    window: float,
    ok: Column | None = None,
    gap: Column | None = None,
    same: Sequence[str] | None = None,
    small: bool = False,
) -> DataFrame:
    """The k nearest points of each query within its key; ties go to the lowest ``pid``.

    ``dims`` are scaled features; a point counts only if it is within ``window`` in
    every dimension and passes ``ok`` (written with the aliases ``q`` and ``p``).
    ``gap`` replaces the Euclidean distance of the dims by an equal expression.
    Points with equal ``same`` columns are interchangeable, so only the k lowest ids
    of them are kept from the start.

    With ``small`` keys with few points or few queries compare all of them
    (``nearest_of_all``).  For the others a pyramid holds the number of points per cell on every level, cells halving from the
    window down.  Each query starts on the finest level on which its own small cell holds
    k points: these lie within one cell size of that level, so no farther point and no
    cell but the neighbouring ones can matter, however dense or thin the place is.  One
    round answers all queries but those whose near points fail ``ok``; they go on at half
    the level.  Level 0's cells are as wide as the window, so every query ends with its
    full answer.
    """
    if same:
        points = top_per(points, [*keys, *same], [F.asc(pid)], k)
    if not small:
        sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        if not most:
            return queries.join(points.select(*keys, F.col(pid)), list(keys)).select(qid, pid, F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return _by_pyramid(queries, points, keys, dims, k, qid, pid, window, ok, gap, sizes, most)
    sizes = cut(_sizes(queries, points, keys))
    few = (F.col("_n") * F.col("_m") <= FEW * (F.col("_n") + F.col("_m"))) & ((F.col("_n") <= 2 * FEW) | (F.col("_n") * F.col("_m") <= KEY_PAIRS))
    most = sizes.where(~few).agg(F.max("_n")).first()[0]
    if not most:
        return nearest_of_all(queries, points, keys, dims, k, qid, pid, window, ok, gap, sizes)
    all_of, sizes = sizes.where(few), sizes.where(~few)
    near = None
    if not all_of.isEmpty():
        own, theirs = (side.join(all_of.select(*keys), list(keys), "left_semi") for side in (queries, points))
        near = nearest_of_all(own, theirs, keys, dims, k, qid, pid, window, ok, gap, all_of)
        points = points.join(sizes.select(*keys), list(keys), "left_semi")
    found = _by_pyramid(queries, points, keys, dims, k, qid, pid, window, ok, gap, sizes, most)
    # an id that is asked for in keys of both kinds
    return found if near is None else top_per(near.unionByName(found).drop("rank"), [qid], [F.asc("distance"), F.asc(pid)], k, "rank")


def _sizes(queries: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points ``_n`` and queries ``_m`` of the keys that have both."""
    n, m = (side.groupBy(*keys).agg(F.count("*").alias(name)) for side, name in ((points, "_n"), (queries, "_m")))
    return n.join(m, list(keys))


def few_pairs(queries: DataFrame, points: DataFrame, keys: Sequence[str]) -> bool:
    """Whether all pairs within the keys are few for the rows that there are."""
    n, m = (side.groupBy(*keys).agg(F.count("*").alias(name)) for side, name in ((points, "_n"), (queries, "_m")))
    both = n.join(m, list(keys), "full")
    pairs, rows = both.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.sum(F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0)))).first()
    return (pairs or 0.0) <= FEW * (rows or 0)


def nearest_of_all(
    queries: DataFrame, points: DataFrame, keys: Sequence[str], dims: Sequence[str], k: int, qid: str, pid: str,
    window: float, ok: Column | None = None, gap: Column | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """``nearest_k`` by all pairs of a key; rows travel once, whatever their number of neighbours.

    A query id may stand in several keys.  Of a key with very many pairs the side with more rows
    is cut into parts that meet all rows of the other.
    """
    sizes = _sizes(queries, points, keys) if sizes is None else sizes
    pairs = F.col("_n").cast("double") * F.col("_m")
    parts = F.ceil(pairs / KEY_PAIRS).cast("int")
    total, split = sizes.agg(F.sum(pairs), F.max(parts)).first()
    on_keys = list(keys)
    if (split or 1) > 1:
        cuts = sizes.select(*keys, parts.alias("_parts"), (F.col("_m") >= F.col("_n")).alias("_cut"))
        every = F.sequence(F.lit(0), F.col("_parts") - 1)
        one = lambda n: F.array(F.pmod(F.xxhash64(n), F.col("_parts")).cast("int"))
        queries = queries.join(cuts, list(keys)).withColumn("_part", F.explode(F.when(F.col("_cut"), one(qid)).otherwise(every)))
        points = points.join(cuts, list(keys)).withColumn("_part", F.explode(F.when(F.col("_cut"), every).otherwise(one(pid))))
        on_keys.append("_part")
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil((total or 0) / TASK_PAIRS)))
    q, p = (side.repartition(tasks, *on_keys).alias(n) for side, n in ((queries, "q"), (points, "p")))
    on = None
    for n in on_keys:
        equal = F.col("q." + n) == F.col("p." + n)
        on = equal if on is None else on & equal
    square = F.lit(0.0)
    for d in dims:
        apart = F.col("q." + d) - F.col("p." + d)
        on = on & (F.abs(apart) <= F.lit(float(window)))
        square = square + apart * apart
    found = q.join(p.hint("merge"), on if ok is None else on & ok).select(
        F.col("q." + qid).alias(qid), F.col("p." + pid).alias(pid), (F.sqrt(square) if gap is None else gap).alias("distance")
    )
    return top_per(found, [qid], [F.asc("distance"), F.asc(pid)], k, "rank")


def _by_pyramid(
    queries: DataFrame, points: DataFrame, keys: Sequence[str], dims: Sequence[str], k: int, qid: str, pid: str,
    window: float, ok: Column | None, gap: Column | None, sizes: DataFrame, most: int,
) -> DataFrame:
    # a cell's diagonal, so many levels down, is at most a cell size up here
    down = math.ceil(math.log2(math.sqrt(len(dims))))
    # twice as deep as evenly spread points would need, for places that are denser
    top = 2 * max(0, math.ceil(math.log2(max(1.0, most / k)) / len(dims)))
    cells = ["_c_" + d for d in dims]

    def cell(d: str, level: Column) -> Column:
        return F.floor(F.col(d) / (F.lit(float(window)) / F.pow(F.lit(2.0), level)))

    points, queries = cut(points), cut(queries.join(sizes.select(*keys), list(keys), "left_semi"))
    todo = queries.withColumn("_level", F.lit(0)) if not top else _started(queries, points, keys, dims, cells, cell, k, qid, top, down)
    found = None
    while True:
        size = F.lit(float(window)) / F.pow(F.lit(2.0), F.col("_level"))
        q = todo.withColumn("_size", size)
        for d in dims:
            at = F.floor(F.col(d) / F.col("_size"))
            q = q.withColumn("_c_" + d, F.explode(F.sequence(at - 1, at + 1)))
        # of the neighbouring cells only those that come that near
        to_cell = F.lit(0.0)
        for d in dims:
            low, v = F.col("_c_" + d) * F.col("_size"), F.col(d)
            off = F.greatest(low - v, v - low - F.col("_size"), F.lit(0.0))
            to_cell = to_cell + off * off
        q = q.where((F.col("_level") == 0) | (to_cell <= F.col("_size") * F.col("_size") * (1 + 2e-9)))
        # points are repeated for the levels that their key's queries are on
        used = todo.select(*keys, "_level").distinct()
        p = points.join(used, list(keys)).withColumn("_size", size)
        p = p.withColumns({"_c_" + d: F.floor(F.col(d) / F.col("_size")) for d in dims}).drop("_size")
        # a task's pairs are many times its rows: tasks follow the rows, not their bytes
        tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(todo.count() * 3 ** len(dims) / TASK_ROWS)))
        q, p = (side.repartition(tasks, *keys, "_level", *cells).alias(n) for side, n in ((q, "q"), (p, "p")))
        on = None
        for n in [*keys, "_level", *cells]:
            equal = F.col("q." + n) == F.col("p." + n)
            on = equal if on is None else on & equal
        square = F.lit(0.0)
        for d in dims:
            apart = F.col("q." + d) - F.col("p." + d)
            on = on & (F.abs(apart) <= F.col("q._size"))
            square = square + apart * apart
        # above level 0 only what lies within a cell size (rounding aside) is sure to be complete
        on = on & ((F.col("q._level") == 0) | (square <= F.col("q._size") * F.col("q._size") * (1 + 1e-9)))
        if ok is not None:
            on = on & ok
        pairs = q.join(p.hint("merge"), on).select(
            F.col("q." + qid).alias(qid),
            F.col("p." + pid).alias(pid),
            (F.sqrt(square) if gap is None else gap).alias("distance"),
            "q._level",
            "q._size",
        )
        best = top_per(pairs, [qid], [F.asc("distance"), F.asc(pid)], k, "rank")
        if ok is None:
            done = best  # the pyramid has counted k points within reach
        else:
            best = cut(best)
            full = best.groupBy(qid).agg(F.count_if(F.col("distance") <= F.col("_size")).alias("_k"), F.max("_level").alias("_l")).where((F.col("_k") >= k) | (F.col("_l") == 0))
            done = best.join(full.select(qid), qid, "left_semi")
        done = done.select(qid, pid, "distance", "rank")
        found = done if found is None else found.unionByName(done)
        if ok is None:
            return found
        todo = cut(todo.where("_level > 0").join(full.select(qid), qid, "left_anti").withColumn("_level", F.floor(F.col("_level") / 2).cast("int")))
        if todo.isEmpty():
            return found


def _started(
    queries: DataFrame, points: DataFrame, keys: Sequence[str], dims: Sequence[str], cells: list[str],
    cell: Callable[[str, Column], Column], k: int, qid: str, top: int, down: int,
) -> DataFrame:
    """The queries with the finest ``_level`` on which k points lie in their own cell ``down`` levels deeper."""
    fine = points.select(*keys, *[cell(d, F.lit(top + down)).alias("_c_" + d) for d in dims]).groupBy(*keys, *cells).agg(F.count("*").alias("_n"))
    levels = F.explode(F.sequence(F.lit(1), F.lit(top)))
    up = F.pow(F.lit(2.0), F.lit(top) - F.col("_level"))
    pyramid = fine.withColumn("_level", levels).withColumns({c: F.floor(F.col(c) / up) for c in cells})
    pyramid = pyramid.groupBy(*keys, "_level", *cells).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).drop("_n")
    here = queries.select(qid, *keys, *dims, levels.alias("_level"))
    here = here.withColumns({"_c_" + d: cell(d, F.col("_level") + down) for d in dims})
    start = here.join(pyramid, [*keys, "_level", *cells], "left_semi").groupBy(qid).agg(F.max("_level").alias("_level"))
    return cut(queries.join(start, qid, "left").withColumn("_level", F.coalesce("_level", F.lit(0))))
