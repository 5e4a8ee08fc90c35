"""N-gram Jaccard join by a tree of count vectors.

A document is its set of word shingles.  Shingles are hashed into ``GROUPS`` groups, and
the document becomes the point of its counts per group: two documents share at most the
sum of the smaller counts, coordinate by coordinate, and two boxes of points at most the
sum of the smaller upper corners.

The tree's upper level lies over the shuffle.  Axes are so fine there that each is one
shingle: a document is filed under those of its shingles that come first in one global
order, enough of them that two documents that reach the similarity must meet under one
(of n shingles, n - ceil(0.75 n) + 1).  Shingles that are frequent in a sample come last in
that order, so a passage that many documents share is an axis only where it makes up most
of a document; any order gives the same links.  Axes whose smallest document is the same
are one cell, and a cell's documents are packed by size into leaves of ``LEAF`` points with
the box of each.

Links are found in two passes.  First each cell compares its documents with its smallest
one, which ties a group of near copies together with as many pairs as documents.  Then, in
cells whose documents are not all connected yet, leaves whose boxes can reach the
similarity are joined, point by point where nothing connects them yet.  Chance fills the
few groups of a long document evenly, so pairs are then held against fine points, which
have as many groups as the document has shingles and are far smaller than its text.  A pair
that the bound lets through is verified on the full shingle sets.  What comes out connects all that
is connected, with at most a link per document and pair of leaves; no pair is skipped but
those that the bound rules out or that are connected already.

Equal sets are one point from the start.  Sets are compared by 64-bit hashes of shingles.

Defined results: a null, empty or blank text has no shingles and is linked with nothing.
Rows without ``doc_id`` are returned with their size, without component.  Rows that repeat
an id are one document with the shingles of its first text by (size, digest), and each is
returned with the component of that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landspan.llm.graph import components
from landspan.llm.pitman_yor import pack, unpack
from landspan.llm.store import save
from landspan.llm.text import C, hashes, mix, runs, slices, spans

SHINGLE = 5
PERCENT = 75
#: Groups of a point, points of a leaf.
GROUPS = 256
LEAF = 512
#: Rows sent to every task at most: ids of documents whose texts are fetched.
FEW_IDS = 1_000_000
#: The sample that finds frequent shingles, and how many of them are ordered last.
SAMPLE_DOCS = 20_000
FREQUENT_IN_SAMPLE = 8
MOST_FREQUENT = 200_000
#: Counts of fine points that are compared at once.
AT_ONCE = 4 << 20
#: Documents of a block, about; pairs are verified by pairs of blocks.
BLOCK = 256


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted by row and hash."""
    starts, ends, row = spans(data, offsets)
    h = hashes(data, starts, ends)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = runs(row)
    last = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    at = np.arange(n)
    whole = at + k <= last
    whole[first] = True  # a row with fewer words is one shingle
    acc, used = np.zeros(n, np.uint64), np.minimum(last - at, k)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        acc = acc * C + np.where(at + j < last, padded[j : j + n], 0).astype(np.uint64)
    value, row = mix(acc + used.astype(np.uint64))[whole], row[whole]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[new], value[new]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles under which a set of n is filed: two similar sets share one of them."""
    return n - -(-n * percent // 100) + 1


def _points(frequent: np.ndarray, groups: int, percent: int):
    """Batches (doc_id, text) to (id, n, digest_1, digest_2, axes, point)."""

    def packed(counts: np.ndarray, m: int) -> pa.Array:
        width = 2 * len(counts) // max(m, 1)
        ends = pa.py_buffer((np.arange(m + 1) * width).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), m, [None, ends, pa.py_buffer(np.minimum(counts, FULL).astype("<u2"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in slices(batch.column(0), batch.column(1)):
                m = len(ids)
                row, value = shingles(data, offsets)
                n = np.bincount(row, minlength=m).astype(np.int64)
                d1, d2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                begin = np.flatnonzero(n)
                at = runs(row)
                if len(at):
                    d1[begin] = np.add.reduceat(mix(value + C), at)
                    d2[begin] = np.bitwise_xor.reduceat(mix(value ^ C), at)
                last = np.zeros(len(value), bool)
                if len(frequent):
                    found = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
                    last = frequent[found] == value
                order = np.lexsort((value, last, row)) if last.any() else np.arange(len(value))
                rank = np.arange(len(value)) - np.repeat(at, n[begin])
                keep = np.where(n > 0, prefix_length(n, percent), 0)
                axes = value[order][rank < keep[row]]
                point = np.bincount(row * groups + (value % np.uint64(groups)).astype(np.int64), minlength=m * groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(n),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(axes.view(np.int64))),
                        packed(point, m),
                    ],
                    ["id", "n", "digest_1", "digest_2", "axes", "point"],
                )

    return work


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Hashes of shingles found in many documents of a bounded sample, sorted; they only order the axes."""
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    n = docs.count()
    if n > SAMPLE_DOCS:
        docs = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(n)) < SAMPLE_DOCS)

    def each(batches):
        for batch in batches:
            for _, data, offsets in slices(batch.column(0), batch.column(1)):
                row, value = shingles(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(np.sort(value).view(np.int64))], ["shingle"])

    df = docs.mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    top = df.where(F.col("df") >= FREQUENT_IN_SAMPLE).orderBy(F.desc("df"), "shingle").limit(MOST_FREQUENT)
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def points(documents: DataFrame, percent: int = PERCENT, groups: int = GROUPS) -> DataFrame:
    """id, n, digest_1, digest_2, axes, point of every document row with an id, in the shared folder."""
    schema = "id long, n long, digest_1 long, digest_2 long, axes array<long>, point binary"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return save(docs.mapInArrow(_points(frequent_shingles(documents), groups, percent), schema), "points")


def _counts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint16)


#: A count that is held as the largest number may be larger, so it bounds nothing.
FULL, NO_BOUND = 65535, 1 << 62


def _most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the shared shingles, point by point: the sum of coordinate minima."""
    least = np.minimum(a, b)
    return np.where((least >= FULL).any(axis=-1), NO_BOUND, least.sum(axis=-1, dtype=np.int64))


def _reaches(most: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` shingles together that share ``most`` at most can be similar."""
    return (most == NO_BOUND) | ((100 + percent) * np.minimum(most, NO_BOUND >> 8) >= percent * n)


def _can_link(percent: int):
    """Keep rows (…, n_a, n_b, point_a, point_b) whose points allow the similarity."""

    def work(batches):
        for pdf in batches:
            a, b = _counts(pdf["point_a"]), _counts(pdf["point_b"])
            ok = _reaches(_most_shared(a, b), pdf["n_a"].to_numpy() + pdf["n_b"].to_numpy(), percent)
            yield pdf.loc[ok, ["a", "b"]]

    return work


def bounded(pairs: DataFrame, pts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that the sum of coordinate minima does not rule out."""
    side = lambda x: pts.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_can_link(percent), "a long, b long")


def _verify(percent: int):
    """The pairs of two blocks, and their documents' texts, to the pairs that link."""

    def work(pairs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        for ids, data, offsets in slices(pa.array(docs["id"], pa.int64()), pa.array(docs["text"], pa.string())):
            row, value = shingles(data, offsets)
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
            sets.update((d, value[cut[i] : cut[i + 1]]) for i, d in enumerate(ids.to_pylist()))
        none = np.zeros(0, np.uint64)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ok = np.zeros(len(pairs), bool)
        for i in range(len(pairs)):
            x, y = sets.get(a[i], none), sets.get(b[i], none)
            if len(x) and len(y):
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                ok[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
        return pd.DataFrame({"a": a[ok], "b": b[ok]})

    return work


def verified(pairs: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity.

    The documents that pairs connect are dealt into blocks of about ``BLOCK``; a text travels
    once to each pair of blocks that needs it, not once per pair.
    """
    pairs = save(pairs, "pairs")
    label = components(pairs)
    sizes = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    place = label.join(sizes, "label").select("node", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    side = lambda x: place.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"), F.col("block").alias(f"block_{x}"))
    tiles = save(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", F.col("label_a").alias("label"), F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi")),
        "tiles",
    )
    tile = ["label", "lo", "hi"]
    wanted = tiles.select(*[F.col(c).alias(f"{c}_of") for c in tile], F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = place.select(F.col("node").alias("id"))
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    laid = wanted.join(texts, "id").groupBy(*[f"{c}_of" for c in tile])
    return save(tiles.groupBy(*tile).cogroup(laid).applyInPandas(_verify(percent), "a long, b long"), "links")


def _may_link(percent: int):
    """Pairs of packed leaves to the documents that the boxes and points leave a partner not connected yet.

    At most one row per document and pair of leaves comes out, however many partners it has.
    """

    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                one = r.ids_2 is None
                a, n, la = _counts(r.points_1), np.asarray(r.ns_1), np.asarray(r.labels_1)
                b, m, lb = (a, n, la) if one else (_counts(r.points_2), np.asarray(r.ns_2), np.asarray(r.labels_2))
                if not _reaches(_most_shared(a.max(axis=0), b.max(axis=0)), n.min() + m.min(), percent):
                    continue  # no point of one box can link with one of the other
                left, right = np.zeros(len(n), bool), np.zeros(len(m), bool)
                for x in range(len(n)):
                    y = np.flatnonzero((la[x] != lb) & (100 * np.minimum(n[x], m) >= percent * np.maximum(n[x], m)))
                    y = y[_reaches(_most_shared(a[x], b[y]), n[x] + m[y], percent)]
                    left[x], right[y] = left[x] or len(y) > 0, True
                if one:
                    left |= right
                for keep, leaf, ids, ns, labels in ((left, r.leaf_1, r.ids_1, n, la), *(() if one else ((right, r.leaf_2, r.ids_2, m, lb),))):
                    out.append(
                        pd.DataFrame(
                            {"leader": r.leader, "leaf_1": r.leaf_1, "leaf_2": r.leaf_2, "leaf": leaf, "id": np.asarray(ids)[keep], "n": ns[keep], "label": labels[keep]}
                        )
                    )
            if out:
                yield pd.concat(out)

    return work


WANTED = "leader long, leaf_1 int, leaf_2 int, leaf int, id long, n long, label long"


def _fine(groups: int):
    """Batches (id, text) to (id, size, fine): counts in a power of two of groups, as many as shingles or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in slices(batch.column(0), batch.column(1)):
                row, value = shingles(data, offsets)
                size, fine = [], []
                for own in np.split(value, np.searchsorted(row, np.arange(1, len(ids)))):
                    width = 1 << (max(groups, len(own)) - 1).bit_length()
                    size.append(len(own))
                    fine.append(pack(np.minimum(np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width), FULL).astype("<u2")))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(fine, pa.binary())], ["id", "size", "fine"])

    return work


def _folded(point: np.ndarray, width: int) -> np.ndarray:
    """A fine point's counts in fewer groups."""
    return np.minimum(point.reshape(-1, width).sum(axis=0, dtype=np.int64), FULL).astype(np.uint16)


def _may_link_finely(percent: int):
    """Documents of two leaves (leader, leaf_1, leaf_2, leaf, id, n, label, size, fine) to those that fine points leave a partner.

    Points are compared in the groups of the one that has fewer.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        n, size, side, label = (rows[c].to_numpy() for c in ("n", "size", "leaf", "label"))
        one = rows["leaf_1"].iloc[0] == rows["leaf_2"].iloc[0]
        points = [unpack(x, np.uint16) for x in rows["fine"]]
        width = np.array([len(p) for p in points])
        keep = np.zeros(len(rows), bool)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            fits = (width >= w) & (100 * n >= percent * n[mine].min()) & (percent * n <= 100 * n[mine].max())
            step = max(1, AT_ONCE // int(w))
            others = np.flatnonzero(fits)
            for part in np.split(others, np.arange(step, len(others), step)):
                held = np.stack([_folded(points[y], w) for y in part])
                for x in mine:
                    near = (label[part] != label[x]) & (one | (side[part] != side[x]))
                    near &= 100 * np.minimum(n[x], n[part]) >= percent * np.maximum(n[x], n[part])
                    y = part[near]
                    y = y[_reaches(_most_shared(points[x], held[near]), size[x] + size[y], percent)]
                    keep[x], keep[y] = keep[x] or len(y) > 0, True
        return rows.loc[keep, [c.split()[0] for c in WANTED.split(", ")]].drop_duplicates()

    return work


def _leaf_links(percent: int, groups: int):
    """Documents of two leaves (leader, leaf_1, leaf_2, leaf, id, n, label, text) to links that connect what is connected.

    Point by point: the sum of coordinate minima first, then the sets.  Points that links of
    this pair of leaves already connect are not compared again.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id"], kind="stable")
        ids, n, side = (rows[c].to_numpy() for c in ("id", "n", "leaf"))
        sets, counts = [], np.zeros((len(rows), groups), np.int32)
        for part, data, offsets in slices(pa.array(ids, pa.int64()), pa.array(rows["text"], pa.string())):
            row, value = shingles(data, offsets)
            begin = len(sets)
            np.add.at(counts, (row + begin, (value % np.uint64(groups)).astype(np.int64)), 1)
            sets += np.split(value, np.searchsorted(row, np.arange(1, len(part))))
        root = pd.factorize(rows["label"])[0]
        one = rows["leaf_1"].iloc[0] == rows["leaf_2"].iloc[0]
        a, b = [], []
        for x in range(len(ids)):
            # later points are larger, up to a size at which they cannot link
            end = np.searchsorted(n, n[x] * 100 // percent, "right")
            y = np.arange(x + 1, end)
            y = y[(root[y] != root[x]) & (one | (side[y] != side[x]))]
            most = np.minimum(counts[x], counts[y]).sum(axis=1)
            for z in y[(100 + percent) * most >= percent * (n[x] + n[y])]:
                if root[x] == root[z]:
                    continue
                p, q = sets[x], sets[z]
                both = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(min(ids[x], ids[z]))
                    b.append(max(ids[x], ids[z]))
                    root[root == root[z]] = root[x]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return work


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of the documents whose ``id`` is wanted."""
    ids = wanted.select("id").distinct()
    return documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(
        F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi"
    )


def links(documents: DataFrame, pts: DataFrame, percent: int = PERCENT, leaf: int = LEAF, groups: int = GROUPS) -> DataFrame:
    """a, b: links between representatives (the smallest id of equal sets) that connect all that are connected."""
    first = pts.where("n > 0").groupBy("digest_1", "digest_2", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = save(
        pts.select("id", "digest_1", "digest_2", "n").join(first, ["digest_1", "digest_2", "n"]).where("id <> first").select("id").distinct(), "copies"
    )
    reps = pts.where("n > 0 and id is not null").join(F.broadcast(copies) if copies.count() <= FEW_IDS else copies, "id", "left_anti")
    filed = reps.select("id", "n", F.explode("axes").alias("axis"))
    smallest = F.first(F.struct("n", "id")).over(Window.partitionBy("axis").orderBy("n", "id"))
    # documents under one axis are of one cell, named by the smallest of them; axes with the same smallest are one cell
    cells = save(
        filed.withColumn("leader", smallest)
        .where(F.col("id") != F.col("leader.id"))
        .select(F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"), "id", "n")
        .distinct(),
        "cells",
    )
    near = cells.where(F.col("leader_n") * 100 >= F.col("n") * percent)
    stars = near.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    found = verified(bounded(stars, reps, percent), documents, percent)
    # cells whose documents are not yet all connected
    label = components(found)
    members = cells.select("leader", "id", "n").union(cells.select("leader", F.col("leader").alias("id"), F.col("leader_n").alias("n")).distinct())
    members = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = (
        members.groupBy("leader")
        .agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("k > 2 and lo <> hi")
        .select("leader")
    )
    rank = F.row_number().over(Window.partitionBy("leader").orderBy("n", "id")) - 1
    packed = save(
        members.join(open_, "leader")
        .withColumn("leaf", F.floor(rank / leaf).cast("int"))
        .join(reps.select("id", "point"), "id")
        .groupBy("leader", "leaf")
        .agg(F.sort_array(F.collect_list(F.struct("n", "id", "label", "point"))).alias("m"))  # of at most ``leaf`` rows
        .select("leader", "leaf", F.col("m.id").alias("ids"), F.col("m.n").alias("ns"), F.col("m.label").alias("labels"), F.col("m.point").alias("points")),
        "leaves",
    )
    fields = ("leaf", "ids", "ns", "labels", "points")
    side = lambda x, df: df.select("leader", *[F.col(c).alias(f"{c}_{x}") for c in fields])
    # a leaf with itself, and with the later leaves of cells that have several
    alone = side(1, packed).withColumn("leaf_2", F.col("leaf_1"))
    alone = alone.select("*", *[F.lit(None).cast(packed.schema[c].dataType).alias(f"{c}_2") for c in fields[1:]])
    several = packed.join(packed.where("leaf = 1").select("leader"), "leader", "left_semi")
    meet = F.expr(f"leaf_1 < leaf_2 and 100 * ns_1[size(ns_1) - 1] >= {percent} * ns_2[0]")
    tiles = side(1, several).join(side(2, several), "leader").where(meet).unionByName(alone)
    wanted = save(tiles.mapInPandas(_may_link(percent), WANTED), "wanted")
    tile = ["leader", "leaf_1", "leaf_2"]
    fine = _texts(documents, wanted).mapInArrow(_fine(groups), "id long, size long, fine binary")
    wanted = save(wanted.join(fine, "id").groupBy(*tile).applyInPandas(_may_link_finely(percent), WANTED), "wanted")
    rows = wanted.join(_texts(documents, wanted).dropDuplicates(["id"]), "id")
    rest = rows.groupBy(*tile).applyInPandas(_leaf_links(percent, groups), "a long, b long")
    return found.unionByName(save(rest, "rest"))


def join(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    pts = points(documents, percent)
    label = save(components(links(documents, pts, percent)), "labels")
    # a document's representative is the smallest id with an equal set, its component that one's label
    reps = pts.where("n > 0").groupBy("digest_1", "digest_2", "n").agg(F.min("id").alias("rep"))
    named = reps.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "digest_1", "digest_2", "n", F.coalesce("label", "rep").alias("component")
    )
    rows = pts.select("id", "digest_1", "digest_2", "n")
    return rows.join(named, ["digest_1", "digest_2", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def first_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` without those that are linked, at whatever length, to a smaller doc_id."""
    gone = join(documents, percent).where("component_id <> doc_id").select("doc_id").distinct()
    gone = save(gone, "linked")
    if gone.count() <= FEW_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, "doc_id", "left_anti")
