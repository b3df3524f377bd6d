"""SimHash near-duplicates: fingerprints in Arrow functions, exact pairs through sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, read

#: Fingerprints that trees are fitted on at once, and how many a shard should hold.
SAMPLE, SHARD = 32_768, 2048
#: A shard that trees don't bring under DEAL is compared in blocks of that size.
DEAL, PASSES = 8192, 6
STEP = 1 << 16


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over all word k-shingles, repeats included; 0 where there is no word.

    A-Z are lower-cased; words are what stands between space, tab, LF, VT, FF and CR, which is how bytes.split()
    splits. Fewer than k words make one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - k + 1, 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + k - 1]
        h = np.array([digest(b" ".join(part[i : i + k]), seed) for i in range(min(STEP, n - at))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


@dataclass
class Node:
    """Points within ``radius`` of ``vantage`` are inside; a leaf has a number only."""

    shard: int = -1
    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None


def divide(points: np.ndarray, reach: int, leaf: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that split ``points`` well, or None where no split tried makes both sides smaller.

    Of some vantage points and radii the one with the least larger side, overlap included, is taken.
    """
    if len(points) <= leaf:
        return None
    best = None
    for i in np.linspace(0, len(points) - 1, 8).astype(int):
        d = distance(points, points[i])
        count = np.bincount(d, minlength=66)
        below = np.cumsum(count)  # at most r
        for r in range(64):
            far = len(points) - (below[r - reach] if r >= reach else 0)  # outside, with what is near the boundary
            larger = max(below[r], far)
            if best is None or larger < best[0]:
                best = larger, points[i], r
    return (best[1], best[2]) if best and best[0] <= 0.9 * len(points) else None


def build(points: np.ndarray, reach: int, leaf: int, count: list[int]) -> Node:
    split = divide(points, reach, leaf)
    if split is None:
        count[0] += 1
        return Node(shard=count[0] - 1)
    d = distance(points, split[0])
    return Node(-1, split[0], split[1], build(points[d <= split[1]], reach, leaf, count), build(points[d > split[1] - reach], reach, leaf, count))


def route(node: Node, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points that belong there).

    Two points at most ``reach`` apart always meet in a shard: where a node parts them, the inner one is at most
    ``reach`` inside the boundary, by the triangle inequality, and such points go to both sides.
    """
    if not len(points):
        return
    if node.shard >= 0:
        yield node.shard, points
        return
    d = distance(points, node.vantage)
    yield from route(node.inside, points[d <= node.radius], reach)
    yield from route(node.outside, points[d > node.radius - reach], reach)


def near_pairs(points: np.ndarray, reach: int, leaf: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs at most ``reach`` apart, in blocks, some more than once: a vantage-point tree walked as it is built."""
    split = divide(points, reach, leaf)
    if split is None:
        for at in range(0, len(points), 512):
            a = points[at : at + 512]
            for to in range(at, len(points), 4096):
                b = points[to : to + 4096]
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= reach)
                keep = a[i] < b[j]
                yield a[i[keep]], b[j[keep]]
                i, j = i[~keep], j[~keep]
                keep = a[i] > b[j]
                yield b[j[keep]], a[i[keep]]
        return
    d = distance(points, split[0])
    yield from near_pairs(points[d <= split[1]], reach, leaf)
    yield from near_pairs(points[d > split[1] - reach], reach, leaf)


def forest(points: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of near pairs; at most one less than there are points."""
    points = np.unique(points)
    root = np.arange(len(points))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for a, b in near_pairs(points, reach):
        ia, ib = np.searchsorted(points, a), np.searchsorted(points, b)
        apart = np.flatnonzero(root[ia] != root[ib])
        for x, y in zip(ia[apart].tolist(), ib[apart].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((x, y))
        for x in np.unique(np.concatenate([ia, ib])).tolist():
            root[x] = find(x)
    signed = points.view(np.int64)
    return [(int(signed[x]), int(signed[y])) for x, y in edges]


def graft(node: Node, under: dict[int, Node]) -> Node:
    """The tree with the leaves of the shards in ``under`` replaced."""
    if node.shard >= 0:
        return under.get(node.shard, node)
    return Node(-1, node.vantage, node.radius, graft(node.inside, under), graft(node.outside, under))


def shards(distinct: DataFrame, reach: int, sample: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(shard, fp) rows of all fingerprints, and (shard, size) of the shards that hold over twice ``shard`` of them.

    The upper tree is fitted on ``sample`` fingerprints of least hash (a bound on what reaches the driver). Where a
    shard is still too large, which happens as the table grows, a sample of the fingerprints in such shards grows
    the tree below them, pass after pass, until no split helps.
    """
    spark = distinct.sparkSession

    def spread(tree: Node) -> DataFrame:
        shared = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, p in route(shared.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), s, np.int32)), pa.array(p.view(np.int64))], ["shard", "fp"])

        return distinct.mapInArrow(run, "shard int, fp long")

    def seen(rows: DataFrame, n: int) -> np.ndarray:
        return np.array([r.fp for r in rows.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(n).collect()], np.int64).view(np.uint64)

    n, points, count = distinct.count(), seen(distinct, sample), [0]
    tree = build(points, reach, max(16, shard * len(points) // max(n, 1)), count)
    for _ in range(PASSES):
        rows = spread(tree)
        large = checkpoint(rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > 2 * shard))
        sizes = {r.shard: r.size for r in large.orderBy(F.desc("size")).limit(sample // 64).collect()}
        if not sizes:
            break
        # the largest shards first; each gets points by its share, and at least 64
        some = rows.where(F.col("shard").isin(list(sizes)))
        bar = min(1.0, 2 * sample / sum(sizes.values()))
        points, under = seen(some.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < bar * (1 << 30)), 2 * sample), {}
        for s, own in route(tree, points, reach):
            if s in sizes:
                at = count[0]
                below = build(own, reach, max(16, shard * len(own) // sizes[s]), count)
                if below.shard < 0:
                    under[s] = below
                else:
                    count[0] = at
        if not under:
            break
        tree = graft(tree, under)
    return rows, large


def link(distinct: DataFrame, reach: int = 2, sample: int = SAMPLE, shard: int = SHARD, deal: int = DEAL) -> DataFrame:
    """a, b: fingerprints of a spanning forest of all pairs of distinct ``fp`` that differ in ``reach`` bits or fewer.

    Vantage-point trees of ``shards`` part the fingerprints; what is near a boundary goes to both sides. A cluster
    so dense that no ball parts it stays one shard; over ``deal`` fingerprints it is dealt out in blocks, and a task
    compares two. Inside a task the same tree goes on, in memory that follows its rows. Exact copies count once
    here, so a group of copies is one point.
    """
    rows, large = shards(distinct, reach, sample, shard)
    hot = large.where(F.col("size") > deal)
    few = hot.limit(100_001).count() <= 100_000
    dealt = rows.join(F.broadcast(hot) if few else hot, "shard", "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / deal), F.lit(1)).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(part, q).alias("p"), F.greatest(part, q).alias("q")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select("shard", "pair.p", "pair.q", "fp")
    dealt = dealt if few else dealt.repartition("shard", "p", "q")  # by block, not by shard

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(group.fp.to_numpy(np.int64).view(np.uint64), reach), columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("shard", "p", "q").applyInPandas(pairs, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of (doc_id, text); other columns are ignored.

    Documents link where fingerprints differ in ``reach`` bits or fewer; component_id is the smallest doc_id that
    links reach. Texts without words, null ones too, have fingerprint 0 and link like any other. Rows with a null
    doc_id take part; a component of such rows only has a null component_id. Repeated rows are repeated.
    """
    rows = checkpoint(fingerprints(docs, k, seed))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(link(distinct.select("fp"), reach))
    # one row per distinct fingerprint; only those that link have a label
    of = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    ids = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = checkpoint(of.join(ids, "label").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each group of near-duplicates; rows that repeat a doc_id count once.

    Rows with a null doc_id are kept, as no id says which of them is the smallest.
    """
    kept = near_duplicates(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
