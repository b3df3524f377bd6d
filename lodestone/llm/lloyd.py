"""Centroid clustering by delta Lloyd: owners and sums persist, a round looks at what changed and sums what moved."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_shared, read, shared_folder

#: Integer components are held to this size, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
_OWNED = "key long, cluster int, distance long, moved array<struct<cluster: int, n: long, total: array<long>>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))


class Bucketed:
    """A table in the shared folder, bucketed by ``key``, so that joins on it need no exchange."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"lodestone_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        df.write.format("parquet").bucketBy(buckets, "key").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_shared(self.spark, self.path)


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """key, vec_id and x, the components floor(scale * x) as 4-byte integers, of vectors with ``dims`` finite components."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(size == dims)
            x = v.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
            finite = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(x[finite] * scale), -LARGEST, LARGEST).astype("<i4")
            at = pa.array(right[finite])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r.tobytes() for r in whole], pa.binary())], ["key", "vec_id", "x"])

    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(kept, "key long, vec_id long, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids; |x|^2 - 2xc + |c|^2 in integers, which may wrap on the way but not at the end."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after ``changed`` centroids moved; owners are -1 where there is none yet.

    An owner that stayed, or came no farther, still beats all centroids that stayed, ties included: only those
    that changed are compared. Vectors whose owner went farther are compared with all.
    """
    near = np.where(owner >= 0, distance, np.iinfo(np.int64).max)
    best = np.where(owner >= 0, owner, len(centroids))
    moves = np.flatnonzero(changed)
    if not len(moves):
        return best, near
    to_changed = squared(x, centroids[moves])
    place = np.full(len(centroids) + 1, -1)
    place[moves] = np.arange(len(moves))
    at = place[best]
    own = at >= 0
    now = np.where(own, to_changed[np.arange(len(x)), at], near)
    lost = np.flatnonzero((now > near) | (owner < 0))
    near = now
    for j, c in enumerate(moves):
        d = to_changed[:, j]
        better = (d < near) | ((d == near) & (c < best))
        near, best = np.where(better, d, near), np.where(better, c, best)
    stayed = np.flatnonzero(~changed)
    if len(lost) and len(stayed):
        to_stayed = squared(x[lost], centroids[stayed])
        for j, c in enumerate(stayed):
            d = to_stayed[:, j]
            better = (d < near[lost]) | ((d == near[lost]) & (c < best[lost]))
            near[lost], best[lost] = np.where(better, d, near[lost]), np.where(better, c, best[lost])
    return best, near


def transfers(x: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> list[dict]:
    """Signed counts and sums that ``new`` owners gain and ``old`` ones lose."""
    go = old != new
    x, old, new, out = x[go], old[go], new[go], []
    for c in range(k):
        came, went = new == c, old == c
        if came.any() or went.any():
            out.append({"cluster": c, "n": int(came.sum()) - int(went.sum()), "total": (x[came].sum(axis=0) - x[went].sum(axis=0)).tolist()})
    return out


def _round(vectors: Bucketed, owned: Bucketed | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            old, d = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            new, d = reassign(x, old, d, centroids, changed)
            # the first row of a batch carries what moved in it
            moved = pa.array([transfers(x, old, new, k)] + [None] * (len(x) - 1), _MOVED)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new.astype(np.int32)), pa.array(d.astype(np.int64)), moved], ["key", "cluster", "distance", "moved"])

    v = vectors.rows().select("key", "x")
    if owned is None:
        v = v.select("key", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        v = v.join(owned.rows().select("key", "cluster", "distance").hint("shuffle_hash"), "key").select("key", "x", "cluster", "distance")
    return v.mapInArrow(assign, _OWNED)


def _moved(owned: Bucketed) -> dict[int, tuple[int, list[int]]]:
    """By centroid the count and the sums that moved: one row a centroid comes to the driver."""
    m = owned.rows().where("moved is not null").select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.total").alias("i", "v"))
    sums = m.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    rows = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).collect()
    return {r["cluster"]: (r["n"], [int(x["v"]) for x in r["v"]]) for r in rows}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", buckets: int | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept (columns vec_id, embedding).

    Kept are vectors of exactly ``dims`` components, none of them null or non-finite; each component x counts as
    floor(``scale`` * x). The first centroids are the ``k`` vectors of least sha256 of ``seed:vec_id`` (fewer, where
    fewer are kept); vectors without vec_id come last, and rows that repeat an id are vectors of their own, ordered
    by their components, so that two equal rows can both be centroids and the smaller number takes all.
    ``rounds`` times vectors go to the nearest centroid (ties: the smaller number) and centroids to the floor of
    their vectors' mean; then vectors go once more. An empty table, or one without a vector to keep, gives no rows.
    Integer components beyond 2^27 count as that, so that distances fit a long; an inertia beyond a long is null.

    Vectors are written once, bucketed by a row number; each round writes only owners and distances, into the
    same buckets, so that no round shuffles. Executors may be lost: all that a round reads lies in the shared folder.
    The driver holds the centroids and their sums, k rows. Rounds end early where no centroid changes any more.
    """
    spark = vectors.sparkSession
    buckets = buckets or max(spark.sparkContext.defaultParallelism, math.ceil(vectors.count() / bucket_rows))
    base = Bucketed(integers(vectors, dims, scale).repartition(buckets, "key"), buckets)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = base.rows().select(order.alias("o"), "x").orderBy(F.col("o").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([np.frombuffer(bytes(r["x"]), "<i4") for r in first], np.int64).reshape(-1, dims)
    counts, sums = [0] * len(first), [[0] * dims for _ in first]
    owned, changed = None, np.ones(len(first), bool)
    for step in range(rounds + 1):
        if not len(first) or not changed.any():
            break
        now = Bucketed(_round(base, owned, centroids, changed), buckets)
        if owned is not None:
            owned.drop()
        owned = now
        if step == rounds:
            break
        for c, (n, total) in _moved(owned).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], total, strict=True)]
        after = np.array([[v // n for v in s] if n else list(c) for n, s, c in zip(counts, sums, centroids, strict=True)], np.int64)
        changed, centroids = (after != centroids).any(axis=1), after
    if owned is None:
        return base.rows().where("false").select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    sizes = {r["cluster"]: int(r["d"]) for r in owned.rows().groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda n: n if n < 1 << 63 else None
    marks = [(i, held(sizes[i]), held(sum(sizes.values())), hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sizes]
    of_cluster = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    ids = base.rows().select("key", "vec_id").join(owned.rows().select("key", "cluster", "distance").hint("shuffle_hash"), "key")
    return ids.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` in one of eight clusters, after ten rounds."""
    return cluster(read(spark, sf_dir, "embeddings"))


def op12_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """DuckDB SQL for the rows of op12_delta_lloyd: plain Lloyd rounds, each over all vectors."""
    span = f"range(1, {dims + 1})"
    distance = f"list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in {span}])"
    parts = [
        f"kept AS (SELECT vec_id, [floor(1024 * v::DOUBLE)::HUGEINT for v in embedding] x FROM embeddings WHERE len(embedding) = {dims} AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) - 1 id, x c FROM kept QUALIFY id < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(id, (d, id)) id, min(d) d FROM (SELECT k.rid, vec_id, x, id, {distance} d FROM (SELECT *, row_number() OVER () rid FROM kept) k, c{r}) GROUP BY rid, vec_id, x)")
        if r < rounds:
            # an integer division that rounds down, whatever the sign
            mean = "[((s[i] - ((s[i] % n) + n) % n) // n) for i in " + span + "]"
            sums = f"[{', '.join(f'sum(x[{i}])' for i in range(1, dims + 1))}]"
            parts.append(f"s{r} AS (SELECT id, count(*)::HUGEINT n, {sums} s FROM a{r} GROUP BY id)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.id, CASE WHEN n IS NULL THEN c ELSE {mean} END c FROM c{r} c LEFT JOIN s{r} s ON c.id = s.id)")
    last = rounds
    final = f"SELECT vec_id, a.id::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.id))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.id = c.id"
    return "WITH " + ", ".join(parts) + " " + final


OP12_SQL = op12_sql()
