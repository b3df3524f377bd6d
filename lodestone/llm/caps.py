"""Embedding near-duplicates: spherical-cap filters from random product codes, list-decoded, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, read, write_shared

#: Cosine from which vectors link; blocks of the product code and words in each, which make WORDS ** BLOCKS filters.
COSINE, BLOCKS, WORDS = 0.93, 2, 256
#: Filters that hold a random vector on average, which fixes the cap at each number of dimensions, and filters that a
#: vector goes to at least (its nearest).
LISTED, LEAST = 16, 16
#: Vectors of one filter and label in one block of a comparison, and vectors decoded at once.
BUCKET, STEP = 1024, 256


@lru_cache(maxsize=8)
def code(dims: int, blocks: int, words: int, seed: int = 11) -> list[np.ndarray]:
    """For each block of dimensions ``words`` random unit vectors; one word of each block makes a filter direction.

    A block of one dimension has two directions, and one of two dimensions 32 words at most.
    """
    rng = np.random.default_rng(seed)
    out = []
    for part in np.array_split(np.arange(dims), blocks):
        if len(part) == 1:
            out.append(np.array([[1.0], [-1.0]]))
            continue
        w = rng.standard_normal((min(words, 8 ** min(len(part), 9) // 2), len(part)))
        out.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return out


def few_of(book: list[np.ndarray], n: int) -> int:
    """``n``, or less where the code has few filters: a sixteenth of them, two at least."""
    return min(n, max(2, int(np.prod([len(b) for b in book])) // 16))


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = 12) -> np.ndarray:
    """A random rotation, so that no pattern of the components, such as zeros in a block, falls together with the code's."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


@lru_cache(maxsize=32)
def cap_for(dims: int, blocks: int = BLOCKS, words: int = WORDS, listed: int = LISTED) -> float:
    """The cosine above which ``listed`` filters on average hold a random vector, measured on a fixed set of such vectors."""
    book = code(dims, min(blocks, dims), words)
    x = np.random.default_rng(13).standard_normal((64, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts, n = np.cumsum([0] + [b.shape[1] for b in book]), few_of(book, listed)
    sums = np.zeros((len(x), 1))
    for i, b in enumerate(book):  # the best of each vector are enough for the mean
        sums = (sums[:, :, None] + (x[:, cuts[i] : cuts[i + 1]] @ b.T)[:, None, :]).reshape(len(x), -1)
        sums = -np.sort(-sums, axis=1)[:, : 16 * n]
    best = np.sort(sums, axis=None)[::-1]
    return float(best[min(n * len(x), len(best)) - 1] / np.sqrt(len(book)))


def nearest(dots: list[np.ndarray], n: int) -> np.ndarray:
    """For each vector the ``n``-th best sum of one word a block, or the least of all if there are fewer."""
    sums = np.zeros((len(dots[0]), 1))
    for d in dots:
        sums = (sums[:, :, None] + d[:, None, :]).reshape(len(d), -1)
        sums = -np.partition(-sums, n - 1, axis=1)[:, :n] if sums.shape[1] > n else sums
    return sums.min(axis=1)


def decode(unit: np.ndarray, book: list[np.ndarray], cap: float, least: int = 0) -> list[np.ndarray]:
    """For each unit vector the numbers of all filters whose direction is at a cosine of ``cap`` or more, and its ``least`` nearest ones.

    Words of a block are tried from the best on; a partial sum goes on only if the best words of the blocks to come
    can still lift it over the bar, so that the work follows the length of the list and not words ** blocks.
    """
    cuts = np.cumsum([0] + [b.shape[1] for b in book])
    dots = [unit[:, cuts[i] : cuts[i + 1]] @ b.T for i, b in enumerate(book)]
    bar = np.full(len(unit), cap * np.sqrt(len(book)))
    if least:
        bar = np.minimum(bar, nearest(dots, least) - 1e-9)
    best = np.array([d.max(axis=1) for d in dots])
    rest = np.vstack([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros(len(unit))])
    rows, ids, sums = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for i, d in enumerate(dots):
        s = sums[:, None] + d[rows]
        keep, word = np.nonzero(s + rest[i][rows][:, None] >= bar[rows][:, None])
        rows, ids, sums = rows[keep], ids[keep] * d.shape[1] + word, s[keep, word]
    order = np.lexsort((ids, rows))
    return np.split(ids[order], np.searchsorted(rows[order], np.arange(1, len(unit))))


def classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct label and vector that can link: class, label, unit (bytes of doubles), n, least, dims.

    Vectors that point the same way are one class only if all components are equal; ``least`` is its smallest
    vec_id and ``n`` the number of its rows.
    """
    ok = vectors.where("label is not null and embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    # 0.0 + x makes -0.0 and 0.0 one value
    ok = ok.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)).withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    one = ok.groupBy("label", "e").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return one.withColumn("class", F.xxhash64("label", "e"))


def filters(unit: np.ndarray, blocks: int, words: int, cap: float | None, least: int) -> list[np.ndarray]:
    """Sorted filter numbers of each unit vector, rotated first."""
    dims = unit.shape[1]
    book, bar = code(dims, min(blocks, dims), words), cap_for(dims, blocks, words) if cap is None else cap
    out: list[np.ndarray] = []
    for at in range(0, len(unit), STEP):
        out += decode(unit[at : at + STEP] @ rotation(dims), book, bar, few_of(book, least))
    return out


def unit_rows(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def close_pairs(x: np.ndarray, starts: np.ndarray, part: np.ndarray, p: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run whose cosine is ``cosine`` or more; run r is the rows from starts[r] to starts[r + 1].

    In a run of blocks p < q the pairs are of one row from each, in all others of any two. Small runs are compared
    many at a time.
    """
    size, found = np.diff(starts), []
    small = (size <= 64) & (p[starts[:-1]] == q[starts[:-1]])
    for s in np.unique(size[small & (size > 1)]).tolist():
        first = starts[:-1][small & (size == s)]
        upper = np.triu(np.ones((s, s), bool), 1)
        step = max(1, 2_000_000 // (s * max(s, x.shape[1])))
        for at in range(0, len(first), step):
            rows = first[at : at + step, None] + np.arange(s)
            r, i, j = np.nonzero((x[rows] @ x[rows].transpose(0, 2, 1) >= cosine) & upper)
            found.append((rows[r, i], rows[r, j]))
    for r in np.flatnonzero(~small):
        rows = np.arange(starts[r], starts[r + 1])
        two = p[rows[0]] != q[rows[0]]
        a, b = (rows[part[rows] == p[rows[0]]], rows[part[rows] == q[rows[0]]]) if two else (rows, rows)
        for at in range(0, len(a), 512):
            i, j = np.nonzero(x[a[at : at + 512]] @ x[b].T >= cosine)
            i, j = a[at + i], b[j]
            found.append((i, j) if two else (i[i < j], j[i < j]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def at_first_filter(i: np.ndarray, j: np.ndarray, key: np.ndarray, lists: dict[int, np.ndarray]) -> np.ndarray:
    """Whether no filter under ``key`` lists both rows of the pair."""
    names = np.array(sorted(lists))
    held = [lists[n] for n in names.tolist()]
    size = np.array([len(h) for h in held])
    start, flat = np.cumsum(size) - size, np.concatenate(held).astype(np.int64)
    wide = int(flat.max()) + 1
    member = np.repeat(np.arange(len(names)), size) * wide + flat  # sorted
    a, b = np.searchsorted(names, i), np.searchsorted(names, j)
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 50_000):
        x, y, n = a[at : at + 50_000], b[at : at + 50_000], size[a[at : at + 50_000]]
        pair = np.repeat(np.arange(len(x)), n)
        k = flat[np.repeat(start[x] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        earlier = k < key[at : at + 50_000][pair]
        pair, k = pair[earlier], k[earlier]
        want = y[pair] * wide + k
        spot = np.minimum(np.searchsorted(member, want), len(member) - 1)
        out[at + pair[member[spot] == want]] = False
    return out


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that a spanning forest of their graph on n nodes needs."""
    root, kept = np.arange(n), []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for at in range(0, len(i), 4096):
        x, y = i[at : at + 4096], j[at : at + 4096]
        while True:  # roots of these nodes, at any depth
            r = root[root[x]], root[root[y]]
            if (r[0] == root[x]).all() and (r[1] == root[y]).all():
                break
            root[x], root[y] = r
        for k in np.flatnonzero(root[x] != root[y]).tolist():
            r, s = find(int(x[k])), find(int(y[k]))
            if r != s:
                root[max(r, s)] = min(r, s)
                kept.append(at + k)
    return i[kept], j[kept]


def links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, words: int = WORDS, cap: float | None = None, least: int = LEAST, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, counts, edges) of the vectors that link.

    A class goes to every filter whose cap (of ``cap`` or cap_for) holds its rotated vector, and to its ``least``
    nearest. These lists are decoded once, written with the vectors to the shared folder and carried in the rows, so
    that counting and comparing read them. Vectors of equal label and dimension meet in a filter, and the cosine of
    what meets is verified in double precision. A pair counts at the first filter that both share, so no pair is counted twice and none is
    sent anywhere: a task returns for each class how many rows it links to, and of the links a spanning forest.
    A filter with more than ``bucket`` classes is dealt out in blocks, and two blocks are compared at a time; the
    rows of such a filter are repeated as often as it has blocks. Filters lie sorted one after the other in a
    partition, and a task holds a few Arrow batches at once.
    """
    wide = pa.int32() if words**blocks <= 1 << 31 else pa.int64()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            start = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                for k in range(0, len(at), STEP):
                    some = at[k : k + STEP]
                    raw = flat[start[some, None] + np.arange(dims)]
                    keys = filters(unit_rows(raw), blocks, words, cap, least)
                    ends = np.cumsum([0] + [len(f) for f in keys]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)).cast(wide))
                    single = raw.astype(np.float32)
                    unit = pa.array([v.tobytes() for v in (single if np.array_equal(single.astype(float), raw) else raw)], pa.binary())
                    own = [batch.column(c).take(pa.array(some)) for c in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(some), dims, np.int32)), lists, unit], ["class", "label", "n", "least", "dims", "keys", "vector"])

    kind, id_ = (vectors.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    listed = f"class long, label {kind}, n long, least {id_}, dims int, keys array<{'int' if wide == pa.int32() else 'bigint'}>, vector binary"
    rows = write_shared(classes(vectors).select("class", "label", "e", "n", "least").mapInArrow(spread, listed))
    caps = rows.withColumn("key", F.explode("keys"))
    hot = checkpoint(caps.groupBy("label", "dims", "key").agg(F.count("*").alias("size")).where(F.col("size") > bucket))
    few = hot.limit(100_001).count() <= 100_000  # rows of four numbers each
    dealt = caps.join(F.broadcast(hot) if few else hot, ["label", "dims", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / bucket), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    # part p meets q in the pair (p, q) with p <= q
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(F.col("part"), q).alias("p"), F.greatest(F.col("part"), q).alias("q")))
    run = ["dims", "key", "p", "q"]
    dealt = dealt.withColumn("pair", F.explode(pair)).select("label", "dims", "key", "pair.p", "pair.q", "part", "class", "n", "keys", "vector")
    sorted_ = dealt.repartition("label", *run).sortWithinPartitions("label", *run, "class")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        """What whole runs of one number of dimensions give."""
        ids, n, key, part, p, q = (table[c].to_numpy() for c in ("class", "n", "key", "part", "p", "q"))
        dims, raw = int(table["dims"][0].as_py()), table["vector"].to_pylist()
        width = {len(v) for v in raw}
        if width == {4 * dims}:
            x = unit_rows(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dims).astype(float))
        else:
            x = unit_rows(np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dims else np.float64) for v in raw], float))
        i, j = close_pairs(x, bounds(table), part, p, q, cosine)
        if not len(i):
            return None
        own = table["keys"].combine_chunks()
        size, flat = own.value_lengths().to_numpy(), own.flatten().to_numpy()
        end = np.cumsum(size)
        lists = {r: flat[end[r] - size[r] : end[r]] for r in np.unique(np.concatenate([i, j])).tolist()}
        first = at_first_filter(i, j, key[i], lists)
        i, j = i[first], j[first]
        names, of = np.unique(ids, return_inverse=True)
        linked = np.bincount(of[i], n[j], len(names)) + np.bincount(of[j], n[i], len(names))
        a, b = spanning(of[i], of[j], len(names))
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[some], names[a]])), pa.array(np.concatenate([names[some], names[b]])), pa.array(np.concatenate([linked[some].astype(np.int64), np.zeros(len(a), np.int64)]))], ["a", "b", "linked"])

    def bounds(table: pa.Table) -> np.ndarray:
        """Where runs begin, and the number of rows."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in ("label", *run):
            codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for d in table["dims"].unique().to_pylist():
                if (out := compare(table.filter(pc.equal(table["dims"], d)))) is not None:
                    yield out

        for batch in batches:
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            last = int(bounds(held)[-2]) if held.num_rows else 0
            if last:  # the last run may go on in the next batch
                yield from done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held)

    found = checkpoint(sorted_.mapInArrow(meet, "a long, b long, linked long"))
    return rows, found.where("a = b").groupBy("a").agg(F.sum("linked").alias("linked")), found.where("a <> b").select("a", "b")


def near_duplicates(vectors: DataFrame, **how: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label); other columns are ignored.

    Vectors link where labels are equal and not null, numbers of dimensions are equal and the cosine is COSINE or
    more. Equal vectors always link. Vectors that are null, empty, zero or hold a null, NaN or infinity link with
    nothing and are their own component. Rows that repeat a vec_id count as vectors of their own.
    """
    rows, counts, edges = links(vectors, **how)
    labels = connected_components(edges)
    of = rows.join(counts, rows["class"] == counts.a, "left").join(labels, rows["class"] == labels.node, "left").select("class", "least", "n", F.coalesce(labels.label, "class").alias("comp"), F.coalesce("linked", F.lit(0)).alias("linked"))
    least = of.groupBy("comp").agg(F.min("least").alias("component"))
    of = of.join(least, "comp").select("class", "component", (F.col("linked") + F.col("n") - 1).alias("links"))
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = vectors.select("vec_id", F.when(ok, F.xxhash64("label", e)).alias("_class"))
    out = keyed.join(of, F.col("_class") == F.col("class"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and what is kept of every vector."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
