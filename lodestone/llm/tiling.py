"""Benchmark decontamination: greedy string tiling of documents against benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

#: Shortest tile in words, and the share of an item that tiles must cover.
TILE, COVER = 5, 0.8
#: Characters of benchmark text in one block; a larger benchmark is gone through in several.
BLOCK_CHARS = 32_000_000
EDGES = "".join(map(chr, (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)))) + "¡¿«»“”‘’„…–—"
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and where each text's begin (one place more than texts).

    Words are lower-cased, parted by white space, and lose punctuation at both ends; what is nothing but
    punctuation goes. Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = pc.utf8_trim(lists.flatten(), characters=EDGES)
    keep = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return words.filter(pa.array(keep)), starts


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of k numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + x[j : j + n]
    return h


@dataclass
class Bench:
    """Items of one block: vocabulary, words of all items as numbers, and where each k-word seed occurs."""

    vocabulary: pa.Array
    ids: np.ndarray
    starts: np.ndarray
    names: list
    seeds: np.ndarray  # hashes, sorted
    places: np.ndarray  # of each seed, in ids
    items: np.ndarray  # of each seed


def index(names: list, texts: list[str | None], k: int = TILE) -> Bench:
    """Items with fewer than k words have no seed and match nothing."""
    words, starts = words_of(pa.array(texts, pa.string()))
    vocabulary = words.unique()
    ids = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    h = rolling(ids, k)
    item = np.searchsorted(starts, np.arange(len(h)), side="right") - 1
    inside = np.arange(len(h)) + k <= starts[item + 1]
    at = np.flatnonzero(inside)
    at = at[np.argsort(h[at], kind="stable")]
    return Bench(vocabulary, ids, starts, names, h[at], at, item[at])


def _window_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the Karp-Rabin hash of any run: before each number, and the powers of BASE."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    power = np.ones(len(ids) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(ids), BASE, np.uint64), out=power[1:])
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(ids)], dtype=np.uint64)]), power


def _hashes_at(sums: np.ndarray, power: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    # each hash is lifted to the highest power, so that equal runs at different places are equal
    return (sums[at + n] - sums[at]) * power[len(power) - 1 - at]


def tiles(doc: np.ndarray, item: np.ndarray, doc_places: np.ndarray, item_places: np.ndarray, k: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of non-overlapping common runs, longest first.

    ``doc_places`` and ``item_places`` are the sorted places where seeds of k words begin that both hold; every
    match begins at one of each. Again and again the greatest length is sought at which a free run of either has
    the same running Karp-Rabin hash (a shared run of n words has shared runs of all lengths from k to n, so
    halving finds it), and matches of that length are marked in order of their place in the item, each with the
    first free place in the document. Words are compared before a match is marked. Every length is gone through
    once, in time that follows the places, however often words repeat.
    """
    if not len(doc_places) or not len(item_places):
        return []
    skip = int(doc_places[0])  # matches lie between the first place and the end of the last
    doc = doc[skip : int(doc_places[-1]) + k]
    both, shift = np.concatenate([doc, [-1], item]), len(doc) + 1
    here, there = doc_places - skip, item_places + shift
    sums, power = _window_hashes(both)
    used = np.zeros(len(both) + 1, bool)
    used[[len(doc), -1]] = True
    out, most = [], min(len(doc), len(item))

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = (p[stop[p] - p >= n] for p in (here, there))
        ha, hb = _hashes_at(sums, power, a, n), _hashes_at(sums, power, b, n)
        in_a, in_b = np.isin(ha, hb), np.isin(hb, ha)
        return a[in_a], ha[in_a], b[in_b], hb[in_b]

    while most >= k and not used[shift:].all():
        taken = np.flatnonzero(used)
        stop = taken[np.searchsorted(taken, np.arange(len(used)))]  # the first used word from each place on
        lo, hi = k - 1, min(most, int((stop[here] - here).max()), int((stop[there] - there).max()))
        while lo < hi:
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if len(shared(n)[0]) else (lo, n - 1)
        if lo < k:
            break
        n, most = lo, lo - 1
        a, ha, b, hb = shared(n)
        order = np.lexsort((a, ha))
        a, ha = a[order].tolist(), ha[order]
        next_of = dict(zip(hb.tolist(), np.searchsorted(ha, hb, "left").tolist(), strict=True))
        end_of = dict(zip(hb.tolist(), np.searchsorted(ha, hb, "right").tolist(), strict=True))
        for y, h in zip(b.tolist(), hb.tolist(), strict=True):
            if used[y] or used[y + n - 1]:
                continue
            # marks of this length hide a place for good; a run of the same hash but other words only for this y
            while next_of[h] < end_of[h] and (used[a[next_of[h]]] or used[a[next_of[h]] + n - 1]):
                next_of[h] += 1
            for x in a[next_of[h] : end_of[h]]:
                if not (used[x] or used[x + n - 1]) and np.array_equal(both[x : x + n], both[y : y + n]):
                    out.append((x + skip, y - shift, n))
                    used[x : x + n] = used[y : y + n] = True
                    break
    return out


def matches(bench: Bench, texts: pa.Array, k: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, words covered, words of the item) of each text and item that share a seed."""
    words, starts = words_of(texts)
    if not len(bench.seeds) or not len(words):
        return
    ids = pc.fill_null(pc.index_in(words, value_set=bench.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.zeros(0, np.int64)
    if not len(at):
        return
    h = np.zeros(len(at), np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    for j in range(k):
        h = h * BASE + x[at + j]
    row = np.searchsorted(starts, at, side="right") - 1
    seed = np.minimum(np.searchsorted(bench.seeds, h), len(bench.seeds) - 1)
    ok = (bench.seeds[seed] == h) & (at + k <= starts[row + 1])
    # words of the seed and of its first place in the benchmark; places of one hash are taken to hold the same words
    ok[ok] = (ids[at[ok][:, None] + np.arange(k)] == bench.ids[bench.places[seed[ok]][:, None] + np.arange(k)]).all(axis=1)
    at, row, h = at[ok], row[ok], h[ok]
    for r in np.unique(row):  # texts with seeds only
        own = slice(*np.searchsorted(row, [r, r + 1]))
        mine, places = h[own], at[own] - starts[r]
        # each seed once, however often the text repeats it
        distinct = np.unique(mine)
        lo, hi = np.searchsorted(bench.seeds, distinct, "left"), np.searchsorted(bench.seeds, distinct, "right")
        n = hi - lo
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = hit[np.argsort(bench.items[hit], kind="stable")]
        doc = ids[starts[r] : starts[r + 1]]
        cut = np.flatnonzero(np.diff(bench.items[hit])) + 1
        for some in np.split(hit, cut):
            i = bench.items[some[0]]
            item = bench.ids[bench.starts[i] : bench.starts[i + 1]]
            got = tiles(doc, item, places[np.isin(mine, bench.seeds[some])], np.sort(bench.places[some]) - bench.starts[i], k)
            yield int(r), int(i), sum(t[2] for t in got), len(item)


def _blocks(benchmark: DataFrame, k: int, block_chars: int) -> Iterator[Bench]:
    """The benchmark's index in blocks of at most about ``block_chars`` characters; a longer item is a block of its own."""
    sized = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(sized.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for b in range(blocks):
        some = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = some.orderBy("item_id", "text").collect()
        yield index([r.item_id for r in rows], [r.text for r in rows], k)


def overlaps(docs: DataFrame, benchmark: DataFrame, k: int = TILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_covered, n_item, coverage for documents and items that share k words in a row.

    The benchmark is the stated query set: it goes to every task in blocks of a bounded size, and each block meets
    all documents. Documents are never shuffled. Null texts have no words; rows with null ids take part. Repeated
    rows give repeated results.
    """
    kind, name = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = pa.string() if name == "string" else pa.int64()
    out = None
    for bench in _blocks(benchmark, k, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for part in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
                got = list(matches(bench, part.column(1), k))
                if got:
                    r, i, n, m = (np.array(v) for v in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array([bench.names[j] for j in i], item_type), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(n / m)], ["doc_id", "item_id", "n_covered", "n_item", "coverage"])

        found = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id {'string' if name == 'string' else 'long'}, n_covered long, n_item long, coverage double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, k: int = TILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, of which no benchmark item is covered to ``cover`` or more. No shuffle.

    Null and empty texts hold no item and stay, repeated rows go or stay alike, and an empty table stays empty; with
    an empty benchmark all rows stay.
    """
    at = docs.columns.index("text")
    for bench in _blocks(benchmark, k, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
                bad = {r for r, _, n, m in matches(shared.value, part.column(at), k) if n >= cover * m}
                yield part.filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, **how: int) -> DataFrame:
    """One row per doc_id of ``docs``: doc_id, item_id, coverage, n_items, contaminated.

    item_id is the item of which tiles cover most (the smallest id of equals; null if no item shares k words),
    n_items how many items are covered to ``cover`` or more; with one or more the document is contaminated.
    """
    best = F.min_by(F.struct("item_id", "coverage"), F.struct(-F.col("coverage"), "item_id"))
    per = checkpoint(overlaps(docs, benchmark, **how)).groupBy("doc_id").agg(best.alias("b"), F.count_distinct(F.when(F.col("coverage") >= cover, F.col("item_id"))).alias("n_items"))
    per = per.select(F.col("doc_id").alias("_id"), "b.item_id", "b.coverage", "n_items")
    ids = docs.select("doc_id").distinct()
    return ids.join(per, ids.doc_id.eqNullSafe(F.col("_id")), "left").select("doc_id", "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the benchmark item of which its text covers most."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
