"""Near copies by word shingles: close fingerprints and min-hash bands bring candidates together, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components
from .simhash import link

#: Words of a shingle, and the similarity from which documents are copies.
WORDS, SIMILAR = 5, 0.8
#: Bits in which fingerprints of candidates differ at most.
REACH = 2
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8, over 0.99998 at 0.85.
BANDS, ROWS = 24, 6
#: Sets, and hashes in them, in one block of a comparison.
BLOCK, VOLUME = 2048, 2_000_000
#: Hashes that min-hashes are taken of at once, and bytes of text that are cut into words at once.
STEP, TEXT = 512, 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sets(texts: pa.Array, k: int, seed: int) -> list[np.ndarray]:
    whole = pa.concat_arrays([texts.cast(pa.large_string())])  # ascii_lower misreads a cast slice
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    flat = words.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(some)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    of = np.array([xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
    w = of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.uint64)
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for j in range(k):
        h = h * BASE + w[j : j + len(h)]
    h, out = _mix(h), []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(h[lo : hi - k + 1]))
        else:  # all words in one shingle
            one = np.array([hi - lo], np.uint64)
            for x in w[lo:hi]:
                one = one * BASE + x
            out.append(_mix(one) if hi > lo else np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int = WORDS, seed: int = 42) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word k-shingles; fewer words than k make one shingle.

    A-Z are lower-cased; words are what stands between space, tab, LF, VT, FF and CR. Each distinct word is hashed
    once, and a shingle is the polynomial of its words' hashes.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT, "right")))
        yield from _sets(texts.slice(at, to - at), k, seed)
        at = to


def name(hashes: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


@lru_cache(maxsize=4)
def _orders(seed: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(seed).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
    return a | np.uint32(1), b


def band_keys(hashes: np.ndarray, seed: int = 42) -> list[int]:
    """One signed long for each band of the set's min-hashes, of 32 bits each; none for the empty set."""
    if not len(hashes):
        return []
    a, b = _orders(seed)
    high, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, ~np.uint32(0))
    for at in range(0, len(high), STEP):
        part = a * high[at : at + STEP]
        part += b
        np.minimum(least, part.min(axis=1), out=least)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), n)).view(np.int64)) for n, r in enumerate(least.reshape(BANDS, ROWS))]


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of the set as a signed long: a bit is 1 if set in over half the hashes; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def linked(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """For each set a member of its component by pairs of that Jaccard similarity or more; what is linked isn't compared again."""
    size = np.array([len(s) for s in sets], np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(size)[:-1])
    held, comp = np.zeros(len(names), bool), np.arange(len(sets))
    for i in range(len(sets) - 1):
        todo = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (np.minimum(size[i + 1 :], size[i]) >= similar * np.maximum(size[i + 1 :], size[i])))
        if not len(todo):
            continue
        held[parts[i]] = True
        both = np.add.reduceat(held[np.concatenate([parts[j] for j in todo])], np.concatenate([[0], np.cumsum(size[todo])[:-1]]), dtype=np.int64)
        held[parts[i]] = False
        for j in todo[both >= similar * (size[todo] + size[i] - both)].tolist():
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
    return comp


def candidates(sets: DataFrame, reach: int = REACH) -> DataFrame:
    """node, label: the sets (columns ``set``, ``fp``, ``bands``) that close fingerprints or shared bands join.

    Every pair whose fingerprints differ in ``reach`` bits or fewer, found through vantage-point trees, and every
    pair that shares a band has one label.
    """
    keys = sets.select("set", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("set").alias("a"), F.max("set").alias("last")).where("a <> last").select("band", "a")
    edges = keys.join(shared, "band").select("a", F.col("set").alias("b"))
    # sets of equal fingerprint hang on the least of them, and trees link the fingerprints
    prints = checkpoint(sets.groupBy("fp").agg(F.min("set").alias("a"), F.max("set").alias("last")))
    equal = sets.select("fp", "set").join(prints.where("a <> last").select("fp", "a"), "fp").select("a", F.col("set").alias("b"))
    near = link(prints.select("fp"), reach).withColumnsRenamed({"a": "x", "b": "y"})
    of = prints.select(F.col("fp").alias("x"), "a"), prints.select(F.col("fp").alias("y"), F.col("a").alias("b"))
    return connected_components(edges.unionByName(equal).unionByName(near.join(of[0], "x").join(of[1], "y").select("a", "b")))


def near_copies(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR, reach: int = REACH, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """doc_id, component_id for each row of (doc_id, text); component_id is the smallest doc_id that links reach.

    Documents link where the Jaccard similarity of their sets of word shingles is ``similar`` or more; texts without
    words link with each other. Equal sets count once, whatever the number of copies. Candidates are what
    ``candidates`` joins; they are compared exactly; a group of them over ``block`` or ``volume`` is dealt out in
    blocks, and a task compares two. Rows with a null doc_id take part; a component of such rows only has a null
    component_id. Repeated rows are repeated, an empty table gives an empty result, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(name(h), simhash(h), band_keys(h)) for h in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.int64()))], ["doc_id", "set", "fp", "bands"])

    rows = checkpoint(docs.select("doc_id", "text").mapInArrow(signed, f"doc_id {kind}, set long, fp long, bands array<long>"))
    sets = checkpoint(rows.groupBy("set").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    groups = checkpoint(candidates(sets, reach).join(sets.select(F.col("set").alias("node"), "least"), "node"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = list(shingle_sets(batch.column(0), k))
            yield pa.RecordBatch.from_arrays([pa.array([name(h) for h in all_], pa.int64()), pa.array([len(h) for h in all_], pa.int64()), pa.array([h.tobytes() for h in all_], pa.binary())], ["set", "n", "hashes"])

    # the texts of the sets that have candidates; a doc_id may repeat with other texts, and a set may have no doc_id
    wanted = groups.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    some = docs.where("doc_id is not null").join(wanted, "doc_id", "left_semi").select("text").unionByName(docs.where("doc_id is null").select("text"))
    held = some.mapInArrow(hashed, "set long, n long, hashes binary").join(groups.select(F.col("node").alias("set"), "label"), "set").dropDuplicates(["set"])
    held = checkpoint(held)
    sizes = held.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / volume)).cast("int").alias("parts"))
    # groups of one block need no entry; a group over it may hold many of all rows, so it is dealt by block, not by label
    hot = checkpoint(sizes.where("parts > 1"))
    few = hot.limit(100_001).count() <= 100_000
    dealt = held.join(F.broadcast(hot) if few else hot, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(F.col("part"), q).alias("p"), F.greatest(F.col("part"), q).alias("q")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select("label", "pair.p", "pair.q", "parts", "set", "hashes")
    dealt = dealt if few else dealt.repartition("label", "p", "q")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["set"].tolist()
        roots = linked([np.frombuffer(h, np.uint64) for h in group.hashes], similar)
        found = [(ids[r], ids[i]) for i, r in enumerate(roots) if (roots == r).sum() > 1]
        out = pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        return out.assign(whole=bool(group.parts.iloc[0] == 1))

    found = checkpoint(dealt.groupBy("label", "p", "q").applyInPandas(compare, "a long, b long, whole boolean"))
    # a group in one block is done; blocks of the others still have to be joined
    labels = connected_components(found.where("not whole")).unionByName(found.where("whole").select(F.col("b").alias("node"), F.col("a").alias("label")))
    of = sets.join(labels, sets.set == labels.node, "left").select("set", F.coalesce("label", "set").alias("label"), "least")
    ids = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = checkpoint(of.join(ids, "label").select("set", "component_id"))
    return rows.join(of, "set").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **how: float) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each group of near copies; rows that repeat a doc_id count once.

    Rows with a null doc_id are kept, as no id says which of them is the smallest.
    """
    kept = near_copies(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
