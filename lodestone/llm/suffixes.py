"""Suffix-array deduplication: maximal repeats from the LCP-interval trees of sharded enhanced suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read, write_shared

#: Bytes of a repeat, and of the seed that shards are made by.
LEAST, SEED = 200, 64
#: Bytes worked on at once, starts in one segment at most, and bytes of a seed's segments in one suffix array.
CHUNK, RUN, HOT = 1 << 17, 4096, 250_000
#: Bits of a seed's hash that its place takes while the least is looked for.
PLACE = 19
SEGMENT = "start int, runs int, key long, seg long, own boolean"
U = np.uint64
B, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    """base ** i modulo 2^64 for i up to n."""
    out = np.ones(n + 1, np.uint64)
    have = 1
    while have <= n:
        m = min(have, n + 1 - have)
        out[have : have + m] = out[:m] * U(pow(base, have, 1 << 64))
        have += m
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(30))) * U(0xCA4BCAA75EC3F625)
    return h ^ (h >> U(29))


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of data[start:end]."""
    size = 1 << max(12, int(len(data)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table()[data] * _powers(size, B)[: len(data)])])
    return _mix((sums[ends] - sums[starts]) * _powers(size, INVERSE)[starts])


def segments(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(start, starts in it, key, hash, own) of the segments of texts that lie end to end in ``data``.

    The key of a string of ``least`` bytes is the least hash of its runs of ``seed`` bytes, so equal strings have
    equal keys. Strings with one key that start at consecutive places make a segment; each string is in just one.
    ``own`` tells that the first seed of that hash is not the same one in all strings of the segment; else no
    string of it can repeat inside it.
    """
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    if len(data) >= 1 << PLACE:
        raise ValueError("too many bytes at once")
    h, m = _table()[data], 1
    while m < seed:
        h = h[:-m] * U(pow(B, m, 1 << 64)) + h[m:]
        m *= 2
    # the hash, cut by some bits, and the place: the least is the leftmost of the least hashes
    low, m, width = (_mix(h) & ~U((1 << PLACE) - 1)) | np.arange(len(h), dtype=np.uint64), 1, least - seed + 1
    while 2 * m <= width:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if m < width:
        low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
    place, low = (low & U((1 << PLACE) - 1)).astype(np.int64), low & ~U((1 << PLACE) - 1)
    n = len(low)
    begin, end = bounds[:-1], np.maximum(bounds[1:] - least + 1, bounds[:-1])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(begin, n), 1)
    np.add.at(edge, np.minimum(end, n), -1)
    valid = np.cumsum(edge[:n]) > 0
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    new[begin[begin < n]] = True
    starts = np.flatnonzero(new & valid)
    if not len(starts):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
    runs = stop - starts
    if runs.max() > RUN:
        parts = -(-runs // RUN)
        rep = np.repeat(np.arange(len(runs)), parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, runs = starts[rep] + k * RUN, np.minimum(runs[rep] - k * RUN, RUN)
    return starts, runs, low[starts], substring_hashes(data, starts, starts + runs + least - 1), place[starts] < starts + runs - 1


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the texts; a text longer than CHUNK is worked on in pieces that overlap by LEAST - 1 bytes."""
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(2)]
        todo, size = [], 0

        def flush() -> pa.RecordBatch | None:
            data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in todo), np.uint8)
            bounds = np.cumsum([0] + [b - a for _, a, b in todo])
            starts, runs, key, seg, own = segments(data, bounds)
            if not len(starts):
                return None
            piece = np.searchsorted(bounds, starts, side="right") - 1
            row, base = np.array([i for i, _, _ in todo])[piece], np.array([a for _, a, _ in todo])[piece]
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((starts - bounds[piece] + base).astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(own)], ["doc_id", "rk", "start", "runs", "key", "seg", "own"])

        for i, t in enumerate(texts):
            for a in range(0, max(len(t) - LEAST + 1, 0), CHUNK):
                todo.append((i, a, min(a + CHUNK + LEAST - 1, len(t))))
                size += todo[-1][2] - a
                if size >= CHUNK:
                    if (out := flush()) is not None:
                        yield out
                    todo, size = [], 0
        if todo and (out := flush()) is not None:
            yield out


def suffix_array(data: np.ndarray, at: np.ndarray, left: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes that start at ``at`` and have ``left`` symbols, at least ``least`` each.

    Symbols are 1 to 256; a 0 stands behind each text, so that a suffix comes before all longer ones that begin with
    it. Suffixes are sorted to their whole length by ranks of blocks that double. lcp[i] is the length that suffixes
    i - 1 and i of the order share, ends minded.
    """
    n = len(data)
    pad = np.concatenate([data, np.zeros(8, data.dtype)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for j in range(7):
        word |= pad[j : n + 1 + j] << U(9 * (6 - j))
    ranks, top = {7: np.unique(word, return_inverse=True)[1].astype(np.uint64)}, 7
    while 2 * top < left.max():
        r = ranks[top]
        both = (r << U(32)) | np.concatenate([r[top:], np.zeros(min(top, n + 1), np.uint64)])
        top *= 2
        ranks[top] = np.unique(both, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort((ranks[top][at] << U(32)) | ranks[top][np.minimum(at + top, n)], kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    shared = np.zeros(len(a), np.int64)
    for size in (top, *sorted(ranks, reverse=True)):  # two of the longest blocks, one of each other length
        r = ranks[size]
        same = r[np.minimum(a + shared, n)] == r[np.minimum(b + shared, n)]
        shared[same] += size
    for _ in range(6):
        shared[(pad[np.minimum(a + shared, n)] == pad[np.minimum(b + shared, n)]) & (shared < n)] += 1
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.minimum(shared, np.minimum(left[order[:-1]], left[order[1:]]))
    return order, lcp


def maximal_intervals(lcp: list[int], before: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the LCP intervals of ``least`` or more whose suffixes are preceded by different bytes.

    One pass with a stack: an interval opens where the common prefix grows and closes where it shrinks, and takes
    the bytes before its suffixes along to the one that holds it. -1 (nothing before) differs from everything.
    """
    stack: list[list] = []  # length, first, set of bytes before
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first, seen = i - 1, {before[i - 1] if before[i - 1] >= 0 else -i}
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            own |= seen
            if len(own) > 1 and length >= least:
                yield length, first, i - 1
            seen = own if len(own) < 3 else set(list(own)[:3])
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] |= seen
            else:
                stack.append([now, first, seen])
        else:
            stack.clear()


def repeats(pieces: list[bytes], least: int = LEAST, nested: bool = False) -> list[list[tuple[int, int, int]]]:
    """For each piece the maximal repeats that start in it and have another start among the pieces: (start, end, group).

    Of nested intervals a suffix takes the longest, or all with ``nested``. Group is a hash of the repeated string.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = data.astype(np.uint16) + 1
    symbols[offset + sizes] = 0
    runs = np.maximum(sizes - least + 1, 0)
    if not runs.sum():
        return out
    owner = np.repeat(np.arange(len(pieces)), runs)
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    at = offset[owner] + inside
    order, lcp = suffix_array(symbols, at, sizes[owner] - inside, least)
    before = np.where(inside > 0, data[at - 1].astype(np.int64), -1)[order]
    # groups of suffixes that share ``least`` bytes; where all are preceded by one byte, no interval below is maximal
    first = np.flatnonzero(lcp < least)
    count = np.diff(np.append(first, len(lcp)))
    differ = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) | (np.minimum.reduceat(before, first) < 0)
    hits: list[tuple[int, int]] = []
    for g in np.flatnonzero((count > 1) & differ).tolist():
        lo, hi = int(first[g]), int(first[g] + count[g])
        longest = np.zeros(hi - lo, np.int64)
        for length, a, b in maximal_intervals([0, *lcp[lo + 1 : hi].tolist()], before[lo:hi].tolist(), least):
            if nested:
                hits += [(int(k), length) for k in order[lo + a : lo + b + 1]]
            else:
                longest[a : b + 1] = np.maximum(longest[a : b + 1], length)
        hits += [(int(k), int(n)) for k, n in zip(order[lo:hi][longest > 0], longest[longest > 0], strict=True)]
    if hits:
        k, n = np.array([x for x, _ in hits]), np.array([x for _, x in hits])
        names = substring_hashes(data, at[k], at[k] + n).view(np.int64)
        for p, s, e, g in zip(owner[k].tolist(), inside[k].tolist(), (inside[k] + n).tolist(), names.tolist(), strict=True):
            out[p].append((s, e, g))
    return out


COVER = "key long, seg long, begin array<int>, stop array<int>, grp array<long>"
COVER_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))


def _trees(batches: Iterator[pa.RecordBatch], nested: bool = False) -> Iterator[pa.RecordBatch]:
    """A suffix array for every few seeds: rows come sorted by key, and a key is not parted."""
    keys: list[int] = []
    segs: list[int] = []
    pieces: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(k, s, *map(list, zip(*r, strict=True))) for k, s, r in zip(keys, segs, repeats(pieces, nested=nested), strict=True) if r]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COVER_TYPES, strict=True)], ["key", "seg", "begin", "stop", "grp"])

    for batch in batches:
        for k, s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if size >= 2 * CHUNK and k != keys[-1]:
                yield flush()
                keys, segs, pieces, size = [], [], [], 0
            keys.append(k)
            segs.append(s)
            pieces.append(p)
            size += len(p)
    if keys:
        yield flush()


def _pack(parts: int):
    """Strings of segments of hot seeds by hash range: a row for each range and batch, strings packed in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            pieces = batch.column(2).to_pylist()
            sizes = np.array([len(p) for p in pieces])
            runs = np.maximum(sizes - LEAST + 1, 0)
            owner = np.repeat(np.arange(len(pieces)), runs)
            inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            at = (np.cumsum(sizes) - sizes)[owner] + inside
            h = substring_hashes(np.frombuffer(b"".join(pieces), np.uint8), at, at + LEAST)
            rec = np.empty(len(h), [("h", "u8"), ("key", "i8"), ("seg", "i8"), ("at", "i4")])
            rec["h"], rec["key"], rec["seg"], rec["at"] = h, batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner], inside
            place = (h % U(parts)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            names, first = np.unique(place[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([r.tobytes() for r in np.split(rec[order], first[1:])], pa.binary())], ["range", "strings"])

    return run


def _meet(group: pd.DataFrame, least: int = 2) -> pd.DataFrame:
    rec = np.concatenate([np.frombuffer(b, [("h", "u8"), ("key", "i8"), ("seg", "i8"), ("at", "i4")]) for b in group.strings])
    _, back, n = np.unique(rec["h"], return_inverse=True, return_counts=True)
    rec = rec[n[back] >= least]
    rec = rec[np.lexsort((rec["at"], rec["seg"], rec["key"]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rec["key"]) != 0) | (np.diff(rec["seg"]) != 0)])) if len(rec) else np.zeros(0, int)
    rows = [(int(r["key"][0]), int(r["seg"][0]), r["at"].astype(np.int32), (r["at"] + LEAST).astype(np.int32), r["h"].view(np.int64)) for r in (np.split(rec, new[1:]) if len(rec) else [])]
    return pd.DataFrame(rows, columns=["key", "seg", "begin", "stop", "grp"])


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and a hash of its content; rows equal in both are repeats of each other all over."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def _occurrences(docs: DataFrame, nested: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments whose seed occurs again, repeats in the distinct ones of them, all or the longest of each suffix)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _keyed(docs)
    segs = write_shared(texts.mapInArrow(_cut, f"doc_id {kind}, rk long, {SEGMENT}"))
    again = write_shared(segs.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own"), (F.min("seg") != F.max("seg")).alias("differ")).where("n > 1 or own").select("key", (F.col("differ") | F.col("own")).alias("differ")))
    segs = write_shared(segs.drop("own").join(again, "key"))
    # of equal segments one is cut out of its text
    one = segs.where("differ").groupBy("key", "seg").agg(F.min(F.struct("doc_id", "rk", "start", "runs")).alias("r"), F.count("*").alias("copies"))
    one = write_shared(one.select("r.*", "key", "seg", "copies"))
    hot = checkpoint(one.groupBy("key").agg(F.sum(F.col("runs") + LEAST - 1).alias("size"), F.sum("runs").alias("n")).where(F.col("size") > HOT).drop("size"))
    strings = hot.agg(F.sum("n")).first()[0] or 0
    if strings:
        few = hot.limit(100_001).count() <= 100_000  # rows of two numbers
        one = one.join(F.broadcast(hot) if few else hot, "key", "left")
    one = one.withColumn("hot", F.col("n").isNotNull() if strings else F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w["key"], w["seg"], t[w["start"] : w["start"] + w["runs"] + LEAST - 1]) for t, ws in zip(((x.as_py() or "").encode() for x in batch.column(0)), batch.column(1).to_pylist(), strict=True) for w in ws]
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "seg", "bytes"])

    def pieces(some: DataFrame) -> DataFrame:
        """Bytes of segments. All of this stays in one plan, so that the texts are shuffled once for every use of them."""
        wanted = some.groupBy(F.col("doc_id").alias("w_id"), F.col("rk").alias("w_rk")).agg(F.collect_list(F.struct("start", "runs", "key", "seg")).alias("wanted"))  # as many as a text has
        return texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("rk") == F.col("w_rk"))).select("text", "wanted").mapInArrow(cut, "key long, seg long, bytes binary")

    cover = pieces(one.where("not hot")).repartition("key").sortWithinPartitions("key").mapInArrow(partial(_trees, nested=nested), COVER)
    if strings:
        packed = pieces(one.where("hot")).mapInArrow(_pack(max(1, strings // 500_000)), "range int, strings binary")
        # for groups also strings that equal segments alone repeat; the rest has one occurrence and goes later
        met = packed.groupBy("range").applyInPandas(lambda g: _meet(g, 1 if nested else 2), COVER)
        cover = cover.unionByName(met.groupBy("key", "seg").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begin", "stop", "grp")]))
    # segments with an equal one repeat as a whole
    whole = one.where("copies > 1 and not hot" if nested else "copies > 1").select("key", "seg", F.array(F.lit(0)).alias("begin"), F.array((F.col("runs") + LEAST - 1).cast("int")).alias("stop"), F.array("seg").alias("grp"))
    return segs, cover.unionByName(whole)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """group, doc_id, start, length: the maximal repeats of LEAST bytes or more with all their occurrences; offsets in bytes.

    Every interval of the trees comes out with all its suffixes, nested ones too: a text in three documents that goes on
    alike in two of them makes two groups. Intervals end where segments end (some 70 starts). One whose occurrences all
    go on as the occurrences of another one, none more and none less, is joined with it, over any number of segments, so
    a repeat whose 200-byte strings all occur equally often comes out in one piece and whole. A longer repeat that holds
    a more frequent one is given in pieces, each with all its occurrences: before, within and after that one.
    A repeat of over CHUNK bytes from a text's start may also show without the occurrence that is parted there.

    Null texts count as empty; a repeated row is an occurrence of its own; an empty table gives no group; other columns
    are ignored. A text of one letter has a group for every length its segments allow.
    """
    segs, cover = _occurrences(docs, nested=True)
    alike = segs.where("not differ").select("doc_id", "rk", "start", F.col("seg").alias("group"), (F.col("runs") + LEAST - 1).alias("length"))
    # distinct, as an interval may be a whole segment too
    inside = cover.select("key", "seg", F.explode(F.arrays_zip("begin", "stop", "grp")).alias("x")).select("key", "seg", "x.*").distinct()
    part = segs.where("differ").join(inside, ["key", "seg"]).select("doc_id", "rk", (F.col("start") + F.col("begin")).alias("start"), F.col("grp").alias("group"), (F.col("stop") - F.col("begin")).alias("length"))
    found = write_shared(alike.unionByName(part))
    # what goes on alike: as many occurrences, and the same places; places are told by the sum of their hashes
    after = F.col("start") + F.col("length") - (LEAST - 1)
    place = lambda c: F.sum(F.xxhash64("doc_id", "rk", c).cast("decimal(20,0)"))
    sums = write_shared(found.groupBy("group").agg(F.count("*").alias("n"), place(F.col("start")).alias("at"), place(after).alias("next"), (F.max("length") - (LEAST - 1)).alias("runs")).where("n > 1"))
    follows = sums.select(F.col("group").alias("head"), "n", F.col("next").alias("at"), F.col("runs").alias("off"))
    up = sums.select("group", "n", "at").join(follows, ["n", "at"]).where("head <> group").groupBy("group").agg(F.min_by("head", "off").alias("head"), F.min("off").alias("off"))
    while True:  # pointers double, so rounds grow with the logarithm of a chain
        higher = up.select(F.col("group").alias("head"), F.col("head").alias("top"), F.col("off").alias("more"))
        step = write_shared(up.join(higher, "head", "left").select("group", F.coalesce("top", "head").alias("head"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("top").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    long = sums.join(up, "group", "left").groupBy(F.coalesce("head", "group").alias("group")).agg((F.max(F.coalesce("off", F.lit(0)) + F.col("runs")) + LEAST - 1).cast("int").alias("length"))
    return found.drop("length").join(long, "group").select("group", "doc_id", "start", "length")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of (doc_id, text); other columns are ignored.

    Every byte goes that a string of LEAST bytes covers which also starts anywhere else, in another row or this
    one. Null texts count as empty; a row that is repeated is a repeat of itself, and so is each of the two.
    """
    segs, cover = _occurrences(docs)
    alike = segs.where("not differ").select("doc_id", "rk", "start", F.array(F.lit(0)).alias("begin"), F.array((F.col("runs") + LEAST - 1).cast("int")).alias("stop"))
    part = segs.where("differ").join(cover.drop("grp"), ["key", "seg"]).select("doc_id", "rk", "start", "begin", "stop")
    spans = alike.unionByName(part).groupBy(F.col("doc_id").alias("s_id"), F.col("rk").alias("s_rk")).agg(F.collect_list(F.struct("start", "begin", "stop")).alias("spans"))  # as many as a text has
    both = _keyed(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("rk") == F.col("s_rk")), "left").select("doc_id", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, spans in zip(batch.column(1), batch.column(2), strict=True):
                t = (x.as_py() or "").encode()
                edge = np.zeros(len(t) + 1, np.int32)
                for s in spans.as_py() or ():
                    np.add.at(edge, np.array(s["begin"], np.int64) + s["start"], 1)
                    np.add.at(edge, np.array(s["stop"], np.int64) + s["start"], -1)
                gone = np.cumsum(edge)[: len(t)] > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((len(t), len(t) - len(kept), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeats."""
    return remove_repeats(read(spark, sf_dir, "documents"))
