"""Personal data: spans found by pattern seed lexical contexts; scored contexts find identifiers that no pattern takes."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_shared

BASE = ("email", "ip", "card", "phone")
#: Order of kinds in results: the base kinds, then what contexts of each kind found.
KINDS = BASE + tuple(f"context_{k}" for k in BASE)

# Each run is consumed whole, so that no text costs more than its length.
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may be an identifier although no base pattern takes it.
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){4,7}(?![0-9A-Za-z:])")
_LOOSE_NUMBER = re.compile(r"[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

BITS = 22  # contexts looked for are marked in 2^22 bits, 512 kB, however many there are


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        s = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            e = s + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((s, e))
            s = e + 1
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by kind, then start; ends are exclusive."""
    return [(k, s, e) for k, f in (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones)) for s, e in f(text)]


def _loose_emails(text: str) -> list[tuple[int, int]]:
    """Places where @ or (at) stands between a name and a host; looked for around each sign, so that words cost nothing."""
    out, end = [], 0
    for sign in re.finditer(r"@|[(\[]at[)\]]", text, re.I):
        s = sign.start() - (sign.start() > end and text[sign.start() - 1] == " " and sign[0] != "@")
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _LOOSE_EMAIL.match(text, s) if s >= end else None
        if m and m.end() > sign.end():
            out.append(m.span())
            end = m.end()
    return out


def loose_spans(text: str) -> list[tuple[tuple[str, ...], int, int]]:
    """(kinds that it could be, start, end) of what looks like an identifier."""
    out = [(("email",), *s) for s in _loose_emails(text)]
    out += [(("ip",), *m.span()) for m in _LOOSE_IP.finditer(text) if any(c != ":" for c in m[0])] if ":" in text else []
    for m in _LOOSE_NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0]) if m.end() - m.start() >= 7 else 0
        kinds = (("card",) if 12 <= n <= 19 else ()) + (("phone",) if 7 <= n <= 15 else ())
        if kinds:
            out.append((kinds, *m.span()))
    return out


def _name(instance: str) -> str:
    return instance if len(instance) <= 48 else "#" + hashlib.sha256(instance.encode()).hexdigest()[:24]


def _short(word: str) -> str:
    """A word of a context, lower-cased; of one over 48 characters only the last 24 count."""
    return (word if len(word) <= 48 else "#" + word[-24:]).lower()


class _Before:
    """The two words before a place of a text; ^ stands for the text's begin. Words are looked up once a text."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def __call__(self, at: int) -> str:
        i = bisect.bisect_left(self.starts, at)
        last = [self._word(j, at) if j >= 0 else "^" for j in (i - 2, i - 1)]
        return " ".join(last)

    def _word(self, i: int, at: int) -> str:
        s, e = self.starts[i], min(self.ends[i], at)
        return _short(self.text[max(s, e - 49) : e])


def mentions(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, bool, int, int, str, str]]]:
    """(base spans, mentions). A mention is (kind, seed, start, end, instance, context); loose spans that meet a base span are left out."""
    base, loose = base_spans(text), loose_spans(text)
    if not base and not loose:
        return [], []
    before = _Before(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    out = [(k, True, s, e, _name(text[s:e].lower()), before(s)) for k, s, e in base]
    for kinds, s, e in loose:
        i = bisect.bisect_left(starts, e)
        if i and ends[i - 1] > s:
            continue
        name, context = _name(re.sub(r"[\x20().-]", "", text[s:e]).lower()), before(s)
        out += [(k, False, s, e, name, context) for k in kinds]
    return base, out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_MENTION = pa.list_(pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("s", pa.int32()), ("e", pa.int32()), ("instance", pa.string()), ("context", pa.string())]))
_MARKED = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<kind: string, seed: boolean, s: int, e: int, instance: string, context: string>>"


def marked(docs: DataFrame) -> DataFrame:
    """A row for each document: the base results and the mentions, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, doc_id, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                base, found = mentions(text or "")
                n = [sum(k == kind for k, _, _ in base) for kind in BASE]
                told = joined(base)
                out.append((row, doc_id, *n, hashlib.sha256(told.encode()).hexdigest(), told, [dict(zip(("kind", "seed", "s", "e", "instance", "context"), m, strict=True)) for m in found]))
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [_MENTION]
            cols = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _MARKED)


def context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, places: how often the words of each of ``contexts`` (context) stand in the texts, whatever follows.

    Contexts are marked in a bit set of fixed size, which goes to all tasks; a text sends on only those of its word
    pairs whose bit is set, counted, and a join keeps the true ones. Contexts beyond what the bits tell apart cost
    more rows, never a count.
    """
    spark = docs.sparkSession
    hit = contexts.select((F.crc32(F.col("context").cast("binary")) % (1 << BITS)).cast("int").alias("bit")).distinct()
    bits = np.zeros(1 << BITS, bool)
    bits[np.array([r["bit"] for r in hit.collect()], np.int64)] = True  # at most 2^BITS rows
    sent = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(sent.value, np.uint8)).tobytes()
        last, crc = (1 << BITS) - 1, zlib.crc32
        for b in batches:
            n: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                before, old = "^", "^ ^"
                if text and marks[crc(old.encode()) & last]:
                    n[old] = n.get(old, 0) + 1
                for word in _WORD.findall(text or ""):
                    word = _short(word)
                    pair = f"{before} {word}"
                    if marks[crc(pair.encode()) & last]:
                        n[pair] = n.get(pair, 0) + 1
                    before = word
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["context", "n"])

    counts = docs.select("text").mapInArrow(run, "context string, n long").groupBy("context").agg(F.sum("n").alias("places"))
    return contexts.join(counts, "context", "left").select("context", F.coalesce("places", F.lit(0)).cast("long").alias("places"))


def learn(mentioned: DataFrame, docs: DataFrame, least: int = 5, confidence: float = 0.7, rounds: int = 3) -> DataFrame:
    """(kind, context, score) of the contexts that are sure of a kind, from ``mentioned`` (kind, seed, instance, context).

    Instances and contexts are the two sides of a graph. Seeds score 1. A context's score for a kind is the scores
    of the mentions in it over (the places at which its words stand in the texts + 1); it counts with ``least``
    scored instances or more that differ, and ``confidence``. An unseen instance scores 1 - prod(1 - score) over its
    contexts that count, and so brings new contexts in the next round. ``rounds`` rounds, or until no context comes.
    """
    edges = mentioned.groupBy("kind", "context", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = write_shared(edges)
    # what can ever count: no context with fewer instances
    wide = edges.groupBy("kind", "context").agg(F.count("*").alias("instances"), F.sum("n").alias("mentions"), F.max("seed").alias("seeded")).where(F.col("instances") >= least)
    wide = write_shared(wide)
    places = context_counts(docs, wide.select("context").distinct())
    size = write_shared(wide.join(places, "context").select("kind", "context", F.greatest("mentions", "places").alias("all")))
    graph = write_shared(edges.join(size, ["kind", "context"]))
    scores, known = None, 0
    for _ in range(rounds):
        if scores is None:
            scored = graph.withColumn("score", F.col("seed").cast("double"))
        else:
            unseen = graph.where("not seed").join(scores.select("kind", "context", "score"), ["kind", "context"])
            # doubles are summed in the order of contexts: reruns agree to the last bit
            logs = F.aggregate(F.sort_array(F.collect_set(F.struct("context", "score"))), F.lit(1.0), lambda p, x: p * (1 - x["score"]))
            instance = unseen.groupBy("kind", "instance").agg((1 - logs).alias("found"))
            scored = graph.join(instance, ["kind", "instance"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        # scores in millionths add up alike in any order
        weight = F.sum(F.floor(F.col("score") * 1_000_000).cast("long") * F.col("n"))
        now = scored.where("score > 0").groupBy("kind", "context").agg(F.count("*").alias("instances"), weight.alias("w"), F.first("all").alias("all"))
        now = now.withColumn("score", F.col("w") / 1_000_000 / (F.col("all") + 1)).where((F.col("instances") >= least) & (F.col("score") >= confidence))
        scores = write_shared(now.select("kind", "context", "score"))
        n = scores.count()
        if n == known:
            break
        known = n
    return scores


def extract(docs: DataFrame, least: int = 5, confidence: float = 0.7, rounds: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs`` (doc_id, text; others are ignored).

    ``spans`` holds the base spans and those that a learned context found, as kinds context_email and so on; of found
    spans that overlap the one with the surer context stays (ties: the earlier kind). Null and empty texts have no
    spans, repeated rows give repeated results, rows without doc_id are kept, an empty table stays empty. A number
    repeated in many documents is one instance, so copies of a text teach no more than the text. Texts are read
    twice, by tasks that keep one text at a time; only mentions are shuffled, combined first.
    """
    spark = docs.sparkSession
    # a table that later joins read three times; rows stay as numbered
    rows = write_shared(marked(docs))
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    sure = learn(each.select("kind", "seed", "instance", "context"), docs, least, confidence, rounds)
    found = each.where("not seed").join(sure, ["kind", "context"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind", "score"))).alias("found"))
    both = rows.drop("mentions").join(found, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans.append(",".join(filter(None, (base, joined(choose(more or []))))))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(spans, pa.string())], [*b.schema.names[2:], "spans"])

    out = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    return both.select("base", "found", *out).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def choose(found: list[dict]) -> list[tuple[str, int, int]]:
    """Spans that don't overlap, surest first, as (kind, start, end) by kind and start."""
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (-x["score"], BASE.index(x["kind"]), x["s"])):
        i = bisect.bisect_left(out, (x["s"],))
        if (i < len(out) and out[i][0] < x["e"]) or (i and out[i - 1][1] > x["s"]):
            continue
        out.insert(i, (x["s"], x["e"], f"context_{x['kind']}"))
    return sorted(((k, s, e) for s, e, k in out), key=lambda x: (KINDS.index(x[0]), x[1]))


def op11_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return extract(read(spark, sf_dir, "documents"))
