"""Secret scans: a trigram inverted index narrows each rule to candidate documents; regexes then verify. DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: A private key runs to its END line or, where that is missing, to the end of its base64 lines; lines may be joined by
#: spaces or by escapes such as backslash n. Character classes repeat without bound, groups don't: Java's would use its stack.
_HEADERS, _BASE64 = r"(?:\s*[A-Za-z-]+:[^\r\n]*){0,8}", r"[A-Za-z0-9+/=\s\\]*[A-Za-z0-9+/]{40,}={0,2}(?:[\s\\nr]+[A-Za-z0-9+/]*={1,2}|[\r\n]+[A-Za-z0-9+/]+(?![^\r\n]))?"
_KEY_BODY = rf"(?:[^-]*(?:-(?!----)[^-]*){{0,100}}-----END [A-Z ]*PRIVATE KEY-----|{_HEADERS}{_BASE64})?"
MORE = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_KEY_BODY}"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abpr]-[A-Za-z0-9-]{20,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]{6,}@"),
)
RULES = BASE + MORE
#: Longest class of characters that is spelled out, and most strings at once.
CLASS, STRINGS = 8, 64

Query = frozenset[frozenset[str]]  # an OR of ANDs of trigrams
ANY: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    """Without the alternatives that another one covers."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _all(*qs: Query) -> Query:
    out = ANY
    for q in qs:
        both = _least(frozenset(a | b for a in out for b in q))
        out = both if len(both) <= STRINGS else min(out, q, key=len)
    return out


def _of(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """All strings that the items match, if they are few, and what else must hold."""
    run, need, whole = frozenset([""]), ANY, True
    for op, arg in items:
        name, exact, sub = str(op), None, ANY
        if name == "LITERAL":
            exact = frozenset([chr(arg).lower()])
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            chars = {chr(c).lower() for o, v in arg for c in ([v] if str(o) == "LITERAL" else range(v[0], min(v[1], v[0] + 200) + 1))}
            exact = frozenset(chars) if len(chars) <= CLASS else None
        elif name == "AT":
            exact = frozenset([""])
        elif name == "SUBPATTERN":
            exact, sub = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            else:
                sub = _least(frozenset().union(*(_all(q, _of(e)) if e is not None else q for e, q in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            e, q = _walk(inner)
            if (low, high) == (0, 1) and e is not None:
                exact = e | {""}
            elif low == high == 1:
                exact, sub = e, q
            elif low:
                sub = q if e is None else _of(frozenset(map("".join, product(e, repeat=min(low, 3))))) if len(e) ** min(low, 3) <= STRINGS else ANY
        if exact is not None and len(run) * len(exact) <= STRINGS:
            run = frozenset(a + b for a in run for b in exact)
            need = _all(need, sub)
        else:
            need = _all(need, _of(run), sub, _of(exact) if exact is not None else ANY)
            run, whole = frozenset([""]), False
    return (run, need) if whole else (None, _all(need, _of(run)))


def trigram_query(pattern: str) -> Query:
    """Trigrams, lower-cased, of which every text with a match holds all of one alternative; ANY if none is mandatory."""
    exact, need = _walk(sre.parse(pattern))
    return need if exact is None else _all(need, _of(exact))


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """doc_id, trigram: the inverted index, of the trigrams that rules ask for."""
    low = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, rules: the indexed rules whose trigram query the document's postings meet.

    Postings of one alternative are intersected as bits that an aggregate brings together, in the task that made
    them first. The table of queries has a row for each trigram of a rule; its size follows the rules alone.
    """
    spark = docs.sparkSession
    rows = [(r.kind, f"{r.kind}{n}", t, 1 << i, (1 << len(a)) - 1) for r in rules for n, a in enumerate(_ways(r)) for i, t in enumerate(a)]
    if not rows:
        return docs.select("doc_id", F.array().cast("array<string>").alias("rules")).limit(0)
    table = spark.createDataFrame(rows, "rule string, way string, trigram string, bit long, full long")
    met = postings(docs, sorted({r[2] for r in rows})).join(F.broadcast(table), "trigram").groupBy("doc_id", "rule", "way", "full").agg(F.bit_or("bit").alias("got")).where("got = full")
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _ways(rule: Rule) -> list[list[str]]:
    """The alternatives of the rule's trigram query; none for a rule without mandatory trigrams."""
    query = trigram_query(rule.pattern)
    return [] if frozenset() in query else sorted(sorted(a) for a in query)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(items: Column) -> Column:
    """An array cut in about the square root of its size parts of as many items, so that sums along it stay cheap."""

    def cut(both: Column) -> Column:
        items, step = both["items"], both["step"]
        return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), step), lambda at: F.slice(items, at, step))).otherwise(F.array())

    step = lambda x: F.greatest(F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"), F.lit(1))
    return _let(items, lambda x: _let(F.struct(x.alias("items"), step(x).alias("step")), cut))


def _before(totals: Column, start: Column, add) -> Column:
    """For each total what ``add`` makes of ``start`` and the totals before it."""
    return F.aggregate(totals, F.array(start), lambda acc, t: F.concat(acc, F.array(add(F.element_at(acc, -1), t))))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs of start, order, kind, end; code points, end exclusive.

    The gaps between matches and the matches give the places: their lengths are summed up along parts of the array
    first, so that the work doesn't grow with the square of the number of matches.
    """
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    found = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h["hit"]).alias("n"), F.length(h["value"]).alias("v")))
    span = "array<struct<start:int,order:int,kind:string,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        one = F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end"))
        return F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["v"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(span).alias("out"))

    def inside(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(span).alias("out")), step, lambda acc: acc["out"])

    def along(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
        return F.flatten(F.zip_with(parts, F.slice(_before(totals, F.lit(0), lambda x, t: x + t), 1, F.size(parts)), inside))

    return _let(_parts(found), along)


def _likely(text: Column, rule: Rule) -> Column:
    """A cheap test that every text with a match of the needed length passes.

    Only of literal characters before one repeated class is the length of a match known from the pattern.
    """
    plain = re.fullmatch(r"([A-Za-z0-9_\x20]*)(\[[^\[\]\\&]+\])\+", rule.pattern) if rule.group == 0 else None
    if plain:
        head, last = plain.groups()
        return text.rlike(f"{head}{last}{{{max(rule.least - len(head), 1)},}}")
    return text.rlike(rule.pattern)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with a column ``spans``: array of (start, order, kind, end), by start and then order of the rules.

    Rules without mandatory trigrams are tried on every text where it stands; the others only on documents that the
    index gives. The candidates, ids and kinds only, are broadcast if there are ``broadcast_rows`` or fewer; beyond
    that, rows whose text holds all trigrams of some rule are joined with them by a shuffle, and no other text
    moves. Null and empty texts have none. Rows that repeat a doc_id share candidates but are verified one by one;
    rows without doc_id are tried with every rule. An empty table gives an empty result. Other columns are carried
    along whatever their names; one named spans is replaced.
    """
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    held = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "spans"]).alias("row"))
    ways = [w for r in rules for w in _ways(r)]
    if ways:
        found = checkpoint(candidates(docs, rules).withColumnRenamed("doc_id", "_id"))
        few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
        if few:
            both = held.join(F.broadcast(found), F.col("doc_id") == F.col("_id"), "left")
        else:
            low = F.lower("text")
            may = F.coalesce(F.col("doc_id").isNotNull() & F.exists(F.array(*[F.forall(F.array(*[F.contains(low, F.lit(t)) for t in w]), lambda x: x) for w in ways]), lambda x: x), F.lit(False))
            rest = held.where(~may).select("*", F.lit(None).cast("array<string>").alias("rules"))
            both = held.where(may).join(found, F.col("doc_id") == F.col("_id"), "left").drop("_id").unionByName(rest)
    else:
        both = held.withColumn("rules", F.lit(None).cast("array<string>"))
    text, parts = F.coalesce("text", F.lit("")), []
    for n, r in enumerate(rules):
        tried = F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", r.kind), F.lit(False)) if _ways(r) else F.lit(True)
        parts.append(F.when(tried & _likely(text, r), _spans(text, r, n)).otherwise(none))
    return both.select("row", F.array_sort(F.concat(*parts)).alias("spans")).select("row.*", "spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]", piece: int = 1024) -> DataFrame:
    """``docs``, all columns, with every span of its text replaced by ``mark``; spans that overlap share one.

    Null texts stay null, an empty table stays empty, repeated rows stay. The text is cut into pieces of ``piece``
    code points first, and what is kept is read from the pieces, so that the work follows the text's length.
    """
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    spans, text = F.col("spans"), F.col("text")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def between(cut: Column, lo: Column, hi: Column) -> Column:
        """Characters lo to hi of the text."""
        first, last = F.floor(lo / piece).cast("int"), F.floor((hi - 1) / piece).cast("int")
        return F.when(hi > lo, F.substring(F.array_join(F.slice(cut, first + 1, last - first + 1), ""), lo - first * piece + 1, hi - lo)).otherwise(F.lit(""))

    def step(cut: Column):
        def one(acc: Column, s: Column) -> Column:
            kept = F.when(s["start"] >= acc["at"], F.array(F.concat(between(cut, acc["at"], s["start"]), F.lit(mark)))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(acc["out"], kept).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return one

    def inside(cut: Column):
        return lambda part, at: F.aggregate(part, F.struct(F.array().cast("array<string>").alias("out"), at.alias("at")), step(cut), lambda acc: F.array_join(acc["out"], ""))

    def clean(both: Column) -> Column:
        parts, cut = both["parts"], both["cut"]
        ends = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, s: F.greatest(acc, s["end"])))
        at = _before(ends, F.lit(0), lambda x, e: F.greatest(x, e))
        head = F.array_join(F.zip_with(parts, F.slice(at, 1, F.size(parts)), inside(cut)), "")
        rest = F.element_at(at, -1)
        return F.concat(head, between(cut, rest, F.greatest(rest, F.length(text))))

    done = scan(packed, rules).withColumn("clean", F.when(F.size(spans) > 0, _let(F.struct(_parts(spans).alias("parts"), pieces.alias("cut")), clean)).otherwise(text))
    return done.select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base rules' spans and all spans of every document, as ``scan`` finds them."""
    got = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
