"""Conversation repair: rows, edits and the grammar of roles are automata, composed lazily; the cheapest path of least label repairs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_shared

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Acceptor of (s?(ua)+)?: from each state the initials it takes. 0 is the start, 1 follows s, 2 waits for a, 3 has whole pairs.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
SOUND, GONE, CUT = 0, 1, 2  # a row's fault: none, one that requires Delete, truncated

Weight = tuple[int, str]


def inserts(state: int, most: int = 2) -> list[tuple[int, Weight]]:
    """States that up to ``most`` inserted turns reach, each once, with their weight: more only come back to one of them."""
    out, at, weight = [(state, (0, ""))], [(state, (0, ""))], (0, "")
    for _ in range(most):
        weight = (weight[0] + INSERT, weight[1] + "I")
        at = [(GRAMMAR[q][c], weight) for q, _ in at for c in ROLE if c in GRAMMAR[q]]
        out += [x for x in at if x[0] not in {q for q, _ in out}]
    return out


@functools.lru_cache(maxsize=4096)
def arcs(initial: str, fault: int) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, label) of the composition over one row: inserts before it, then its own edit.

    Arcs are composed when a kind of row is first met. Of two arcs between the same states only the lighter one stays.
    """
    best: dict[tuple[int, int], Weight] = {}
    for start in GRAMMAR:
        for q, (cost, label) in inserts(start):
            steps = [(q, DELETE, "D")]
            if fault != GONE:
                extra = TRUNCATED if fault == CUT else 0
                steps += [(GRAMMAR[q][initial], KEEP + extra, "K")] if initial in GRAMMAR[q] else []
                steps += [(GRAMMAR[q][c], REROLE + extra, "R") for c in ROLE if c in GRAMMAR[q]]
            for to, w, edit in steps:
                new = (cost + w, label + edit)
                best[start, to] = min(best.get((start, to), new), new)
    return tuple((a, b, *w) for (a, b), w in sorted(best.items()))


def advance(paths: dict[int, Weight], initial: str, fault: int) -> dict[int, Weight]:
    """Lightest weights by state after one more row. Labels end in the row's edit, so none of equal cost begins another."""
    out: dict[int, Weight] = {}
    for a, b, cost, label in arcs(initial, fault):
        if a in paths:
            new = (paths[a][0] + cost, paths[a][1] + label)
            if b not in out or new < out[b]:
                out[b] = new
    return out


def final(paths: dict[int, Weight]) -> Weight:
    """The lightest weight that ends in an accepting state, after inserts at the end."""
    return min((cost + w, label + t) for q, (cost, label) in paths.items() for to, (w, t) in inserts(q) if to in ACCEPTING)


@dataclass
class Piece:
    """What consecutive rows of a conversation come to; pieces add up in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    least: int | None = None
    most: int | None = None
    turns: int = 0
    paths: dict[int, dict[int, Weight]] = field(default_factory=dict)

    def take(self, initial: str, turn: int | None, blank: bool, seen: bool, cut: bool) -> None:
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        self._meet(initial)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        fault = GONE if blank or seen else CUT if cut else SOUND
        self.paths = {a: advance(p, initial, fault) for a, p in self.paths.items()}

    def _meet(self, initial: str) -> None:
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")

    def add(self, other: Piece) -> None:
        """Append the rows that ``other`` stands for."""
        for c in ("blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + getattr(other, c))
        if other.first is not None:
            self._meet(other.first)
            self.illegal += other.illegal
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if other.turns:
            self.turns += other.turns - (other.least == self.most)
            self.least, self.most = other.least if self.least is None else self.least, other.most
        joined = {a: [(b, t, (p[0] + w[0], p[1] + w[1])) for b, p in from_a.items() for t, w in other.paths[b].items()] for a, from_a in self.paths.items()}
        self.paths = {a: {t: min(w for _, u, w in ways if u == t) for t in {t for _, t, _ in ways}} for a, ways in joined.items()}


def start(states=(0,)) -> Piece:
    return Piece(paths={q: {q: (0, "")} for q in states})


_PIECE = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns")
_PATHS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("label", pa.string())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept after the fixed damage; rows that the damage drops stay with kept = false and no text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(h.isin(0, 1), "").when(h == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(h == 4, "user").otherwise(shown("role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (h != 0).alias("kept"), F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "kept", F.explode("copies").alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with faults and a ``place`` that ascends by conversation, turn (nulls first), role and text.

    Texts that agree in 32 characters go by hash. Equal rows are spread by a last key, so that no key, a conversation
    or a row repeated without end included, is one task's.
    """
    tail = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    out = rows.select("*", (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"), F.monotonically_increasing_id().alias("tie"))
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32), F.col("same"), F.col("tie")]
    return out.repartitionByRange(*key).sortWithinPartitions(*key).drop("tie").withColumn("place", F.monotonically_increasing_id())


def pieces(rows: DataFrame, block_bits: int) -> DataFrame:
    """conv_id, block and a piece for each run of a conversation's rows in a block of 2^block_bits places."""
    block = F.shiftright("place", block_bits).alias("block")
    kept = rows.where("kept")
    firsts = kept.groupBy("conv_id", "same").agg(F.min("place").alias("place"))
    none = lambda t: F.lit(None).cast(t)
    data = rows.select("conv_id", block, "place", F.lit(1).alias("kind"), F.left("role", F.lit(1)).alias("initial"), "turn", "kept", "blank", "cut")
    # a mark comes before the row that is the first of its role and text
    marks = firsts.select("conv_id", block, "place", F.lit(0).alias("kind"), none("string").alias("initial"), none("long").alias("turn"), *[none("boolean").alias(c) for c in ("kept", "blank", "cut")])
    stream = data.unionByName(marks).repartition("block").sortWithinPartitions("place", "kind")
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, mark, done = None, None, None, []

        def flush():
            cols = list(zip(*[(*k, *[getattr(p, c) for c in _COUNTS], [{"a": a, "b": b, "cost": w, "label": s} for a, to in p.paths.items() for b, (w, s) in to.items()]) for k, p in done], strict=True))
            types = [kind, pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, _PATHS]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "block", *_COUNTS, "paths"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, block, place, is_row, initial, turn, kept, blank, cut in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not is_row:
                    mark = place
                    continue
                if at != (conv_id, block):
                    # a conversation that begins inside the block can't come from another state than the start
                    begins = at is not None and at[1] == block
                    if now is not None:
                        done.append((at, now))
                    at, now = (conv_id, block), start((0,) if begins else tuple(GRAMMAR))
                if kept:
                    now.take(initial, turn, blank, place != mark, cut)
            if len(done) >= 1000:
                yield flush()
        if now is not None:
            done.append((at, now))
        if done:
            yield flush()

    return stream.mapInArrow(run, f"conv_id {conv}, block long, {_PIECE}, paths array<struct<a: int, b: int, cost: long, label: string>>")


def _read_piece(row: dict) -> Piece:
    p = Piece(**{c: row[c] for c in _COUNTS})
    for w in row["paths"]:
        p.paths.setdefault(w["a"], {})[w["b"]] = (w["cost"], w["label"])
    return p


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(parts: DataFrame) -> DataFrame:
    """conv_id and its counts, cost and audit: the pieces of a conversation, in order, composed to one path."""
    conv = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, now = False, None, start()

        def result() -> tuple:
            cost, audit = final(now.paths[0])
            gaps = now.most - now.least + 1 - now.turns if now.turns else 0
            return at, gaps, now.blank, now.duplicate, now.truncated, now.illegal, cost, audit

        for b in batches:
            done = []
            for row in b.to_pylist():
                if known and row["conv_id"] != at:
                    done.append(result())
                    now = start()
                known, at = True, row["conv_id"]
                now.add(_read_piece(row))
            kind = b.schema.field(0).type
            yield _rows(done, kind)
        if known:
            yield _rows([result()], kind)

    def _rows(done, kind) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *[pa.int64()] * 6, pa.string()], strict=True)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, f"conv_id {conv}, {_RESULT}")


class Repaired:
    """SHA-256 of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.sha = audit, 0, 0, False, hashlib.sha256()

    def _say(self, initial: str, role: str, text: str) -> None:
        self.state = GRAMMAR[self.state][initial]
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _next_role(self) -> str:
        return next(c for c in ROLE if c in GRAMMAR[self.state])

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            c = self._next_role()
            self._say(c, ROLE[c], "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role[0], role, text)
        elif edit == "R":
            c = self._next_role()
            self._say(c, ROLE[c], text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def hashed(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` with repaired_sha256. A conversation's rows pass one hash in order, as a stream; nothing of it is held but its audit."""
    names = results.columns[1:]
    none = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in names]
    head = results.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    stream = head.unionByName(rows.where("kept").select("conv_id", "place", "role", "text", *none)).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    types = results.schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types) + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, kinds = None, None, None
        for b in batches:
            kinds = [b.schema.field(0).type, *[b.schema.field(c).type for c in names], pa.string()]
            done = []
            places, convs, roles, texts = b.column(1).to_pylist(), b.column(0), b.column(2), b.column(3)
            for i, place in enumerate(places):
                if place < 0:
                    if now is not None:
                        done.append((*head, now.digest()))
                    head = (convs[i].as_py(), *[b.column(4 + j)[i].as_py() for j in range(len(names))])
                    now = Repaired(head[-1])
                else:
                    now.take(roles[i].as_py(), texts[i].as_py())
            if done:
                yield batch(done, kinds)
        if now is not None:
            yield batch([(*head, now.digest())], kinds)

    def batch(done, kinds) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *names, "repaired_sha256"])

    return stream.mapInArrow(run, schema)


def repair(conversations: DataFrame, block_bits: int = 12) -> DataFrame:
    """One row for each conv_id of ``conversations`` (conv_id, turn, role, text), after damage(): faults, cheapest repair and its hash.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null roles and texts
    are one space; a null turn sorts first and counts for no gap; rows with null conv_id are one conversation. Rows
    of equal turn go by role and text; repeated rows are duplicates. A role without a legal initial (the empty one
    too) can only be reroled or deleted. A conversation without rows after damage has zeros, an empty audit and the
    hash of the empty string; an empty table gives no rows. Other columns are ignored.

    Rows are sorted once over all tasks. Blocks of 2^``block_bits`` rows, of one conversation or many, are composed
    apart from each other, from each state of the grammar, so a conversation of any length is many tasks' work; what
    meets in one task are its blocks' edits, up to 11 bytes a row, of which the audit is one. Its hash is sequential
    by definition: its texts pass one task as a stream.
    """
    rows = write_shared(ordered(damaged(conversations)))
    return hashed(rows, audits(pieces(rows, block_bits)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged as the contract says, and repaired at least cost."""
    return repair(read(spark, sf_dir, "conversations"))


#: DuckDB has no CRC-32: its table is made here from the polynomial; the search goes row by row over all conversations.
OP13_SQL = r"""
WITH RECURSIVE
crc AS MATERIALIZED (SELECT [list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k FROM conversations),
hit AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, [ascii(k[i])::BIGINT FOR i IN range(1, len(k) + 1)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 h FROM raw, crc),
rows1 AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END r, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END x, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) copy
  FROM hit WHERE h <> 0),
rows2 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, copy) i, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY turn NULLS FIRST, copy) nth,
    right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1) tail
  FROM rows1),
r AS MATERIALIZED (
  SELECT conv_id, turn, i, r role, x text, r[1] c, tail = '' AS blank, tail <> '' AND nth > 1 AS dup, tail <> '' AND nth = 1 AND tail NOT IN ('.', '!', '?') AS cut,
    lag(r[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM rows2),
grammar(q, c, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins AS (
  SELECT q, q AS nq, 0 AS w, '' AS l FROM (VALUES (0), (1), (2), (3)) s(q)
  UNION ALL SELECT q, nq, 5, 'I' FROM grammar WHERE c <> 's'
  UNION ALL SELECT a.q, b.nq, 10, 'II' FROM grammar a JOIN grammar b ON a.nq = b.q WHERE a.c <> 's' AND b.c <> 's'),
edit AS MATERIALIZED (
  SELECT i.q, i.nq AS nq, i.w + 2 AS w, i.l || 'D' AS l, NULL AS needs, false AS stays FROM ins i
  UNION ALL SELECT i.q, g.nq, i.w, i.l || 'K', g.c, true FROM ins i JOIN grammar g ON i.nq = g.q
  UNION ALL SELECT i.q, g.nq, i.w + 1, i.l || 'R', NULL, true FROM ins i JOIN grammar g ON i.nq = g.q WHERE g.c <> 's'),
walk(conv_id, i, q, m) AS (
  SELECT conv_id, 0::BIGINT, 0, {'w': 0, 'l': ''} FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT walk.conv_id, any_value(r.i), e.nq, min({'w': (m).w + e.w + CASE WHEN r.cut AND e.stays THEN 5 ELSE 0 END, 'l': (m).l || e.l})
  FROM walk JOIN r ON r.conv_id = walk.conv_id AND r.i = walk.i + 1 JOIN edit e ON e.q = walk.q AND (e.needs IS NULL OR e.needs = r.c) AND NOT (e.stays AND (r.blank OR r.dup))
  GROUP BY walk.conv_id, e.nq),
ends AS (SELECT conv_id, max(i) n FROM r GROUP BY conv_id),
best AS (
  SELECT walk.conv_id, min({'w': (m).w + ins.w, 'l': (m).l || ins.l}) m
  FROM walk JOIN ends ON walk.conv_id = ends.conv_id AND walk.i = ends.n JOIN ins ON ins.q = walk.q AND ins.nq IN (0, 3) GROUP BY walk.conv_id),
step AS (SELECT conv_id, j, (m).l[j] e FROM (SELECT conv_id, m, unnest(range(1, len((m).l) + 1)) j FROM best)),
told AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS pos FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
opens AS (SELECT t.conv_id, bool_or(t.e = 'K' AND r.c = 's') s FROM told t JOIN r ON r.conv_id = t.conv_id AND r.i = t.i WHERE t.pos = 1 AND t.e <> 'D' GROUP BY t.conv_id),
said AS (
  SELECT t.conv_id, t.j, CASE WHEN t.e = 'K' THEN r.role WHEN (t.pos - CASE WHEN o.s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN t.e = 'I' THEN '' ELSE r.text END line
  FROM told t LEFT JOIN r ON r.conv_id = t.conv_id AND r.i = t.i LEFT JOIN opens o ON o.conv_id = t.conv_id WHERE t.e <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) body FROM said GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (blank) blank, count(*) FILTER (dup) dup, count(*) FILTER (cut) cut,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) illegal
  FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((m).w, 0)::BIGINT AS cost, coalesce((m).l, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN whole USING (conv_id)
"""
