"""Chat formatting: quoted passages are linked to the messages they come from, and conversations put in reply order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

QUOTE = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
#: Lines that announce a quote; they go with it if a quoted line follows.
ANNOUNCES = re.compile(r"^\s*(?:on\b.{1,200}\bwrote|le\b.{1,200}\ba écrit|am\b.{1,200}\bschrieb\b.{0,80}|el\b.{1,200}\bescribió)\s*:\s*$", re.I)


#: Sentences end here, once blanks are made one; shorter ones than LEAST_WORDS are too common to tell where they are from.
SENTENCE, LEAST_WORDS = re.compile(r"(?<=[.!?…。！？])\s+"), 3


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """(text without quotes, quoted passages): a passage is its nesting level and its lines.

    The level of a line is the number of > it begins with, blanks between them allowed. Lines of one level that
    follow each other make a passage; a blank line ends it. Without a quote the text is returned as it is.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level_before, removed = 0, False
    for line in (text or "").split("\n"):
        m = QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            removed = True
            if not level_before:
                while own and not own[-1].strip():
                    own.pop()
                if own and ANNOUNCES.match(own[-1]):
                    own.pop()
            body = line[m.end() :].strip()
            if not body:
                level = level or 1
                level_before = -level  # the next line of this level begins a passage
                continue
            if level != level_before:
                passages.append((level, []))
            passages[-1][1].append(body)
        level_before = level
    return ("\n".join(own).strip("\n") if removed else (text or "")), passages


def sentences(text: str) -> list[str]:
    """Sentences of LEAST_WORDS words or more, normalised; line breaks inside them don't count."""
    return [s for s in SENTENCE.split(normalise(text)) if s.count(" ") >= LEAST_WORDS - 1]


def originals(own: str) -> set[int]:
    """Hashes that a quote of this message may have: the whole text, its paragraphs, its lines, its sentences."""
    paragraphs = re.split(r"\n\s*\n", own)
    parts = {normalise(p) for p in (own, *paragraphs, *own.split("\n"))} | {s for p in paragraphs for s in sentences(p)}
    return {digest(p) for p in parts if p}


def parts_of(lines: list[str]) -> set[str]:
    """What a quoted passage is looked up by if it isn't found as a whole: its lines and its sentences."""
    return {normalise(x) for x in lines} | set(sentences(" ".join(lines)))


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with text (without quotes), n_quotes, max_level, said (hashes) and quoted (level, whole, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts, levels, said, quoted = [], [], [], [], []
            for t in batch.column(3):
                text, passages = parse(t.as_py())
                own.append(text)
                counts.append(len(passages))
                levels.append(max((v for v, _ in passages), default=0))
                said.append(sorted(originals(text)))
                quoted.append([{"level": v, "whole": digest(normalise(" ".join(p))), "parts": sorted(digest(x) for x in parts_of(p))} for v, p in passages])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("whole", pa.int64()), ("parts", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(counts, pa.int32()), pa.array(levels, pa.int32()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind)], ["conv_id", "turn", "role", "text", "n_quotes", "max_level", "said", "quoted"])

    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, n_quotes int, max_level int, said array<long>, quoted array<struct<level:int,whole:long,parts:array<long>>>")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, max_level, parent_turn, thread_root, depth: one row per message.

    A quoted passage comes from the first message of its conversation that says it outside of quotes, in an earlier
    turn: as its whole text, a paragraph, a line or a sentence; a passage found as no whole counts by its lines and
    by its sentences, so one that was wrapped anew or cut to some sentences is found. A message
    answers the latest message that its first-level passages come from; the chain of answers leads to thread_root,
    depth steps up. n_linked counts the passages found, of any level. Messages that answer none are their own root.

    First sayings are aggregated by (conversation, hash) before they are joined, so each passage meets one row, and
    a common line makes no pairs. Chains are followed by doubling, over messages that answer something only.
    Null conversations or turns link with nothing; null texts are empty; repeated rows are repeated.
    """
    rows = checkpoint(parsed(messages))
    quoting = rows.where("n_quotes > 0 and conv_id is not null and turn is not null")
    empty = quoting.isEmpty()
    if empty:
        return rows.select("conv_id", "turn", "role", "text", "n_quotes", F.lit(0).alias("n_linked"), "max_level", F.lit(None).cast(rows.schema["turn"].dataType).alias("parent_turn"), F.col("turn").alias("thread_root"), F.lit(0).alias("depth"))
    first = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("said").alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    passages = quoting.select("conv_id", "turn", F.posexplode("quoted").alias("no", "q")).select("conv_id", "turn", "no", "q.level", F.explode(F.array_union(F.array("q.whole"), F.col("q.parts"))).alias("h"), (F.col("q.whole")).alias("whole")).distinct()
    found = passages.join(first, ["conv_id", "h"]).where("origin < turn")
    # the whole passage counts before its parts
    per = found.groupBy("conv_id", "turn", "no", "level").agg(F.coalesce(F.max(F.when(F.col("h") == F.col("whole"), F.col("origin"))), F.max("origin")).alias("origin"))
    answers = checkpoint(per.groupBy("conv_id", "turn").agg(F.count("*").cast("int").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent_turn")))
    up = answers.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).alias("depth"))
    while True:
        higher = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = checkpoint(up.join(higher, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    out = rows.join(answers, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level", "parent_turn", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def reply_order(linked: DataFrame) -> DataFrame:
    """Rows sorted by conversation, thread and turn: every answer comes after what it answers. Ranges are cut by all four columns, so one conversation may fill many partitions."""
    return linked.orderBy("conv_id", "thread_root", "turn", "text")


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and reply order of every message."""
    return reply_order(link_quotes(read(spark, sf_dir, "conversations")))
