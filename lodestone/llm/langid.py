"""Language ID: a family first, then one-versus-one linear SVMs between the languages of the family."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, held_out, read, write_shared
from .linear import Row, fit_hinge

BITS = 15
DIMS = 1 << BITS
#: Labelled rows of each language, and of all, that the SVMs are fitted on; each of many languages gets fewer rows.
FIT_ROWS, ALL_ROWS = 1500, 60_000
#: Languages of one family at most; a larger one is parted into families of languages with like 3-grams.
FAMILY = 12
STEP = 1 << 18
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "ky"), "turkic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "ne", "gu", "pa"), "indic"),
}


def _buckets(data: np.ndarray) -> np.ndarray:
    """Hash buckets of the byte 3-grams that start at each place; two places fewer than bytes."""
    code = data.astype(np.uint32)
    return ((code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(f"  {(text or '').lower()} ".encode(), np.uint8)


def features(text: str | None) -> Row:
    """Shares of hashed byte 3-grams of the whole lower-cased text, scaled to unit length."""
    data, n = _bytes(text), np.zeros(DIMS)
    for at in range(0, len(data) - 2, STEP):
        n += np.bincount(_buckets(data[at : at + STEP + 2]), minlength=DIMS)
    ids = np.flatnonzero(n)
    v = np.sqrt(n[ids])
    return ids, v / np.sqrt(v @ v)


@dataclass
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]  # of each family
    family_w: np.ndarray  # a row for each family, against all others
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.families:
            return "und", 0.0
        ids, v = features(text)
        m = self.family_w[:, ids] @ v + self.family_w[:, -1]
        p = 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        best = int(m.argmax())
        family, sure = self.families[best], float(p[best] / p.sum())
        names = self.languages[family]
        votes, wins = np.zeros(len(names)), np.zeros(len(names))
        for a, b, w in self.pairs[family]:
            q = 1 / (1 + np.exp(-2 * np.clip(float(w[ids] @ v) + w[-1], -15, 15)))
            votes[[a, b]] += q, 1 - q
            wins[a if q >= 0.5 else b] += 1
        if len(names) == 1:
            return names[0], sure
        top = max(range(len(names)), key=lambda i: (wins[i], votes[i]))
        return names[top], float(sure * votes[top] / (len(names) - 1))


def part_families(names: dict[str, list[str]], centres: dict[str, np.ndarray], most: int = FAMILY) -> dict[str, list[str]]:
    """Families of ``most`` languages or fewer: a larger one is filled up from one language on with those of the nearest mean."""
    out = {}
    for family, all_ in names.items():
        left = sorted(all_)
        n = 0
        while left:
            near = sorted(left, key=lambda a: (-float(centres[a] @ centres[left[0]]), a))[:most] if len(left) > most else left
            out[family if len(all_) <= most else f"{family} {n}"] = sorted(near)
            left = [a for a in left if a not in set(near)]
            n += 1
    return out


def fit_languages(docs: DataFrame, families: Mapping[str, str] = FAMILIES, fit_rows: int = FIT_ROWS, all_rows: int = ALL_ROWS, family: int = FAMILY) -> LanguageModel:
    """Learn from text and lang of the rows whose crc32(doc_id) mod 5 is not 0 and whose lang is not null.

    Every value of lang is learned. The SVMs are fitted on the rows of least doc_id hash of each language, at most
    ``fit_rows`` a language and about ``all_rows`` in all: with many languages each gives fewer, ten at least.
    Languages that ``families`` doesn't name form one family; a family of over ``family`` languages is parted by
    likeness, so that the pairs to fit grow in proportion to the languages. The sample is written to the shared folder,
    each SVM is fitted in a task of its own, and weights alone come to the driver. Rows that repeat a doc_id count once a
    language. Without labelled rows every prediction is und.
    """
    may = docs.where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = checkpoint(may.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    per = min(fit_rows, max(10, all_rows // max(languages, 1)))
    # hashes below a bar that lets about twice as many rows through as are wanted; so no window holds a whole language
    few = may.select("doc_id", "lang", "text").join(F.broadcast(counts) if languages <= 100_000 else counts, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), 2 * per / F.col("n")) * (1 << 30))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = few.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= per)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.uint16).tobytes() for i, _ in x], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in x], pa.binary())], ["doc_id", "lang", "ids", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = write_shared(few.select("doc_id", "lang", "text").mapInArrow(extract, f"doc_id {kind}, lang string, ids binary, v binary"))
    known: dict[str, list[str]] = defaultdict(list)
    for a in sorted(r.lang for r in sample.select("lang").distinct().collect()):
        known[families.get(a, "other")].append(a)
    crowded = [a for names in known.values() if len(names) > family for a in names]
    names = part_families(known, language_centres(sample.where(F.col("lang").isin(crowded))) if crowded else {}, family)
    order = sorted(names)
    # fits by number: the families against all others, if there are two or more, then the pairs of each family
    duels = [(f, i, j) for f in order for i, j in combinations(range(len(names[f])), 2)]
    one_family = len(order) == 1
    signs = [] if one_family else [(k, a, 1.0 if f == g else -1.0) for k, f in enumerate(order) for g in order for a in names[g]]
    for k, (f, i, j) in enumerate(duels, len(order)):
        signs += [(k, names[f][i], 1.0), (k, names[f][j], -1.0)]
    w = fit_all(sample, signs)
    family_w = np.array([np.append(np.zeros(DIMS), 1.0) if one_family else w[k] for k in range(len(order))], np.float32).reshape(len(order), DIMS + 1)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {f: [] for f in order}
    for k, (f, i, j) in enumerate(duels, len(order)):
        pairs[f].append((i, j, w[k]))
    return LanguageModel(order, dict(names), family_w, pairs)


def _rows(table: pa.Table) -> list[Row]:
    """The feature rows of a table, as views of its buffers."""
    ids, v = table["ids"].combine_chunks(), table["v"].combine_chunks()
    return [(np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(x.as_buffer(), np.float32)) for i, x in zip(ids, v, strict=True)]


def language_centres(sample: DataFrame) -> dict[str, np.ndarray]:
    """The mean direction of each language's rows (lang, doc_id, ids, v): 2^15 numbers a language come to the driver, no rows."""

    def centre(table: pa.Table) -> pa.Table:
        total = np.zeros(DIMS)
        for ids, v in _rows(table.sort_by("doc_id")):
            total[ids] += v
        return pa.table({"lang": table["lang"].slice(0, 1), "centre": [(total / (np.sqrt(total @ total) or 1.0)).astype(np.float32).tobytes()]})

    got = sample.groupBy("lang").applyInArrow(centre, "lang string, centre binary").collect()
    return {r.lang: np.frombuffer(r.centre, np.float32) for r in got}


def fit_all(sample: DataFrame, signs: list[tuple[int, str, float]]) -> dict[int, np.ndarray]:
    """Weights of each fit in ``signs`` (fit, lang, sign): every fit is a task that holds the bounded rows of its languages.

    ``signs`` has a row for each fit and language of it, and only weights come to the driver.
    """
    if not signs:
        return {}

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        w = fit_hinge(_rows(table), table["sign"].to_numpy(), DIMS, c=4.0)
        return pa.table({"fit": table["fit"].slice(0, 1), "w": [w.astype(np.float32).tobytes()]})

    of = sample.sparkSession.createDataFrame(signs, "fit int, lang string, sign double")
    # a number of partitions of its own, as adaptive execution would put fits together by their bytes
    tasks = sample.join(F.broadcast(of), "lang").repartition(min(signs[-1][0] + 1, 2000), "fit")
    got = tasks.groupBy("fit").applyInArrow(fit, "fit int, w binary").collect()
    return {r.fit: np.frombuffer(r.w, np.float32) for r in got}


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of (doc_id, text); und with score 0 where the text is null or has no letter.

    Other columns are ignored, repeated rows are predicted alike, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 numbers for each SVM, at most six SVMs a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))
