"""Odd rows that every operator must take, with extra columns whose names clash with inner ones."""

from __future__ import annotations

EXTRA = {"spans": "x", "fp": 1, "key": "k", "score": 0.5, "size": 9, "a": 1, "b": 2, "n": 3, "label": 4}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, fp long, key string, score double, size int, a int, b int, n int, label int"
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\r\n "),
    (4, "one"),
    (5, "two words"),
    (5, "two words"),
    (6, "two words"),
    (None, "a row without an id"),
    (7, "ä ö ü 😀 ñ " * 40),
    (8, "a long text of many words " * 6000),
]


def frame(spark, rows, sources=("web",)):
    data = [(i, t, "en", sources[k % len(sources)], len(t or ""), *EXTRA.values()) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def components(ids, links):
    """The smallest id that each id reaches."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}
