import random
import re
import time

import numpy as np

from lodestone.llm import tiling as G

from .cases import ODD, frame

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a pot of very strong tea"
OTHER = "a museum in the old harbour shows forty maps of rivers that nobody has ever sailed on or even seen"


def words(text):
    return [w for w in (x.strip(G.EDGES) for x in re.split(r"\s+", (text or "").lower())) if w]


def brute(doc, item, k=G.TILE):
    """Words of the item that greedy tiling covers, by trying all places for the longest free match again and again."""
    a, b = [False] * len(doc), [False] * len(item)
    total = 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        a[i : i + n] = b[j : j + n] = [True] * n
        total += n


def items(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, key string")


def test_tiles_cover_what_the_plain_algorithm_covers(spark):
    rng = random.Random(5)
    vocabulary = list("abcdefg")
    bench = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80)))) for i in range(40)]
    got = {(r.doc_id, r.item_id): r.n_covered for r in G.overlaps(frame(spark, docs), items(spark, *bench)).collect()}
    want = {(i, j): n for i, d in docs for j, b in enumerate(bench) if (n := brute(words(d), words(b)))}
    assert got == want


def test_many_blocks_give_the_same(spark):
    docs = [(i, f"{ITEM} {i} {OTHER}" if i % 2 else OTHER) for i in range(10)]
    one, many = (sorted(map(tuple, G.overlaps(frame(spark, docs), items(spark, ITEM, OTHER, None, "short one"), block_chars=c).collect())) for c in (10**9, 50))
    assert one == many and len(one) == 15


def test_reordered_and_marked_up_passages_are_caught(spark):
    w = ITEM.split()
    shuffled = " ".join(w[14:] + ["and"] + w[7:14] + ["then"] + w[:7])
    rows = [(1, f"before {ITEM} after"), (2, f"before {shuffled} after"), (3, f"«{ITEM.upper().replace(' ', '   ')}!»"), (4, " ".join(w[:8])), (5, OTHER), (6, " ".join(reversed(w)))]
    got = {r.doc_id: r for r in G.contamination(frame(spark, rows), items(spark, ITEM)).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 3}
    assert got[1].coverage == 1.0 and got[4].item_id == 0 and got[5].item_id is None
    assert sorted(r.doc_id for r in G.decontaminate(frame(spark, rows), items(spark, ITEM)).collect()) == [4, 5, 6]


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    for bench in (items(spark, ITEM, None, "", "one"), items(spark, ITEM).limit(0), items(spark, "many words a long text of many words a")):
        assert sorted((r.doc_id or 0) for r in G.contamination(docs, bench).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
        kept = G.decontaminate(docs, bench)
        assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    assert G.contamination(docs.limit(0), items(spark, ITEM)).collect() == []


def test_real_tables(spark, sf):
    docs = G.read(spark, sf, "documents")
    bench = {r.item_id: words(r.text) for r in G.read(spark, sf, "benchmark").collect()}
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    got = list(G.overlaps(docs, G.read(spark, sf, "benchmark")).collect())
    for r in sorted(got, key=lambda r: (len(text[r.doc_id]), r.doc_id, r.item_id))[:30]:
        assert r.n_covered == brute(text[r.doc_id], bench[r.item_id]) and r.n_item == len(bench[r.item_id])
    pairs = {(r.doc_id, r.item_id) for r in got}
    grams = lambda w: {tuple(w[i : i + G.TILE]) for i in range(len(w) - G.TILE + 1)}
    of = {j: grams(w) for j, w in bench.items()}
    assert pairs == {(i, j) for i, w in text.items() for g in [grams(w)] for j, b in of.items() if g & b}


def test_rolling_hashes_follow_the_words():
    ids = np.array([1, 2, 3, 1, 2, 3])
    h = G.rolling(ids, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(G.rolling(ids, 7)) == 0


def test_texts_of_one_word(spark):
    """20,000 equal words against 20,000: as many places of one seed."""
    docs = [(1, "word " * 20_000), (2, "word " * 30_000), (3, "word other " * 9_000), (4, "x " + "word " * 700)]
    began = time.perf_counter()
    got = {r.doc_id: r.n_covered for r in G.overlaps(frame(spark, docs), items(spark, "word " * 20_000)).collect()}
    assert got == {1: 20_000, 2: 20_000, 4: 700} and time.perf_counter() - began < 30


def test_tiles_of_runs_and_periods():
    rng = random.Random(7)
    for _ in range(150):
        doc, item = (np.array([rng.randrange(2) for _ in range(rng.randrange(5, 60))]) for _ in range(2))
        k = rng.randrange(2, 6)
        grams = lambda w: [tuple(w[i : i + k].tolist()) for i in range(len(w) - k + 1)]
        a, b = grams(doc), grams(item)
        here, there = (np.array([i for i, g in enumerate(x) if g in set(y)], np.int64) for x, y in ((a, b), (b, a)))
        got = G.tiles(doc, item, here, there, k)
        assert sum(t[2] for t in got) == brute(doc.tolist(), item.tolist(), k)
        assert all((doc[x : x + n] == item[y : y + n]).all() for x, y, n in got)
        assert [n for _, _, n in got] == sorted((n for _, _, n in got), reverse=True)
