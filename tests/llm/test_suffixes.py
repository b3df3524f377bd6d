import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import suffixes as X

from .cases import ODD, frame, texts

N = X.LEAST


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + N] for d in data for i in range(len(d) - N + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - N + 1):
            if seen[d[i : i + N]] > 1:
                gone[i : i + N] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((-1 if doc is None else doc, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.remove_repeats(df).collect())


def planted(n=60):
    rng = random.Random(1)
    noise = lambda k: "".join(rng.choice("abcdefghij éß") for _ in range(k))
    passage, other = noise(700), noise(N)
    rows = [(i, noise(rng.randrange(50, 600)) + (passage[: rng.randrange(150, 700)] if i % 3 == 0 else other if i % 7 == 0 else "") + noise(40)) for i in range(n)]
    rows += [(100, "z" * 900), (101, "y" * (N - 1)), (102, "y" * N), (103, noise(250) * 3), (104, rows[5][1]), (105, rows[5][1]), (106, passage)]
    return rows


def test_real_texts(spark, sf):
    rows = texts(spark, sf)
    assert got(frame(spark, rows)) == brute(rows)


def test_planted_repeats(spark):
    rows = planted()
    assert got(frame(spark, rows)) == brute(rows)


def test_hot_seeds_take_the_other_way_to_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 500)
    rows = planted(90)
    assert got(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, t[:3000] if t else t) for i, t in ODD]
    assert got(frame(spark, rows)) == brute(rows)
    assert X.remove_repeats(frame(spark, rows).limit(0)).collect() == []


def grouped(df):
    by = {}
    for r in X.repeat_groups(df).collect():
        by.setdefault(r.group, []).append((r.doc_id, r.start, r.length))
    return by


def even_repeats(data):
    """Places of the maximal repeats of which all strings of N bytes occur equally often, by looking at every string."""
    where = {}
    for k, d in enumerate(data):
        for i in range(len(d) - N + 1):
            where.setdefault(d[i : i + N], []).append((k, i))
    out = set()
    for k, d in enumerate(data):
        i = 0
        while i + N <= len(d):
            places, n = where[d[i : i + N]], 1
            while i + n + N <= len(d) and where[d[i + n : i + n + N]] == [(q, j + n) for q, j in places]:
                n += 1
            before = {(data[q][j - 1] if j else None, (q, j) if not j else 0) for q, j in places}
            after = {(data[q][j + n + N - 1], 0) if j + n + N - 1 < len(data[q]) else (None, (q, j)) for q, j in places}
            if len(places) > 1 and len(before) > 1 and len(after) > 1:
                out.add((n + N - 1, tuple(places)))
            i += n
    return out


@pytest.mark.parametrize("hot", [X.HOT, 500])
def test_groups_are_maximal_and_hold_every_occurrence(spark, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT", hot)
    rng = random.Random(3)
    noise = lambda k: "".join(rng.choice("abcdefghij éß") for _ in range(k))
    a, b, c = noise(1500), noise(N), noise(330)
    rows = [(i, noise(rng.randrange(50, 400)) + (a, b, c, a[:700], noise(300))[i % 5] + noise(90)) for i in range(40)]
    rows += [(50, c + a), (51, a), (52, rows[3][1]), (53, noise(2500)), (54, None), (55, "")]
    rows += [rows[-3], (56, "w" * 230)]  # a repeated row
    data = [(t or "").encode() for _, t in rows]
    by = grouped(frame(spark, rows))
    texts_of = {}
    for (doc, _), d in zip(rows, data, strict=True):
        texts_of[doc] = d
    found = {}
    for places in by.values():
        strings = {texts_of[d][s : s + n] for d, s, n in places}
        assert len(strings) == 1
        string = strings.pop()
        assert len(string) >= N and len(string) == places[0][2]
        every = sorted((doc, i) for (doc, _), d in zip(rows, data, strict=True) for i in range(len(d) - len(string) + 1) if d.startswith(string, i))
        assert sorted((d, s) for d, s, _ in places) == every
        found[len(string), tuple(every)] = string
    want = {(n, tuple(sorted((rows[k][0], i) for k, i in places))) for n, places in even_repeats(data)}
    assert max(n for n, _ in want) >= 1500 and want <= set(found)


def test_groups_of_odd_tables(spark):
    rows = [(i, t[:3000] if t else t) for i, t in ODD]
    by = grouped(frame(spark, rows))
    assert all(len(places) > 1 for places in by.values())
    assert X.repeat_groups(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("text", [b"banana", b"mississippi", b"aaaa", b"abcabcabc"])
def test_suffix_array_and_intervals(text):
    at = np.arange(len(text))
    order, lcp = X.suffix_array(np.frombuffer(text, np.uint8), at, len(text) - at, 1)
    assert sorted(order.tolist()) == list(range(len(text)))
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n
    before = [text[i - 1] if i else -1 for i in order.tolist()]
    found = {text[order[a] : order[a] + n] for n, a, _ in X.maximal_intervals(lcp.tolist(), before, 1)}
    places = lambda s: [i for i in range(len(text)) if text.startswith(s, i)]
    want = set()
    for s in {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}:
        p = places(s)
        left = {text[i - 1] if i else -1 for i in p}
        right = {text[i + len(s)] if i + len(s) < len(text) else -1 for i in p}
        if len(p) > 1 and len(left) > 1 and len(right) > 1:
            want.add(s)
    assert found == want


@pytest.mark.parametrize("seed", range(12))
def test_pieces_are_covered_where_a_string_starts_twice(seed):
    """Two-letter and periodic pieces, longer than two of the blocks that suffixes are first sorted by."""
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(200, 420))) for _ in range(4)]
    pieces = []
    for _ in range(rng.randrange(2, 12)):
        x, y = base[rng.randrange(4)], base[rng.randrange(4)]
        kinds = [bytes([rng.choice(b"ab")]) * rng.randrange(200, 700), (x[:7] * 100)[: rng.randrange(200, 700)], x[rng.randrange(50) :] + y[: rng.randrange(300)]]
        pieces.append(kinds[min(rng.randrange(5), 2)])
    count = Counter(p[i : i + N] for p in pieces for i in range(len(p) - N + 1))
    for p, found in zip(pieces, X.repeats(pieces), strict=True):
        want, got_ = np.zeros(len(p), bool), np.zeros(len(p), bool)
        for i in range(len(p) - N + 1):
            if count[p[i : i + N]] > 1:
                want[i : i + N] = True
        for s, e, _ in found:
            got_[s:e] = True
        assert (want == got_).all()
