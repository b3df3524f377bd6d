from itertools import combinations

import corpus_pipeline as P
import numpy as np
import pytest

from lodestone.llm import shingles as S
from lodestone.llm.common import read

from .cases import ODD, components, frame


def sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    held = [(i, sets(t)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in combinations(held, 2) if a != b and (x == y or 10 * len(x & y) >= 8 * len(x | y) > 0)]
    return components([i for i, _ in rows], links)


def planted():
    """Copies of 1 to 9 changed words of 200, some in chains, beside others."""
    rng, out = np.random.default_rng(3), []
    for k in range(40):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        out.append((len(out), " ".join(words)))
        for n in range(1, 10):
            for at in rng.integers(0, 200, 1 + n % 4):
                words[at] = f"x{k}-{n}"
            out.append((len(out), " ".join(words)))
    return out


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"volume": 500}])
def test_planted_copies_link_as_by_brute_force(spark, how):
    rows = planted()
    assert {r.doc_id: r.component_id for r in S.near_copies(frame(spark, rows), **how).collect()} == brute(rows)


def test_stage_keeps_one_of_each_group_by_jaccard(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    comp = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, sf).collect()) == sorted(set(comp.values()))


def test_odd_rows(spark):
    got = {(r.doc_id, r.component_id) for r in S.near_copies(frame(spark, ODD)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (None, None), (7, 7), (8, 8)}
    assert sorted(r.doc_id or 0 for r in S.keep_one(frame(spark, ODD)).collect()) == [0, 1, 4, 5, 7, 8]
    assert S.keep_one(frame(spark, ODD).limit(0)).collect() == []


def test_a_row_without_an_id_links_others(spark):
    words = [f"w{n}" for n in range(100)]
    texts = [" ".join(words[:at] + ["x"] * (at < 100) + words[at + 1 :]) for at in (10, 100, 80)]
    ends = [(1, texts[0] + " end"), (None, texts[1]), (2, texts[2])]
    want = brute([(1 if i == 1 else 2 if i == 2 else 3, t) for i, t in ends])
    got = {r.doc_id: r.component_id for r in S.near_copies(frame(spark, ends)).collect()}
    assert got[2] == want[2] and got[1] == want[1]
