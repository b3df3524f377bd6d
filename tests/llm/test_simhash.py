import random
import re
from itertools import combinations

import xxhash

from lodestone.llm import simhash as S

from .cases import ODD, components, frame, texts


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    """(doc_id, fingerprint, component) of rows whose ids differ."""
    fp = {i: brute(t) for i, t in rows}
    links = [(i, j) for i, j in combinations(sorted(fp), 2) if (fp[i] ^ fp[j]).bit_count() <= 2]
    return sorted((i, f"{fp[i]:016x}", c) for i, c in components(fp, links).items())


def test_fingerprints_and_components_are_those_of_all_pairs(spark, sf):
    rows = [(i, t) for i, t in texts(spark, sf)]
    body = max((t for _, t in rows if t), key=len)
    rows += [(10_000, body), (10_001, body + " tail"), (10_002, body.replace("a", "A")), (10_003, None), (10_004, "")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(frame(spark, rows)).collect())
    assert got == expected(rows)


def test_odd_rows(spark):
    got = S.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1 and by[6].component_id == 5
    assert S.near_duplicates(frame(spark, ODD).limit(0)).collect() == []


def test_trees_find_every_close_pair(spark):
    rng = random.Random(3)
    points = {0}
    while len(points) < 3000:
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(rng.randrange(3)):
            p ^= 1 << rng.randrange(64)
            points.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.link(df, sample=512, shard=200).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    links = [(p, p ^ f) for p in points for f in flips if p ^ f in points]
    assert components(points, edges) == components(points, links)


def close_links(points):
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    return [(p, p ^ f) for p in points for f in flips if p < p ^ f and p ^ f in points]


def signed(points):
    return [(p - (1 << 64) if p >> 63 else p,) for p in points]


def test_a_dense_cluster_is_dealt_out_in_blocks(spark):
    """Fingerprints within 5 bits of one centre, which no ball parts well, beside others."""
    rng, centre = random.Random(5), 0x0123456789ABCDEF
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(6000)} | {rng.getrandbits(64) for _ in range(2000)}
    df = spark.createDataFrame(signed(points), "fp long")
    rows, large = S.shards(df, 2, 1024, 200)
    assert large.count() > 0
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.link(df, sample=1024, shard=200, deal=700).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    assert components(points, edges) == components(points, close_links(points))


def test_trees_grow_below_shards_that_are_too_large(spark):
    rng = random.Random(6)
    points = {rng.getrandbits(64) for _ in range(12_000)}
    points |= {p ^ 1 << rng.randrange(64) for p in list(points)[:3000]}
    df = spark.createDataFrame(signed(points), "fp long")
    rows, large = S.shards(df, 2, 512, 100)
    biggest = rows.groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert biggest < 2000  # a tree of 512 points alone has leaves of 16 of them, some 500 of all and their borders
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.link(df, sample=512, shard=100).collect()]
    assert components(points, edges) == components(points, close_links(points))


def test_keep_one(spark):
    body = " ".join(f"word{i % 97}" for i in range(400))
    rows = [(3, body), (1, body), (2, body + " x"), (9, "quite another text, about other things"), (9, "quite another text, about other things"), (None, body)]
    got = sorted((r.doc_id or 0) for r in S.keep_one(frame(spark, rows)).collect())
    assert got == [0, 1, 9]
