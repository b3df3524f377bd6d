import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import pii as P

from .cases import ODD, frame, texts

#: The contract's base patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# The patterns as they stand cost the square of a long run, so very long texts take the spans of the operator, held against these on short ones.
def plain(rows, least=5, confidence=0.7, rounds=3):
    """Spans of each text; contexts scored over dictionaries, their places counted over all words of all texts."""
    found, edges = [], defaultdict(lambda: defaultdict(list))
    pairs = Counter()
    for _, text in rows:
        words = ["^", "^", *(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))]
        if text:
            pairs.update(" ".join(words[i : i + 2]) for i in range(len(words) - 1))
        _, m = P.mentions(text or "")
        found.append(m)
        for kind, seed, _, _, instance, context in m:
            edges[kind, context][instance].append(seed)
    size = {e: max(pairs[e[1]], sum(map(len, i.values()))) for e, i in edges.items()}
    score = {}
    for _ in range(rounds):
        unseen = defaultdict(dict)
        for (kind, context), value in score.items():
            for instance, seeds in edges[kind, context].items():
                if not any(seeds):
                    unseen[kind, instance][context] = value
        new = {}
        for (kind, context), instances in edges.items():
            values = []
            for instance, seeds in instances.items():
                rest = 1.0
                for _, v in sorted(unseen[kind, instance].items()):
                    rest *= 1 - v
                values.append((1.0 if any(seeds) else 1 - rest, len(seeds)))
            some = [(v, n) for v, n in values if v > 0]
            total = sum(int(v * 1_000_000) * n for v, n in some) / 1_000_000 / (size[kind, context] + 1)
            if len(some) >= least and total >= confidence:
                new[kind, context] = total
        if len(new) == len(score):
            break
        score = new
    out = []
    for (_, text), m in zip(rows, found, strict=True):
        more = [{"kind": k, "s": s, "e": e, "score": score[k, c]} for k, seed, s, e, _, c in m if not seed and (k, c) in score]
        out.append(",".join(filter(None, (told(plain_base(text) if len(text or "") < 10_000 else P.base_spans(text)), told(P.choose(more))))))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("base_sha256", "spans").collect())


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_given_tables(spark, table):
    sf = f"/root/testdata/{table}"
    rows = {r.doc_id: r for r in P.op11_context_pii(spark, sf).collect()}
    given = texts(spark, sf)
    assert len(rows) == len(given)
    for (i, text), spans in zip(given, plain(given), strict=True):
        base = plain_base(text)
        n = Counter(k for k, _, _ in base)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert rows[i].base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert rows[i].spans == spans


def test_base_spans_of_random_texts():
    r = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "22", "255", "256", " ", "(", ")", "4", "x@y.zz", "+1 (377) 555-0271", "4539578763621486", "é", "0.0.0.0", "%"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert P.base_spans(text) == plain_base(text), text


def planted():
    r = random.Random(11)
    words = "the river ran over old stones while people walked home under trees".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    number = lambda: "".join(r.choice("0123456789") for _ in range(7))
    rows = [f"{say(9)} call me +1 ({r.randint(100, 999)}) 555-{1000 + i} {say(5)}" for i in range(300)]
    rows += [f"{say(9)} call me 555 01{i}7 {i} {say(5)}" for i in range(10, 16)]  # no base pattern takes these
    rows += [f"{say(4)} write to ann{i}@mail.example.org {say(4)}" for i in range(40)]
    rows += [f"{say(4)} write to bob{i} (at) example (dot) org or so" for i in range(6)]
    # second round: found in a sure context, the same numbers teach another one
    rows += [f"{say(3)} call me 44 20 {i}{i} 1{i}5 {say(2)} ring us 44 20 {i}{i} 1{i}5 today" for i in range(10, 30)]
    rows += [f"{say(5)} ring us 44 20 9090 {i}11 today" for i in range(3)]
    # a context that mostly stands before other words is sure of nothing
    rows += [f"walked home +1 (222) 555-{2000 + i}" for i in range(20)] + [f"{say(3)} walked home at night" for _ in range(60)] + [f"walked home {number()}" for _ in range(5)]
    # one number, copied, isn't many
    rows += ["dial here +1 (333) 555-3000"] * 50 + ["dial here 333 555 4000"]
    return list(enumerate(rows))


def test_contexts_find_unseen_identifiers(spark):
    rows = planted()
    want = plain(rows)
    out = {r.doc_id: r.spans for r in P.extract(frame(spark, rows)).collect()}
    assert [out[i] for i, _ in rows] == want
    kinds = Counter(s.split(":")[0] for v in want for s in v.split(",") if s.startswith("context"))
    assert kinds == {"context_phone": 6 + 20 + 20 + 3, "context_email": 6}
    assert all("context" not in out[i] for i, t in rows if t.startswith(("walked home", "dial here")))


def test_odd_rows(spark):
    rows = [*ODD, (9, "a@b.cc" * 3), (10, None), (11, "1" * 400_000), (12, "a" * 400_000 + "@"), (13, "+1" + " " * 200_000 + "x"), (14, "1.1." * 100_000), (15, "w " * 10 + "x" * 5000 + " +1 (377) 555-0271")]
    out = P.extract(frame(spark, rows)).collect()
    assert sorted((r.base_sha256, r.spans) for r in out) == sorted((hashlib.sha256(told(P.base_spans(t or "")).encode()).hexdigest(), s) for (_, t), s in zip(rows, plain(rows), strict=True))
    assert P.extract(frame(spark, rows).limit(0)).collect() == []


def test_reruns_and_partitions_agree(spark):
    rows = planted()
    assert got(P.extract(frame(spark, rows).repartition(1))) == got(P.extract(frame(spark, rows).repartition(6)))


def test_bits_only_bound_memory(spark, monkeypatch):
    docs = frame(spark, planted())
    contexts = spark.createDataFrame([("call me",), ("walked home",), ("not there",), ("^ ^",)], "context string")
    full = {tuple(r) for r in P.context_counts(docs, contexts).collect()}
    monkeypatch.setattr(P, "BITS", 3)
    assert {tuple(r) for r in P.context_counts(docs, contexts).collect()} == full
    assert ("not there", 0) in full and ("call me", 326) in full
