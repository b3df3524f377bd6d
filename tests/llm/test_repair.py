import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from lodestone.llm import repair as R

from ..oracle import compare, database

SCHEMA = "conv_id long, turn long, role string, text string, place int, kept string, block int, audit string, copy int"
LEGAL = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "a", 3) for r in rows], SCHEMA)


def damage(rows):
    """The damage row by row, in order of turn."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, most_inserts=2):
    """Every edit script, up to two inserts at a place, tried one by one: (cost, audit, repaired lines)."""
    wrong = faults(rows)
    best = None
    gaps = [s for n in range(most_inserts + 1) for s in product("ua", repeat=n)]
    edits = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in wrong]
    for ops in product(*edits):
        base = sum({"D": 2, "K": 0}.get(o, 1) + (5 if f == "truncated" and o != "D" else 0) for o, f in zip(ops, wrong, strict=True))
        if best and base > best[0]:
            continue
        for ins in product(gaps, repeat=len(rows) + 1):
            n = sum(map(len, ins))
            if n > 3 or (best and base + 5 * n > best[0]):
                continue
            audit, said = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(ins[i])
                said += [({"u": "user", "a": "assistant"}[c], "") for c in ins[i]]
                if i < len(rows):
                    audit += ops[i][0]
                    if ops[i] != "D":
                        said.append((rows[i][1] if ops[i] == "K" else {"Ru": "user", "Ra": "assistant"}[ops[i]], rows[i][2]))
            if all(r for r, _ in said) and LEGAL.fullmatch("".join(r[0] for r, _ in said)):
                new = (base + 5 * n, audit, [f"{r}:{t}" for r, t in said])
                best = min(best, new) if best else new
    return best


def plain(rows):
    """All columns by the plain search."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        turns = [t for t, _, _ in mine if t is not None]
        f, initials = faults(mine), [r[:1] for _, r, _ in mine]
        cost, audit, lines = search(mine)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def generated(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " ", None, "Why?", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""]
    return [(c, r.choice([t, t, t + 3, None]), r.choice(roles), r.choice(texts)) for c in range(n) for t in range(r.randint(0, 4))]


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_given_tables_against_sql(spark, table):
    sf = f"/root/testdata/{table}"
    assert compare(R.op13_conversation_repair(spark, sf), database(sf), R.OP13_SQL) > 10


@pytest.mark.parametrize("seed,bits", [(1, 12), (2, 0), (3, 1), (4, 2)])
def test_generated_conversations_against_a_plain_search(spark, seed, bits):
    rows = generated(seed, 50)
    assert got(R.repair(frame(spark, rows), block_bits=bits)) == plain(rows)


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_blocks_of_a_long_conversation_compose_to_one(spark, sf, bits):
    r = random.Random(7)
    rows = [(1, i // 2 if i % 5 else None, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", f"text {i}!", f"cut {i}"])) for i in range(500)]
    rows += [(2, None, "user", "the same.")] * 300 + [(None, 4, "system", "Be kind."), (None, 5, "user", "Hi.")]
    whole = got(R.repair(frame(spark, rows).repartition(7), block_bits=bits))
    mine = damage([x for x in rows if x[0] == 1])
    p = {0: (0, "")}
    for (_, role, _), f in zip(mine, faults(mine), strict=True):
        p = R.advance(p, role[:1], {"": R.SOUND, "truncated": R.CUT}.get(f, R.GONE))
    assert whole[1][5:7] == R.final(p) and whole[1][1:4] == tuple(faults(mine).count(k) for k in ("blank", "duplicate", "truncated"))
    twos = damage([x for x in rows if x[0] == 2])
    assert whole[2][2] == len(twos) - 1 and whole[2][6].count("D") >= len(twos) - 1
    assert set(whole) == {1, 2, None}


def test_empty_and_dropped(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(R.repair(frame(spark, [(dropped, 1, "user", "Hello.")]))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []


def test_very_long_texts(spark):
    rows = [(1, 1, "user", "long text. " * 200_000), (1, 2, "assistant", " " * 300_000 + "x." + "\n" * 300_000)]
    assert got(R.repair(frame(spark, rows))) == plain(rows)
