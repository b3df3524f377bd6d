import random
import textwrap

from lodestone.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, said string, level int, origin long"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, "user", x, "a", 1, 2) for c, t, x in rows], SCHEMA)


def link(spark, rows):
    return {(r.conv_id, r.turn): r for r in Q.link_quotes(frame(spark, rows)).collect()}


def test_parse_takes_levels_apart():
    text = "Hi\n\nOn Monday, Ann wrote:\n> first\n> > deeper\n>> deeper still\n>\n> again\n\nmy answer"
    own, passages = Q.parse(text)
    assert own == "Hi\n\n\nmy answer"
    assert passages == [(1, ["first"]), (2, ["deeper", "deeper still"]), (1, ["again"])]
    assert Q.parse("no quote, a > b") == ("no quote, a > b", [])
    assert Q.parse(None) == ("", []) and Q.parse("") == ("", [])


def test_quotes_lead_to_their_messages(spark):
    rows = [
        (1, 1, "How do I sort a list?\n\nIt is long."),
        (1, 2, "> how do I   SORT a list?\nUse sorted."),
        (1, 3, "> Use sorted.\n>> How do I sort a list?\nThanks, and in reverse?"),
        (1, 4, "> It is long.\nHow long?"),
        (1, 5, "> nobody said this\nWhat?"),
        (1, 6, "> Thanks, and in reverse?\nreverse=True"),
        (2, 1, "> How do I sort a list?\nanother conversation"),
    ]
    got = link(spark, rows)
    assert {k[1]: r.parent_turn for k, r in got.items() if k[0] == 1} == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: 3}
    assert {k[1]: (r.thread_root, r.depth) for k, r in got.items() if k[0] == 1} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 1), 5: (5, 0), 6: (1, 3)}
    assert got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2 and got[1, 3].max_level == 2
    assert got[1, 2].text == "Use sorted." and got[2, 1].parent_turn is None


def test_long_chains(spark):
    rows = [(1, 1, "message 1")] + [(1, i, f"> message {i - 1}\nmessage {i}") for i in range(2, 40)]
    assert {k[1]: (r.thread_root, r.depth) for k, r in link(spark, rows).items()} == {i: (1, i - 1) for i in range(1, 40)}


def test_answers_follow_what_they_answer(spark):
    rows = [(1, 1, "a question here"), (1, 2, "another matter"), (1, 3, "> a question here\nyes"), (1, 4, "> another matter\nno")]
    order = [(r.thread_root, r.turn) for r in Q.reply_order(Q.link_quotes(frame(spark, rows))).collect()]
    assert order == [(1, 1), (1, 3), (2, 2), (2, 4)]


def test_sentences_out_of_lines_and_wrapped_anew(spark):
    long = "The build is broken since Monday. Nobody has looked at the linker yet! Should we go back to the old compiler, or is there a flag that helps us out here? I am away."
    rows = [
        (1, 1, "hello all of you"),
        (1, 2, long),
        (1, 3, "> Nobody has looked at the linker yet!\nI have."),
        (1, 4, "\n".join("> " + x for x in textwrap.wrap(long[34:], 30)) + "\nThere is one."),
        (1, 5, "> There is one.\nWhich?"),
        (1, 6, "> Nobody has\nmid-sentence cuts aren't found"),
    ]
    assert {k[1]: r.parent_turn for k, r in link(spark, rows).items()} == {1: None, 2: None, 3: 2, 4: 2, 5: 4, 6: None}


def plain(rows):
    """Links by comparing texts themselves, message after message."""
    said, out = {}, {}
    for c, t, text in sorted(rows):
        own, passages = Q.parse(text)
        origins = []
        for level, lines in passages:
            whole = [u for u in sorted(said.get(c, {})) if Q.normalise(" ".join(lines)) in said[c][u]]
            parts = [next(u for u in sorted(said[c]) if p in said[c][u]) for p in Q.parts_of(lines) if any(p in said[c][u] for u in said.get(c, {}))]
            if whole or parts:
                origins.append((level, whole[0] if whole else max(parts)))
        parent = max((o for level, o in origins if level == 1), default=None)
        up = out.get((c, parent))
        out[c, t] = (len(passages), len(origins), parent, up[3] if up else t, up[4] + 1 if up else 0)
        blocks = own.split("\n\n")
        said.setdefault(c, {})[t] = {Q.normalise(p) for p in (own, *blocks, *own.split("\n"))} | {s for b in blocks for s in Q.sentences(b)}
    return out


def threads(n, seed, hot=0.4):
    """Messages that quote earlier ones at levels 1 to 4: whole, cut to a sentence, wrapped, never said, or common."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split())
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(2, 9))).capitalize() + rng.choice(".!?")
    turn, owns, rows = {}, {}, []
    for _ in range(n):
        c = 0 if rng.random() < hot else rng.randrange(1, 12)
        t = turn[c] = turn.get(c, 0) + 1
        lines = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            source = rng.choice(owns[c]) if c in owns and rng.random() < 0.8 else sentence()
            kind = rng.randrange(4)
            body = source if kind == 0 else rng.choice(source.replace("\n", " ").split(". ")) if kind == 1 else "\n".join(textwrap.wrap(source, 25)) if kind == 2 else source.split("\n")[0]
            mark = rng.choice(["> ", ">> ", "> > > ", ">>>> "]) if rng.random() < 0.5 else "> "
            lines += [(mark + x).rstrip() for x in body.split("\n")] + [rng.choice(["", "Agreed."])]
        own = "\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
        owns.setdefault(c, []).append(own)
        rows.append((c, t, "\n".join([*lines, own])))
    return rows


def test_generated_threads_against_plain_comparison(spark):
    for seed in range(3):
        rows = threads(400, seed)
        got = {k: (r.n_quotes, r.n_linked, r.parent_turn, r.thread_root, r.depth) for k, r in link(spark, rows).items()}
        want = plain(rows)
        assert got == want
        assert sum(w[1] for w in want.values()) > 150 and max(w[4] for w in want.values()) > 3


def test_odd_rows(spark):
    rows = [(None, 1, "x"), (1, None, "> x"), (1, 1, None), (1, 2, ""), (1, 3, ">"), (1, 3, ">"), (1, 4, "> " + "word " * 20000), (1, 5, ">>>\n>> a\n>"), (None, 2, "> x\ny")]
    assert Q.link_quotes(frame(spark, rows)).count() == len(rows)
    assert Q.link_quotes(frame(spark, rows).limit(0)).collect() == []
    assert Q.link_quotes(frame(spark, [(1, 1, "plain")])).count() == 1


def test_real_table(spark, sf):
    table = Q.read(spark, sf, "conversations")
    got = Q.op2_quotes(spark, sf).collect()
    assert len(got) == table.count()
    by = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        if r.parent_turn is not None:
            up = by[r.conv_id, r.parent_turn]
            assert r.parent_turn < r.turn and r.thread_root == up.thread_root and r.depth == up.depth + 1
