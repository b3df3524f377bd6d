import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import langid as L
from lodestone.llm import tokens as T

from .cases import ODD, frame, texts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("piece", [20, 1 << 16])
def test_counts_are_those_of_whole_texts(spark, sf, piece):
    t = Tokenizer.from_file(PATH)
    rows = texts(spark, sf) + [(900, "a<|endoftext|>b <|endoftext|> c"), (901, "x  y\n z 12 34's  "), (902, "nospace" * 5000), (903, "é ü " * 500)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(frame(spark, rows), PATH, batch_bytes=1 << 14, piece_chars=piece).collect()}
    for i, s in rows:
        n = len(t.encode(s or "", add_special_tokens=False))
        assert got[i] == (len((s or "").encode()), n, n > 512)


def test_token_counts_of_odd_rows(spark):
    got = T.count_tokens(frame(spark, ODD), PATH).collect()
    assert len(got) == len(ODD)
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    assert T.count_tokens(frame(spark, ODD).limit(0), PATH).collect() == []


def test_pieces_join_to_the_text():
    for text in ("", "a b c d e f", "ab" * 50, "one  two   three four five six"):
        assert "".join(T.split_safely(text, 3)) == text


def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = L.op8_language(spark, BIG).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    away = [(lang[r.doc_id], r.lang_pred) for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(a == b for a, b in away) / len(away) > 0.93
    assert {b for _, b in away} <= {a for a in lang.values() if a} | {"und"}


def test_languages_of_one_family_are_told_apart(spark):
    say = {"de": "der schnelle braune Fuchs springt über den faulen Hund und schläft", "nl": "de snelle bruine vos springt over de luie hond en slaapt dan", "fr": "le renard brun rapide saute par-dessus le chien paresseux et dort", "es": "el rápido zorro marrón salta sobre el perro perezoso y duerme"}
    data = [(i, f"{t} {i % 7}", a) for i, (a, t) in enumerate([(a, t) for a, t in say.items() for _ in range(30)])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    assert model.languages == {"germanic": ["de", "nl"], "romance": ["es", "fr"]}
    got = Counter(r.lang_pred == a for r, (_, _, a) in zip(sorted(L.predict_languages(docs, model).collect(), key=lambda r: r.doc_id), data, strict=True))
    assert got == {True: len(data)}


def test_languages_of_odd_rows(spark):
    docs = frame(spark, ODD)
    got = L.predict_languages(docs, L.fit_languages(docs)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    empty = L.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in L.predict_languages(docs, empty).collect()} == {"und"}
    assert L.predict_languages(docs.limit(0), empty).collect() == []


def test_every_language_is_learned_however_many(spark):
    """40 languages that no family names, 30 of them with a pair of letters of their own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda k: " ".join(f"{letters[k % 26]}{letters[(k * 7 + 3) % 26]}{letters[(k // 26 * 5 + j) % 26]}q{letters[k % 26]}" for j in range(6))
    data = [(k * 25 + n, f"{words(k)} {n}", f"x{k:02}") for k in range(40) for n in range(25)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = L.fit_languages(docs, all_rows=600)
    assert sorted(a for names in model.languages.values() for a in names) == [f"x{k:02}" for k in range(40)]
    assert max(map(len, model.languages.values())) <= L.FAMILY and sum(map(len, model.pairs.values())) <= 40 * L.FAMILY / 2
    got = L.predict_languages(docs, model).collect()
    of = {i: a for i, _, a in data}
    assert np.mean([r.lang_pred == of[r.doc_id] for r in got]) > 0.9


def test_an_id_that_many_rows_repeat_counts_once(spark):
    docs = spark.createDataFrame([(1 if i < 300 else i, f"some english words {i}", "en") for i in range(330)] + [(1000 + i, f"quelques mots {i}", "fr") for i in range(30)], "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    assert model.families == ["germanic", "romance"]
    assert {r.lang_pred for r in L.predict_languages(docs.where("lang = 'fr'"), model).collect()} == {"fr"}


def plain_features(text):
    """Shares of 3-grams of bytes, one by one."""
    data = f"  {text.lower()} ".encode()
    n = Counter((int.from_bytes(data[i : i + 3], "little") * 2654435761 % (1 << 32)) >> (32 - L.BITS) for i in range(len(data) - 2))
    v = {b: c**0.5 for b, c in n.items()}
    size = sum(x * x for x in v.values()) ** 0.5
    return {b: x / size for b, x in v.items()}


def test_predictions_are_those_of_a_plain_vote(spark, sf):
    """Family of the greatest margin, then one vote for each pair of its languages, worked out with dictionaries."""
    docs = L.read(spark, sf, "documents")
    model = L.fit_languages(docs)
    rows = texts(spark, sf)
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(docs, model).collect()}
    for i, t in rows[:60]:
        if not t or not any(map(str.isalpha, t)):
            assert got[i] == "und"
            continue
        x = plain_features(t)
        margin = lambda w: sum(float(w[b]) * v for b, v in x.items()) + float(w[-1])
        family = max(range(len(model.families)), key=lambda f: margin(model.family_w[f]))
        names = model.languages[model.families[family]]
        wins = Counter(names[a] if margin(w) >= 0 else names[b] for a, b, w in model.pairs[model.families[family]])
        assert got[i] in ({a for a in names if wins[a] == max(wins.values())} if wins else set(names))
