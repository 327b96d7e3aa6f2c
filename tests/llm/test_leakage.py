import random
import re

from proofmill.llm import leakage as lk


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = words(t)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = words(x)
            if any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def run(spark, docs, items, n=4):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, body string, item string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, words string, doc string")
    return lk.leaks(d, "doc_id", "body", i, "item_id", "words", n).collect()


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda k: rng.choice([" ", ", ", "\n- "]).join(rng.choice(["ab", "Cd", "EF", "g1", "été"]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "... !")]
    items = [(i, text(rng.randint(0, 12))) for i in range(25)] + [(50, None), (51, "ab"), (52, "")]
    want = brute(docs, items, 4)
    assert {(r.doc, r["item"]) for r in run(spark, docs, items)} == want and want
    one = sorted(map(tuple, run(spark, docs + docs[:3], items)))
    monkeypatch.setattr(lk, "AUTOMATON_WORDS", 0)  # the way for large evaluation sets gives the same rows
    assert sorted(map(tuple, run(spark, docs + docs[:3], items))) == one


def test_places_and_repeats(spark):
    docs = [(1, "Intro: The  BLIND test, of\nwording!  End"), (1, "the blind test of wording"), (2, "the blind test wording of")]
    rows = sorted((r.doc, r["item"], r.n_windows, r.start, r.end) for r in run(spark, docs, [(7, "the blind test of wording")]))
    assert rows == [(1, 7, 2, 0, 25), (1, 7, 2, 7, 34)]
    assert docs[0][1][7:34] == "The  BLIND test, of\nwording"


def test_passages_apart_and_spellings(spark, monkeypatch):
    far = "x " * 50
    docs = [(1, f"Le cafe\u0301 noir \uff41\uff42 {far}İ le CAFÉ noir ab fin"), (2, "le ca\u00adfé noir a\u200bb")]
    for words_ in (10**6, 0):
        monkeypatch.setattr(lk, "AUTOMATON_WORDS", words_)
        rows = sorted((r.doc, r.passage_no, r.passage) for r in run(spark, docs, [(7, "le café noir ab")]))
        assert rows == [(1, 1, "Le cafe\u0301 noir \uff41\uff42"), (1, 2, "le CAFÉ noir ab"), (2, 1, docs[1][1])]


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [(1, "a b c d")], []) == [] and run(spark, [], [(1, "a b c d")]) == []


def test_long_text(spark):
    long = "x y z " * 200_000
    assert sorted((r.doc, r["item"]) for r in run(spark, [(1, long + "a b c d")], [(3, "a b c d"), (4, "z a b c q")])) == [(1, 3), (1, 4)]
