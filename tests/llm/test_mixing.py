import os
import random

import pytest

from proofmill.llm import mixing as mx

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]
needs_vocabulary = pytest.mark.skipif(not os.path.exists(mx.TOKENIZER), reason="no vocabulary here")


def fill(budget, weights, caps):
    """Shares by repeated filling, for comparison."""
    got, left, open_ = [0.0] * len(weights), min(budget, sum(c for w, c in zip(weights, caps) if w > 0)), {i for i, w in enumerate(weights) if w > 0 and caps[i] > 0}
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= caps[i] * (1 - 1e-12)}
        if not full:
            for i in open_:
                got[i] = unit * weights[i]
            break
        for i in full:
            got[i], left = caps[i], left - caps[i]
        open_ -= full
    return got


def test_shares_go_to_siblings(spark):
    rng = random.Random(2)
    cases = [(100, [0.5, 0.3, 0.2], [1000, 1000, 1000]), (100, [0.5, 0.3, 0.2], [10, 1000, 1000]), (100, [1, 1], [10, 20]), (100, [0, 1], [10, 500]), (7, [1, 1, 1], [1, 1, 1])]
    cases += [(rng.uniform(1, 300), [rng.choice([0, 1, 2, rng.random()]) for _ in range(k)], [rng.choice([0, 5, rng.uniform(0, 90)]) for _ in range(k)]) for k in range(1, 30)]
    nodes = spark.createDataFrame([(p, f"c{i}", float(w), float(c)) for p, (_, ws, cs) in enumerate(cases) for i, (w, c) in enumerate(zip(ws, cs))], "p int, child string, weight double, capacity double")
    budgets = spark.createDataFrame([(p, float(b)) for p, (b, _, _) in enumerate(cases)], "p int, budget double")
    got = {(r.p, r.child): r.budget for r in mx.share_out(nodes, ["p"], budgets).collect()}
    for p, case in enumerate(cases):
        for i, want in enumerate(fill(*case)):
            assert got.get((p, f"c{i}"), 0.0) == pytest.approx(want, abs=1e-6), case


def test_budgets_fill_siblings_before_ancestors(spark):
    # In domain x / en source b is full at 5: its shortage of 20 goes to its sibling a, not to y or to x / de.
    leaves = [("x", "en", "a", 25.0, 100.0), ("x", "en", "b", 25.0, 5.0), ("x", "de", "a", 25.0, 100.0), ("y", "en", "a", 25.0, 100.0)]
    df = spark.createDataFrame(leaves, "domain string, language string, source string, weight double, capacity double")
    run = lambda total, **k: {tuple(r)[:3]: r.budget for r in mx.leaf_budgets(df, ["domain", "language", "source"], total, **k).collect()}
    assert run(100) == pytest.approx({("x", "en", "a"): 45, ("x", "en", "b"): 5, ("x", "de", "a"): 25, ("y", "en", "a"): 25})
    # All of x / en is full at 105 of 125: the rest goes to its sibling x / de; y keeps its quarter.
    assert run(250) == pytest.approx({("x", "en", "a"): 100, ("x", "en", "b"): 5, ("x", "de", "a"): 82.5, ("y", "en", "a"): 62.5})
    # All of x is full: only now y gets more.
    assert run(300) == pytest.approx({("x", "en", "a"): 100, ("x", "en", "b"): 5, ("x", "de", "a"): 100, ("y", "en", "a"): 95})
    assert run(100, weights={"domain": {"x": 1, "y": 3}})[("y", "en", "a")] == pytest.approx(75)


def corpus(spark, n=400):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30)), rng.choice("aaaaabbc"), rng.choice(["en", "DE", None]), rng.choice(["k", None]), "clash") for i in range(n)]
    rows += [(9000, None, "a", "en", "k", "x"), (9001, "free", None, "en", "k", "x"), (9002, "free", "zzz", "en", "k", "x"), (9003, "", "a", "en", "k", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, doc_kind string, repeats string"), rows


@needs_vocabulary
def test_mixture(spark):
    docs, rows = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen = mx.mix(docs, "doc_id", "text", targets)
    got = {r.doc_id: r for r in chosen.collect()}
    sources = {r[0]: r[2] for r in rows}
    caps = {s: m for s, _, m in TARGETS}
    assert all(r.source == sources[d] and 1 <= r.repeats <= caps[r.source] and r.tokens > 0 for d, r in got.items())
    assert not {9000, 9001, 9002, 9003} & set(got)
    share = {r.source: r for r in mx.shares(chosen, targets).collect()}
    assert share["none"].n_docs == 0 and share["none"].actual_share == 0 and len(share) == 4
    every = sum(r.n_tokens for r in share.values())
    # No shortage but the missing source's: its tenth goes to the others by weight.
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(share[s].n_tokens / every - w / 0.9) < 0.08, share
    assert {r.doc_id: r.repeats for r in mx.mix(docs.repartition(7), "doc_id", "text", targets).collect()} == {d: r.repeats for d, r in got.items()}


@needs_vocabulary
def test_prefix_is_exact(spark):
    docs, _ = corpus(spark)
    targets = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    sizes = {r.doc_id: r.tokens for r in mx.token_counts(docs.where("source = 'a'"), "doc_id", "text", []).collect() if r.tokens}
    every = sum(sizes.values())
    for total in (1, every // 3, every, every + every // 2, 9 * every):
        chosen = {r.doc_id: r.repeats for r in mx.mix(docs, "doc_id", "text", targets, levels=("source",), total=total).collect()}
        used = sum(sizes[d] * n for d, n in chosen.items())
        assert used <= total and (used > total - max(sizes.values()) or used == 4 * every)
        assert len(chosen) <= 1 or max(chosen.values()) - min([*chosen.values(), 4 if len(chosen) == len(sizes) else 0]) <= 1


@needs_vocabulary
def test_large_plans_and_many_buckets(spark, monkeypatch):
    docs, _ = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    tree = lambda: {r.doc_id: r.repeats for r in mx.mix(docs, "doc_id", "text", targets).collect()}
    sent = tree()
    monkeypatch.setattr(mx, "LEAVES_SENT", 0)
    assert tree() == sent
    monkeypatch.setattr(mx, "BUCKET_DOCS", 3)
    assert len(tree()) > 0
    sizes = {r.doc_id: r.tokens for r in mx.token_counts(docs.where("source = 'a'"), "doc_id", "text", []).collect() if r.tokens}
    one = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    for total in (50, sum(sizes.values()) // 3):
        chosen = mx.mix(docs, "doc_id", "text", one, levels=("source",), total=total).collect()
        used = sum(r.tokens * r.repeats for r in chosen)
        assert total - max(sizes.values()) < used <= total


@needs_vocabulary
def test_empty(spark):
    docs, _ = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mx.mix(docs.limit(0), "doc_id", "text", targets).collect() == []
    assert mx.mix(docs, "doc_id", "text", targets.limit(0)).collect() == []
