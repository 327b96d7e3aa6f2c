import random

import pytest

from proofmill.llm import truncation as tr

WHOLE = ["A sentence ends here.", "It ends!\n[6/6]", "It ends.\n-- \nQD1 / 13", "It ends. (GSV71-0831-E)", "It ends.\n66 x 42 mm", "It ends.\nLOT 22-585", "LOT 22-585", 'He said "stop."', "- the hang tag", "Panel review KFF51-2176-B", "It ends.\n- the hang tag\n-- #48176"]
CUT = ["A sentence that en", "A sentence that…", "A sentence that ...", "A sent [...]\n<end 2>", "It ends.\nThe carton (KGF59-", "It ends. The lines of\n[6/6]", "It ends.\n- the ha", "As agreed last week, the", "It ends. The inner a<b"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src" if i % 2 else None, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, line string")


def test_closes(spark):
    model = [f"Panel review ABC12-34{i}5-A\nIt is good number {i}.\n- the hang tag\n- the lid\nIt ends number {i}." for i in range(4)]
    texts = WHOLE + CUT + model + [None, "", "  \n", CUT[0]]
    got = {r.doc_id for r in tr.cut_texts(docs(spark, texts), "doc_id", "text").collect()}
    assert got == {*range(len(WHOLE), len(WHOLE) + len(CUT)), len(texts) - 1}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_near_copies_are_aligned(spark, monkeypatch, limit):
    monkeypatch.setattr(tr, "BROADCAST_ROWS", limit)
    base = " ".join(f"word{i} goes on" for i in range(60))
    full = base + ". Then it stops here.\n- the long red label"
    cut = base + ". Then it stops here.\n- the long red"
    other = " ".join(f"thing{i} is so" for i in range(60)) + "."
    links = {(r.id, r.other): (r.held, r.early) for r in tr.near_copies(docs(spark, [full, cut, other, cut, full]), "doc_id", "text").collect()}
    # Either exact copy may stand for both; the whole text has an open close too, and its copy does not go on.
    assert {(o, early) for (i, o), (held, early) in links.items() if i in (1, 3)} <= {(0, True), (4, True)} and all(h >= 0.8 for h, _ in links.values())
    assert any(i in (1, 3) for i, _ in links) and not any(early for (i, _), (_, early) in links.items() if i in (0, 4))
    # The closing entry stands in other texts too, so only the alignment tells; the repeated copy is told as well.
    more = [f"Note {i} is fine.\n- the long red\n- the long red label\nIt ends {i}." for i in range(3)]
    got = {(r.doc_id, r.by) for r in tr.cut_texts(docs(spark, [full, cut, other, cut, full, *more]), "doc_id", "text").collect()}
    assert {(1, "copy"), (3, "copy")} <= got and not {0, 2, 4} & {d for d, _ in got}


def test_alignment_tells_where_a_copy_ends():
    base = " ".join(f"word{i} goes on" for i in range(60)) + ". "
    whole = base + "Then the long red label goes on the lid.\n- the lid\n- ab cd\nAt the end, the long red label.\n- the lid"
    early = ["Then the lomg red label goes", "Then the long red la", "Then the long red", "Then the long red label goes on the lid.\n- ab", "Then the", "T", "Then the long red label […]\n[2/6]"]
    complete = ["Then the long red label goes on the lid.", "Then the long red label goes on the lid.\n- the lid", whole[len(base) :], "Then the long red label goes on the lid.\n- the lid\n- ab cd\n- another thing"]
    assert [tr.ends_early(base + t, whole) for t in early] == [True] * len(early)
    assert [tr.ends_early(base + t, whole) for t in complete] == [False] * len(complete)
    assert tr.ends_early("ลูกค้าต้องอ่านคำเตีอนก่อนใช้", "ลูกค้าต้องอ่านคำเตือนก่อนใช้งานทุกครั้ง") and not tr.ends_early("", whole) and not tr.ends_early("a", "")
    long = "It goes on. " * 20_000
    assert tr.ends_early(long + "And", long + "And so it ends.") and not tr.ends_early(long + "And", long)


@pytest.mark.parametrize("block", [2000, 2, 1])
def test_all_texts_of_a_bucket_are_compared(spark, monkeypatch, block):
    # One band of one hash: the common part puts several groups of near-copies and a longer text into one bucket.
    monkeypatch.setattr(tr, "BANDS", 1)
    monkeypatch.setattr(tr, "ROWS", 1)
    monkeypatch.setattr(tr, "BLOCK", block, raising=False)
    common = " ".join(f"the same for all {i}" for i in range(60))
    texts = [f"{common} " + " ".join(f"w{i} own{g}" for i in range(30)) + end for g in range(4) for end in (f" of the long red label{g}.", f" of the long red")]
    texts += [f"{common} " + " ".join(f"more{i} x{i}" for i in range(300)) + "."]
    links = {(r.id, r.other): r.held for r in tr.near_copies(docs(spark, texts), "doc_id", "text").collect()}
    size = lambda t: len(tr._words(t)) - 4
    brute = {(i, j): tr.held(texts[i], texts[j]) for i in range(9) for j in range(9) if i != j and tr.open_end(texts[i]) and size(texts[j]) >= 0.8 * size(texts[i])}
    assert links == pytest.approx({k: v for k, v in brute.items() if v >= 0.8}) and {(i, i - 1) for i in range(1, 8, 2)} <= set(links)


def cut_copies(rng, n, shares, words=170, prefix=""):
    """Texts and copies of them that keep a share of the words, two of which are changed; (id, text) and id -> share."""
    rows, cut = [], {}
    for k in range(n):
        whole = [f"{prefix}w{rng.randrange(4000)}" for _ in range(words)]
        for x in range(12, words, 13):
            whole[x] += "."
        whole[-1] += "."
        copy = whole[: int(words * shares[k % len(shares)])]
        copy[-1] = copy[-1].rstrip(".")
        for _ in range(2):
            copy[rng.randrange(len(copy) - 5)] = f"{prefix}w{rng.randrange(4000)}"
        cut[2 * k + 1] = shares[k % len(shares)]
        rows += [(2 * k, " ".join(whole)), (2 * k + 1, " ".join(copy))]
    return rows, cut


def test_recall_by_share_kept(spark):
    shares = (0.9, 0.75, 0.6, 0.45)  # shorter copies than these are found less often, see the README
    rows, cut = cut_copies(random.Random(5), 200, shares)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id for r in tr.near_copies(df, "doc_id", "text").where("early").collect()}
    assert got <= set(cut)
    for share in shares:
        mine = {i for i, s in cut.items() if s == share and tr.held(rows[i][1], rows[i - 1][1]) >= 0.8}
        assert len(got & mine) >= 0.9 * len(mine), share


def test_judges_do_not_depend_on_the_size_of_the_corpus(spark):
    # The same kinds of texts thirty times over, in other words: what stood cut stays cut, what stood whole stays whole.
    def corpus(times):
        out = []
        for k in range(times):
            out += [f"Note {k} ab{i} is fine.\n- the long red label\n- the lid\nIt ends {k}." for i in range(4)]
        return [*out, "It ends.\n- the long red", "It ends.\n- the lid", "It ends.\n- the long red la"]

    for times in (2, 60):
        texts = corpus(times)
        assert {r.doc_id for r in tr.cut_texts(docs(spark, texts), "doc_id", "text").collect()} == {len(texts) - 3, len(texts) - 1}


def test_shares_and_empty(spark):
    rows = {r.source: (r.n_docs, r.n_cut) for r in tr.cut_shares(docs(spark, ["It ends.", "It en", "It ends.", "It ends."]), "doc_id", "text", "source").collect()}
    assert rows == {None: (2, 0), "src": (2, 1)}
    assert tr.cut_texts(docs(spark, []), "doc_id", "text").collect() == []
    long = "It goes on. " * 50_000
    assert [r.doc_id for r in tr.cut_texts(docs(spark, [long, long + "And"]), "doc_id", "text").collect()] == [1]


def test_only_buckets_that_are_asked_for_are_written(spark, monkeypatch):
    # Few texts are open: the buckets of the others, 16 for every beginning, must not be written out.
    wrote = []
    monkeypatch.setattr(tr, "cut_lineage", lambda df, f=tr.cut_lineage: wrote.append(f(df)) or wrote[-1])
    rows, cut = cut_copies(random.Random(7), 10, (0.9,))
    whole = [(100 + i, text.replace("w", f"v{i}u")) for i, (_, text) in enumerate(rows) if text.endswith(".")]
    whole = [(i + 1000 * k, text.replace("v", f"x{k}v")) for i, text in whole for k in range(20)]
    df = spark.createDataFrame(rows + whole, "doc_id bigint, text string")
    links = {(r.id, r.other) for r in tr.near_copies(df, "doc_id", "text").collect()}
    assert {(i, i - 1) for i in cut} <= links
    arrays = [sum(sum(len(v) for v in r if isinstance(v, list)) for r in df.collect()) for df in wrote]
    assert sum(arrays) < 16 * 8 * len(rows) * 2


def test_bitmap_keeps_its_selectivity(spark):
    import numpy as np

    key = np.random.default_rng(3).integers(0, 2**64, 2_000_000, dtype=np.uint64)
    asks = spark.createDataFrame([(key[i : i + 32].view(np.int64).tolist(),) for i in range(0, 1_000_000, 32)], "buckets array<bigint>")
    bits, n_hashes = tr._bitmap(asks)
    assert tr._kept(bits, n_hashes, key[:1_000_000]).all() and tr._kept(bits, n_hashes, key[1_000_000:]).mean() < 0.05


def test_long_lines_are_told_by_their_first_words():
    import tracemalloc

    line = "word 1 " * 200_000
    tracemalloc.start()
    assert not tr.is_mark_line(line)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # no list of all words
    marks = {"12/30": True, "REF AB-12 v3": True, "---": True, "...": False, "_": False, "- item": False, "Total 12 pieces": False, "a1 b c d e f": False, "": True}
    assert {x: tr.is_mark_line(x) for x in marks} == marks
