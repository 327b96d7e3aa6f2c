import pytest

from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.operators import matching as mt

ITEMS = "item_id bigint, doc_id string, page_no int, item_no int, text string, bold boolean, italic boolean, underline boolean, size string, size_unit string, size_mm double, bbox struct<x0:double,y0:double,x1:double,y1:double>, source string, level string, loaded_at timestamp, variant_norm string"


def items(spark, rows):
    full = []
    for i, (doc, page, text, *more) in enumerate(rows):
        extra = more[0] if more else {}
        full.append((i, doc, page, i, text, extra.get("bold"), None, extra.get("underline"), None, None, extra.get("mm"), extra.get("box"), extra.get("source", "pdf"), extra.get("level"), None, "clash"))
    return spark.createDataFrame(full, ITEMS)


def checklist(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "clash") for i, (t, s) in enumerate(rows)], "row_id bigint, symbol_exact_wording string, specification string, term_html string, variant string")


def results(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id string, row_id bigint, variant_norm string")


def test_ladder(spark, monkeypatch):
    texts = [("d", 1, "Rémove ALL ties, now"), ("d", 2, "13+"), ("d", 3, "for ages 3 + only"), ("d", 4, "remove then all the ties"), ("d", 5, None), ("e", 1, "remove all ties")]
    check = checklist(spark, [("Remove all ties", None), ("3+", None), ("missing word", None), ("a;13+", None), (None, None), ("-", None), ("of the", None)])
    rows = results(spark, [("d", i) for i in range(7)] + [("d", 0), ("x", 0), (None, 1), ("d", None), ("d", 99)])
    # "3+" also stands inside "13+"; "a" stands in three texts and 13+ in a fourth; stop words alone match nothing but themselves.
    want = {("d", 0, 2), ("d", 1, 2), ("d", 2, 0), ("d", 3, 4), ("d", 6, 0), ("x", 0, 0)}
    for block in (2000, 1):  # one block of items per document, and one per item
        monkeypatch.setattr(mt, "BLOCK", block)
        got = {(r.doc_id, r.row_id, r.n_pages) for r in mt.term_pages(rows, check, items(spark, texts)).collect()}
        assert got == want


def test_page_fallback_and_fuzzy(spark):
    rows = items(spark, [("d", 1, "remove all"), ("d", 1, "ties here"), ("d", 2, "wipe only with a damp-cloth please now okay!"), ("d", 3, "other")])
    need = mt.required(results(spark, [("d", 0), ("d", 1)]), checklist(spark, [("remove all ties", None), ("wipe only with a damp cloth please now okay.", None)]))
    found = mt.hits(need, rows)
    assert [(r.variant_norm, r.page_no) for r in mt.page_hits(need, rows, found).collect()] == [("remove all ties", 1)]
    assert [r.variant_norm for r in mt.fuzzy(need, rows).collect()] == ["wipe only with a damp cloth please now okay."]


def test_verdicts(spark):
    rows = items(spark, [("d", 1, "one", {"bold": True, "mm": 1.0}), ("d", 1, "TWO", {"underline": True, "mm": 2.0}), ("d", 2, "three"), ("d", 2, "two")])
    check = checklist(spark, [("one", "bold, ≥ 1.5 mm"), ("TWO", "underline"), ("three", "All caps; no underline"), ("TWO", "no underline"), ("none here", "bold"), ("one", None)])
    from pyspark.sql import functions as F

    from proofmill.functions import numbers as nb

    got = {r.row_id: (r.match, r.notes) for r in mt.verdicts(results(spark, [("d", i) for i in range(6)]), check, rows, nb.threshold_mm(F.col("specification"))).collect()}
    assert got == {0: (False, "Font too small"), 1: (True, ""), 2: (False, "Not All Caps"), 3: (False, "Underline must be absent"), 5: (True, "")}


def test_term_verdicts_keep_every_term(spark):
    from pyspark.sql import functions as F

    from proofmill.functions import numbers as nb

    rows = items(spark, [("d", 1, "Keep one dry", {"bold": True, "mm": 1.0}), ("d", 2, "TWO here", {"underline": True, "mm": 2.0}), ("d", 2, "two here", {"mm": None})])
    # Part of an item; two wordings in a cell; no item; no item and a size; styles over all spellings of an item.
    check = checklist(spark, [("one", "bold, ≥ 1.5 mm"), ("one; two here", "bold, underline, ≥ 1.5 mm"), ("none here", "bold"), ("nor here", "≥ 1.5 mm"), ("two here", "all caps; no underline"), ("one", None)])
    got = {(r.row_id, r.term_no): (r.found, r.match, r.notes) for r in mt.term_verdicts(results(spark, [("d", i) for i in range(6)]), check, rows, nb.threshold_mm(F.col("specification"))).collect()}
    assert got == {
        (0, 0): (True, False, "Font too small"), (1, 0): (True, True, ""), (2, 0): (False, False, "Not found on artwork pages; Not Bold"),
        (3, 0): (False, True, "Not found on artwork pages; No measurable text for font size"), (4, 0): (True, False, "Underline must be absent; Not All Caps"), (5, 0): (True, True, ""),
    }


def test_geometry(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = items(spark, [
        ("d", 1, "Text", {"box": box}), ("d", 1, "text ", {"box": (0.0, 0.0, 10.0, 7.0), "source": "ocr"}), ("d", 1, "text", {"box": (0.0, 0.0, 10.0, 5.0), "source": "ocr"}), ("d", 1, "text", {"source": "ocr"}),
        ("d", 1, "other", {"box": box, "source": "ocr"}), ("d", 2, "text", {"box": box, "source": "ocr"}), ("d", 1, None, {"box": (1.0, 1.0, 9.0, 9.0), "source": None}),
    ])
    assert sorted(r.item_id for r in it.new_ocr_items(rows).collect()) == [2, 3, 4, 5]
    assert sorted(r.item_id for r in it.grid_first(rows).collect()) == [0, 1, 5]
    near = {r.item_id: r.other_id for r in it.nearest(rows).collect()}
    assert near[0] in (4, 6) and 5 not in near and 6 not in near
    assert [tuple(r) for r in it.page_boxes(rows).orderBy("page_no").collect()] == [("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, 0.0, 0.0, 10.0, 10.0)]


def test_lines_and_pages(spark):
    word = lambda t, x, y: ("d", 1, t, {"box": (x, y, x + 8.0, y + 4.0), "source": "ocr"})
    rows = items(spark, [word("b", 10.0, 0.5), word("a", 0.0, 0.0), word("far", 60.0, 0.2), word("low", 0.0, 20.0), word(None, 10.0, 20.0)])
    got = sorted((r.line_no, r.text, r.n_words) for r in it.ocr_lines(rows).collect())
    assert sorted(t for _, t, _ in got) == ["a b", "far", "low "]
    assert [r.page_text for r in it.page_texts(items(spark, [("d", 1, "x"), ("d", 1, None), ("d", 1, "y")])).collect()] == ["x  y"]
    info = it.product_info(items(spark, [("d", 1, "Big name", {"mm": 2.0}), ("d", 1, "AB12-C3 rev A2"), ("d", 1, "ZZ-99 A3"), ("d", 2, None)])).orderBy("page").collect()
    assert [tuple(r)[1:] for r in info] == [(1, "Big name", "AB12-C3", "A2"), (2, "-", "-", "-")]


def test_empty(spark):
    none = items(spark, [])
    for f in (it.page_texts, it.artwork_pages, it.product_info, it.built_lines, it.distinct_items, it.ranked_items, it.new_ocr_items, it.nearest, it.grid_first, it.page_boxes, it.inside_artwork, it.underlined_by, it.ocr_lines, it.latest):
        assert f(none).collect() == []
    assert mt.term_pages(results(spark, []), checklist(spark, []), none).collect() == []


def test_image_groups_without_a_name_are_parsed(spark):
    from pyspark.sql import functions as F

    rows = [(1, [("", "any", ["a", "b"])]), (2, [("N", "all", ["c"]), (" ", "all", ["d\\e", "-"]), (None, None, ["f"])]), (3, [("", "any", []), ("M", None, ["g"])]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "row_id bigint, image_groups_resolved array<struct<name:string,mode:string,paths:array<string>>>")
    got = {r.row_id: [(g.name, g.mode, g.paths) for g in r.g] for r in df.select("row_id", cl.all_image_groups(F.col("image_groups_resolved")).alias("g")).collect()}
    assert got == {1: [("", "any", ["a", "b"])], 2: [("", "all", ["d/e"]), ("", "any", ["f"]), ("N", "all", ["c"])], 3: [("M", "any", ["g"])], 4: [], 5: []}


def test_checklist_rows(spark):
    schema = "row_id bigint, checklist_id string, row_no int, requirement string, symbol_exact_wording string, specification string, verification string, remark string, has_image boolean"
    rows = [
        (1, "c", 1, "Age mark", "x", None, "Manual", None, False), (2, "c", 2, None, "x", "click here", None, None, False), (3, "c", 3, None, "-", "n/a".replace("n/a", "-"), None, None, None), (4, "c", 4, "Brand logo", "x", None, None, None, None),
        (5, "c", 5, None, None, "spec", None, None, None), (6, "c", 6, "B", "x", None, None, None, None), (7, "c", 6, "B", "x", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r.row_class for r in cl.row_class(df).orderBy("row_id").collect()] == ["manual", "skip", "empty", "keyword", "keyword", "verify", "verify"]
    assert [r.requirement for r in cl.filled(df).orderBy("row_id").collect()] == ["Age mark"] * 3 + ["Brand logo"] * 2 + ["B"] * 2
    assert len({r.report_no for r in cl.ordered_groups(df).collect()}) == 7


@pytest.mark.parametrize("many", [0, 10**9])
def test_nearly_equal_against_brute_force(spark, monkeypatch, many):
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(mt, "MANY", many, raising=False)
    rng, variants, texts = random.Random(4), [], []
    for n in [*range(10, 60), 75, 100, 101, 140, 149, 150, 151, 170]:
        base = "".join(rng.choice("abcdefgh, ") for _ in range(n)).strip() + "!"
        variants.append(" ".join(base.split()))
        for _ in range(6):  # changed, dropped, added and moved characters, often one more than the ratio allows
            t = list(variants[-1])
            for _ in range(rng.randint(0, max(1, n // 20))):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))]
            texts.append(("d", " ".join("".join(t).split()), rng.choice(["pdf", "pdf", "ocr"])))
    wanted = spark.createDataFrame([("d", v) for v in variants] + [("e", variants[0])], "doc_id string, variant_norm string")
    shown = spark.createDataFrame(texts, "doc_id string, text_norm string, source string")
    flat = lambda t: " ".join(t.replace("-", " ").split())
    want = {(v, t, s): round(r, 6) for v in variants for _, t, s in texts if (s != "ocr" or len(v) <= 6) and (r := SequenceMatcher(None, flat(v), flat(t)).ratio()) >= 0.96}
    got = {(r.variant_norm, r.text_norm, r.source): r.ratio for r in mt.nearly_equal(wanted, shown).collect()}
    assert got == want and len(want) > 60


def test_few_of_a_large_document_are_compared(spark):
    # Texts of one length that have no piece in common don't meet.
    from pyspark.sql import functions as F

    df = spark.range(600).select(F.lit("d").alias("doc_id"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40).alias("a"))
    v, t = mt._near_keys(df, df.select("doc_id", F.col("a").alias("b"), F.length("a").alias("size")))
    assert v.join(t, ["doc_id", "key"]).where("a != b").count() < 60


def test_long_wordings_need_no_pattern(spark):
    # Ten thousand words as one pattern overflow the stack when it is compiled.
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = items(spark, [("d", 1, long.replace("word9 ", "word9 more ")), ("d", 2, "word1 word2")])
    need = mt.required(results(spark, [("d", 0), ("d", 1)]), checklist(spark, [(long, None), ("word1 a_b", None)]))
    assert [(r.variant_norm == long, r.page_no) for r in mt.hits(need, rows).collect()] == [(True, 1)]
    assert [(r.variant_norm == long, r.page_no) for r in mt.page_hits(need, rows, mt.hits(need, rows).limit(0)).collect()] == [(True, 1)]
