import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.functions import numbers as nb
from proofmill.functions import text as tx
from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.operators import pages as pg

LETTERS = "abzAZ 019+-–—‐➕éÀßöłŁżŻĳﬁ½ªＡ＋，　​ςΣάЁйŅ̃́ดำ™…\t\n ガ"


def evaluate(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.select("i", *columns).orderBy("i").collect()]


def model(text):
    s = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    s = s.translate(str.maketrans(tx.SIGNS)).lower().replace("ς", "σ")
    return " ".join(re.split(r"[\s\x1c-\x1f\x85]+", s)).strip()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=15), min_size=1, max_size=30))
def test_normalize_against_model(spark, texts):
    assert evaluate(spark, texts, tx.normalize(F.col("t"))) == [model(t) for t in texts]


def test_normalize_odd_values(spark):
    assert evaluate(spark, [None, "", " ", "x" * 100_000], F.length(tx.normalize(F.col("t")))) == [0, 0, 0, 100_000]


@pytest.mark.parametrize(("spec", "mm"), [("≥ 1.2 mm", 1.2), ("> 6 pt", 6 * 25.4 / 72), ("<= 2mm", 2.0), ("≤ 2 mm", None), ("min 1.2 mm", None), ("> 1,5", 1.0), (None, None), ("", None)])
def test_threshold(spark, spec, mm):
    assert evaluate(spark, [spec], nb.threshold_mm(F.col("t")))[0] == (pytest.approx(mm) if mm is not None else None)


def test_text_predicates(spark):
    texts = ["ABC", "AbC", "ÉÀ 1", "123", "", None, "3+", "AB", "plain words"]
    assert evaluate(spark, texts, tx.all_caps(F.col("t"))) == [True, False, True, False, False, False, False, True, False]
    assert evaluate(spark, texts, tx.risky(F.col("t"))) == [True, True, True, True, True, True, True, True, False]
    assert evaluate(spark, ["", " – ", "None", "nan", None, "x ", "--="], tx.dashify(F.col("t"))) == ["-", "-", "-", "-", "-", "x", "-"]
    assert evaluate(spark, ["<u>a <b>b</b></u> c <U>d\ne</U><u> </u>", None], tx.underlined(F.col("t"))) == [["a b", "d\ne"], []]
    assert evaluate(spark, ["see www.a.b and https://c.d/e", None], tx.linkify(F.col("t"))) == ['see <a href="http://www.a.b">www.a.b</a> and <a href="https://c.d/e">https://c.d/e</a>', None]


@pytest.mark.parametrize(
    ("term", "variants"),
    [
        ("a\nb;c|d", ["a", "b", "c", "d"]), ("a<br>b", ["a", "b"]), ("a or b / c", ["a or b", "c"]), ("Made in China. Hecho en China. ", ["Made in China", "Hecho en China"]), ("plain. term", ["plain. term"]), ("x", ["x"]), ("/", ["/"]), (" a , b・c ", ["a", "b", "c"]),
    ],
)
def test_variants(spark, term, variants):
    assert evaluate(spark, [term], cl.split_variants(F.col("t")))[0] == variants


def test_search_terms(spark):
    got = evaluate(spark, ["a.;a|3+\nb,", "-", None, " ; "], cl.search_terms(F.col("t")))
    assert got == [["a", "3+", "3 +", "3＋", "b"], [], [], []]
    assert evaluate(spark, ["a b", "ab"], F.size(cl.space_variants(F.col("t")))) == [7, 1]


def test_image_groups(spark):
    cells = ["[GROUP: Old logo][ALL]\n//s/a.png\n\\\\s\\b.png\n[group: New][any]\nc.png;d.png|N/A", "a.png;b.png", "", None, "[GROUP: x][ANY]", "p.png\n[GROUP: y][ALL]\nq.png", "x.png\n100.png\n2 a.png"]
    got = [[tuple(g) for g in x] for x in evaluate(spark, cells, cl.parse_image_groups(F.col("t")))]
    assert got == [
        [("Old logo", "all", ["//s/a.png", "//s/b.png"]), ("New", "any", ["c.png", "d.png"])], [("", "any", ["a.png", "b.png"])], [], [], [], [("", "any", ["p.png"]), ("y", "all", ["q.png"])], [("", "any", ["x.png", "100.png", "2 a.png"])],
    ]


def test_pages(spark):
    specs = ["1-3, 5", "All Pages", "-", "", None, "9", "0-2", "x, 2", "3-1", "2 4"]
    assert evaluate(spark, specs, pg.parsed(F.col("t"), F.lit(5))) == [[0, 1, 2, 4], None, [], [], [], [], [0, 1], [1], [], [1, 3]]
    rows = spark.createDataFrame([("k", p) for p in (5, 1, 2, 3, 3, None)] + [("l", 7)], "k string, p int")
    assert sorted(map(tuple, pg.compacted(rows, ["k"], "p").collect())) == [("k", "1-3, 5"), ("l", "7")]
    found = spark.createDataFrame([("d", "v", p) for p in range(1, 10)] + [("d", "w", 2), ("d", "w", 1), ("d", "x", 99)], "doc_id string, v string, page_no int")
    art = spark.createDataFrame([("d", p) for p in range(1, 11)], "doc_id string, page_no int")
    assert sorted((r.v, r.pages) for r in pg.formatted(found, art, ["v"]).collect()) == [("v", "All Pages"), ("w", "1, 2"), ("x", "-")]


def test_warning_forms(spark):
    texts = ["small parts may be generated", "small parts.", "small parts; small  parts - may be generated", "none", None]
    assert evaluate(spark, texts, it.warning_class(F.coalesce("t", F.lit("")))) == ["MBG", "SHORT", "BOTH", "UNKNOWN", "UNKNOWN"]
    assert evaluate(spark, ["uu1_dom x 3LB 9lb DOM", None, "2lbx"], it.part_codes(F.col("t"))) == [["3LB", "9LB", "DOM", "UU1_DOM"], [], []]


def test_remark_and_origin(spark):
    rows = spark.createDataFrame([("a = DE\nzz = FR", "xx a"), (None, "a"), ("x", None)], "remark string, term string")
    assert [r[0] for r in rows.select(cl.remark_languages(F.col("remark"), F.col("term"))).collect()] == [["DE"], ["Unspecified"], ["Unspecified"]]
    langs = spark.createDataFrame([(["german", " Dutch "],), (["Unspecified"],), ([],), (None,)], "l array<string>")
    got = [r[0] for r in langs.select(cl.origin_phrases(F.col("l"))).collect()]
    assert got[0] == ["hergestellt in", "gemaakt in", "vervaardigd in"] and got[1] == [] and got[2] == got[3] and len(got[2]) > 15
