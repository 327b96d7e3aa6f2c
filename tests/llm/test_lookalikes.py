import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from proofmill.llm import lookalikes as lk

REF = [(1, "Öl zuerst prüfen"), (2, "Ne pas plier, près du bord"), (3, "Het blad - bij de rand"), (4, "Не сгибать карту"), (5, "カードを折り曲げないでください"), (6, "the ﬂap")]


def found(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, form string")
    ref = spark.createDataFrame([(*r, "x") for r in REF], "wording_id bigint, wording string, form string")
    return sorted((r.row_id, r.wording_id) for r in lk.same_look(df, ["row_id"], "text", ref, "wording_id", "wording").collect())


def test_finds_other_spellings(spark):
    same = [
        ("Ｏ̈l zuerst prüfen", 1), ("Öl zuerst prüfen​", 1), ("Öl zu­erst prüfen", 1), ("Öl zuеrst prüfen", 1), ("Ӧl zuerst prüfen", 1), ("Ne pas plier， près du bord", 2),
        ("Het blad − bij de rand", 3), ("Не сгибaть кaрту", 4), (unicodedata.normalize("NFD", "カードを折り曲げないでください"), 5), ("the flap", 6), ("Öl  zuerst\tprüfen ", 1),
    ]
    other = ["Ol zuerst prüfen", "öl zuerst prüfen", "Öl zuerst prüfen!", "Öl zuerst prufen", "Öl zuerst", "Не сгибать кaрту ещё", None, "", "  ", "​", "Не сгибатъ карту", *(r for _, r in REF)]
    assert found(spark, [t for t, _ in same] + other + [same[0][0]]) == sorted([(i, w) for i, (_, w) in enumerate(same)] + [(len(same) + len(other), 1)])


def test_empty(spark):
    assert found(spark, []) == []


def test_classes_are_transitive_and_frequent_members_stand_for_them():
    table = lk.rewriting({"o": 5, "ο": 1, "о": 9, "ó": 1, "ό": 3})
    assert table["o"] == table["ο"] == "о" and lk.rewriter(table)("oοо") == "ооо"
    assert lk.rewriter(table)("ó") == lk.rewriter(table)("ό") == lk.rewriter(table)("ó")


@given(st.text(alphabet="aàеè​­о οﬁfiＡ A", max_size=12))
def test_forms_do_not_change_again(text):
    rewrite = lk.rewriter(lk.rewriting({c: 1 for c in "aàеè​­о οﬁfiＡ A"}))
    assert rewrite(rewrite(text)) == rewrite(text)


def test_very_long(spark):
    long = "Не сгибать карту " * 20_000
    df = spark.createDataFrame([(1, long.replace("а", "a"))], "row_id bigint, text string")
    ref = spark.createDataFrame([(1, long)], "w bigint, t string")
    assert lk.same_look(df, ["row_id"], "text", ref, "w", "t").count() == 1
