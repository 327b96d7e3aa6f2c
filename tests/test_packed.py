import pytest

from proofmill.operators import packed as p

CASES = [
    ("a b / c d / e", ["a b", "c d", "e"]), ("a\tb", ["a", "b"]), ("a;b ；c;", ["a", "b", "c"]), ("1. a  2. b", ["a", "b"]), ("(1) a\n(2) b", ["a", "b"]), ("- a\n- b", ["a", "b"]), ("• a • b", ["a", "b"]), ("a•b", ["a", "b"]),
    ("a<br>b<BR />c", ["a", "b", "c"]), ('"The ""Luvio"" seal","b, boxed"', ['The "Luvio" seal', "b, boxed"]), ('x\t"b; both sides"', ["x", "b; both sides"]), ("a;b\r\nc", ["a", "b", "c"]), ('3+<br>"b / both sides"', ["3+", "b / both sides"]), ("a; ; b", ["a", "b"]), ("R&amp;D seal\tx", ["R&amp;D seal", "x"]),
]
SINGLE = ["R&amp;D seal", "Tested to class 2/3/4 ink", "Tray, lid, base", '"Front | back side"', "Left-hand use only", '"a; see leaflet"', "", "   ", "No. 4 (blue)", "2 x AA", "a, b, c", '"quoted, alone"', "x * (2)"]


def test_splits_cells(spark):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(100 + i, t, "x") for i, t in enumerate(SINGLE)] + [(200, None, None), (0, CASES[0][0], None)]
    df = spark.createDataFrame(rows, "row_id bigint, cell string, item string")
    got: dict[int, list] = {}
    for r in sorted(p.split_cells(df, "row_id", "cell").collect(), key=lambda r: (r.key, r.pos)):
        got.setdefault(r.key, []).append((r.pos, r["item"]))
    for i, (text, want) in enumerate(CASES):
        mine = [x for _, x in got.pop(i)]
        assert (mine[::2] if i == 0 else mine) == want, text  # row 0 is there twice
    assert not got


def test_evidence_decides(spark):
    # "red / blue" stands quoted in other cells, so its slash does not part it; "up" and "down" stand alone elsewhere.
    rows = [(i, f'"red / blue",w{i}x,"v{i}"') for i in range(3)] + [(10 + i, f'"red / blue","v{i}"') for i in range(5)] + [(20, "up"), (21, "down"), (22, "up / down")]
    got = {(r.key, r["item"]) for r in p.split_cells(spark.createDataFrame(rows, "k bigint, c string"), "k", "c").collect()}
    assert (10, "red / blue") in got and {(22, "up"), (22, "down")} <= got


@pytest.mark.parametrize(
    ("cell", "pages"),
    [
        ("1, 3-5", [1, 3, 4, 5]), ('"1-2","2"', [1, 2, 2]), ("p. 2; p.3", [2, 3]), ("P1‑4", [1, 2, 3, 4]), ("2 / 1 / 2", [2, 1, 2]), ("1, 2 & 3", [1, 2, 3]), ("2 and 3", [2, 3]), ("1 3-4 5", [1, 3, 4, 5]), ("3; 1;", [3, 1]), ("1\n2", [1, 2]), ("4-2", [4, 3, 2]),
        ("7", None), ("All Pages", None), ("-", None), ("", None), (None, None), ("Page 1", None), ("2-2", None), ("see sheet 2", None), ("1" * 60 + "x", None), ("12 " * 40 + "x", None), ("1 2", [1, 2]),
        ("page 1 to 3", [1, 2, 3]), ("2, 4 et 6", [2, 4, 6]), ("1, 2 (back)", [1, 2]), ("S. 1 bis S. 3, 5", [1, 2, 3, 5]), ("1 to 2 to 3", None), ("1234567890, 2", None), ("2 y 3", [2, 3]), ("clause 7, 2", None),
    ],
)
def test_page_cells(spark, cell, pages):
    found = p.page_runs(cell).values()
    flat = [[x for a, b in runs for x in (range(a, b + 1) if a <= b else range(a, b - 1, -1))] for runs in found]
    assert flat == [pages] * len(flat) and bool(flat) == (pages is not None)


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "1-3", "x"), (1, "1-3", "x"), (2, None, "x"), (3, "9;8", "x")], "result_id bigint, pages string, item string")
    got = sorted((r.key, r.pos, r["item"]) for r in p.split_pages(df, "result_id", "pages").collect())
    assert got == sorted([(1, 1, "1"), (1, 2, "2"), (1, 3, "3")] * 2 + [(3, 1, "9"), (3, 2, "8")])


def test_wide_ranges_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p, "CHUNK", 3)
    df = spark.createDataFrame([(1, "9, 1-8; 12-5, 2")], "k bigint, c string")
    want = [9, *range(1, 9), *range(12, 4, -1), 2]
    assert sorted((r.pos, r["item"]) for r in p.split_pages(df, "k", "c").collect()) == [(i, str(x)) for i, x in enumerate(want, 1)]
    monkeypatch.setattr(p, "CHUNK", 10_000)
    wide = spark.createDataFrame([(1, "1-3000000")], "k bigint, c string")
    assert p.split_pages(wide, "k", "c").count() == 3_000_000


def test_long_cells_take_no_time():
    assert p.page_runs("1" * 100_000 + "x") == {} and p.page_runs("1 " * 20_000 + "x") == {}
    assert p.parses(" " * 50_000 + "a;b")["semicolon"] == ["a", "b"]


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "row_id bigint, cell string")
    assert p.split_cells(empty, "row_id", "cell").collect() == [] and p.split_pages(empty, "row_id", "cell").collect() == []
    long = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(3000)))], "row_id bigint, cell string")
    assert p.split_cells(long, "row_id", "cell").count() == 3000
