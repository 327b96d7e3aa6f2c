from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofmill.operators import units as u

ITEM = "item_id bigint, size string, size_unit string, size_mm double, extractor string, level string, key string, num string"
A = u._automaton()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("h=6.31mm", (631, 100, "mm")), ("ca. 119 thou", (119, 1, "mil")), ("0,053  in.", (53, 1000, "in")), ('0.058"', (58, 1000, "in")), ("5/64-inch", (5, 64, "in")),
        ("3250 um", (3250, 1, "um")), ("4720 μm", (4720, 1, "um")), ("7.1 Pt.", (71, 10, "pt")), ("0.8 pc", (8, 10, "pica")), ("1 1/8 in", (9, 8, "in")), ("5.5", (55, 10, None)),
        ("", None), (None, None), ("no number", None), ("9" * 50 + " mm", None), ("9" * 6000 + " mm", None),
        ("1.234,5 mm", (12345, 10, "mm")), ("1,234.5 mm", (12345, 10, "mm")), ("1 200 mm", (1200, 1, "mm")), ("1'200,5 mm", (12005, 10, "mm")), ("1.234.567 µm", (1234567, 1, "um")), ("1.234 mm", (1234, 1000, "mm")),
        ("½ in", (1, 2, "in")), ("1½ in", (3, 2, "in")), ("2 ⅜\"", (19, 8, "in")), ("2 m", (2, 1, "m")), ("1 ft", (1, 1, "ft")), ("6 Q", (6, 1, "q")), ("8 didot", (8, 1, "didot")), ("12345678901234567 um", (12345678901234567, 1, "um")),
        ("0.0000000000001 mm", (1, 10**13, "mm")), ("clause 4 120 pt", (120, 1, "pt")), ("0." + "0" * 30 + "1 mm", (0, 10**17, "mm")),
    ],
)
def test_reads_quantities(text, found):
    assert u.read_quantity(text, A) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Clause 7-1: min 3.02 MM", (302, 100, "mm")), ("See drawing 12", None), ("Class 2/3 ink", None), ("Bold, ≥ 1.5", (15, 10, None)), ("> 4", (4, 1, None)), ("3.1", (31, 10, None)),
        ("letter height at least 3.1", (31, 10, None)), ("All caps; cap height from 2520 µm", (2520, 1, "um")), ("≥9/9 inch, no underline", (9, 9, "in")), ("Not below the fold", None), ("-", None),
        ("Höhe 1,2", (12, 10, None)), ("hauteur 1,2", (12, 10, None)), ("Zeichnung 12", None), ("höhe 1.200,5", (12005, 10, None)), ("½", None),
    ],
)
def test_reads_stated_heights(text, found):
    assert u.read_quantity(text, A, heights_only=True) == found


def test_longest_alias_wins_and_letters_bound():
    assert u.read_quantity("12 mils", A)[2] == "mil" and u.read_quantity("12 millimetres", A)[2] == "mm"
    assert u.read_quantity("12 minutes", A) == (12, 1, None)


def test_common_unit(spark):
    rows = [
        (1, "2.0", "in", 50.8, "x", "line", "clash", "clash"), (2, "2.0", None, None, "x", "line", None, None), (3, "10 pt", "mm", 10.0, "x", None, None, None),
        (4, None, "mm", None, "x", "line", None, None), (5, "3", "", None, "y", "line", None, None), (6, "3 mm", None, float("nan"), "y", None, None, None), (6, "3 mm", None, float("nan"), "y", None, None, None),
        (7, "", "mm", None, "x", "line", None, None), (8, "1.0", "mm", 1.005, "z", "line", None, None), (9, "1.0", "mm", 1.02, "z", "line", None, None),
    ]
    got = sorted(map(tuple, u.wrong_sizes(spark.createDataFrame(rows, ITEM)).collect()))
    # 2: unit of its extractor and level; 5: nothing names a unit; repeated row 6 counts twice; 8 is within one per cent.
    assert got == [(2, 50800), (3, 3528), (6, 3000), (6, 3000), (9, 1000)]
    specs = spark.createDataFrame([(1, "≥ 2"), (2, None), (3, ""), (4, "min. 1 pt"), (4, "min. 1 pt"), (5, "x" * 50_000 + " 2 mm")], "row_id bigint, specification string")
    assert sorted(map(tuple, u.stated_heights(specs).collect())) == [(1, 2000), (4, 353), (4, 353), (5, 2000)]
    huge = spark.createDataFrame([(1, "99999999999999999 m"), (2, "9000000000000 m")], "row_id bigint, specification string")  # the first has more micrometres than 64 bits hold
    assert [tuple(r) for r in u.stated_heights(huge).collect()] == [(2, 9 * 10**18)]


def test_empty_tables(spark):
    items, specs = spark.createDataFrame([], ITEM), spark.createDataFrame([], "row_id bigint, specification string")
    assert u.common_unit(items, specs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from([1, 10, 100, 1000]), st.sampled_from(sorted(u.FACTORS))), min_size=1, max_size=40))
def test_rounding_is_exact(spark, rows):
    df = spark.createDataFrame([(n, d, *u.FACTORS[f]) for n, d, f in rows], "num bigint, den bigint, f_num bigint, f_den bigint")
    got = [int(r[0]) for r in df.select(u.micrometres()[0]).collect()]
    want = []
    for n, d, f in rows:
        top, bottom = n * u.FACTORS[f][0], d * u.FACTORS[f][1]
        whole, rest = divmod(top, bottom)
        want.append(whole + (2 * rest > bottom or (2 * rest == bottom and whole % 2 == 1)))
    assert got == want
    assert Decimal("2.5").quantize(Decimal(1), ROUND_HALF_EVEN) == 2
