import itertools
import json
import random
from datetime import datetime

from proofmill.operators import drift as d

CHECKLIST = "row_id bigint, " + ", ".join(f"{t} string" for t in d.TARGETS)
FILES = "file_id bigint, template_id string, exported_at timestamp, name string"
RAW = "raw_id bigint, file_id bigint, sheet_row int, payload string, kind string"


def tables(spark, files, raw, checklist=()):
    return (
        spark.createDataFrame([(*f, "clash") for f in files], FILES),
        spark.createDataFrame([(i, f, i, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, (f, p) in enumerate(raw)], RAW),
        spark.createDataFrame(list(checklist), CHECKLIST),
    )


def run(spark, files, raw, checklist=()):
    return sorted((r.file_id, r.field, r.change_kind) for r in d.changes(*tables(spark, files, raw, checklist)).collect())


def test_reports_changes(spark):
    files = [(3, "T", datetime(2024, 3, 9)), (1, "T", datetime(2024, 1, 5)), (2, "T", datetime(2024, 1, 9)), (9, "U", datetime(2024, 1, 1)), (4, "T", datetime(2024, 5, 1))]
    words = ["Age grading mark", "Storage advice", "Brand seal", "Importer block"]
    raw = [(1, {"Requirement": w, "Remark": "ask plant", "Due Week": 3}) for w in words]
    raw += [(2, {"requirement ": w, "Bemerkung": "ask plant", "due\nweek": "W3", "Eco Mark": True}) for w in words]
    raw += [(3, {"Exigence": [w], "Bemerkung": "ask plant", "Eco Mark": None}) for w in words] + [(3, None), (3, "{broken"), (3, "[1]"), (3, {})]
    raw += [(9, {"Requirement": w}) for w in words] + [(77, {"Requirement": "of no listed file"})]
    assert run(spark, files, raw) == sorted([
        (2, "remark", "renamed"), (2, "Due Week", "retyped"), (2, "Eco Mark", "added"),
        (3, "requirement", "renamed"), (3, "requirement", "retyped"), (3, "Due Week", "removed"),
        (4, "requirement", "removed"), (4, "remark", "removed"), (4, "Eco Mark", "removed"),
    ])


def test_removed_and_added_are_no_rename(spark):
    files = [(1, "T", datetime(2024, 1, 5)), (2, "T", datetime(2024, 2, 9))]
    raw = [(1, {"Requirement": "Age grading mark", "Remark": "ask plant"})] * 5 + [(2, {"Remark": "ask plant", "Specification": "Bold, min 2 mm"})] * 5
    assert run(spark, files, raw) == [(2, "requirement", "removed"), (2, "specification", "added")]


def test_strays_and_ties_do_not_retype(spark):
    files = [(1, "T", datetime(2024, 1, 5)), (2, "T", datetime(2024, 1, 6))]
    raw = [(1, {"Due Week": 3})] * 4 + [(2, {"Due Week": 3})] * 2 + [(2, {"Due Week": "W3"})] * 2
    assert run(spark, files, raw) == []


def test_empty(spark):
    assert run(spark, [], []) == []


def test_unified(spark):
    files = [(1, "T", datetime(2024, 1, 5)), (2, "T", datetime(2024, 2, 5))]
    raw = [(1, {"Requirement": "Age mark", "Odd": 1}), (2, {"Requirements ": "Age mark"}), (2, None)]
    rows = {r.raw_id: r for r in d.unified(*tables(spark, files, raw)).collect()}
    assert rows[0].requirement == rows[1].requirement == "Age mark" and rows[0].other_fields == {"odd": "1"} and rows[2].requirement is None and len(rows) == 3


def test_unified_joins_renamed_fields_and_keeps_every_value(spark):
    files = [(1, "T", datetime(2024, 1, 5)), (2, "T", datetime(2024, 2, 5)), (3, "T", datetime(2024, 3, 5)), (4, "U", datetime(2024, 1, 1))]
    words = ["crimson dye lot", "azure dye lot", "olive dye lot"]
    raw = [(1, {"Requirement": "Age mark", "Shade batch": w}) for w in words] + [(2, {"Requirement": "Age mark", "Shade group": w}) for w in words] + [(3, {"Requirement": "Age mark", "Farbcharge": w}) for w in words]
    raw += [(4, {"Farbcharge": "x", "farb charge": "y", "Requirement": "Age mark", "requirement ": "Brand seal"})]
    rows = [r for r in d.unified(*tables(spark, files, raw)).orderBy("raw_id").collect()]
    assert [r.other_fields for r in rows[:9]] == [{"shadebatch": w} for w in words * 3]  # as in the first file of the template
    assert rows[9].requirement == "Brand seal" and rows[9].other_fields == {"farbcharge": "x", "farbcharge 2": "y", "requirement": "Age mark"}
    assert len(rows) == 10


def test_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        score = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        best = max(sum(score[i][j] for i, j in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        found = d.assign(score)
        assert len({j for j in found if j >= 0}) == sum(j >= 0 for j in found)
        assert abs(sum(score[i][j] for i, j in enumerate(found) if j >= 0) - best) < 1e-9
