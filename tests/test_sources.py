from datetime import datetime

import pytest

from proofmill.operators import checklists as cl
from proofmill.sources import checklists as src
from proofmill.streaming import deliveries as dl


def test_columns_and_header():
    got = src.column_names(["Requirement", "Symbol/ Exact\nwording", "Specification", "Remark", "Remark Link", "Package Panel", "Other", ""])
    assert got == {"Requirement": "requirement", "Symbol/ Exact\nwording": "symbol_exact_wording", "Specification": "specification", "Remark": "remark", "Remark Link": "remark_link", "Package Panel": "package_panel"}
    rows = [["Title", None], ["=A1", "“x”"], ["Requirement", "Symbol", "Remark"], ["Requirement", "Symbol", "Remark"], [None, None]]
    assert src.header_row(rows) == 2 and src.header_row([]) == 0
    assert src.pick_sheet(["Cover", "dom 1"], ["DOM"]) == "dom 1" and src.pick_sheet(["Cover"], ["DOM"]) == "Cover" and src.pick_sheet([], ["DOM"]) is None


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Age mark", "a,b\n\"c\"", None), ("B", "", "x")], "requirement string, `exact wording` string, remark string")
    for kind in ("parquet", "json", "csv"):
        writer = df.write.format(kind)
        (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).save(str(tmp_path / kind))
        got = src.read_checklist(spark, str(tmp_path / kind), kind)
        assert set(got.columns) == {"requirement", "symbol_exact_wording", "remark"}
        assert {r.symbol_exact_wording or "" for r in got.collect()} == {"a,b\n\"c\"", ""}
    with pytest.raises(ValueError):
        src.read_checklist(spark, "x.odd")


def test_report_sink(spark, tmp_path):
    rows = [(1, *[None] * 12, "Manual"), (2, *["–"] * 12, "x")]
    df = spark.createDataFrame(rows, "result_id bigint, " + ", ".join(f"{c} string" for c in cl.REPORT))
    src.write_report(df, str(tmp_path / "out"), "csv")
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("result_id").collect()
    assert got[0].pages == "-" and got[1].note == "-" and got[1].verification == "x" and len(got[0]) == 14
    with pytest.raises(ValueError):
        src.write_report(df, str(tmp_path / "no"), "odd")


def test_stream(spark, tmp_path):
    schema = "item_id bigint, doc_id string, page_no int, item_no int, text string, loaded_at timestamp_ntz"
    day = datetime(2024, 1, 5)
    rows = [(1, "d", 1, 1, "É", day), (2, "d", 1, 1, "É", day), (3, "d", 1, 2, None, day), (4, "e", 1, 1, "x", day)]
    path = str(tmp_path / "items")
    spark.createDataFrame(rows, schema).write.parquet(path)
    for name, f in (("once", dl.first_deliveries), ("daily", dl.daily_counts)):
        q = f(dl.read_items(spark, path)).writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "update").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.doc_id, r.item_no, r.text_norm) for r in spark.table("once").collect()) == [("d", 1, "e"), ("d", 2, ""), ("e", 1, "x")]
    assert sorted((r.doc_id, r.n_items) for r in spark.table("daily").collect()) == [("d", 3), ("e", 1)]
