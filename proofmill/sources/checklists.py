"""Checklist tables from files, and result tables to files.

CSV, JSON lines, Parquet and Excel (the last where pandas can read it) give the checklist columns of the data model; the
header row of a raw sheet is found by score, its columns by keyword.  Results go out as Parquet, CSV or JSON lines, one
blank spelling for all blanks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import checklists as cl

#: Keywords by which a sheet's columns are known, most specific first.
COLUMN_KEYS = {
    "symbol_exact_wording": ["exact wording", "symbol", "wording", "term"], "specification": ["specification", "spec"], "requirement": ["requirement"], "language": ["language"],
    "verification": ["verification", "verified"], "package_panel": ["panel"], "procedure_text": ["procedure"], "remark_link": ["remark link", "link"], "remark": ["remark", "comment"],
}


def column_names(headers: list[str]) -> dict[str, str]:
    """header -> checklist column, each column once, by the first keyword that a free header holds."""
    free, out = [h for h in headers if h and h.strip()], {}
    for column, keys in COLUMN_KEYS.items():
        for key in keys:
            hit = next((h for h in free if key in " ".join(h.lower().split())), None)
            if hit is not None:
                out[hit] = column
                free.remove(hit)
                break
    return out


def header_row(rows: list[list[str | None]]) -> int:
    """Place of the row most like a header among the first 15 that hold two or more cells; the upper one on a tie."""
    best, at = None, 0
    for i, row in enumerate(rows):
        cells = [str(c).strip() for c in row if c is not None and str(c).strip()]
        if len(cells) < 2 or i >= 15:
            continue
        score = sum(5 * any(w in c.lower() for w in cl.HEADER_WORDS) + (len(c) <= 24) - 2 * any(x in c for x in "=“”") for c in cells)
        if best is None or score > best:
            best, at = score, i
    return at


def pick_sheet(names: list[str], codes: list[str]) -> str | None:
    """The first sheet whose name, in capitals and without blanks, starts with one of the codes; else the first."""
    tight = {n: "".join(n.upper().split()) for n in names}
    return next((n for n in names if any(tight[n].startswith(c) for c in codes)), names[0] if names else None)


def read_excel(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """A checklist workbook.  One workbook is small by nature and is read in the driver; needs an Excel reader for pandas."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None, header=None, dtype=str)
    frame = sheets[pick_sheet(list(sheets), codes or cl.PART_CODES)]
    rows = frame.where(frame.notna(), None).values.tolist()
    at = header_row(rows)
    headers = [str(h) if h is not None else "" for h in rows[at]]
    names = column_names(headers)
    places = {names[h]: i for i, h in enumerate(headers) if h in names}
    data = [(n + 1, at + n + 2, *(r[places[c]] if c in places else None for c in COLUMN_KEYS)) for n, r in enumerate(rows[at + 1 :]) if any(r)]
    return spark.createDataFrame(data, "row_no int, sheet_row int, " + ", ".join(f"{c} string" for c in COLUMN_KEYS))


def read_checklist(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A checklist of any supported kind, by name ending where none is given."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if kind in ("xlsx", "xls", "xlsm"):
        return read_excel(spark, path)
    if kind == "parquet":
        frame = spark.read.parquet(path)
    elif kind in ("json", "jsonl"):
        frame = spark.read.json(path)
    elif kind in ("csv", "tsv", "txt"):
        frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        raise ValueError(f"no reader for {kind!r}")
    names = column_names(frame.columns)
    return frame.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in frame.columns])


def write_report(results: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """The display table in its fixed column order."""
    out = cl.report(results)
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for {kind!r}")
    writer = out.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def evidence_counts(items: DataFrame) -> DataFrame:
    """doc_id, n_pdf, n_ocr, n_bold, n_underline: what the log of a check counts."""
    source = F.coalesce("source", F.lit("pdf"))
    return items.groupBy("doc_id").agg(F.count_if(source != "ocr").alias("n_pdf"), F.count_if(source == "ocr").alias("n_ocr"), F.count_if("bold").alias("n_bold"), F.count_if("underline").alias("n_underline"))
