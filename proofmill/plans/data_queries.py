"""Queries of the general data-processing operators: drift, packed values, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import drift, packed, units
from proofmill.runtime import table


def _drift(f, spark, d):
    return f(table(spark, d, "checklist_files"), table(spark, d, "checklist_raw"), table(spark, d, "checklist"))


def p1_found(spark, d):
    return _drift(drift.changes, spark, d).select("file_id", "field", "change_kind")


def p1_unified(spark, d):
    """Every row of every file under one set of columns; fields the checklist lacks in a map, as JSON here."""
    return _drift(drift.unified, spark, d).withColumn("other_fields", F.to_json("other_fields"))


def p2_found(spark, d):
    return packed.unpack(table(spark, d, "checklist"), table(spark, d, "check_result"))


def p2_values_per_cell(spark, d):
    """How many cells hold how many values."""
    return p2_found(spark, d).groupBy("table_name", "row_id").agg(F.count("*").alias("n_values")).groupBy("table_name", "n_values").agg(F.count("*").alias("n_cells"))


def p5_found(spark, d):
    return units.common_unit(table(spark, d, "page_items"), table(spark, d, "checklist"))


def p5_item_heights(spark, d):
    """Height in micrometres of every page item that states one."""
    return units.in_micrometres(units.item_sizes(table(spark, d, "page_items"))).select("item_id", "unit", "size_um")


QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified, "p2_found": p2_found, "p2_values_per_cell": p2_values_per_cell, "p5_found": p5_found, "p5_item_heights": p5_item_heights}


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_UNITS = f"names(alias, unit) AS (VALUES {_sql_rows((a, u) for u, names in units.ALIASES.items() for a in names)}), factors(unit, fn, fd) AS (VALUES {_sql_rows((u, *f) for u, f in units.FACTORS.items())})"
_UNIT = "([a-zA-Zµμ]+[.]?|\"|″)"
#: Numerator and denominator of a decimal as written, and the rounding of n / d with halves to even.
_NUM, _DEN = "CAST(regexp_replace({0}, '[.,]', '') AS HUGEINT)", "CAST(pow(10, coalesce(nullif(length(regexp_extract({0}, '[.,]([0-9]*)', 1)), 0), 0)) AS HUGEINT)"
_ROUNDED = "(n * fn // (d * fd) + CASE WHEN 2 * (n * fn % (d * fd)) > d * fd OR (2 * (n * fn % (d * fd)) = d * fd AND n * fn // (d * fd) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT"
_SIZES = f"""{_UNITS},
said AS (SELECT p.*, regexp_extract(size, '([0-9]+(?:[.,][0-9]+)?)', 1) AS v, w.unit AS written, o.unit AS beside FROM page_items p
  LEFT JOIN names w ON w.alias = lower(regexp_extract(size, '[0-9]\\s*{_UNIT}', 1)) LEFT JOIN names o ON o.alias = lower(trim(size_unit)) WHERE regexp_matches(size, '[0-9]')),
usual AS (SELECT extractor, level, arg_min(unit, (-n, unit)) AS unit FROM (SELECT extractor, level, coalesce(written, beside) AS unit, count(*) AS n FROM said WHERE coalesce(written, beside) IS NOT NULL GROUP BY ALL) GROUP BY ALL),
sized AS (SELECT s.item_id, s.size_mm, f.unit, f.fn, f.fd, {_NUM.format('s.v')} AS n, {_DEN.format('s.v')} AS d FROM said s LEFT JOIN usual u ON s.extractor IS NOT DISTINCT FROM u.extractor AND s.level IS NOT DISTINCT FROM u.level JOIN factors f ON f.unit = coalesce(s.written, s.beside, u.unit))"""
_SPECS = f"""specs AS (SELECT row_id, CASE WHEN fraction[1] <> '' THEN CAST(fraction[1] AS HUGEINT) WHEN named[1] <> '' THEN {_NUM.format('named[1]')} ELSE {_NUM.format('bare')} END AS n,
    CASE WHEN fraction[1] <> '' THEN CAST(fraction[2] AS HUGEINT) WHEN named[1] <> '' THEN {_DEN.format('named[1]')} ELSE {_DEN.format('bare')} END AS d, CASE WHEN fraction[1] <> '' THEN fraction[3] WHEN named[1] <> '' THEN named[2] ELSE 'mm' END AS alias FROM (
  SELECT row_id, [regexp_extract(s, f, 1), regexp_extract(s, f, 2), regexp_extract(s, f, 3)] AS fraction, [regexp_extract(s, m, 1), regexp_extract(s, m, 2)] AS named, nullif(regexp_extract(s, '(?:[≥>]=?|at least|min[.]|mind[.])\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:$|,)', 1), '') AS bare FROM (
    SELECT row_id, lower(specification) AS s, '([0-9]+)/([0-9]+)[- ]*(' || n.any_name || ')(?:$|[^a-z])' AS f, '([0-9]+(?:[.,][0-9]+)?)[- ]*(' || n.any_name || ')(?:$|[^a-z])' AS m FROM checklist, (SELECT string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) AS any_name FROM names) n WHERE specification IS NOT NULL))
  WHERE fraction[1] <> '' OR named[1] <> '' OR bare IS NOT NULL)"""
SQL: dict[str, str] = {
    "p5_found": f"""WITH {_SIZES}, {_SPECS}
SELECT 'page_items' AS table_name, item_id AS row_id, {_ROUNDED} AS size_um FROM sized WHERE size_mm IS NULL OR isnan(size_mm) OR abs(size_mm * 1000 - n::DOUBLE * fn / (d * fd)) > n::DOUBLE * fn / (d * fd) * 0.01
UNION ALL SELECT 'checklist', row_id, {_ROUNDED} FROM specs JOIN names USING (alias) JOIN factors USING (unit)""",
    "p5_item_heights": f"WITH {_SIZES} SELECT item_id, unit, {_ROUNDED} AS size_um FROM sized",
}
