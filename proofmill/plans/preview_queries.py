"""Queries of the preview and evidence operators, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.operators import preview as pv
from proofmill.plans import oracle as q
from proofmill.plans.reference_queries import SQL as REFERENCE_SQL
from proofmill.runtime import table
from proofmill.sources.checklists import evidence_counts

QUERIES, SQL = {}, {}


def query(name: str, tables: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, d: f(*[table(spark, d, t) for t in tables.split()])
        SQL[name] = sql
        return f

    return add


_FLAT = r"coalesce(array_to_string(list_filter(list_transform(string_split_regex(coalesce(symbol_exact_wording, ''), '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> ''), ' | '), '')"


@query("html_escape", "checklist", "SELECT row_id, replace(replace(replace(replace(replace(symbol_exact_wording, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM checklist")
def _(checklist):
    return checklist.select("row_id", pv.html_escape(F.col("symbol_exact_wording")).alias("html"))


@query("flat_wording", "checklist", f"SELECT row_id, {_FLAT} AS wording FROM checklist")
def _(checklist):
    return checklist.select("row_id", pv.flat_wording(F.col("symbol_exact_wording")).alias("wording"))


@query("style_badge", "page_items", "SELECT item_id, concat_ws('/', CASE WHEN bold THEN 'B' END, CASE WHEN underline THEN 'U' END) AS badge FROM page_items")
def _(items):
    return items.select("item_id", pv.badge(F.col("bold"), F.col("underline")).alias("badge"))


@query("format_mm", "page_items", "SELECT item_id, CASE WHEN size_mm IS NOT NULL AND NOT isnan(size_mm) THEN printf('%.1f', round(size_mm, 1)) || ' mm' END AS shown FROM page_items")
def _(items):
    return items.select("item_id", pv.millimetres(F.col("size_mm")).alias("shown"))


_SETS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


@query("sameish", "checklist", f"""
SELECT row_id, a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect({_SETS.format('a')}, {_SETS.format('b')})) >= 0.6 * greatest(len({_SETS.format('a')}), len({_SETS.format('b')})) AS sameish
FROM (SELECT row_id, {q.normalize('symbol_exact_wording')} AS a, {q.normalize("regexp_replace(coalesce(term_html, ''), '<[^>]+>', '', 'g')")} AS b FROM checklist WHERE term_html IS NOT NULL)""")
def _(checklist):
    a, b = tx.normalize(F.col("symbol_exact_wording")), tx.normalize(F.regexp_replace("term_html", "<[^>]+>", ""))
    return checklist.where("term_html is not null").select("row_id", a.alias("a"), b.alias("b")).select("row_id", pv.sameish(F.col("a"), F.col("b")).alias("sameish"))


@query("sure_items", "page_items", f"SELECT item_id FROM page_items WHERE source = 'ocr' AND ((confidence >= {pv.LEAST_CONFIDENCE} AND NOT isnan(confidence)) OR trim(text) IN ('+', '＋'))")
def _(items):
    return pv.sure_items(items.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence"))))


@query("recognition_gate", "page_items", f"""
SELECT doc_id, page_no, count(*) FILTER (WHERE pdf) < {pv.ENOUGH_ITEMS} OR coalesce(max(mm) FILTER (WHERE pdf), 0) < {pv.ENOUGH_MM} AS needs_ocr FROM (SELECT doc_id, page_no, coalesce(source, 'pdf') = 'pdf' AS pdf, {q.picked_mm()} AS mm FROM page_items) GROUP BY 1, 2""")
def _(items):
    return pv.recognition_gate(items)


@query("plus_pages", "page_items", r"SELECT doc_id, page_no, coalesce(bool_or(regexp_matches(text, '(^|[^\p{L}\p{N}_])[0-9]{1,2}\s*[+＋]($|[^\p{L}\p{N}_])')), false) AS has_age FROM page_items GROUP BY 1, 2")
def _(items):
    return pv.plus_pages(items)


@query("code_pages", "page_items", "SELECT doc_id, code, string_agg(page_no::VARCHAR, ', ' ORDER BY page_no) AS pages FROM (SELECT DISTINCT doc_id, page_no, unnest(list_filter(string_split_regex(upper(coalesce(text, '')), '[^A-Z0-9_]+'), lambda t: t IN ("
       + ", ".join(q.quote(c) for c in pv.cl.PART_CODES) + ") OR regexp_full_match(t, '[2-9]LB'))) AS code FROM page_items) GROUP BY 1, 2")
def _(items):
    return pv.code_pages(items)


@query("largest_boxes", "page_items", """
SELECT item_id, rank FROM (SELECT item_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round((bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0), 6) DESC, item_no, item_id)::INT AS rank FROM page_items WHERE bbox IS NOT NULL) WHERE rank <= 4""")
def _(items):
    return pv.largest_boxes(items)


@query("right_neighbours", "page_items", """
SELECT item_id, m.other_id FROM (SELECT a.item_id, min({'gap': round(b.bbox.x0 - a.bbox.x1, 6), 'other_id': b.item_id}) AS m FROM page_items a JOIN page_items b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.item_id <> b.item_id AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL
  AND abs((a.bbox.y0 + a.bbox.y1) / 2 - (b.bbox.y0 + b.bbox.y1) / 2) <= 0.6 * greatest(a.bbox.y1 - a.bbox.y0, b.bbox.y1 - b.bbox.y0) AND b.bbox.x0 - a.bbox.x1 >= 0 AND b.bbox.x0 - a.bbox.x1 <= 1.2 * greatest(a.bbox.y1 - a.bbox.y0, b.bbox.y1 - b.bbox.y0) GROUP BY 1)""")
def _(items):
    return pv.right_neighbours(items)


_STATUS = "CASE WHEN coalesce(lower(trim(verification)) = 'manual' OR coalesce(found_flag, '-') = '-', false) THEN 'manual' WHEN contains(coalesce(found_flag, '-'), 'Not') THEN 'missing' ELSE 'found' END"


@query("preview_rows", "check_result", f"SELECT result_id, {q.dashify('requirement')} AS requirement, {_FLAT} AS symbol, {_STATUS} AS status, CASE WHEN {_STATUS} = 'missing' THEN '-' ELSE {q.dashify('pages')} END AS pages_spec FROM check_result")
def _(results):
    return pv.preview_rows(results)


@query("active_rows", "check_result page_items", f"""
WITH pages AS (SELECT DISTINCT doc_id, page_no FROM page_items), p AS (SELECT x.*, r.doc_id FROM ({REFERENCE_SQL['pages_parse']}) x JOIN check_result r USING (result_id))
SELECT g.doc_id, g.page_no, (SELECT count(*) FROM p WHERE p.doc_id = g.doc_id AND (p.state = 'all' OR p.page + 1 = g.page_no)) AS n_rows FROM pages g""")
def _(results, items):
    return pv.active_rows(results, items)


@query("shown_terms", "check_result", f"""
SELECT doc_id, term, term_no FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY a.result_id, a.p, term)::INT AS term_no FROM (
  SELECT doc_id, term, min({{'result_id': row_id, 'p': term_no}}) AS a FROM ({REFERENCE_SQL['search_terms'].replace('FROM checklist', 'FROM (SELECT result_id AS row_id, symbol_exact_wording FROM check_result)')}) t JOIN (SELECT result_id, doc_id FROM check_result) r ON t.row_id = r.result_id GROUP BY 1, 2)) WHERE term_no <= {pv.TERMS_SHOWN}""")
def _(results):
    return pv.shown_terms(results)


@query("evidence_counts", "page_items", "SELECT doc_id, count(*) FILTER (WHERE coalesce(source, 'pdf') <> 'ocr') AS n_pdf, count(*) FILTER (WHERE coalesce(source, 'pdf') = 'ocr') AS n_ocr, count(*) FILTER (WHERE bold) AS n_bold, count(*) FILTER (WHERE underline) AS n_underline FROM page_items GROUP BY 1")
def _(items):
    return evidence_counts(items)
