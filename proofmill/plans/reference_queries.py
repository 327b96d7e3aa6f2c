"""Queries of the checklist-and-artwork operators, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import numbers as nb
from proofmill.functions import text as tx
from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.operators import matching as mt
from proofmill.operators import pages as pg
from proofmill.plans import oracle as q
from proofmill.runtime import spread, table

QUERIES, SQL = {}, {}


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(*[table(spark, d, t) for t in tables.split()])
        if sql:
            SQL[name] = sql
        return f

    return add


ITEM_TEXT = f"(SELECT * REPLACE ({q.normalize('text')} AS text) FROM page_items)"


# --- text and numbers -------------------------------------------------------------------------------------------------
@query("norm_text", "page_items", f"SELECT item_id, {q.normalize('text')} AS text_norm FROM page_items")
def _(items):
    return items.select("item_id", tx.normalize(F.col("text")).alias("text_norm"))


@query("norm_documents", "documents", f"SELECT doc_id, {q.normalize('text')} AS text_norm FROM documents")
def _(docs):
    return spread(docs.select("doc_id", "text")).select("doc_id", tx.normalize(F.col("text")).alias("text_norm"))


@query("latin_fold", "page_items", f"SELECT item_id, {q.latin_fold('text')} AS folded FROM page_items")
def _(items):
    return items.select("item_id", tx.latin_fold(F.col("text")).alias("folded"))


@query("all_caps", "page_items", f"SELECT item_id, {q.all_caps('text')} AS all_caps FROM page_items")
def _(items):
    return items.select("item_id", tx.all_caps(F.col("text")).alias("all_caps"))


@query("risky_term", "checklist", f"SELECT row_id, {q.risky('symbol_exact_wording')} AS risky FROM checklist")
def _(checklist):
    return checklist.select("row_id", tx.risky(F.col("symbol_exact_wording")).alias("risky"))


@query("report_table", "check_result", f"SELECT result_id, {', '.join(f'{q.dashify(c)} AS {c}' for c in cl.REPORT)} FROM check_result")
def _(results):
    return cl.report(results)


@query("threshold_parse", "checklist", r"""
SELECT row_id, round(CASE WHEN u = 'pt' THEN v * 25.4 / 72 ELSE v END, 6) AS least_mm FROM (
  SELECT row_id, try_cast(nullif(regexp_extract(s, '(?:≥|<=|>=|<|>)\s*(\d+(?:\.\d+)?)\s*((?:mm|pt)?)', 1), '') AS DOUBLE) AS v, regexp_extract(s, '(?:≥|<=|>=|<|>)\s*(\d+(?:\.\d+)?)\s*((?:mm|pt)?)', 2) AS u
  FROM (SELECT row_id, trim(lower(specification)) AS s FROM checklist))""")
def _(checklist):
    return checklist.select("row_id", F.round(nb.threshold_mm(F.col("specification")), 6).alias("least_mm"))


@query("pick_size", "page_items", f"SELECT item_id, round({q.picked_mm()}, 6) AS mm FROM page_items")
def _(items):
    return items.select("item_id", F.round(nb.picked_mm(F.col("size_mm"), F.col("size"), F.col("size_unit")), 6).alias("mm"))


@query("code_tokens", "documents", f"""
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(upper(coalesce(text, '')), '[^A-Z0-9_]+'), lambda t: t IN ({', '.join(q.quote(c) for c in cl.PART_CODES)}) OR regexp_full_match(t, '[2-9]LB')))), ','), '') AS codes FROM documents""")
def _(docs):
    return docs.select("doc_id", F.array_join(it.part_codes(F.col("text")), ",").alias("codes"))


@query("underlined_parts", "checklist", r"""
SELECT row_id, (i - 1)::INT AS pos, t AS part FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) AS i, t FROM (
  SELECT row_id, generate_subscripts(u, 1) AS i, trim(regexp_replace(unnest(u), '<[^>]+>', '', 'g')) AS t FROM (SELECT row_id, regexp_extract_all(coalesce(term_html, ''), '(?is)<u>(.*?)</u>', 1) AS u FROM checklist)) WHERE t <> '')""")
def _(checklist):
    return checklist.select("row_id", F.posexplode(tx.underlined(F.col("term_html"))).alias("pos", "part"))


@query("linkify", "checklist", r"""
SELECT row_id, regexp_replace(regexp_replace(remark_link, '(?i)(^|[^/\w])(www\.[^\s<>"]+)', '\1<a href="http://\2">\2</a>', 'g'), '(?i)(^|[^"\w>/])(https?://[^\s<>"]+)', '\1<a href="\2">\2</a>', 'g') AS html FROM checklist""")
def _(checklist):
    return checklist.select("row_id", tx.linkify(F.col("remark_link")).alias("html"))


# --- checklist --------------------------------------------------------------------------------------------------------
@query("ffill", "checklist", "SELECT row_id, last_value(requirement IGNORE NULLS) OVER (PARTITION BY checklist_id ORDER BY row_no, row_id ROWS UNBOUNDED PRECEDING) AS requirement FROM checklist")
def _(checklist):
    return cl.filled(checklist).select("row_id", "requirement")


_WORDS = "concat_ws(' ', coalesce(requirement, ''), coalesce(specification, ''), coalesce(remark, ''))"


@query("row_class", "checklist", f"""
SELECT row_id, CASE WHEN lower(trim(verification)) = 'manual' THEN 'manual'
  WHEN {q.any_of("coalesce(requirement, '')", cl.SKIP)} OR {q.any_of("coalesce(specification, '')", cl.SKIP)} THEN 'skip'
  WHEN ({q.dashify('symbol_exact_wording')}) = '-' AND ({q.dashify('specification')}) = '-' AND ({q.dashify('remark')}) = '-' AND NOT coalesce(has_image, false) THEN 'empty'
  WHEN {q.any_of(_WORDS, cl.MANUAL)} OR ({q.dashify('symbol_exact_wording')}) = '-' THEN 'keyword' ELSE 'verify' END AS row_class FROM checklist""")
def _(checklist):
    return cl.row_class(checklist).select("row_id", "row_class")


@query("term_list", "checklist", f"WITH {q.TERMS} SELECT row_id, term_no::INT AS term_no, term FROM terms")
def _(checklist):
    return cl.terms(checklist)


@query("split_variants", "checklist", f"WITH {q.TERMS}, {q.VARIANTS} SELECT row_id, term_no::INT AS term_no, variant_no::INT AS variant_no, variant FROM variants")
def _(checklist):
    return cl.variants(cl.terms(checklist))


@query("search_terms", "checklist", r"""
SELECT row_id, t AS term, (row_number() OVER (PARTITION BY row_id ORDER BY a) - 1)::INT AS term_no FROM (SELECT row_id, t, min(i * 3 + j) AS a FROM (
  SELECT row_id, i, generate_subscripts(l, 1) AS j, unnest(l) AS t FROM (SELECT row_id, i, CASE WHEN contains(p, '3+') THEN [p, '3 +', '3＋'] ELSE [p] END AS l FROM (
    SELECT row_id, i, regexp_replace(trim(p), '^[ .;,，、：:]+|[ .;,，、：:]+$', '', 'g') AS p FROM (
      SELECT row_id, generate_subscripts(s, 1) AS i, unnest(s) AS p FROM (SELECT row_id, string_split_regex(replace(coalesce(symbol_exact_wording, ''), chr(13), ''), '[|;\n]+') AS s FROM checklist)))
    WHERE p <> '' AND p <> '-')) GROUP BY row_id, t)""")
def _(checklist):
    return checklist.select("row_id", F.posexplode(cl.search_terms(F.col("symbol_exact_wording"))).alias("term_no", "term"))


@query("space_variants", "wording_ref", """
SELECT wording_id, unnest(CASE WHEN contains(text, ' ') THEN list_distinct([text, replace(text, ' ', chr(160)), replace(text, ' ', chr(8201)), replace(text, ' ', chr(8194)), replace(text, ' ', chr(8195)), replace(text, ' ', chr(8239)), replace(text, ' ', '  ')]) ELSE [text] END) AS variant FROM wording_ref""")
def _(ref):
    return ref.select("wording_id", F.explode(cl.space_variants(F.col("text"))).alias("variant"))


@query("origin_phrases", "checklist", "SELECT c.row_id, (row_number() OVER (PARTITION BY c.row_id ORDER BY p.no) - 1)::INT AS phrase_no, p.phrase FROM checklist c JOIN (VALUES " + ", ".join(f"({n}, {q.quote(k)}, {q.quote(p)})" for n, (k, p) in enumerate((k, p) for k, v in cl.ORIGIN_BY_LANGUAGE.items() for p in v)) + ") p(no, lang, phrase) ON len(list_filter(coalesce(c.language_list, []), lambda x: trim(x) <> '')) = 0 OR list_contains(list_transform(c.language_list, lambda x: upper(trim(x))), p.lang)")
def _(checklist):
    return checklist.select("row_id", F.posexplode(cl.origin_phrases(F.col("language_list"))).alias("phrase_no", "phrase"))


@query("language_split", "checklist", "SELECT row_id, unnest(string_split(language, ',')) AS language FROM checklist WHERE language IS NOT NULL")
def _(checklist):
    return checklist.where("language is not null").select("row_id", F.explode(F.split("language", ",")).alias("language"))


@query("remark_languages", "checklist", r"""
SELECT row_id, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE 'Unspecified' END AS languages FROM (SELECT row_id, list_transform(list_filter(string_split_regex(coalesce(remark, ''), '\r?\n'),
  lambda x: contains(x, '=') AND trim(split_part(x, '=', 1)) <> '' AND contains(coalesce(symbol_exact_wording, ''), trim(split_part(x, '=', 1)))), lambda x: trim(substr(x, strpos(x, '=') + 1))) AS f FROM checklist)""")
def _(checklist):
    return checklist.select("row_id", F.array_join(cl.remark_languages(F.col("remark"), F.col("symbol_exact_wording")), ",").alias("languages"))


_HEAD = ["requirement", "symbol_exact_wording", "specification", "language", "verification", "package_panel", "procedure_text", "remark"]
_SCORE = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 5 * regexp_matches(lower({c}), '{'|'.join(cl.HEADER_WORDS)}')::INT + (length({c}) <= 24)::INT - 2 * regexp_matches({c}, '[=“”]')::INT END" for c in _HEAD)


@query("header_scores", "checklist", f"""
SELECT checklist_id, sheet_row, score FROM (SELECT *, row_number() OVER (PARTITION BY checklist_id ORDER BY score DESC, n) AS r FROM (
  SELECT checklist_id, sheet_row, {_SCORE} AS score, row_number() OVER (PARTITION BY checklist_id ORDER BY sheet_row, row_id) AS n FROM checklist WHERE {' + '.join(f'({c} IS NOT NULL)::INT' for c in _HEAD)} >= 2) WHERE n <= 15) WHERE r = 1""")
def _(checklist):
    return cl.header_scores(checklist)


@query("flat_paths", "checklist", r"""
SELECT row_id, array_to_string(p, ';') AS paths, len(list_filter(p, lambda x: trim(x) <> '')) > 0 AS any_image FROM (SELECT row_id, list_transform(flatten(list_transform(image_groups_resolved, lambda g: coalesce(g.paths, []))), lambda x: replace(x, '\', '/')) AS p FROM checklist)""")
def _(checklist):
    return cl.flat_paths(checklist)


@query("image_groups_parsed", "checklist", r"""
SELECT row_id, generate_subscripts(g, 1)::INT - 1 AS group_no, unnest(g).name AS name, unnest(g).mode AS mode, array_to_string(unnest(g).paths, ';') AS paths FROM (
  SELECT row_id, list_filter(image_groups_resolved, lambda x: len(x.paths) > 0 AND trim(coalesce(x.name, '')) <> '') AS g FROM checklist)""")
def _(checklist):
    named = F.filter("image_groups_resolved", lambda g: F.trim(F.coalesce(g["name"], F.lit(""))) != "")
    cell = F.array_join(F.transform(named, lambda g: F.concat(F.lit("[GROUP: "), g["name"], F.lit("]["), F.upper(g["mode"]), F.lit("]\n"), F.array_join(g["paths"], "\n"))), "\n")
    return checklist.select("row_id", F.posexplode(cl.parse_image_groups(cell)).alias("group_no", "g")).select("row_id", "group_no", "g.name", "g.mode", F.array_join("g.paths", ";").alias("paths"))


@query("image_groups_all", "checklist", r"""
SELECT row_id, generate_subscripts(g, 1)::INT - 1 AS group_no, trim(coalesce(unnest(g).name, '')) AS name, unnest(g).mode AS mode, array_to_string(unnest(g).paths, ';') AS paths FROM (
  SELECT row_id, list_filter(image_groups_resolved, lambda x: len(x.paths) > 0 AND trim(coalesce(x.name, '')) = '') || list_filter(image_groups_resolved, lambda x: len(x.paths) > 0 AND trim(coalesce(x.name, '')) <> '') AS g FROM checklist)""")
def _(checklist):
    return checklist.select("row_id", F.posexplode(cl.all_image_groups(F.col("image_groups_resolved"))).alias("group_no", "g")).select("row_id", "group_no", "g.name", "g.mode", F.array_join("g.paths", ";").alias("paths"))


@query("group_order", "checklist", """
SELECT checklist_id, row_id, row_number() OVER (PARTITION BY checklist_id ORDER BY a, b, row_no, row_id)::INT AS report_no FROM (
  SELECT *, first_value(row_no) OVER w AS a, first_value(row_id) OVER w AS b FROM checklist WINDOW w AS (PARTITION BY checklist_id, coalesce(requirement, ''), coalesce(specification, ''), coalesce(verification, '') ORDER BY row_no, row_id))""")
def _(checklist):
    return cl.ordered_groups(checklist)


# --- results ----------------------------------------------------------------------------------------------------------
@query("joined_notes", "check_result", """
SELECT row_id, string_agg(note, '; ' ORDER BY first_at, low) AS notes FROM (SELECT row_id, lower(trim(note)) AS low, min(result_id) AS first_at, arg_min(trim(note), result_id) AS note FROM check_result
  WHERE note IS NOT NULL AND trim(note) NOT IN ('', '-') GROUP BY ALL) GROUP BY row_id""")
def _(results):
    return cl.joined_notes(results)


@query("hide_empty_groups", "check_result", """
SELECT result_id FROM (SELECT result_id, requirement, bool_or(coalesce(contains(found_flag, 'Found') AND NOT contains(found_flag, 'Not'), false)) OVER (PARTITION BY doc_id, requirement) AS f FROM check_result) WHERE f OR requirement IS NULL""")
def _(results):
    return cl.shown_results(results).select("result_id")


@query("status_counts", "check_result", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(lower(trim(verification)) = 'manual' OR coalesce(found_flag, '-') = '-', false) THEN 'manual' WHEN contains(coalesce(found_flag, '-'), 'Not') THEN 'missing' ELSE 'found' END AS status FROM check_result) GROUP BY 1""")
def _(results):
    return cl.status(results).groupBy("status").agg(F.count("*").alias("n"))


@query("pages_parse", "check_result page_items", r"""
WITH t AS (SELECT doc_id, max(page_no) AS n FROM page_items GROUP BY 1),
s AS (SELECT r.result_id, lower(trim(coalesce(r.pages, ''))) AS s, coalesce(t.n, 0) AS n FROM check_result r LEFT JOIN t USING (doc_id)),
p AS (SELECT result_id, n, unnest(string_split_regex(s, '[,\s]+')) AS p FROM s WHERE s NOT IN ('', '-', 'all', 'all pages', 'all page')),
b AS (SELECT result_id, n, try_cast(nullif(regexp_extract(p, '^([0-9]{1,9})(?:-([0-9]{1,9}))?$', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(p, '^([0-9]{1,9})(?:-([0-9]{1,9}))?$', 2), '') AS INT) AS z FROM p)
SELECT result_id, state, page FROM (
  SELECT DISTINCT result_id, 'some' AS state, unnest(range(greatest(1, a) - 1, least(n, coalesce(z, a))))::INT AS page FROM b WHERE a IS NOT NULL
  UNION ALL SELECT result_id, 'all', NULL FROM s WHERE s IN ('all', 'all pages', 'all page'))""")
def _(results, items):
    total = items.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    rows = results.select("result_id", "doc_id", "pages").join(total, "doc_id", "left").withColumn("p", pg.parsed(F.col("pages"), F.coalesce("n", F.lit(0))))
    some = rows.where("p is not null").select("result_id", F.lit("some").alias("state"), F.explode("p").alias("page"))
    return some.unionByName(rows.where("p is null").select("result_id", F.lit("all").alias("state"), F.lit(None).cast("int").alias("page")))


# --- page items -------------------------------------------------------------------------------------------------------
@query("latest_items", "page_items", "SELECT item_id, doc_id, page_no, item_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, item_no ORDER BY loaded_at DESC NULLS LAST, item_id DESC) AS r FROM page_items) WHERE r = 1")
def _(items):
    return it.latest(items)


@query("page_text", "page_items", "SELECT doc_id, page_no, string_agg(coalesce(text, ''), ' ' ORDER BY item_no, item_id) AS page_text FROM page_items GROUP BY 1, 2")
def _(items):
    return it.page_texts(items)


_ARTWORK = f"""SELECT doc_id, page_no, bool_or(regexp_matches(upper(coalesce(text, '')), '\\b[A-Z]{{3}}[0-9]{{2}}\\b'))
  OR (count(*) FILTER (WHERE NOT ocr) >= {it.ARTWORK_ITEMS} AND bool_or(NOT ocr AND mm >= {it.ARTWORK_MM})) OR (count(*) FILTER (WHERE ocr) >= {it.ARTWORK_ITEMS} AND bool_or(mm >= {it.ARTWORK_MM}))
  OR len(list_filter([{', '.join(q.quote(h) for h in it.ORIGIN_HINTS)}], lambda h: contains({q.normalize("string_agg(coalesce(text, ''), ' ' ORDER BY item_no, item_id)")}, h))) > 0 AS is_artwork
FROM (SELECT *, lower(coalesce(source, 'pdf')) = 'ocr' AS ocr, {q.picked_mm()} AS mm FROM page_items) GROUP BY 1, 2"""


@query("artwork_pages", "page_items", _ARTWORK)
def _(items):
    return it.artwork_pages(items)


@query("considered_pages", "page_items", f"SELECT doc_id, page_no FROM ({_ARTWORK}) WHERE is_artwork OR page_no > 1")
def _(items):
    return it.artwork_pages(items).where(F.col("is_artwork") | (F.col("page_no") > 1)).select("doc_id", "page_no")


_CLASS = r"""CASE WHEN n_short > n_long AND n_long > 0 THEN 'BOTH' WHEN n_long > 0 THEN 'MBG' WHEN n_short > 0 THEN 'SHORT' ELSE 'UNKNOWN' END"""


@query("warning_class", "page_items", rf"""
SELECT doc_id, page_no, {_CLASS} AS warning FROM (SELECT doc_id, page_no, len(regexp_extract_all(t, '\bsmall\s+parts\b')) AS n_short, len(regexp_extract_all(t, '\bsmall\s+parts\b[\s\W]{{0,20}}may[\s\W]{{0,20}}be[\s\W]{{0,20}}generat')) AS n_long
  FROM (SELECT doc_id, page_no, string_agg({q.normalize('text')}, ' ' ORDER BY item_no, item_id) AS t FROM page_items GROUP BY 1, 2))""")
def _(items):
    norm = items.select("doc_id", "page_no", "item_no", "item_id", tx.normalize(F.col("text")).alias("text"))
    return it.page_texts(norm).select("doc_id", "page_no", it.warning_class(F.col("page_text")).alias("warning"))


@query("warning_class_forms", "region", r"""
SELECT name, """ + _CLASS + r""" AS warning FROM (SELECT name, len(regexp_extract_all(t, '\bsmall\s+parts\b')) AS n_short, len(regexp_extract_all(t, '\bsmall\s+parts\b[\s\W]{0,20}may[\s\W]{0,20}be[\s\W]{0,20}generat')) AS n_long
  FROM (SELECT r_name || f.no AS name, f.t FROM region CROSS JOIN (VALUES (1, 'warning: small parts may be generated'), (2, 'warning: small parts. not under 3'), (3, 'small parts; small  parts - may be generated'), (4, 'no parts')) f(no, t)))""")
def _(region):
    forms = ["warning: small parts may be generated", "warning: small parts. not under 3", "small parts; small  parts - may be generated", "no parts"]
    rows = region.select("r_name", F.posexplode(F.array(*[F.lit(f) for f in forms])).alias("no", "t"))
    return rows.select(F.concat("r_name", (F.col("no") + 1).cast("string")).alias("name"), it.warning_class(F.col("t")).alias("warning"))


@query("product_info", "page_items", rf"""
SELECT doc_id, page_no AS page, coalesce(trim(string_agg(coalesce(trim(text), ''), ' ' ORDER BY item_no, item_id) FILTER (WHERE CASE WHEN isnan(size_mm) THEN 0 ELSE coalesce(size_mm, 0) END >= {it.ARTWORK_MM})), '-') AS product_name,
  coalesce(first(p ORDER BY item_no, item_id) FILTER (WHERE p <> ''), '-') AS part_no, coalesce(first(v ORDER BY item_no, item_id) FILTER (WHERE v <> ''), '-') AS rev
FROM (SELECT *, regexp_extract(coalesce(text, ''), '\b([A-Z0-9]{{2,5}}-[A-Z0-9]{{2,6}})\b', 1) AS p, regexp_extract(coalesce(text, ''), '\b(A[0-9])\b', 1) AS v FROM page_items) GROUP BY 1, 2""")
def _(items):
    return it.product_info(items)


@query("built_lines", "page_items", """
SELECT doc_id, page_no, round(bbox.y0, 1) AS y, string_agg(coalesce(text, ''), ' ' ORDER BY item_no, item_id) AS text, coalesce(bool_or(bold), false) AS bold, coalesce(bool_or(italic), false) AS italic, coalesce(bool_or(underline), false) AS underline,
  max(CASE WHEN isnan(size_mm) THEN NULL ELSE size_mm END) AS size_mm, min(bbox.x0) AS x0, max(bbox.x1) AS x1 FROM page_items WHERE level IS NULL AND bbox.y0 IS NOT NULL GROUP BY 1, 2, 3""")
def _(items):
    return it.built_lines(items)


@query("dedup_items", "page_items", f"SELECT arg_min(item_id, (item_no, item_id)) AS item_id, doc_id, page_no, text_norm, source FROM (SELECT item_id, item_no, doc_id, page_no, {q.normalize('text')} AS text_norm, coalesce(source, 'pdf') AS source FROM page_items) GROUP BY doc_id, page_no, text_norm, source")
def _(items):
    return it.distinct_items(items)


@query("item_ranking", "page_items", """
SELECT item_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (coalesce(level, '') = 'line') DESC, coalesce(bold, false) DESC, (CASE WHEN isnan(size_mm) THEN 0 ELSE coalesce(size_mm, 0) END) DESC, item_no, item_id)::INT AS rank FROM page_items""")
def _(items):
    return it.ranked_items(items)


_IOU = "CASE WHEN ua > 0 THEN i / ua ELSE 0 END"


@query("iou_anti", "page_items", """
SELECT item_id, doc_id, page_no FROM page_items o WHERE coalesce(source, 'pdf') = 'ocr' AND NOT EXISTS (SELECT 1 FROM page_items p WHERE coalesce(p.source, 'pdf') = 'pdf' AND p.bbox IS NOT NULL AND p.doc_id = o.doc_id AND p.page_no = o.page_no
  AND lower(trim(p.text)) = lower(trim(o.text)) AND o.bbox IS NOT NULL AND (WITH g AS (SELECT greatest(0, least(o.bbox.x1, p.bbox.x1) - greatest(o.bbox.x0, p.bbox.x0)) * greatest(0, least(o.bbox.y1, p.bbox.y1) - greatest(o.bbox.y0, p.bbox.y0)) AS i)
  SELECT i >= 0.6 * ((o.bbox.x1 - o.bbox.x0) * (o.bbox.y1 - o.bbox.y0) + (p.bbox.x1 - p.bbox.x0) * (p.bbox.y1 - p.bbox.y0) - i) AND i > 0 FROM g))""")
def _(items):
    return it.new_ocr_items(items)


@query("nearest_within", "page_items", """
SELECT item_id, o.other_id, o.distance FROM (SELECT a.item_id, min({'distance': round(sqrt(pow((a.bbox.x0 + a.bbox.x1) / 2 - (b.bbox.x0 + b.bbox.x1) / 2, 2) + pow((a.bbox.y0 + a.bbox.y1) / 2 - (b.bbox.y0 + b.bbox.y1) / 2, 2)), 4), 'other_id': b.item_id}) AS o
  FROM page_items a JOIN page_items b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.item_id <> b.item_id AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND length(trim(a.text)) <= 6
  WHERE round(sqrt(pow((a.bbox.x0 + a.bbox.x1) / 2 - (b.bbox.x0 + b.bbox.x1) / 2, 2) + pow((a.bbox.y0 + a.bbox.y1) / 2 - (b.bbox.y0 + b.bbox.y1) / 2, 2)), 4) <= 14 GROUP BY a.item_id)""")
def _(items):
    return it.nearest(items)


@query("grid_dedup", "page_items", "SELECT arg_min(item_id, (item_no, item_id)) AS item_id, doc_id, page_no FROM page_items WHERE bbox IS NOT NULL GROUP BY doc_id, page_no, floor(bbox.x0 / 8), floor(bbox.y0 / 8), floor(bbox.x1 / 8), floor(bbox.y1 / 8)")
def _(items):
    return it.grid_first(items)


_BOXES = "SELECT doc_id, page_no, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM page_items WHERE bbox IS NOT NULL GROUP BY 1, 2"


@query("union_bbox", "page_items", _BOXES)
def _(items):
    return it.page_boxes(items)


@query("inside_artwork", "page_items", f"""
SELECT i.item_id FROM page_items i JOIN ({_BOXES}) b USING (doc_id, page_no) WHERE i.bbox IS NOT NULL
  AND (i.bbox.x0 + i.bbox.x1) / 2 BETWEEN b.x0 + (b.x1 - b.x0) * 0.08 AND b.x1 - (b.x1 - b.x0) * 0.08 AND (i.bbox.y0 + i.bbox.y1) / 2 BETWEEN b.y0 + (b.y1 - b.y0) * 0.12 AND b.y1 - (b.y1 - b.y0) * 0.12""")
def _(items):
    return it.inside_artwork(items)


@query("underline_attach", "page_items", """
SELECT item_id FROM page_items a WHERE level IS NULL AND bbox IS NOT NULL AND EXISTS (SELECT 1 FROM page_items b WHERE b.level = 'line' AND b.underline AND b.bbox IS NOT NULL AND a.doc_id = b.doc_id AND a.page_no = b.page_no
  AND abs(b.bbox.y1 - a.bbox.y1) <= 2.0 AND greatest(0.0, least(a.bbox.x1, b.bbox.x1) - greatest(a.bbox.x0, b.bbox.x0)) >= 0.5 * (a.bbox.x1 - a.bbox.x0))""")
def _(items):
    return it.underlined_by(items)


@query("ocr_lines", "page_items")
def _(items):
    return it.ocr_lines(items)


@query("salvage_first", "page_items", f"""
SELECT doc_id, page_no, arg_min(item_id, (item_no, item_id)) AS item_id FROM page_items WHERE coalesce(bold, false) OR (coalesce(level, '') = 'line' AND {q.all_caps('text')} AND CASE WHEN isnan(size_mm) THEN 0 ELSE coalesce(size_mm, 0) END >= 1.2) GROUP BY 1, 2""")
def _(items):
    return mt.salvaged(items)


# --- matching ---------------------------------------------------------------------------------------------------------
@query("term_match", "check_result checklist page_items", q.hits() + """
SELECT n.doc_id, n.row_id, n.term_no::INT AS term_no, count(DISTINCT h.page_no) AS n_pages, min(h.page_no) AS first_page, count(DISTINCT h.page_no) > 0 AS found FROM need n LEFT JOIN hit h USING (doc_id, variant_norm) WHERE n.variant_norm <> '' GROUP BY 1, 2, 3""")
def term_match(results, checklist, items):
    return mt.term_pages(results, checklist, items)


@query("best_variant", "check_result checklist page_items", q.hits() + """
SELECT doc_id, row_id, term_no, variant_no, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row_id, term_no ORDER BY n_hits DESC, variant_no) AS r FROM (
  SELECT n.doc_id, n.row_id, n.term_no::INT AS term_no, n.variant_no::INT AS variant_no, count(DISTINCT h.page_no) AS n_hits FROM need n LEFT JOIN hit h USING (doc_id, variant_norm) WHERE n.variant_norm <> '' GROUP BY 1, 2, 3, 4)) WHERE r = 1""")
def _(results, checklist, items):
    return mt.best_variants(results, checklist, items)


@query("page_fallback", "check_result checklist page_items", q.hits() + f""",
pages AS (SELECT doc_id, page_no, {q.normalize("string_agg(coalesce(text, ''), ' ' ORDER BY item_no, item_id)")} AS page_norm FROM page_items GROUP BY 1, 2)
SELECT w.doc_id, w.variant_norm, p.page_no FROM wanted w JOIN pages p ON w.doc_id = p.doc_id AND len(w.words) >= 2 AND p.page_norm LIKE '%' || replace(array_to_string(w.words, '%'), '_', '\\_') || '%' ESCAPE '\\'
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = w.doc_id AND h.variant_norm = w.variant_norm AND h.page_no = p.page_no)""")
def _(results, checklist, items):
    need = mt.required(results, checklist)
    return mt.page_hits(need, items, mt.hits(need, items))


@query("pages_format", "check_result checklist page_items", q.hits() + f""",
art AS (SELECT doc_id, page_no FROM ({_ARTWORK}) WHERE is_artwork), total AS (SELECT doc_id, count(*) AS n FROM art GROUP BY 1),
lists AS (SELECT h.doc_id, h.variant_norm, list_sort(list(DISTINCT h.page_no)) AS p FROM hit h JOIN art USING (doc_id, page_no) GROUP BY 1, 2)
SELECT e.doc_id, e.variant_norm, CASE WHEN coalesce(len(l.p), 0) / greatest(coalesce(t.n, 0), 1) >= {it.COVERAGE} THEN 'All Pages' WHEN l.p IS NULL THEN '-' ELSE array_to_string(l.p, ', ') END AS pages
FROM (SELECT DISTINCT doc_id, variant_norm FROM hit) e LEFT JOIN lists l USING (doc_id, variant_norm) LEFT JOIN total t USING (doc_id)""")
def _(results, checklist, items):
    found = mt.hits(mt.required(results, checklist), items)
    return pg.formatted(found, it.artwork_pages(items).where("is_artwork"), ["variant_norm"], it.COVERAGE)


@query("pages_compact", "check_result checklist page_items", q.hits() + """
SELECT doc_id, variant_norm, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM (
  SELECT doc_id, variant_norm, min(page_no) AS a, max(page_no) AS b FROM (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id, variant_norm ORDER BY page_no) AS g FROM hit) GROUP BY doc_id, variant_norm, g) GROUP BY 1, 2""")
def _(results, checklist, items):
    return pg.compacted(mt.hits(mt.required(results, checklist), items), ["doc_id", "variant_norm"], "page_no")


_SPEC = "lower(coalesce(specification, ''))"


@query("verdict", "check_result checklist page_items", f"""
WITH t AS (SELECT doc_id, norm, coalesce(bool_or(bold), false) AS bold, coalesce(bool_or(underline), false) AS underline, bool_and(caps) AS caps, max(mm) AS mm FROM (
    SELECT doc_id, {q.normalize('text')} AS norm, bold, underline, {q.all_caps('text')} AS caps, CASE WHEN isnan(size_mm) THEN NULL ELSE size_mm END AS mm FROM page_items) GROUP BY 1, 2),
n AS (SELECT r.doc_id, r.row_id, {q.normalize('c.symbol_exact_wording')} AS norm, {_SPEC} AS spec, l.least_mm FROM (SELECT DISTINCT doc_id, row_id FROM check_result) r JOIN checklist c USING (row_id) JOIN ({SQL['threshold_parse']}) l USING (row_id)),
v AS (SELECT n.doc_id, n.row_id, list_filter([CASE WHEN contains(spec, 'bold') AND NOT bold THEN 'Not Bold' END, CASE WHEN contains(spec, 'no underline') AND underline THEN 'Underline must be absent' END,
    CASE WHEN contains(spec, 'underline') AND NOT contains(spec, 'no underline') AND NOT underline THEN 'Underline Missing' END, CASE WHEN contains(spec, 'all caps') AND NOT caps THEN 'Not All Caps' END, CASE WHEN mm < least_mm THEN 'Font too small' END], lambda x: x IS NOT NULL) AS notes
  FROM n JOIN t ON n.doc_id = t.doc_id AND n.norm = t.norm AND n.norm <> '')
SELECT doc_id, row_id, len(notes) = 0 AS match, coalesce(array_to_string(notes, '; '), '') AS notes FROM v""")
def _(results, checklist, items):
    return mt.verdicts(results, checklist, items, F.round(nb.threshold_mm(F.col("specification")), 6))


@query("verdict_terms", "check_result checklist page_items", q.hits() + f""",
met AS (SELECT DISTINCT w.doc_id, w.variant_norm, t.text_norm FROM wanted w JOIN texts t ON w.doc_id = t.doc_id AND t.text_norm <> '' AND {q.CARRIES}),
s AS (SELECT doc_id, {q.normalize('text')} AS text_norm, bold, underline, {q.all_caps('text')} AS caps, CASE WHEN isnan(size_mm) THEN NULL ELSE size_mm END AS mm FROM page_items),
e AS (SELECT n.doc_id, n.row_id, n.term_no::INT AS term_no, count(m.text_norm) > 0 AS found, coalesce(bool_or(s.bold), false) AS bold, coalesce(bool_or(s.underline), false) AS underline, coalesce(bool_and(s.caps), false) AS caps, max(s.mm) AS mm
  FROM need n LEFT JOIN met m USING (doc_id, variant_norm) LEFT JOIN s ON s.doc_id = m.doc_id AND s.text_norm = m.text_norm WHERE n.variant_norm <> '' GROUP BY 1, 2, 3),
v AS (SELECT e.*, l.least_mm, list_filter([CASE WHEN contains(spec, 'bold') AND NOT bold THEN 'Not Bold' END, CASE WHEN contains(spec, 'no underline') AND underline THEN 'Underline must be absent' END,
    CASE WHEN contains(spec, 'underline') AND NOT contains(spec, 'no underline') AND NOT underline THEN 'Underline Missing' END, CASE WHEN contains(spec, 'all caps') AND NOT caps THEN 'Not All Caps' END, CASE WHEN mm < least_mm THEN 'Font too small' END], lambda x: x IS NOT NULL) AS notes
  FROM e JOIN (SELECT row_id, {_SPEC} AS spec FROM checklist) c USING (row_id) JOIN ({SQL['threshold_parse']}) l USING (row_id))
SELECT doc_id, row_id, term_no, found, len(notes) = 0 AS match, coalesce(array_to_string(list_filter([CASE WHEN NOT found THEN 'Not found on artwork pages' END] || notes || [CASE WHEN least_mm IS NOT NULL AND mm IS NULL THEN 'No measurable text for font size' END], lambda x: x IS NOT NULL), '; '), '') AS notes FROM v""")
def _(results, checklist, items):
    return mt.term_verdicts(results, checklist, items, F.round(nb.threshold_mm(F.col("specification")), 6))


@query("fuzzy_pairs", "check_result checklist page_items")
def _(results, checklist, items):
    return mt.fuzzy(mt.required(results, checklist), items)
