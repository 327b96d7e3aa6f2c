"""Queries of the whole check, with SQL written from the rules by themselves (word lists typed again, no shared tables).

No test table has rows of small-parts rules, names of Thailand or phrases of origin, so the SQL leaves out the end-boundary
veto and the origin phrases; these are tested on rows made by hand.  The nearly-equal rung is an edit count in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.operators import check as ck
from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.plans import oracle as q
from proofmill.runtime import table

QUERIES, SQL = {}, {}


def query(name: str, tables: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(*[table(spark, d, t) for t in tables.split()])
        if sql:
            SQL[name] = sql
        return f

    return add


def _has(x: str, words: str) -> str:
    """One of the words, parted by |, is in x."""
    listed = ", ".join(q.quote(w) for w in words.split("|"))
    return f"(len(list_filter([{listed}], lambda w: contains({x}, w))) > 0)"


_CELL = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'n/a', 'none', 'unspecified', 'nan') THEN '-' ELSE trim(coalesce({0}, '')) END"
_SKIP = "do not print|do not forget|see template|don't forget|for reference|note|click|reminder|refer template|remove from template|remove from mb legal template"
_MANUAL = (
    "brand logo|copyright for t&f|space for date code|lion mark|lionmark|lion-mark|ce mark|en 71|ukca|mc mark|cib|argentina logo|brazilian logo|italy requirement|france requirement|sorting & donation label|"
    "spain sorting symbols|usa warning statement|product’s common|upc requirement|list of content : text|list of content : pictorial|product's common|generic name|"
    "โลโก้|ลิขสิทธิ์|ตรา|สัญลักษณ์|เครื่องหมาย|สำรองพื้นที่รหัสวันที่|เครื่องหมายรับรอง"
)
_HINTS = (
    "made in|hecho en|fabriqué en|fabrique en|prodotto in|fabbricato in|hergestellt in|gemaakt in|tillverkad i|valmistettu|fremstillet i|produceret i|produsert i|wyprodukowano w|vyrobeno v|vyrobené v|"
    "gyártva|készült|сделано в|произведено в|κατασκευ|παράγ|üret|صنع في|صناعة"
)
_UNDERLINED = "list_filter(list_transform(regexp_extract_all(coalesce(term_html, ''), '(?is)<u>(.*?)</u>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '')"
_ROWS = f"""
filled AS (SELECT * REPLACE (last_value(requirement IGNORE NULLS) OVER (PARTITION BY checklist_id ORDER BY row_no, row_id ROWS UNBOUNDED PRECEDING) AS requirement) FROM checklist),
read AS (SELECT *, trim(coalesce(requirement, '')) AS req, {_CELL.format('specification')} AS spec, {_CELL.format('symbol_exact_wording')} AS term_cell, coalesce(has_image, false) AS image,
  {q.normalize('requirement')} AS req_norm, {q.normalize(_CELL.format('specification'))} AS spec_norm, {q.normalize('remark')} AS remark_norm FROM filled),
asked AS (SELECT *, req_norm || ' ' || spec_norm || ' ' || remark_norm AS said FROM read),
classed AS (SELECT *, CASE WHEN lower(trim(coalesce(verification, ''))) = 'manual' THEN 'hard' WHEN {_has('req_norm', _SKIP)} OR {_has('spec_norm', _SKIP)} THEN 'skip'
  WHEN term_cell = '-' AND lower(spec) IN ('', '-', 'nan', 'none', 'null') AND lower(trim(coalesce(remark, ''))) IN ('', '-', 'nan') AND NOT image THEN 'empty'
  WHEN {_has('said', _MANUAL)} OR term_cell = '-' OR (image AND {_has('said', 'logo|mark|symbol|copyright|t&f|t & f|©|™|®')})
    OR regexp_matches(lower(regexp_replace(coalesce(requirement, ''), '\\s+', ' ', 'g')), '\\binternational\\s+warning\\s+statement\\s*[:\\-]?\\s*sp[wg]\\b') THEN 'manual' ELSE 'verify' END AS row_class FROM asked),
listed AS (SELECT row_id, i, t FROM (SELECT row_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT row_id, CASE WHEN term_cell = '-' THEN [] ELSE [term_cell] || {_UNDERLINED} END AS l FROM classed))),
terms AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS term_no, t AS term FROM (SELECT row_id, t, min(i) AS i FROM listed GROUP BY 1, 2))
"""
_CONSIDERED = f"""
art AS (SELECT doc_id, page_no, page_no > 1 OR regexp_matches(upper(string_agg(coalesce(text, ''), ' ')), '\\b[A-Z]{{3}}[0-9]{{2}}\\b') OR (count(*) FILTER (WHERE NOT ocr) >= 12 AND bool_or(NOT ocr AND mm >= 1.6))
    OR (count(*) FILTER (WHERE ocr) >= 12 AND bool_or(mm >= 1.6)) OR {_has(q.normalize("string_agg(coalesce(text, ''), ' ' ORDER BY item_no, item_id)"), _HINTS)} AS considered
  FROM (SELECT *, lower(coalesce(source, 'pdf')) = 'ocr' AS ocr, {q.picked_mm()} AS mm FROM page_items WHERE doc_id IS NOT NULL AND page_no IS NOT NULL) GROUP BY 1, 2),
pages AS (SELECT doc_id, page_no FROM art WHERE considered)
"""
_FLAT = r"trim(regexp_replace({0}, '[\s\-]+', ' ', 'g'))"
_WORDS_2 = r"list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ('in', 'en', 'na', 'de', 'la', 'el', 'em', 'da', 'do', 'di', 'du', 'of', 'and', 'y', 'et', 'the', 'a', 'an'))"


def report_sql(strict: bool) -> str:
    """The report; strict: every row without a long warning keeps only items that are a short one."""
    gate = "(contains(lower(j.joined), 'may be generat') OR (contains(m.text_norm, 'warning') AND contains(m.text_norm, 'small parts') AND NOT contains(m.text_norm, 'may be generat')))" if strict else "true"
    caps = "all caps|ตัวพิมพ์ใหญ่ทั้งหมด|ตัวใหญทั้งหมด|พิมพ์ใหญ่ทั้งหมด"
    ul, no_ul, bold = (lambda x, w=w: _has(x, w) for w in ("underline|ขีดเส้นใต้", "no underline|ไม่มีขีดเส้นใต้", "bold|ตัวหนา"))
    return f"""WITH {_ROWS}, {_CONSIDERED},
verified AS (SELECT t.* FROM terms t JOIN classed c ON c.row_id = t.row_id AND c.row_class = 'verify'),
{q.VARIANTS.replace('FROM terms', 'FROM verified')},
wanted_rows AS (SELECT DISTINCT doc_id, row_id FROM check_result WHERE doc_id IS NOT NULL AND row_id IS NOT NULL),
norms AS (SELECT DISTINCT row_id, term_no, {q.normalize('variant')} AS variant_norm FROM variants),
need AS (SELECT w.doc_id, n.* FROM wanted_rows w JOIN norms n ON w.row_id = n.row_id AND n.variant_norm <> ''),
wanted AS (SELECT DISTINCT doc_id, variant_norm, {q.words('variant_norm')} AS words, regexp_extract(variant_norm, '^\\s*([0-9]{{1,2}})\\s*\\+\\s*$', 1) AS age, {_FLAT.format('variant_norm')} AS a, {q.risky('variant_norm')} AS risky FROM need),
item AS (SELECT i.item_id, i.doc_id, i.page_no, i.item_no, {q.normalize('text')} AS text_norm, lower(coalesce(source, 'pdf')) AS source, coalesce(level, '') AS level, coalesce(bold, false) AS bold, coalesce(underline, false) AS underline,
  {q.all_caps('text')} AS caps, {q.picked_mm()} AS mm, CASE WHEN isnan(size_mm) THEN 0 ELSE coalesce(size_mm, 0) END AS mm0 FROM page_items i JOIN pages USING (doc_id, page_no)),
texts AS (SELECT DISTINCT doc_id, page_no, text_norm, source, {_FLAT.format('text_norm')} AS b FROM item WHERE text_norm <> ''),
matched AS (SELECT w.doc_id, w.variant_norm, t.page_no, t.text_norm, t.source FROM wanted w JOIN texts t ON w.doc_id = t.doc_id AND ({q.CARRIES}
  OR (w.risky AND (t.source <> 'ocr' OR length(w.variant_norm) <= 6) AND a <> '' AND abs(length(a) - length(b)) <= 0.04 * (length(a) + length(b)) + 1e-9
    AND (a = b OR 2 * levenshtein(a, b) - abs(length(a) - length(b)) <= 0.04 * (length(a) + length(b)) + 1e-9)))),
page_norm AS (SELECT doc_id, page_no, string_agg(text_norm, ' ' ORDER BY item_no, item_id) AS page_text FROM item WHERE text_norm <> '' GROUP BY 1, 2),
found AS (SELECT DISTINCT n.doc_id, n.row_id, n.term_no, m.page_no FROM need n JOIN matched m USING (doc_id, variant_norm)
  UNION SELECT DISTINCT n.doc_id, n.row_id, n.term_no, p.page_no FROM need n JOIN wanted w USING (doc_id, variant_norm) JOIN page_norm p ON p.doc_id = n.doc_id AND len(w.words) >= 2 AND p.page_text LIKE '%' || replace(array_to_string(w.words, '%'), '_', '\\_') || '%' ESCAPE '\\'),
shown_pages AS (SELECT f.doc_id, f.row_id, f.term_no, CASE WHEN count(*) >= 0.9 * any_value(t.n) THEN 'All Pages' ELSE string_agg(f.page_no::VARCHAR, ', ' ORDER BY f.page_no) END AS pages FROM found f JOIN (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1) t USING (doc_id) GROUP BY 1, 2, 3),
first_item AS (SELECT doc_id, text_norm, source, bold, underline, caps, mm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text_norm, source ORDER BY level = 'line' DESC, bold DESC, mm0 DESC, page_no, item_no, item_id) AS r FROM item) WHERE r = 1),
joined AS (SELECT row_id, string_agg(term, ' ' ORDER BY term_no) AS joined FROM terms GROUP BY 1),
term_rows AS (SELECT w.doc_id, v.row_id, v.term_no, v.term, c.image, lower(c.spec) AS spec_low, c.term_html FROM wanted_rows w JOIN verified v USING (row_id) JOIN classed c USING (row_id)),
seen AS (SELECT s.doc_id, s.row_id, s.term_no, i.* EXCLUDE (doc_id) FROM term_rows s JOIN joined j USING (row_id) JOIN (SELECT DISTINCT n.doc_id, n.row_id, n.term_no, m.text_norm, m.source FROM need n JOIN matched m USING (doc_id, variant_norm)) m
  ON m.doc_id = s.doc_id AND m.row_id = s.row_id AND m.term_no = s.term_no JOIN first_item i ON i.doc_id = m.doc_id AND i.text_norm = m.text_norm AND i.source = m.source
  WHERE {gate} AND (NOT {ul('s.spec_low')} OR i.underline) AND (NOT {no_ul('s.spec_low')} OR NOT i.underline)),
ev AS (SELECT s.*, coalesce(e.n, 0) AS n, coalesce(e.n_bold, 0) AS n_bold, coalesce(e.n_ul, 0) AS n_ul, e.mm, e.caps, EXISTS (SELECT 1 FROM found f WHERE f.doc_id = s.doc_id AND f.row_id = s.row_id AND f.term_no = s.term_no) AS found FROM term_rows s
  LEFT JOIN (SELECT doc_id, row_id, term_no, count(*) AS n, count(*) FILTER (WHERE bold) AS n_bold, count(*) FILTER (WHERE underline) AS n_ul, max(mm) AS mm, bool_and(caps) AS caps FROM seen GROUP BY 1, 2, 3) e USING (doc_id, row_id, term_no)),
variant_list AS (SELECT row_id, term_no, list(variant_norm) AS vs FROM norms GROUP BY 1, 2),
asked_words AS (SELECT e.doc_id, e.row_id, e.term_no, list_distinct(flatten(list_transform(CASE WHEN len(flatten(list_transform(u, lambda x: list_filter(string_split_regex(x, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)))) > 0 THEN u ELSE vs END, lambda x: {_WORDS_2.format('x')}))) AS ws
  FROM (SELECT *, list_transform({_UNDERLINED}, lambda x: {q.normalize('x')}) AS u FROM ev WHERE {ul('spec_low')} AND n_ul = 0 AND found) e JOIN variant_list USING (row_id, term_no)),
by_line AS (SELECT a.doc_id, a.row_id, a.term_no, arg_min({{'bold': i.bold, 'mm': i.mm, 'caps': i.caps}}, (i.page_no, i.item_no, i.item_id)) AS s FROM asked_words a JOIN found f USING (doc_id, row_id, term_no) JOIN item i ON i.doc_id = f.doc_id AND i.page_no = f.page_no AND i.underline
  AND (len(a.ws) = 0 OR len(list_filter(a.ws, lambda w: contains(i.text_norm, w))) > 0) GROUP BY 1, 2, 3),
ev2 AS (SELECT e.* REPLACE (e.n + (b.s IS NOT NULL)::INT AS n, e.n_ul + (b.s IS NOT NULL)::INT AS n_ul, e.n_bold + coalesce(b.s.bold, false)::INT AS n_bold, greatest(e.mm, b.s.mm) AS mm, CASE WHEN b.s IS NULL THEN e.caps ELSE coalesce(e.caps, true) AND b.s.caps END AS caps) FROM ev e LEFT JOIN by_line b USING (doc_id, row_id, term_no)),
by_bold AS (SELECT e.doc_id, e.row_id, e.term_no, arg_min({{'caps': i.caps}}, (i.page_no, i.item_no, i.item_id)) AS s FROM ev2 e JOIN variant_list v USING (row_id, term_no) JOIN found f USING (doc_id, row_id, term_no) JOIN item i ON i.doc_id = f.doc_id AND i.page_no = f.page_no AND (i.bold OR (i.level = 'line' AND i.caps AND i.mm >= 1.2))
  AND len(list_filter(v.vs, lambda x: (x <> '' AND contains(i.text_norm, x)) OR (len({_WORDS_2.format('x')}) > 0 AND len(list_filter({_WORDS_2.format('x')}, lambda w: NOT contains(i.text_norm, w))) = 0))) > 0
  WHERE {bold('e.spec_low')} AND e.n_bold = 0 AND e.found GROUP BY 1, 2, 3),
least AS (SELECT row_id, CASE WHEN regexp_extract(s, p, 2) = 'pt' THEN try_cast(regexp_extract(s, p, 1) AS DOUBLE) * 25.4 / 72 ELSE try_cast(nullif(regexp_extract(s, p, 1), '') AS DOUBLE) END AS least_mm FROM (SELECT row_id, trim(lower(spec)) AS s, '(?:≥|<=|>=|<|>)\\s*(\\d+(?:\\.\\d+)?)\\s*((?:mm|pt)?)' AS p FROM classed)),
v AS (SELECT e.*, p.pages, l.least_mm, b.s IS NOT NULL AS saved, {bold('spec_low')} AND n_bold = 0 AND b.s IS NULL AS f_bold, {no_ul('spec_low')} AND n_ul > 0 AS f_no_ul, {ul('spec_low')} AND NOT {no_ul('spec_low')} AND n_ul = 0 AS f_ul,
    {_has('spec_low', caps)} AND NOT coalesce(CASE WHEN b.s IS NULL THEN e.caps ELSE coalesce(e.caps, true) AND b.s.caps END, false) AS f_caps, coalesce(n > 0 AND e.mm < l.least_mm, false) AS f_mm
  FROM ev2 e LEFT JOIN by_bold b USING (doc_id, row_id, term_no) LEFT JOIN shown_pages p USING (doc_id, row_id, term_no) JOIN least l USING (row_id)),
told AS (SELECT *, f_bold OR f_no_ul OR f_ul OR f_caps OR f_mm AS broken, array_to_string(list_filter([CASE WHEN NOT found THEN 'Not found on artwork pages' END, CASE WHEN NOT found AND image THEN 'Text may be image-only' END, CASE WHEN saved THEN 'Bold evidence found on artwork page' END,
    CASE WHEN f_bold THEN 'Not Bold' END, CASE WHEN f_no_ul THEN 'Underline must be absent' END, CASE WHEN f_ul THEN 'Underline Missing' END, CASE WHEN f_caps THEN 'Not All Caps' END, CASE WHEN f_mm THEN 'font ' || printf('%.1f', mm) || ' mm' END,
    CASE WHEN least_mm IS NOT NULL AND n = 0 THEN 'No measurable text for font size' END], lambda x: x IS NOT NULL), ', ') AS notes FROM v),
lines_out AS (
  SELECT doc_id, row_id, term_no, term, CASE WHEN found THEN '✅ Found' ELSE '❌ Not Found' END AS found_flag, CASE WHEN found AND NOT broken THEN '✔' ELSE '❌' END AS match_flag, CASE WHEN found THEN pages ELSE '-' END AS pages,
    CASE WHEN NOT found OR least_mm IS NULL OR n = 0 THEN '-' WHEN f_mm THEN '❌' ELSE '✔' END AS font_size, CASE WHEN (found AND NOT broken) OR notes = '' THEN '-' ELSE notes END AS note, 'Verified' AS verification FROM told
  UNION ALL SELECT w.doc_id, c.row_id, 0, coalesce(c.symbol_exact_wording, ''), '-', '-', '-', '-', '-', 'Manual' FROM wanted_rows w JOIN classed c ON c.row_id = w.row_id AND c.row_class = 'hard'
  UNION ALL SELECT w.doc_id, c.row_id, coalesce(t.term_no, 0), coalesce(t.term, ''), '-', '-', '-', '-', 'Manual check required', 'Manual' FROM wanted_rows w JOIN classed c ON c.row_id = w.row_id AND c.row_class = 'manual' LEFT JOIN terms t ON t.row_id = c.row_id)
SELECT o.doc_id, o.row_id, o.term_no::INT AS term_no, c.req AS requirement, CASE WHEN lower(trim(o.term)) IN ('', 'nan', 'none', '-') THEN CASE WHEN len(coalesce(c.image_groups_resolved, [])) > 0 THEN '' ELSE '-' END ELSE o.term END AS symbol_exact_wording, c.spec AS specification,
  coalesce(nullif(trim(c.package_panel), ''), '-') AS package_panel, coalesce(nullif(trim(c.procedure_text), ''), '-') AS procedure_text, trim(coalesce(c.remark, '')) AS remark, trim(coalesce(c.remark_link, '')) AS remark_url,
  o.found_flag, o.match_flag, o.pages, o.font_size, o.note, o.verification, min(o.row_id) OVER (PARTITION BY o.doc_id, c.req, c.spec, o.verification) AS group_row_id FROM lines_out o JOIN classed c USING (row_id)"""


@query("check_report", "check_result checklist page_items", report_sql(True))
def _(results, checklist, items):
    return ck.report(*ck.checked(results, checklist, items))


@query("check_report_lenient", "check_result checklist page_items", report_sql(False))
def check_report_lenient(results, checklist, items):
    return ck.report(*ck.checked(results, checklist, items, strict=False))


@query("check_verdict", "check_result checklist page_items", f"""
SELECT doc_id, row_id, term_no, CASE WHEN verification = 'Manual' THEN 'Manual' WHEN found_flag = '✅ Found' AND match_flag = '✔' AND font_size IN ('-', '✔') THEN 'Verified' ELSE 'Rejected' END AS verdict FROM ({report_sql(False)})""")
def _(results, checklist, items):
    return ck.overall(ck.report(ck.checked(results, checklist, items, strict=False)[0]))


@query("check_classes", "checklist", f"WITH {_ROWS} SELECT row_id, row_class FROM classed")
def _(checklist):
    return ck.classified(checklist).select("row_id", "row_class")


@query("keep_filter", "checklist", r"""
SELECT row_id FROM (SELECT *, last_value(requirement IGNORE NULLS) OVER (PARTITION BY checklist_id ORDER BY row_no, row_id ROWS UNBOUNDED PRECEDING) AS req FROM checklist)
WHERE trim(coalesce(symbol_exact_wording, '')) <> '' OR trim(coalesce(specification, '')) <> '' OR trim(coalesce(remark, '')) <> '' OR trim(coalesce(remark_link, '')) <> '' OR coalesce(has_image, false) OR regexp_matches(coalesce(req, ''), '(?i)instruction\s+of\s+play\s+function\s+feature')""")
def _(checklist):
    return cl.kept_rows(checklist).select("row_id")


@query("remark_pairs", "checklist", r"""
SELECT row_id, pair_no::INT AS pair_no, trim(regexp_extract(l, '^([^=]*)=', 1)) AS left_text, trim(regexp_extract(l, '=(.*)$', 1)) AS right_text FROM (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) AS pair_no, l FROM (SELECT row_id, generate_subscripts(s, 1) AS i, unnest(s) AS l FROM (SELECT row_id, string_split_regex(coalesce(remark, ''), '\r\n|\r|\n|;') AS s FROM checklist))
  WHERE contains(l, '=') AND trim(regexp_extract(l, '^([^=]*)=', 1)) <> '' AND trim(regexp_extract(l, '=(.*)$', 1)) <> '')""")
def _(checklist):
    return cl.remark_pairs(checklist)


@query("latin_text", "page_items", "SELECT item_id, coalesce(regexp_matches(text, '[A-Za-z]'), false) AS latin, lower(replace(regexp_replace(coalesce(text, ''), '[ \\s]+', ' ', 'g'), '–', '-')) AS spaced FROM page_items")
def _(items):
    spaced = F.lower(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x{a0}\s]+", " "), F.lit("–"), F.lit("-")))
    return items.select("item_id", F.coalesce(F.col("text").rlike("[A-Za-z]"), F.lit(False)).alias("latin"), spaced.alias("spaced"))


@query("logo_names", "checklist", "SELECT row_id, g.name, contains(lower(coalesce(g.name, '')), 'logo') AS is_logo FROM (SELECT row_id, unnest(image_groups_resolved) AS g FROM checklist)")
def _(checklist):
    return checklist.select("row_id", F.explode("image_groups_resolved").alias("g")).select("row_id", "g.name", F.lower(F.coalesce("g.name", F.lit(""))).contains("logo").alias("is_logo"))


@query("image_mode", "checklist", "SELECT row_id, i::INT AS group_no, g.name, 'all' AS mode, len(coalesce(g.paths, []))::INT AS n_paths FROM (SELECT row_id, generate_subscripts(image_groups_resolved, 1) AS i, unnest(image_groups_resolved) AS g FROM checklist)")
def _(checklist):
    groups = checklist.where("image_groups_resolved is not null").select("row_id", F.posexplode(cl.with_mode(F.col("image_groups_resolved"), "all")).alias("i", "g"))
    return groups.select("row_id", (F.col("i") + 1).alias("group_no"), "g.name", "g.mode", F.size(F.coalesce("g.paths", F.array().cast("array<string>"))).alias("n_paths"))


@query("resolved_paths", "checklist", r"""
SELECT row_id, i::INT AS path_no, CASE WHEN regexp_matches(p, '^([A-Za-z]:)?/') OR regexp_matches(p, '^[a-z]+://') THEN p ELSE '/base/' || p END AS path FROM (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY g, k) AS i, p FROM (SELECT row_id, g, generate_subscripts(ps, 1) AS k, replace(trim(unnest(ps)), '\', '/') AS p FROM (SELECT row_id, generate_subscripts(image_groups_resolved, 1) AS g, unnest(image_groups_resolved).paths AS ps FROM checklist)) WHERE coalesce(p, '') <> '')""")
def _(checklist):
    return cl.resolved_paths(checklist, "/base")


@query("term_search", "check_result", "SELECT doc_id, min(result_id) AS first_id FROM check_result WHERE contains(lower(symbol_exact_wording), 'blade') OR contains(lower(symbol_exact_wording), 'keep') GROUP BY 1")
def _(results):
    return cl.first_holding(results, ["blade", "keep"])


@query("result_row_flags", "check_result", """
SELECT result_id, coalesce(trim(pages) NOT IN ('', '-', '—', '0') AND lower(trim(pages)) <> 'none', false) AS has_pages, coalesce(lower(trim(verification)) = 'manual' OR starts_with(trim(found_flag), '✅'), false) AS is_found FROM check_result""")
def _(results):
    return cl.result_flags(results)


@query("part_numbers", "page_items", r"SELECT doc_id, bool_or(regexp_matches(upper(coalesce(text, '')), '\b[A-Z]{3}[0-9]{2}\b')) AS has_part_no FROM page_items GROUP BY 1")
def _(items):
    return items.groupBy("doc_id").agg(F.bool_or(F.upper(F.coalesce("text", F.lit(""))).rlike(r"\b[A-Z]{3}[0-9]{2}\b")).alias("has_part_no"))


@query("three_plus", "page_items", r"SELECT doc_id, page_no, bool_or(coalesce(regexp_matches(text, '(^|[^\p{L}\p{N}_])3\s*[+＋]($|[^\p{L}\p{N}_])'), false)) AS has_three_plus FROM page_items GROUP BY 1, 2")
def _(items):
    three = F.coalesce(F.col("text").rlike(r"(^|[^\p{L}\p{N}_])3\s*[+＋]($|[^\p{L}\p{N}_])"), F.lit(False))
    return items.groupBy(*it.PAGE).agg(F.bool_or(three).alias("has_three_plus"))


@query("plus_boxes", "page_items", "SELECT item_id, trim(text) AS sign FROM page_items WHERE trim(text) IN ('+', '＋', '3', '3+') AND bbox IS NOT NULL AND level IS NULL")
def _(items):
    return items.where(F.trim("text").isin("+", "＋", "3", "3+") & F.col("bbox").isNotNull() & F.col("level").isNull()).select("item_id", F.trim("text").alias("sign"))


@query("full_ocr_gate", "page_items", r"""
SELECT doc_id, page_no, count(*) FILTER (WHERE source = 'ocr') = 0 OR (coalesce(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))) FILTER (WHERE source = 'ocr'), 0) < 8 AND NOT coalesce(bool_or(contains(text, '+') OR contains(text, '＋')) FILTER (WHERE source = 'ocr'), false)) AS again FROM page_items GROUP BY 1, 2""")
def _(items):
    return it.full_recognition_gate(items)


@query("clean_text", "checklist", r"SELECT row_id, trim(regexp_replace(replace(replace(coalesce(remark, ''), '&nbsp;', ' '), chr(160), ' '), '\s+', ' ', 'g')) AS plain FROM checklist")
def _(checklist):
    return checklist.select("row_id", F.trim(F.regexp_replace(F.replace(F.replace(F.coalesce("remark", F.lit("")), F.lit("&nbsp;"), F.lit(" ")), F.lit(" "), F.lit(" ")), r"\s+", " ")).alias("plain"))


@query("end_words", "page_items", f"SELECT item_id, {_WORDS_2.format(q.normalize('text'))} AS words FROM page_items")
def _(items):
    return items.select("item_id", ck.content_words(tx.normalize(F.col("text"))).alias("words"))
