"""SQL fragments with the meaning of the text functions, for checking queries in another engine."""

from __future__ import annotations

from proofmill.functions import text as tx
from proofmill.operators import checklists as cl
from proofmill.operators import matching as mt


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_marks(x: str) -> str:
    source, target, longer, marks = tx.fold_tables()
    out = f"regexp_replace(translate(coalesce({x}, ''), {quote(source)}, {quote(target)}), {quote(marks)}, '', 'g')"
    for c, plain in longer.items():
        out = f"replace({out}, {quote(c)}, {quote(plain)})"
    return out


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {quote(tx.BLANKS + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quote(f'^{tx.BLANKS}+|{tx.BLANKS}+$')}, '', 'g')"


def normalize(x: str) -> str:
    return squeeze(f"translate(lower(translate({strip_marks(x)}, {quote(''.join(tx.SIGNS))}, {quote(''.join(tx.SIGNS.values()))})), 'ς', 'σ')")


def latin_fold(x: str) -> str:
    plain = f"lower({strip_marks(f'''translate(coalesce({x}, ''), {quote(''.join(tx.LOOSE))}, {quote(''.join(tx.LOOSE.values()))})''')})"
    return squeeze(f"regexp_replace({plain}, {quote(r'[ \t\x{a0}./\\|•·;,:\-]+')}, ' ', 'g')")


def all_caps(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '\p{{L}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'), false)"


def risky(x: str) -> str:
    return rf"(regexp_matches(coalesce({x}, ''), '[^\p{{L}}\p{{N}}\s\p{{Z}}]') OR length(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) <= 3)"


def dashify(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR regexp_full_match(trim({x}), '(?i)(?:none|nan|null|[-–—=\\s]*)') THEN '-' ELSE trim({x}) END"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quote(w)})" for w in words) + ")"


def picked_mm(mm: str = "size_mm", size: str = "size", unit: str = "size_unit") -> str:
    number = f"CASE WHEN regexp_full_match(trim({size}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN try_cast(trim({size}) AS DOUBLE) END"
    return f"coalesce(CASE WHEN isnan({mm}) THEN NULL ELSE {mm} END, CASE WHEN lower(trim({unit})) = 'pt' THEN ({number}) * (25.4 / 72) ELSE ({number}) END, 0.0)"


def words(x: str) -> str:
    """List of the search words of a variant."""
    keep, drop = (", ".join(quote(w) for w in ws) for ws in (mt.KEEP, mt.DROP + mt.STOP))
    return rf"list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '' AND (length(w) >= 3 OR w IN ({keep})) AND w NOT IN ({drop}))"


TERMS = rf"""
terms AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY p) - 1 AS term_no, t AS term FROM (
  SELECT row_id, 0 AS p, {strip('symbol_exact_wording')} AS t FROM checklist
  UNION ALL
  SELECT row_id, p, t FROM (SELECT row_id, {strip('symbol_exact_wording')} AS cell, min(i) AS p, t FROM (
    SELECT row_id, symbol_exact_wording, generate_subscripts(u, 1) AS i, trim(regexp_replace(unnest(u), '<[^>]+>', '', 'g')) AS t
    FROM (SELECT row_id, symbol_exact_wording, regexp_extract_all(coalesce(term_html, ''), '(?is)<u>(.*?)</u>', 1) AS u FROM checklist)) GROUP BY row_id, symbol_exact_wording, t)
  WHERE t IS DISTINCT FROM cell)
  WHERE t IS NOT NULL AND t <> '' AND t <> '-')
"""
VARIANTS = rf"""
lines AS (SELECT row_id, term_no, term, generate_subscripts(l, 1) AS line_no, {strip('unnest(l)')} AS line
  FROM (SELECT *, string_split_regex(regexp_replace(replace(term, chr(13), ''), '(?i)<br\s*/?>', chr(10), 'g'), '[\n;|]+') AS l FROM terms)),
parts AS (SELECT row_id, term_no, line_no, generate_subscripts(s, 1) AS part_no, {strip('unnest(s)')} AS part FROM (
  SELECT *, CASE WHEN NOT regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(or|หรือ)($|[^\p{{L}}\p{{N}}_])') AND regexp_matches(line, {quote(cl.ORIGIN)}) AND contains(line, '.')
    THEN list_transform(string_split_regex(line, '\.\s*'), lambda s: regexp_replace(s, '^[ ,/]+|[ ,/]+$', '', 'g')) ELSE string_split_regex(line, {quote(cl.VARIANT_MARKS)}) END AS s FROM lines WHERE line <> '')),
variants AS (SELECT row_id, term_no, row_number() OVER (PARTITION BY row_id, term_no ORDER BY line_no, part_no) - 1 AS variant_no, part AS variant FROM parts WHERE part <> ''
  UNION ALL SELECT row_id, term_no, 0, {strip('term')} FROM terms t WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.row_id = t.row_id AND p.term_no = t.term_no AND p.part <> ''))
"""


CARRIES = """(
  contains(t.text_norm, w.variant_norm)
  OR (len(w.words) > 0 AND t.text_norm LIKE '%' || replace(array_to_string(w.words, '%'), '_', '\\_') || '%' ESCAPE '\\')
  OR (w.age <> '' AND regexp_matches(t.text_norm, '(^|[^\\p{L}\\p{N}_])' || w.age || '\\s*\\+($|[^\\p{L}\\p{N}_])')))"""


def hits() -> str:
    """CTEs up to `hit`(doc_id, variant_norm, page_no) and `need`."""
    return f"""WITH {TERMS}, {VARIANTS},
need AS (SELECT DISTINCT r.doc_id, v.row_id, v.term_no, v.variant_no, {normalize('v.variant')} AS variant_norm FROM check_result r JOIN variants v ON r.row_id = v.row_id WHERE r.doc_id IS NOT NULL),
wanted AS (SELECT DISTINCT doc_id, variant_norm, {words('variant_norm')} AS words, regexp_extract(variant_norm, '^\\s*([0-9]{{1,2}})\\s*\\+\\s*$', 1) AS age FROM need WHERE variant_norm <> ''),
texts AS (SELECT DISTINCT doc_id, page_no, {normalize('text')} AS text_norm FROM page_items),
hit AS (SELECT DISTINCT w.doc_id, w.variant_norm, t.page_no FROM wanted w JOIN texts t ON w.doc_id = t.doc_id AND t.text_norm <> '' AND {CARRIES})
"""
