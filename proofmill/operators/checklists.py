"""Checklist operators: fill, classify, terms, variants, notes, groups, report.

Nulls count as empty text; repeated rows each give their own result; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import text as tx

#: Phrases that make a row a remark to the printer, dropped from the check.
SKIP = ["do not print", "do not forget", "see template", "don't forget", "for reference", "note", "click", "reminder", "refer template", "remove from template", "remove from mb legal template"]
#: Phrases that leave a row to manual checking.
MANUAL = [
    "brand logo", "copyright for t&f", "space for date code", "lion mark", "lionmark", "lion-mark", "ce mark", "en 71", "ukca", "mc mark", "cib",
    "argentina logo", "brazilian logo", "italy requirement", "france requirement", "sorting & donation label", "spain sorting symbols",
    "usa warning statement", "product’s common", "upc requirement", "list of content : text", "list of content : pictorial", "product's common", "generic name",
    "โลโก้", "ลิขสิทธิ์", "ตรา", "สัญลักษณ์", "เครื่องหมาย", "สำรองพื้นที่รหัสวันที่", "เครื่องหมายรับรอง",
]
#: Separators between variants of a term.
VARIANT_MARKS = r"[/,•·∙・／]+"
#: Phrases of origin, after which full stops part variants.
ORIGIN = (
    r"(?i)\b(made\s+in|hecho\s+en|fabricad\w*\s+en|fabriqu\w*\s+en|prodotto\s+in|fabbricato\s+in|hergestellt\s+in|feito\s+(?:em|no|na)|gemaakt\s+in|"
    r"tillverkad\s+i|valmistettu|fremstillet\s+i|produceret\s+i|produsert\s+i|vyroben[oaé]?|wyprodukowano\s+w|gyártva|készült|сделано\s+в|произведено\s+в|κατασκευ|παράγ|üret|صنع\s+في|صناعة)\b"
)
#: Phrases of origin by language.
ORIGIN_BY_LANGUAGE = {
    "ENGLISH": ["made in"], "UK": ["made in"], "US": ["made in"], "SPANISH": ["hecho en", "fabricado en"], "LAAM SPANISH": ["hecho en", "fabricado en"], "CANADIAN FRENCH": ["fabriqué en", "fabriqué au"],
    "FRENCH": ["fabriqué en", "fabrique en"], "PORTUGUESE": ["feito em", "feito na", "fabricado em", "fabricado na"], "BRAZILIAN PORTUGUESE": ["feito no", "feito na", "feito em", "fabricado no", "fabricado na", "fabricado em"],
    "GERMAN": ["hergestellt in"], "ITALIAN": ["prodotto in", "fabbricato in"], "DUTCH": ["gemaakt in", "vervaardigd in"], "SWEDISH": ["tillverkad i"], "FINNISH": ["valmistettu"],
    "DANISH": ["fremstillet i", "produceret i"], "NORWEGIAN": ["produsert i", "fremstilt i"], "POLISH": ["wyprodukowano w"], "CZECH": ["vyrobeno v"], "SLOVAK": ["vyrobené v"], "HUNGARIAN": ["gyártva", "készült"],
    "RUSSIAN": ["сделано в", "произведено в"], "GREEK": ["κατασκευάζεται στην", "παράγεται στην"], "TURKISH": ["üretildiği", "üretim yeri", "ürün menşei"], "ARABIC": ["صنع في", "صناعة"],
}
#: Roots by which a bare phrase of origin is known.
ORIGIN_ROOTS = [
    "made", "hecho", "fabrique", "fabriqu", "prodotto", "fabbricato", "hergestellt", "gemaakt", "tillverkad", "valmistettu", "fremstillet", "produceret", "produsert", "wyprodukowano", "vyroben", "gyártva", "készült",
    "сделано", "произведено", "κατασκευ", "παράγ", "üret", "صنع", "صناعة",
]
#: Words that carry no search.
STOP = ["in", "en", "na", "de", "la", "el", "em", "da", "do", "di", "du", "of", "and", "y", "et", "the", "a", "an"]
#: Words of a header row.
HEADER_WORDS = ["requirement", "symbol", "wording", "specification", "language", "verification", "panel", "procedure", "remark"]
#: Part codes, in order of preference.
PART_CODES = ["UU1_DOM", "DOM", "UU1", "2LB", "2XV", "4LB", "19L", "19A", "21A", "DC1"]


def holds_any(text: Column, words: list[str]) -> Column:
    """One of the words, as written, is part of the text."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def contains_any(text: Column, words: list[str]) -> Column:
    return holds_any(F.lower(text), words)


#: Rows of a sheet that are filled together; what is carried into a block comes from the table of blocks.
FILL_BLOCK = 1000


def filled(checklist: DataFrame) -> DataFrame:
    """The requirement of merged cells carried down the sheet: inside blocks of rows, then between blocks, so that no task orders a whole sheet."""
    block = F.floor(F.col("row_no") / FILL_BLOCK).alias("__block")
    rows = checklist.withColumn("__block", block)
    down = Window.partitionBy("checklist_id", "__block").orderBy("row_no", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("__inside", F.last("requirement", ignorenulls=True).over(down))
    ends = rows.groupBy("checklist_id", "__block").agg(F.max_by("requirement", F.when(F.col("requirement").isNotNull(), F.struct("row_no", "row_id"))).alias("__last"))
    before = Window.partitionBy("checklist_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("checklist_id", "__block", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    same = [inside[c].eqNullSafe(ends[c]) for c in ("checklist_id", "__block")]
    joined = inside.join(ends, same, "left").drop(ends["checklist_id"], ends["__block"])
    return joined.withColumn("requirement", F.coalesce("__inside", "__carried")).drop("__inside", "__carried", "__block")


def row_class(checklist: DataFrame) -> DataFrame:
    """manual (marked), skip, manual (by keyword or without a term), empty or verify, in this order."""
    blank = lambda c: F.coalesce(tx.dashify(F.col(c)), F.lit("-")) == "-"
    req, spec, remark = (F.coalesce(F.col(c), F.lit("")) for c in ("requirement", "specification", "remark"))
    words = F.concat_ws(" ", req, spec, remark)
    kind = (
        F.when(F.lower(F.trim("verification")) == "manual", "manual")
        .when(contains_any(req, SKIP) | contains_any(spec, SKIP), "skip")
        .when(blank("symbol_exact_wording") & blank("specification") & blank("remark") & ~F.coalesce("has_image", F.lit(False)), "empty")
        .when(contains_any(words, MANUAL) | blank("symbol_exact_wording"), "keyword")
        .otherwise("verify")
    )
    return checklist.withColumn("row_class", kind)


def terms(checklist: DataFrame) -> DataFrame:
    """row_id, term_no, term: the whole cell, and each underlined part of it that is not the cell again."""
    cell = tx.strip(F.col("symbol_exact_wording"))
    listed = F.filter(F.array_union(F.array(cell), tx.underlined(F.col("term_html"))), lambda t: t.isNotNull() & (t != "") & (t != "-"))
    return checklist.select("row_id", F.posexplode(listed).alias("term_no", "term"))


def split_variants(term: Column) -> Column:
    """Spellings that a term allows: lines, then slashes and commas; after a phrase of origin, full stops."""
    lines = F.split(F.regexp_replace(F.replace(term, F.lit("\r"), F.lit("")), r"(?i)<br\s*/?>", "\n"), r"[\n;|]+")

    def parts(line: Column) -> Column:
        either = line.rlike(r"(?i)\b(or|หรือ)\b")
        by_stop = F.transform(F.split(line, r"\.\s*"), lambda s: F.regexp_replace(s, r"^[ ,/]+|[ ,/]+$", ""))
        return F.when(~either & line.rlike(ORIGIN) & line.contains("."), by_stop).otherwise(F.split(line, VARIANT_MARKS))

    found = F.flatten(F.transform(F.filter(F.transform(lines, tx.strip), lambda s: s != ""), parts))
    found = F.filter(F.transform(found, tx.strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(tx.strip(term)))


def variants(terms_: DataFrame) -> DataFrame:
    return terms_.select("row_id", "term_no", F.posexplode(split_variants(F.col("term"))).alias("variant_no", "variant"))


def search_terms(text: Column) -> Column:
    """Distinct search terms of a cell in order, outer punctuation off, with the two other spellings of "3+"."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), r"[|;\n]+")
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^[ .;,，、：:]+|[ .;,，、：:]+$", "")), lambda p: (p != "") & (p != "-"))
    spelled = F.transform(clean, lambda p: F.when(p.contains("3+"), F.array(p, F.lit("3 +"), F.lit("3＋"))).otherwise(F.array(p)))
    return F.array_distinct(F.flatten(spelled))


def space_variants(term: Column) -> Column:
    """The term with each other kind of blank, and with two blanks."""
    other = F.array(*[F.lit(c) for c in (" ", " ", " ", " ", " ", "  ")])
    return F.when(term.contains(" "), F.array_distinct(F.concat(F.array(term), F.transform(other, lambda c: F.replace(term, F.lit(" "), c))))).otherwise(F.array(term))


def origin_phrases(languages: Column) -> Column:
    """Phrases of origin of the named languages, in the order of the table; of all languages if none is named."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(p) for p in v]).alias("p")) for k, v in ORIGIN_BY_LANGUAGE.items()])
    named = F.filter(F.transform(F.coalesce(languages, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(F.filter(table, lambda t: (F.size(named) == 0) | F.array_contains(named, t["k"])), lambda t: t["p"])))


def bare_origin(variant_norm: Column) -> Column:
    """A phrase of origin of at most two words that count, with no country behind it."""
    words = F.filter(F.split(variant_norm, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP))
    return holds_any(variant_norm, ORIGIN_ROOTS) & (F.size(words) <= 2)


def remark_languages(remark: Column, term: Column) -> Column:
    """Languages of the lines "wording = language" of a remark whose wording is part of the term."""
    lines = F.filter(F.split(F.coalesce(remark, F.lit("")), r"\r?\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("w"), F.trim(F.split(x, "=", 2)[1]).alias("l")))
    found = F.transform(F.filter(pairs, lambda p: (p["w"] != "") & F.coalesce(term, F.lit("")).contains(p["w"])), lambda p: p["l"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unspecified")))


def header_scores(checklist: DataFrame) -> DataFrame:
    """checklist_id, sheet_row, score of the row most like a header among the first 15 with two or more cells (ties: the upper)."""
    cells = ["requirement", "symbol_exact_wording", "specification", "language", "verification", "package_panel", "procedure_text", "remark"]
    pattern = "|".join(HEADER_WORDS)
    one = lambda c: F.when(F.col(c).isNull(), 0).otherwise(5 * F.lower(c).rlike(pattern).cast("int") + (F.length(c) <= 24).cast("int") - 2 * F.col(c).rlike("[=“”]").cast("int"))
    filled_ = sum((F.col(c).isNotNull().cast("int") for c in cells), F.lit(0))
    scored = checklist.where(filled_ >= 2).select("checklist_id", "sheet_row", "row_id", sum((one(c) for c in cells), F.lit(0)).alias("score"))
    first = F.row_number().over(Window.partitionBy("checklist_id").orderBy("sheet_row", "row_id"))
    best = scored.withColumn("n", first).where("n <= 15").groupBy("checklist_id").agg(F.max_by(F.struct("sheet_row", "score"), F.struct("score", -F.col("n"))).alias("b"))
    return best.select("checklist_id", "b.sheet_row", "b.score")


def flat_paths(checklist: DataFrame) -> DataFrame:
    """row_id, paths of all image groups in order, and whether any is not blank."""
    paths = F.flatten(F.transform("image_groups_resolved", lambda g: F.coalesce(g["paths"], F.array().cast("array<string>"))))
    paths = F.transform(paths, lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    return checklist.select("row_id", F.array_join(paths, ";").alias("paths"), F.coalesce(F.exists(paths, lambda p: F.trim(p) != ""), F.lit(False)).alias("any_image"))


def parse_image_groups(cell: Column) -> Column:
    """Groups of a cell of lines "[GROUP: name][ANY|ALL]" and paths; paths before any group form one of mode any."""
    head = r"(?i)^\s*\[GROUP:\s*(.+?)\s*\]\s*\[(ANY|ALL)\]\s*$"
    lines = F.filter(F.transform(F.split(F.replace(F.coalesce(cell, F.lit("")), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    group = "struct<name:string,mode:string,paths:array<string>>"
    start = F.lit(None).cast(f"array<{group}>")
    start = F.coalesce(start, F.array().cast(f"array<{group}>"))

    def step(acc: Column, line: Column) -> Column:
        paths = F.filter(F.transform(F.split(line, "[;|]"), lambda p: F.replace(F.trim(p), F.lit("\\"), F.lit("/"))), lambda p: ~p.isin("", "-", "N/A", "None"))
        new = F.struct(F.regexp_extract(line, head, 1).alias("name"), F.lower(F.regexp_extract(line, head, 2)).alias("mode"), F.array().cast("array<string>").alias("paths")).cast(group)
        bare = F.struct(F.lit("").alias("name"), F.lit("any").alias("mode"), paths.alias("paths")).cast(group)
        last = F.element_at(acc, -1)
        grown = F.struct(last["name"].alias("name"), last["mode"].alias("mode"), F.concat(last["paths"], paths).alias("paths")).cast(group)
        return F.when(line.rlike(head), F.concat(acc, F.array(new))).when(F.size(acc) == 0, F.array(bare)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    return F.filter(F.aggregate(lines, start, step), lambda g: F.size(g["paths"]) > 0)


def all_image_groups(groups: Column) -> Column:
    """The groups of a row written as cells and parsed: each group without a name as a cell of bare paths whose mode stands beside it, ahead of one cell of the named groups."""
    groups = F.coalesce(groups, F.array().cast("array<struct<name:string,mode:string,paths:array<string>>>"))
    blank_ = lambda g: F.trim(F.coalesce(g["name"], F.lit(""))) == ""
    mode = lambda g: F.coalesce(g["mode"], F.lit("any"))
    paths = lambda g: F.array_join(F.coalesce(g["paths"], F.array().cast("array<string>")), "\n")
    bare = F.transform(F.filter(groups, blank_), lambda g: F.transform(parse_image_groups(paths(g)), lambda p: F.struct(p["name"].alias("name"), F.lower(mode(g)).alias("mode"), p["paths"].alias("paths"))))
    named = F.transform(F.filter(groups, lambda g: ~blank_(g)), lambda g: F.concat(F.lit("[GROUP: "), g["name"], F.lit("]["), F.upper(mode(g)), F.lit("]\n"), paths(g)))
    return F.concat(F.flatten(bare), parse_image_groups(F.array_join(named, "\n")))


def ordered_groups(rows: DataFrame) -> DataFrame:
    """Report order: groups of (requirement, specification, verification) as first seen, rows in order inside."""
    keys = [F.coalesce(c, F.lit("")) for c in ("requirement", "specification", "verification")]
    first = F.min(F.struct("row_no", "row_id")).over(Window.partitionBy("checklist_id", *keys))
    order = F.row_number().over(Window.partitionBy("checklist_id").orderBy(first, "row_no", "row_id"))
    return rows.select("checklist_id", "row_id", order.alias("report_no"))


def joined_notes(results: DataFrame) -> DataFrame:
    """row_id, notes: the distinct notes of a row, letter case aside, in order of first appearance."""
    note = F.trim("note")
    good = results.where(note.isNotNull() & ~note.isin("", "-")).select("row_id", note.alias("note"), "result_id")
    first = good.groupBy("row_id", F.lower("note").alias("low")).agg(F.min("result_id").alias("at"), F.min_by("note", "result_id").alias("note"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("at", "low", "note"))), lambda x: x["note"])
    return first.groupBy("row_id").agg(F.array_join(sorted_, "; ").alias("notes"))


def shown_results(results: DataFrame) -> DataFrame:
    """Results of requirement groups of which at least one is found; groups without a requirement stay."""
    found = F.coalesce(F.col("found_flag").contains("Found") & ~F.col("found_flag").contains("Not"), F.lit(False))
    any_found = F.bool_or(found).over(Window.partitionBy("doc_id", "requirement"))
    return results.withColumn("__any", any_found).where(F.col("__any") | F.col("requirement").isNull()).drop("__any")


def status(results: DataFrame) -> DataFrame:
    """result_id, status manual / found / missing."""
    flag = F.coalesce("found_flag", F.lit("-"))
    manual = (F.lower(F.trim("verification")) == "manual") | (flag == "-")
    return results.select("result_id", F.when(F.coalesce(manual, F.lit(False)), "manual").when(flag.contains("Not"), "missing").otherwise("found").alias("status"))


REPORT = ["requirement", "symbol_exact_wording", "specification", "package_panel", "procedure_text", "remark", "remark_url", "found_flag", "match_flag", "pages", "font_size", "note", "verification"]


def report(results: DataFrame) -> DataFrame:
    """Display table: fixed column order, blanks as dashes."""
    return results.select("result_id", *[tx.dashify(F.col(c)).alias(c) for c in REPORT])


def kept_rows(checklist: DataFrame) -> DataFrame:
    """Rows that say anything: a wording, specification, remark or link, an image, or the heading of play functions."""
    rows = filled(checklist)
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    heading = F.coalesce("requirement", F.lit("")).rlike(r"(?i)instruction\s+of\s+play\s+function\s+feature")
    return rows.where(said("symbol_exact_wording") | said("specification") | said("remark") | said("remark_link") | F.coalesce("has_image", F.lit(False)) | heading)


def remark_pairs(checklist: DataFrame) -> DataFrame:
    """row_id, pair_no, left_text, right_text of the lines "left = right" of a remark."""
    lines = F.split(F.coalesce("remark", F.lit("")), r"\r\n|\r|\n|;")
    side = lambda x, pattern: F.trim(F.regexp_extract(x, pattern, 1))
    pairs = F.filter(F.transform(F.filter(lines, lambda x: x.contains("=")), lambda x: F.struct(side(x, "^([^=]*)=").alias("l"), side(x, "=(.*)$").alias("r"))), lambda p: (p["l"] != "") & (p["r"] != ""))
    return checklist.select("row_id", F.posexplode(pairs).alias("p", "x")).select("row_id", (F.col("p") + 1).alias("pair_no"), F.col("x.l").alias("left_text"), F.col("x.r").alias("right_text"))


def with_mode(groups: Column, mode: str) -> Column:
    """All image groups under one mode."""
    return F.transform(groups, lambda g: F.struct(g["name"].alias("name"), F.lit(mode).alias("mode"), g["paths"].alias("paths")))


def resolved_paths(checklist: DataFrame, base: str) -> DataFrame:
    """row_id, path_no, path of all images, relative ones under the folder of the checklist."""
    paths = F.flatten(F.transform("image_groups_resolved", lambda g: F.coalesce(g["paths"], F.array().cast("array<string>"))))
    clean = F.filter(F.transform(paths, lambda p: F.replace(F.trim(p), F.lit("\\"), F.lit("/"))), lambda p: F.coalesce(p, F.lit("")) != "")
    rows = checklist.select("row_id", F.posexplode(clean).alias("i", "p"))
    whole = F.col("p").rlike("^([A-Za-z]:)?/") | F.col("p").rlike("^[a-z]+://")
    return rows.select("row_id", (F.col("i") + 1).alias("path_no"), F.when(whole, F.col("p")).otherwise(F.concat(F.lit(f"{base}/"), "p")).alias("path"))


def first_holding(results: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, first_id: the first result of each document whose wording holds one of the words, letter case aside."""
    return results.where(contains_any(F.coalesce("symbol_exact_wording", F.lit("")), words)).groupBy("doc_id").agg(F.min("result_id").alias("first_id"))


def result_flags(results: DataFrame) -> DataFrame:
    """result_id, has_pages, is_found (manual rows count as found) of stored results."""
    pages = F.trim("pages")
    has = ~pages.isin("", "-", "—", "0") & (F.lower(pages) != "none")
    found = (F.lower(F.trim("verification")) == "manual") | F.trim("found_flag").startswith("✅")
    return results.select("result_id", F.coalesce(has, F.lit(False)).alias("has_pages"), F.coalesce(found, F.lit(False)).alias("is_found"))
