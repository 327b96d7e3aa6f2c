"""Preview and evidence operators: badges, search hits, active rows, gates, neighbours, code maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import numbers as nb
from proofmill.functions import text as tx
from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.operators import pages as pg

#: Least confidence of a recognized word, least items and height of a page that needs no recognition.
LEAST_CONFIDENCE, ENOUGH_ITEMS, ENOUGH_MM, TERMS_SHOWN = 35.0, 5, 1.0, 200


def html_escape(text: Column) -> Column:
    out = text
    for c, name in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}.items():
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def flat_wording(text: Column) -> Column:
    """The lines of a cell on one line."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), " | ")


def badge(bold: Column, underline: Column) -> Column:
    return F.concat_ws("/", F.when(bold, "B"), F.when(underline, "U"))


def millimetres(mm: Column) -> Column:
    return F.when(mm.isNotNull() & ~F.isnan(mm), F.concat(F.round(mm, 1).cast("decimal(20,1)").cast("string"), F.lit(" mm")))


def sameish(a: Column, b: Column, least: float = 0.6) -> Column:
    """Equal, one inside the other, or most words of the larger set in common."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    return (a == b) | a.contains(b) | b.contains(a) | (F.size(F.array_intersect(x, y)) >= least * F.greatest(F.size(x), F.size(y)))


def sure_items(items: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Recognized items of enough confidence (on the 0 to 100 scale of the data), plus signs whatever theirs."""
    return items.where((F.col("source") == "ocr") & ((F.col("confidence") >= least) | F.trim("text").isin("+", "＋"))).select("item_id")


def recognition_gate(items: DataFrame) -> DataFrame:
    """doc_id, page_no, needs_ocr: pages of few items, or without one of readable height."""
    mm = nb.picked_mm(F.col("size_mm"), F.col("size"), F.col("size_unit"))
    pdf = F.coalesce("source", F.lit("pdf")) == "pdf"
    per = items.groupBy(*it.PAGE).agg(F.count_if(pdf).alias("n"), F.max(F.when(pdf, mm)).alias("mm"))
    return per.select(*it.PAGE, ((F.col("n") < ENOUGH_ITEMS) | (F.coalesce("mm", F.lit(0.0)) < ENOUGH_MM)).alias("needs_ocr"))


def plus_pages(items: DataFrame) -> DataFrame:
    """Pages that carry an age of the form N+ as a word of its own."""
    return items.groupBy(*it.PAGE).agg(F.coalesce(F.bool_or(F.col("text").rlike(r"(^|[^\p{L}\p{N}_])[0-9]{1,2}\s*[+＋]($|[^\p{L}\p{N}_])")), F.lit(False)).alias("has_age"))


def code_pages(items: DataFrame) -> DataFrame:
    """doc_id, code, pages: on which pages which part codes stand."""
    codes = items.select(*it.PAGE, F.explode(it.part_codes(F.col("text"))).alias("code")).distinct()
    return codes.groupBy("doc_id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_no")), lambda p: p.cast("string")), ", ").alias("pages"))


def largest_boxes(items: DataFrame, k: int = 4) -> DataFrame:
    """item_id, rank of the k largest boxes of each page."""
    area = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    rank = F.row_number().over(Window.partitionBy(*it.PAGE).orderBy(F.desc("area"), "item_no", "item_id"))
    return items.where(F.col("bbox").isNotNull()).select("item_id", "item_no", *it.PAGE, F.round(area, 6).alias("area")).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank")


def right_neighbours(items: DataFrame, reach: float = 1.2, level: float = 0.6) -> DataFrame:
    """item_id, other_id: the next item to the right on the same line, no further than `reach` heights."""
    boxed = items.where(F.col("bbox").isNotNull())
    left = boxed.select("item_id", *it.PAGE, F.col("bbox").alias("a"))
    right = boxed.select(F.col("item_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in it.PAGE], F.col("bbox").alias("b"))
    h = F.greatest(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))
    gap = F.col("b.x0") - F.col("a.x1")
    line = F.abs((F.col("a.y0") + F.col("a.y1")) / 2 - (F.col("b.y0") + F.col("b.y1")) / 2) <= level * h
    pairs = left.join(right, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page_no") == F.col("o_page_no")) & (F.col("item_id") != F.col("other_id")) & line & (gap >= 0) & (gap <= reach * h))
    return pairs.groupBy("item_id").agg(F.min(F.struct(F.round(gap, 6).alias("gap"), "other_id")).alias("m")).select("item_id", "m.other_id")


def preview_rows(results: DataFrame) -> DataFrame:
    """result_id, requirement, symbol, status, pages_spec: pages only of rows found or left to manual checking."""
    shown = cl.status(results).join(results.select("result_id", "requirement", "symbol_exact_wording", "pages"), "result_id")
    return shown.select("result_id", tx.dashify(F.col("requirement")).alias("requirement"), flat_wording(F.col("symbol_exact_wording")).alias("symbol"), "status", F.when(F.col("status") == "missing", "-").otherwise(tx.dashify(F.col("pages"))).alias("pages_spec"))


def active_rows(results: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page_no, n_rows: how many results concern each page ("all pages" concerns every one)."""
    pages = items.select(*it.PAGE).distinct()
    total = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    spec = results.join(total, "doc_id").select("result_id", "doc_id", pg.parsed(F.col("pages"), F.col("n")).alias("p"))
    every = spec.where("p is null").groupBy("doc_id").agg(F.count("*").alias("n_all"))
    some = spec.where("p is not null").select("doc_id", F.explode("p").alias("page_no")).withColumn("page_no", F.col("page_no") + 1).groupBy(*it.PAGE).agg(F.count("*").alias("n_some"))
    return pages.join(every, "doc_id", "left").join(some, it.PAGE, "left").select(*it.PAGE, (F.coalesce("n_all", F.lit(0)) + F.coalesce("n_some", F.lit(0))).alias("n_rows"))


def shown_terms(results: DataFrame, limit: int = TERMS_SHOWN) -> DataFrame:
    """doc_id, term, term_no: the first `limit` distinct terms of a document (what a viewer marks)."""
    terms = results.select("doc_id", "result_id", F.posexplode(cl.search_terms(F.col("symbol_exact_wording"))).alias("p", "term"))
    first = terms.groupBy("doc_id", "term").agg(F.min(F.struct("result_id", "p")).alias("at"))
    return first.withColumn("term_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at.result_id", "at.p", "term"))).where(F.col("term_no") <= limit).select("doc_id", "term", "term_no")
