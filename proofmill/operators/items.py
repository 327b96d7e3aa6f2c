"""Page-item operators: page texts, classes, lines, duplicates, geometry, product data.

A page is (doc_id, page_no); order inside a page is (item_no, item_id).  Groups are pages, whose size does not grow with
the data, or are reduced by partial aggregates.  Null boxes take part in no geometric result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import numbers as nb
from proofmill.functions import text as tx
from proofmill.operators.checklists import PART_CODES, holds_any
from proofmill.runtime import spread

PAGE = ["doc_id", "page_no"]
#: Fixed values.
ARTWORK_ITEMS, ARTWORK_MM, COVERAGE = 12, 1.6, 0.90
ORIGIN_HINTS = [
    "made in", "hecho en", "fabriqué en", "fabrique en", "prodotto in", "fabbricato in", "hergestellt in", "gemaakt in", "tillverkad i", "valmistettu", "fremstillet i", "produceret i",
    "produsert i", "wyprodukowano w", "vyrobeno v", "vyrobené v", "gyártva", "készült", "сделано в", "произведено в", "κατασκευ", "παράγ", "üret", "صنع في", "صناعة",
]


def latest(items: DataFrame) -> DataFrame:
    """The last delivery of each item: a later load replaces an earlier one."""
    key = [*PAGE, "item_no"]
    ids = items.groupBy(*key).agg(F.max_by("item_id", F.struct("loaded_at", "item_id")).alias("item_id"))
    return ids.select("item_id", *key)


def page_texts(items: DataFrame) -> DataFrame:
    """doc_id, page_no, page_text: the texts of a page in order, one blank between."""
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "item_id", F.coalesce("text", F.lit("")).alias("text"))))
    return items.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("page_text"))


def artwork_pages(items: DataFrame) -> DataFrame:
    """doc_id, page_no, is_artwork: a part number, many items with a big one, or a phrase of origin in the page's text."""
    mm = nb.picked_mm(F.col("size_mm"), F.col("size"), F.col("size_unit"))
    text = F.coalesce("text", F.lit(""))
    ocr = F.lower(F.coalesce("source", F.lit("pdf"))) == "ocr"
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "item_id", text.alias("text"))))
    per = items.groupBy(*PAGE).agg(
        F.bool_or(F.upper(text).rlike(r"\b[A-Z]{3}[0-9]{2}\b")).alias("part"), F.count_if(~ocr).alias("n_pdf"), F.count_if(ocr).alias("n_ocr"),
        F.bool_or(mm >= ARTWORK_MM).alias("big"), F.bool_or(~ocr & (mm >= ARTWORK_MM)).alias("big_pdf"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("page_text"),
    )
    hint = holds_any(tx.normalize(F.col("page_text")), ORIGIN_HINTS)
    many = ((F.col("n_pdf") >= ARTWORK_ITEMS) & F.col("big_pdf")) | ((F.col("n_ocr") >= ARTWORK_ITEMS) & F.col("big"))
    return per.select(*PAGE, (F.col("part") | many | hint).alias("is_artwork"))


def considered_pages(items: DataFrame) -> DataFrame:
    """doc_id, page_no of the pages that are checked: artwork, and every page but the first."""
    return artwork_pages(items).where(F.col("is_artwork") | (F.col("page_no") > 1)).select(*PAGE)


def page_items_normalized(items: DataFrame) -> DataFrame:
    """The columns of items that a check reads, nulls settled: text_norm, source, level, bold, underline, mm, caps."""
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = spread(items.where("doc_id is not null and page_no is not null").select("item_id", *PAGE, "item_no", "text", "source", "level", "bold", "underline", "size", "size_unit", "size_mm"))
    return rows.select(
        "item_id", *PAGE, "item_no", tx.normalize(F.col("text")).alias("text_norm"), F.lower(F.coalesce("source", F.lit("pdf"))).alias("source"), F.coalesce("level", F.lit("")).alias("level"),
        flag("bold"), flag("underline"), "size_mm", nb.picked_mm(F.col("size_mm"), F.col("size"), F.col("size_unit")).alias("mm"), tx.all_caps(F.col("text")).alias("caps"),
    )


def warning_class(page_text: Column) -> Column:
    """MBG, SHORT, BOTH or UNKNOWN by the two forms of the small-parts warning."""
    gap = r"[\s\W]{0,20}"
    long = rf"\bsmall\s+parts\b{gap}may{gap}be{gap}generat"
    has_long, has_short = page_text.rlike(long), page_text.rlike(rf"\bsmall\s+parts\b(?!{gap}may{gap}be{gap}generat)")
    return F.when(has_long & has_short, "BOTH").when(has_long, "MBG").when(has_short, "SHORT").otherwise("UNKNOWN")


def part_codes(text: Column) -> Column:
    """Known part codes among the words of a text, and codes of the form 2LB to 9LB, sorted."""
    words = tx.tokens_upper(text)
    known = F.array_intersect(words, F.array(*[F.lit(c) for c in PART_CODES]))
    return F.array_sort(F.array_union(known, F.filter(words, lambda w: w.rlike("^[2-9]LB$"))))


def product_info(items: DataFrame, least_mm: float = ARTWORK_MM) -> DataFrame:
    """doc_id, page, product_name (big texts joined), part_no and rev (first found)."""
    mm = F.coalesce(F.when(~F.isnan("size_mm"), F.col("size_mm")), F.lit(0.0))
    at = F.struct("item_no", "item_id")
    part = F.regexp_extract(F.coalesce("text", F.lit("")), r"\b([A-Z0-9]{2,5}-[A-Z0-9]{2,6})\b", 1)
    rev = F.regexp_extract(F.coalesce("text", F.lit("")), r"\b(A[0-9])\b", 1)
    big = F.transform(F.array_sort(F.collect_list(F.when(mm >= least_mm, F.struct("item_no", "item_id", F.coalesce(F.trim("text"), F.lit("")).alias("t"))))), lambda x: x["t"])
    per = items.groupBy(*PAGE).agg(big.alias("big"), F.min_by(F.when(part != "", part), F.when(part != "", at)).alias("part_no"), F.min_by(F.when(rev != "", rev), F.when(rev != "", at)).alias("rev"))
    name = F.when(F.size("big") > 0, F.trim(F.array_join("big", " "))).otherwise("-")
    return per.select("doc_id", F.col("page_no").alias("page"), name.alias("product_name"), F.coalesce("part_no", F.lit("-")).alias("part_no"), F.coalesce("rev", F.lit("-")).alias("rev"))


def built_lines(items: DataFrame) -> DataFrame:
    """Lines put together from the spans that stand at one height of a page."""
    spans = items.where(F.col("level").isNull() & F.col("bbox.y0").isNotNull())
    at = [*PAGE, F.round("bbox.y0", 1).alias("y")]
    parts = F.array_sort(F.collect_list(F.struct("item_no", "item_id", F.coalesce("text", F.lit("")).alias("t"))))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return spans.groupBy(*at).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), flag("bold"), flag("italic"), flag("underline"),
        F.max(F.when(~F.isnan("size_mm"), F.col("size_mm"))).alias("size_mm"), F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"),
    )


def distinct_items(items: DataFrame) -> DataFrame:
    """The first item of each text and source of a page."""
    per = items.groupBy(*PAGE, tx.normalize(F.col("text")).alias("text_norm"), F.coalesce("source", F.lit("pdf")).alias("source")).agg(F.min_by("item_id", F.struct("item_no", "item_id")).alias("item_id"))
    return per.select("item_id", *PAGE, "text_norm", "source")


def ranked_items(items: DataFrame) -> DataFrame:
    """Rank of the items of a page as evidence: lines, bold, big, then order."""
    mm = F.coalesce(F.when(~F.isnan("size_mm"), F.col("size_mm")), F.lit(0.0))
    order = [(F.coalesce("level", F.lit("")) == "line").desc(), F.coalesce("bold", F.lit(False)).desc(), mm.desc(), "item_no", "item_id"]
    return items.select("item_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)).alias("rank"))


def new_ocr_items(items: DataFrame, least_iou: float = 0.6) -> DataFrame:
    """OCR items that are not the same text at the same place as a PDF item; items without a box always stay."""
    text = F.lower(F.trim("text"))
    side = lambda s: items.where(F.coalesce("source", F.lit("pdf")) == s)
    ocr = side("ocr").select(F.col("item_id"), *PAGE, text.alias("t"), F.col("bbox").alias("a"))
    pdf = side("pdf").where(F.col("bbox").isNotNull()).select(*[F.col(c).alias(f"p_{c}") for c in PAGE], text.alias("p_t"), F.col("bbox").alias("b"))
    same = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("page_no") == F.col("p_page_no")) & (F.col("t") == F.col("p_t")) & (nb.iou("a", "b") >= least_iou)
    return ocr.join(pdf, same, "left_anti").select("item_id", *PAGE)


def _centre(box: str) -> tuple[Column, Column]:
    return (F.col(f"{box}.x0") + F.col(f"{box}.x1")) / 2, (F.col(f"{box}.y0") + F.col(f"{box}.y1")) / 2


def nearest(items: DataFrame, within: float = 14.0) -> DataFrame:
    """item_id, other_id, distance: for each number-and-plus or short item the nearest other item of its page within reach."""
    boxed = items.where(F.col("bbox").isNotNull())
    small = boxed.where(F.length(F.trim("text")) <= 6).select("item_id", *PAGE, F.col("bbox").alias("a"))
    other = boxed.select(F.col("item_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in PAGE], F.col("bbox").alias("b"))
    (ax, ay), (bx, by) = _centre("a"), _centre("b")
    pairs = small.join(other, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page_no") == F.col("o_page_no")) & (F.col("item_id") != F.col("other_id")))
    pairs = pairs.withColumn("distance", F.round(F.sqrt((ax - bx) ** 2 + (ay - by) ** 2), 4)).where(F.col("distance") <= within)
    return pairs.groupBy("item_id").agg(F.min(F.struct("distance", "other_id")).alias("m")).select("item_id", "m.other_id", "m.distance")


def grid_first(items: DataFrame, cell: float = 8.0) -> DataFrame:
    """The first item of each grid cell of all four edges on a page."""
    edges = [F.floor(F.col(f"bbox.{e}") / cell).alias(f"g_{e}") for e in ("x0", "y0", "x1", "y1")]
    return items.where(F.col("bbox").isNotNull()).groupBy(*PAGE, *edges).agg(F.min_by("item_id", F.struct("item_no", "item_id")).alias("item_id")).select("item_id", *PAGE)


def page_boxes(items: DataFrame) -> DataFrame:
    """The box around all items of a page."""
    return items.where(F.col("bbox").isNotNull()).groupBy(*PAGE).agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def inside_artwork(items: DataFrame, left: float = 0.08, right: float = 0.08, top: float = 0.12, bottom: float = 0.12) -> DataFrame:
    """item_id of items whose centre lies inside the page's box less its margins."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cx, cy = _centre("bbox")
    joined = items.where(F.col("bbox").isNotNull()).join(page_boxes(items), PAGE)
    return joined.where(cx.between(F.col("x0") + w * left, F.col("x1") - w * right) & cy.between(F.col("y0") + h * top, F.col("y1") - h * bottom)).select("item_id")


def underlined_by(items: DataFrame, reach: float = 2.0, least: float = 0.5) -> DataFrame:
    """item_id of spans under which an item's lower edge runs along at least half their width (stand-in for drawn lines)."""
    spans = items.where(F.col("level").isNull() & F.col("bbox").isNotNull()).select("item_id", *PAGE, F.col("bbox").alias("a"))
    rules = items.where((F.col("level") == "line") & F.coalesce("underline", F.lit(False)) & F.col("bbox").isNotNull()).select(*[F.col(c).alias(f"r_{c}") for c in PAGE], F.col("bbox").alias("b"))
    width = F.col("a.x1") - F.col("a.x0")
    along = nb.overlap(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1")) >= least * width
    near = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_no") == F.col("r_page_no")) & (F.abs(F.col("b.y1") - F.col("a.y1")) <= reach) & along
    return spans.join(rules, near, "left_semi").select("item_id")


def full_recognition_gate(items: DataFrame, least_words: int = 8) -> DataFrame:
    """doc_id, page_no, again: pages of which recognition gave nothing, or few words and no plus sign."""
    ocr = F.col("source") == "ocr"
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    plus = F.col("text").contains("+") | F.col("text").contains("＋")
    per = items.groupBy(*PAGE).agg(F.count_if(ocr).alias("n"), F.sum(F.when(ocr, words)).alias("words"), F.bool_or(F.when(ocr, plus)).alias("plus"))
    return per.select(*PAGE, ((F.col("n") == 0) | ((F.coalesce("words", F.lit(0)) < least_words) & ~F.coalesce("plus", F.lit(False)))).alias("again"))


def ocr_lines(items: DataFrame) -> DataFrame:
    """Recognized words of a page gathered into lines.

    A line is open at its right end.  Words come by the height of their middle, then from the left; a word belongs to the
    first open line, in order of opening, whose middle it meets within 0.45 and whose end within 1.2 of the larger height;
    otherwise it opens a line.  Height and middle of a line are the means over its words, its first one counting twice.
    """

    def lines_of(page: pd.DataFrame) -> pd.DataFrame:
        top, bottom = page["y0"].to_numpy(float), page["y1"].to_numpy(float)
        middle, height = (top + bottom) / 2, np.maximum(bottom - top, 1.0)
        left, right, texts = page["x0"].to_numpy(float), page["x1"].to_numpy(float), page["text"].fillna("").tolist()
        n = len(page)
        # One row per open line, in order of opening: sums of middles and heights, words that count, right end.
        sums, ends, line_of, opened = np.zeros((n, 3)), np.zeros(n), np.zeros(n, int), 0
        for i in np.lexsort((page["item_id"], left, middle)):
            mids, talls = (sums[:opened, k] / sums[:opened, 2] for k in (0, 1))
            tall = np.maximum(talls, height[i])
            fits = np.flatnonzero((np.abs(middle[i] - mids) <= 0.45 * tall) & (left[i] - ends[:opened] <= 1.2 * tall))
            at = fits[0] if len(fits) else opened
            if at == opened:
                opened += 1
                sums[at] += (middle[i], height[i], 1)
            sums[at] += (middle[i], height[i], 1)
            ends[at], line_of[i] = right[i], at
        words: list[list[str]] = [[] for _ in range(opened)]
        for i in np.lexsort((page["item_id"], left, middle)):
            words[line_of[i]].append(texts[i])
        head = {c: page[c].iloc[0] for c in PAGE}
        return pd.DataFrame({**head, "line_no": range(1, opened + 1), "text": [" ".join(w) for w in words], "n_words": [len(w) for w in words]})

    words = items.where((F.col("source") == "ocr") & F.col("level").isNull() & F.col("bbox").isNotNull())
    words = words.select("item_id", *PAGE, "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return words.groupBy(*PAGE).applyInPandas(lines_of, "doc_id string, page_no int, line_no int, text string, n_words int")
