"""Matching of required wordings against the page items of their document.

A text can only carry a wording if it holds the wording's longest runs of letters, so both sides meet on the document and
one run of three characters: the one of the wording's words that is rarest among all wordings.  Texts offer only runs that
some wording asks for (a table of at most GRAMS rows, which is sent to the executors).  The work therefore grows with the
texts and the true candidates, not with wordings times texts; the full ladder of predicates is applied to what meets.
Wordings too short for a run, such as "3+", of which there are few different ones, meet all texts of their document, dealt
over salts; nearly equal texts meet on the document and a piece that stands whole in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import text as tx
from proofmill.operators import checklists as cl
from proofmill.operators import items as it
from proofmill.runtime import cut_lineage, spread

BLOCK = 2000
#: Buckets of runs of three characters.
GRAMS = 1 << 16
#: Words that carry no search, words dropped, and short words kept.
STOP = cl.STOP
DROP = ["requirement", "address", "code"]
KEEP = ["astm", "iso", "en71", "f963", "eu", "us", "uk", "br", "ca", "brazil", "canada", "canadian"]
LEAST_RATIO = 0.96
#: In documents of more pairs of a variant and a text, nearly equal ones meet on pieces, up to so many characters of the variant; others meet on their length.
MANY, LONG = 200_000, 150


def search_words(variant: Column) -> Column:
    words = F.filter(F.split(variant, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.filter(words, lambda w: ((F.length(w) >= 3) | w.isin(KEEP)) & ~w.isin(DROP + STOP))


def required(results: DataFrame, checklist: DataFrame) -> DataFrame:
    """doc_id, row_id, term_no, variant_no, variant_norm: what each document must carry."""
    wanted = results.select("doc_id", "row_id").where("doc_id is not null and row_id is not null").distinct()
    spelled = cl.variants(spread(cl.terms(checklist))).withColumn("variant_norm", tx.normalize(F.col("variant")))
    return wanted.join(spelled, "row_id").where("variant_norm != ''")


def distinct_texts(items: DataFrame) -> DataFrame:
    """doc_id, page_no, text_norm, source: the different texts of each page, normalized once and written out."""
    rows = spread(items.select("doc_id", "page_no", "text", "source").where("text is not null and doc_id is not null"))
    texts = rows.select("doc_id", "page_no", tx.normalize(F.col("text")).alias("text_norm"), F.lower(F.coalesce("source", F.lit("pdf"))).alias("source"))
    return spread(cut_lineage(texts.where("text_norm != ''").distinct()))


def _salted(variants: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: the texts of a document dealt over as many as it has blocks of BLOCK, its variants repeated."""
    salts = texts.groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n_salts"))
    dealt = texts.join(salts, "doc_id").withColumn("salt", F.pmod(F.xxhash64(*[c for c in texts.columns if c != "doc_id"]), F.col("n_salts").cast("bigint")).cast("int")).drop("n_salts")
    return variants.join(salts, "doc_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))).drop("n_salts"), dealt


def _runs(text: Column) -> Column:
    """Buckets of all runs of three characters."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1)), lambda r: F.pmod(F.xxhash64(r), F.lit(GRAMS)).cast("int"))


def _spelled_out(wanted: DataFrame) -> DataFrame:
    """wanted (a row per variant_norm and document) with the columns that the ladder reads."""
    v = F.col("variant_norm")
    age = F.regexp_extract(v, r"^\s*([0-9]{1,2})\s*\+\s*$", 1)
    out = wanted.withColumn("words", search_words(v)).withColumn("age_no", F.when(age != "", age))
    return out.withColumn("age", F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), "age_no", F.lit(r"\s*\+($|[^\p{L}\p{N}_])")))


def ordered_end(text: Column) -> Column:
    """Where the last of the words ends, each sought behind the one before; 0 without words, -1 where one is missing."""
    at = lambda end, w: F.call_function("locate", w, text, end + 1)
    return F.aggregate("words", F.lit(0), lambda end, w: F.when(end < 0, end).when(at(end, w) > 0, at(end, w) + F.length(w) - 1).otherwise(-1))


def carriers(wanted: DataFrame, texts: DataFrame, match: Column) -> DataFrame:
    """wanted x texts (doc_id, text_norm ...) where `match` holds; wanted is spelled out, and match implies that the text holds
    all search words of the variant, or the variant itself where it has none."""
    long = F.filter("words", lambda w: F.length(w) >= 3)
    anchors = F.when(F.col("age_no").isNotNull(), F.array().cast("array<string>")).when(F.size("words") > 0, long).otherwise(F.array("variant_norm"))
    runs = spread(cut_lineage(wanted.withColumn("runs", F.array_distinct(F.flatten(F.transform(anchors, _runs))))))  # four uses
    short = runs.where(F.size("runs") == 0)
    counts = runs.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))  # at most GRAMS rows
    each = runs.select("doc_id", "variant_norm", F.explode("runs").alias("run")).join(F.broadcast(counts), "run")
    rarest = each.groupBy("doc_id", "variant_norm").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    asking = runs.drop("runs").join(rarest, ["doc_id", "variant_norm"])
    asked = rarest.select("run").distinct()  # at most GRAMS rows
    offers = texts.withColumn("run", F.explode(F.array_distinct(_runs(F.col("text_norm"))))).join(F.broadcast(asked), "run")
    met = asking.join(offers, ["doc_id", "run"]).where(match).drop("run")
    few, dealt = _salted(short.drop("runs"), texts)
    return met.unionByName(few.join(dealt, ["doc_id", "salt"]).where(match).drop("salt"))


def ladder() -> Column:
    """Age form, substring, or words in order."""
    text = F.col("text_norm")
    first = F.coalesce(text.contains(F.get("words", F.lit(0))), F.lit(False))
    return text.contains(F.col("variant_norm")) | (first & (ordered_end(text) > 0)) | F.coalesce(F.expr("text_norm rlike age"), F.lit(False))


def hits(need: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, variant_norm, page_no: pages with an item that carries the variant (age form, substring or words in order)."""
    return hit_texts(need, items).select("doc_id", "variant_norm", "page_no").distinct()


def hit_texts(need: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, variant_norm, page_no, text_norm: the texts that carry the variant."""
    texts = distinct_texts(items).select("doc_id", "page_no", "text_norm").distinct()
    wanted = _spelled_out(need.select("doc_id", "variant_norm").distinct())
    return carriers(wanted, texts, ladder()).select("doc_id", "variant_norm", "page_no", "text_norm")


def page_carriers(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, variant_norm, page_no: pages (doc_id, page_no, text_norm) whose whole text carries the variant's words in order (two words or more)."""
    several = _spelled_out(wanted.select("doc_id", "variant_norm").distinct()).where("size(words) >= 2")
    # The words anywhere come first, as they are found faster.
    carried = F.forall("words", lambda w: F.col("text_norm").contains(w)) & (ordered_end(F.col("text_norm")) > 0)
    return carriers(several, pages, carried).select("doc_id", "variant_norm", "page_no")


def page_hits(need: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """Further pages whose whole text carries the variant's words in order (two words or more)."""
    pages = it.page_texts(items.select("doc_id", "page_no", "item_no", "item_id", "text")).select("doc_id", "page_no", tx.normalize(F.col("page_text")).alias("text_norm"))
    return page_carriers(need, spread(cut_lineage(pages))).join(found, ["doc_id", "variant_norm", "page_no"], "left_anti")


def term_pages(results: DataFrame, checklist: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row_id, term_no, found, n_pages, first_page: terms without a hit stay, as not found."""
    need = required(results, checklist)
    found = hits(need, items)
    pages = need.join(found, ["doc_id", "variant_norm"], "left")
    return pages.groupBy("doc_id", "row_id", "term_no").agg(F.countDistinct("page_no").alias("n_pages"), F.min("page_no").alias("first_page")).withColumn("found", F.col("n_pages") > 0)


def best_variants(results: DataFrame, checklist: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row_id, term_no, variant_no, n_hits: the variant on most pages (ties: the first)."""
    need = required(results, checklist)
    counted = need.join(hits(need, items), ["doc_id", "variant_norm"], "left").groupBy("doc_id", "row_id", "term_no", "variant_no").agg(F.countDistinct("page_no").alias("n_hits"))
    best = F.row_number().over(Window.partitionBy("doc_id", "row_id", "term_no").orderBy(F.desc("n_hits"), "variant_no"))
    return counted.withColumn("r", best).where("r = 1").drop("r")


def evidence(results: DataFrame, checklist: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row_id, bold, underline, all_caps, max_mm: style over the items that carry the whole cell's text."""
    need = results.select("doc_id", "row_id").distinct().join(checklist.select("row_id", tx.normalize(F.col("symbol_exact_wording")).alias("norm")), "row_id").where("norm != ''")
    text = items.select("doc_id", tx.normalize(F.col("text")).alias("norm"), "bold", "underline", tx.all_caps(F.col("text")).alias("caps"), F.when(~F.isnan("size_mm"), F.col("size_mm")).alias("mm"))
    per = text.groupBy("doc_id", "norm").agg(F.bool_or("bold").alias("bold"), F.bool_or("underline").alias("underline"), F.bool_and("caps").alias("all_caps"), F.max("mm").alias("max_mm"))
    return need.join(per, ["doc_id", "norm"]).select("doc_id", "row_id", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("underline", F.lit(False)).alias("underline"), F.coalesce("all_caps", F.lit(False)).alias("all_caps"), "max_mm")


def verdicts(results: DataFrame, checklist: DataFrame, items: DataFrame, threshold: Column) -> DataFrame:
    """doc_id, row_id, match, notes: the style rules of a row's specification against its evidence."""
    seen = evidence(results, checklist, items).join(checklist.select("row_id", "specification", threshold.alias("least_mm")), "row_id")
    spec = F.lower(F.coalesce("specification", F.lit("")))
    wants_none = spec.contains("no underline")
    checks = [
        F.when(spec.contains("bold") & ~F.col("bold"), F.lit("Not Bold")),
        F.when(wants_none & F.col("underline"), F.lit("Underline must be absent")),
        F.when(spec.contains("underline") & ~wants_none & ~F.col("underline"), F.lit("Underline Missing")),
        F.when(spec.contains("all caps") & ~F.col("all_caps"), F.lit("Not All Caps")),
        F.when(F.col("max_mm") < F.col("least_mm"), F.lit("Font too small")),
    ]
    notes = F.array_compact(F.array(*checks))
    return seen.select("doc_id", "row_id", (F.size(notes) == 0).alias("match"), F.array_join(notes, "; ").alias("notes"))


def term_verdicts(results: DataFrame, checklist: DataFrame, items: DataFrame, threshold: Column) -> DataFrame:
    """doc_id, row_id, term_no, found, match, notes: the style rules against all items that carry any variant of the term; terms without an item stay, as not found."""
    need = required(results, checklist)
    text = items.select("doc_id", tx.normalize(F.col("text")).alias("text_norm"), "bold", "underline", tx.all_caps(F.col("text")).alias("caps"), F.when(~F.isnan("size_mm"), F.col("size_mm")).alias("mm"))
    styles = [F.bool_or("bold").alias("bold"), F.bool_or("underline").alias("underline"), F.bool_and("caps").alias("caps"), F.max("mm").alias("mm")]
    per_text = text.groupBy("doc_id", "text_norm").agg(*styles)
    met = hit_texts(need, items).select("doc_id", "variant_norm", "text_norm").distinct()
    per_variant = met.join(per_text, ["doc_id", "text_norm"]).groupBy("doc_id", "variant_norm").agg(*styles, F.lit(True).alias("hit"))
    per_term = need.join(per_variant, ["doc_id", "variant_norm"], "left").groupBy("doc_id", "row_id", "term_no").agg(*styles, F.bool_or("hit").alias("hit"))
    seen = per_term.join(checklist.select("row_id", F.lower(F.coalesce("specification", F.lit(""))).alias("spec"), threshold.alias("least_mm")), "row_id")
    yes = lambda c: F.coalesce(c, F.lit(False))
    spec, wants_none = F.col("spec"), F.col("spec").contains("no underline")
    style = [
        F.when(spec.contains("bold") & ~yes("bold"), F.lit("Not Bold")),
        F.when(wants_none & yes("underline"), F.lit("Underline must be absent")),
        F.when(spec.contains("underline") & ~wants_none & ~yes("underline"), F.lit("Underline Missing")),
        F.when(spec.contains("all caps") & ~yes("caps"), F.lit("Not All Caps")),
        F.when(F.col("mm") < F.col("least_mm"), F.lit("Font too small")),
    ]
    told = [F.when(~yes("hit"), F.lit("Not found on artwork pages")), *style, F.when(F.col("least_mm").isNotNull() & F.col("mm").isNull(), F.lit("No measurable text for font size"))]
    failed = F.size(F.array_compact(F.array(*style))) > 0
    return seen.select("doc_id", "row_id", "term_no", yes("hit").alias("found"), (~failed).alias("match"), F.array_join(F.array_compact(F.array(*told)), "; ").alias("notes"))


def salvaged(items: DataFrame) -> DataFrame:
    """doc_id, page_no, item_id of the first bold item of each page, or the first line in capitals of 1.2 mm or more."""
    mm = F.when(~F.isnan("size_mm"), F.col("size_mm"))
    good = F.coalesce("bold", F.lit(False)) | ((F.coalesce("level", F.lit("")) == "line") & tx.all_caps(F.col("text")) & (F.coalesce(mm, F.lit(0.0)) >= 1.2))
    return items.where(good).groupBy("doc_id", "page_no").agg(F.min_by("item_id", F.struct("item_no", "item_id")).alias("item_id"))


def _flat(text: Column) -> Column:
    """Blanks and hyphens as one blank."""
    return F.trim(F.regexp_replace(text, r"[\s\-]+", " "))


def _most(size: Column) -> Column:
    """Most characters that a text of a ratio of LEAST_RATIO to one of so many can have."""
    return F.floor(size * (2 - LEAST_RATIO) / LEAST_RATIO + 1e-9).cast("int")


def _unmatched(la: Column, lb: Column) -> Column:
    return F.floor((1 - LEAST_RATIO) * (la + lb) + 1e-9).cast("int")


def _near_keys(v: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (a; b, size) with a row for each key by which a text b can meet a nearly equal a.

    b is parted into one piece more than characters may be unmatched.  Going through the pieces, there is a first one, i, up to whose
    end no more than i characters are unmatched; it stands whole in a, moved by no more than i places, and by no more than
    the rest counted from the end.
    """
    pieces = lambda size: _unmatched(_most(size), size) + 1
    start = lambda i, size: F.floor(i * size / pieces(size)).cast("int")
    piece = lambda text, i, size, moved: F.xxhash64(size, i, F.substr(text, start(i, size) + moved + 1, start(i + 1, size) - start(i, size)))

    def of_piece(size: Column, i: Column) -> Column:
        rest = pieces(size) - 1 - i
        low, high = F.greatest(-i, F.length("a") - size - rest), F.least(i, F.length("a") - size + rest)
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda moved: piece(F.col("a"), i, size, moved))).otherwise(F.array().cast("array<bigint>"))

    sizes = F.filter(F.sequence(F.ceil(F.length("a") * LEAST_RATIO / (2 - LEAST_RATIO) - 1e-9).cast("int"), _most(F.length("a"))), lambda size: _unmatched(F.length("a"), size) > 0)
    keys = F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(F.sequence(F.lit(0), pieces(size) - 1), lambda i: of_piece(size, i)))))
    return v.withColumn("key", F.explode(F.array_distinct(keys))), t.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), pieces(F.col("size")) - 1), lambda i: piece(F.col("b"), i, F.col("size"), F.lit(0)))))


def nearly_equal(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted, text columns, ratio: risky variants and texts (recognized ones only for variants of six characters at most) of a
    ratio of LEAST_RATIO or more, equal ones among them.

    With la and lb characters a ratio of r leaves at most (1 - r) (la + lb) characters unmatched, which bounds the lengths, the
    pieces that stand whole in both (the join key in documents of MANY pairs, up to LONG characters; else the length) and the edits (checked by a
    bounded edit distance); none loses a pair.  Each text of a document is compared once, whatever its pages.
    """
    kept, shown = wanted.columns, [c for c in texts.columns if c != "doc_id"]
    v = wanted.where(tx.risky(F.col("variant_norm"))).withColumn("a", _flat(F.col("variant_norm"))).where("a != ''")
    v = spread(cut_lineage(v))  # four uses
    t = texts.withColumn("b", _flat(F.col("text_norm")))
    allowed = (F.col("source") != "ocr") | (F.length("variant_norm") <= 6)
    equal = v.join(t, (v["doc_id"] == t["doc_id"]) & (v["a"] == t["b"])).where(allowed).select(*[v[c] for c in kept], *shown, F.lit(1.0).alias("ratio"))
    # A variant of 7 characters or more meets no recognized text, one of fewer only its equal.
    va = v.select("doc_id", "a").distinct()
    tb = t.where("source != 'ocr'").select("doc_id", "b").distinct().withColumn("size", F.length("b"))
    tb = tb.where(_unmatched(_most(F.col("size")), F.col("size")) > 0)
    n = va.groupBy("doc_id").agg(F.count("*").alias("n")).join(tb.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id")
    many = cut_lineage(n.select("doc_id", (F.col("n") * F.col("m") > MANY).alias("many")))
    va, tb = spread(cut_lineage(va.join(many, "doc_id"))), spread(cut_lineage(tb.join(many, "doc_id")))
    on_pieces = F.col("many") & (F.length("a") <= LONG)
    short_v, short_t = _near_keys(va.where(on_pieces), tb.where(F.col("many") & (F.col("size") <= _most(F.lit(LONG)))))
    least = F.ceil(F.length("a") * LEAST_RATIO / (2 - LEAST_RATIO) - 1e-9).cast("int")
    long_v = va.where(~on_pieces).withColumn("size", F.explode(F.sequence(least, _most(F.length("a")))))
    unmatched = _unmatched(F.length("a"), F.col("size"))
    near = (F.col("a") != F.col("b")) & (unmatched > 0) & (F.abs(F.length("a") - F.col("size")) <= unmatched) & (F.call_function("levenshtein", "a", "b", unmatched) >= 0)
    pairs = short_v.join(short_t, ["doc_id", "key"]).where(near).select("doc_id", "a", "b").unionByName(long_v.join(tb, ["doc_id", "size"]).where(near).select("doc_id", "a", "b")).distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for batch in batches:
            keep, ratios = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if (r := SequenceMatcher(None, a, b).ratio()) >= LEAST_RATIO:
                    keep.append(i), ratios.append(round(r, 6))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)), pa.array(ratios, pa.float64())], names=["doc_id", "a", "b", "ratio"])

    scored = pairs.mapInArrow(score, "doc_id string, a string, b string, ratio double")
    other = v.join(scored, ["doc_id", "a"]).join(t, ["doc_id", "b"]).where(allowed).select(*kept, *shown, "ratio")
    return equal.unionByName(other)


def fuzzy(need: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, variant_norm, text_norm, ratio: nearly equal texts of risky variants that are not equal."""
    texts = distinct_texts(items).select("doc_id", "text_norm", "source").distinct()
    pairs = nearly_equal(need.select("doc_id", "variant_norm").distinct(), texts)
    return pairs.where(_flat(F.col("variant_norm")) != _flat(F.col("text_norm"))).select("doc_id", "variant_norm", "text_norm", "ratio").distinct()
