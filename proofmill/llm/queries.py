"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.llm import language, leakage, lookalikes, mixing, truncation
from proofmill.runtime import spread, table


def p3_found(spark, d):
    lines = table(spark, d, "page_items").select(F.lit("page_items").alias("table_name"), F.col("item_id").alias("row_id"), "text")
    cells = table(spark, d, "checklist").select(F.lit("checklist").alias("table_name"), "row_id", F.col("symbol_exact_wording").alias("text"))
    found = lookalikes.same_look(lines.unionByName(cells), ["table_name", "row_id"], "text", table(spark, d, "wording_ref"), "wording_id", "text")
    return found.select("table_name", "row_id", "wording_id")


#: Blanks that part words, other than the ASCII ones.
_BLANKS = "[\\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_WORD = _BLANKS.replace("[", "[^", 1)


def _segments(spark, d):
    docs = spread(table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text"))
    lines = table(spark, d, "page_items").where(F.col("level") == "line").select(F.lit("page_items").alias("table_name"), F.col("item_id").alias("row_id"), F.col("lang").alias("label"), "text")
    lines = spread(lines.where(F.col("text").rlike(f"^{_BLANKS}*+(?:{_WORD}++{_BLANKS}++){{5}}{_WORD}")))  # six words or more
    model = language.train(table(spark, d, "documents"), "doc_id", "text", "lang")
    return language.label_segments(docs.unionByName(lines), ["table_name", "row_id", "label"], "text", model)


def p4_found(spark, d):
    return language.mislabelled(_segments(spark, d), "label").select("table_name", "row_id", "segment_no", "lang")


def p4_segments(spark, d):
    """The language and confidence of every text and stretch."""
    return _segments(spark, d).select("table_name", "row_id", "segment_no", "lang", F.round("confidence", 4).alias("confidence"), "n_words")


def _leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p6_found(spark, d):
    return _leaks(spark, d).where("passage_no = 1").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_passages(spark, d):
    """Where in the original text the passages stand."""
    return _leaks(spark, d).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p7_selected(spark, d):
    """The chosen documents with their repeats."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    return mixing.shares(p7_selected(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return truncation.cut_texts(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p8_source_shares(spark, d):
    return truncation.cut_shares(table(spark, d, "documents"), "doc_id", "text", "source")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_segments": p4_segments, "p6_found": p6_found, "p6_passages": p6_passages, "p7_selected": p7_selected, "p7_shares": p7_shares, "p8_found": p8_found, "p8_source_shares": p8_source_shares}
_WINDOWS = """SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (
  SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL)"""
SQL: dict[str, str] = {
    "p6_found": f"SELECT DISTINCT d.doc_id, e.item_id FROM ({_WINDOWS.format(key='doc_id', table='documents')}) d JOIN ({_WINDOWS.format(key='item_id', table='eval_items')}) e USING (g)",
}
