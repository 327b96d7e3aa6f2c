"""Evaluation texts that leak into training text.

All windows of n consecutive words of the evaluation items go into one Aho-Corasick automaton over word numbers; every
document is scanned once, and each window found is mapped back to its place in the original text.  Words are runs of
letters and digits (with the marks that belong to them) found in the original text and compared in compatibility form,
letter case folded and invisible characters removed, so case, punctuation, white space and the spelling of accents do
not matter, and places never shift.

Sizes: an evaluation set of at most AUTOMATON_WORDS words (a checked bound) is one automaton, built once and broadcast.  A
larger set never reaches the driver: the windows of both sides are joined by hash, each item window once, and hits are
compared word for word; a window that many documents hold is split by the join as the rows of its documents lie apart.

Defined results: null and blank documents and items hold nothing; an item of fewer than n words cannot leak; repeated
documents and items each give their own rows; passages of one item in a document that do not touch are told apart.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofmill.runtime import cut_lineage, spread

AUTOMATON_WORDS = 1_000_000
_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿­​-‍⁠︀-️﻿"
_WORD = re.compile(rf"[^\W_][^\W_{_MARKS}]*(?:[{_MARKS}]+[^\W_{_MARKS}]*)*")
_PLAIN = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‍⁠︀-️﻿]")


def word_form(word: str) -> str:
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", word)).casefold()


def words_of(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return [w.lower() if w.isascii() else word_form(w) for w in _WORD.findall(text)]


def places_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in (_PLAIN if text.isascii() else _WORD).finditer(text)]


def automaton_of(items: list[tuple], n: int):
    """The automaton over word numbers (None without a window), the numbers, and the items of each window."""
    import ahocorasick

    numbers: dict[str, int] = {}
    windows: dict[tuple, list] = {}
    for key, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        for i in range(len(ids) - n + 1):
            holders = windows.setdefault(tuple(ids[i : i + n]), [])
            if not holders or holders[-1] != key:
                holders.append(key)
    if not windows:
        return None, numbers
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, holders in windows.items():
        a.add_word(window, holders)
    a.make_automaton()
    return a, numbers


def passages(ends: list[int], n: int) -> list[tuple[int, int, int]]:
    """(first word, last word, windows) of each run of windows that overlap, from the places of their last words in order."""
    out: list[tuple[int, int, int]] = []
    for end in ends:
        first = end - n + 1
        if out and first <= out[-1][1] + 1:
            a, b, k = out[-1]
            out[-1] = (a, max(b, end), k + 1)
        else:
            out.append((first, end, 1))
    return out


_RESULT = [("passage_no", "int"), ("n_windows", "bigint"), ("start", "bigint"), ("end", "bigint"), ("passage", "string")]


def _rows(text: str, found: list[tuple[int, int, int]]) -> list[tuple]:
    at = places_of(text)
    return [(i, k, at[a][0], at[b][1], text[at[a][0] : at[b][1]]) for i, (a, b, k) in enumerate(found, 1)]


def _batch(rows: list[tuple], doc_type: pa.DataType, item_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    types = [doc_type, item_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), ty) for x, ty in zip(cols, types)], names=["doc", "item", *(k for k, _ in _RESULT)])


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 12) -> DataFrame:
    """doc, item, passage_no, n_windows, start, end, passage: the passages of n words or more that documents share with items.

    start and end are characters of the original text; passage_no counts the passages of an item in a document from 1.
    """
    docs = spread(docs.select(key, F.col(text).cast("string").alias("text")).where(F.col(text).isNotNull()))
    items = items.select(item_key, F.col(item_text).cast("string").alias("text")).where(F.col(item_text).isNotNull())
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {doc_kind}, item {item_kind}, " + ", ".join(f"{k} {v}" for k, v in _RESULT)
    # Blanks part words, so characters / 2 bounds the words.
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) / 2 > AUTOMATON_WORDS:
        return _by_hash(docs, items, n, schema)
    item_type = to_arrow_type(items.schema[0].dataType)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(automaton_of([tuple(r) for r in items.collect()], n)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, numbers = pickle.loads(model.value)
        number = numbers.get
        for batch in batches:
            rows: list[tuple] = []
            if automaton is not None:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits: dict = {}
                    for end, holders in automaton.iter(tuple([number(w, 0) for w in words_of(t)])):
                        for item in holders:
                            hits.setdefault(item, []).append(end)
                    for item, ends in hits.items():
                        rows += [(k, item, *x) for x in _rows(t, passages(ends, n))]
            yield _batch(rows, batch.schema[0].type, item_type)

    return docs.mapInArrow(scan, schema)


def _windows(df: DataFrame, n: int) -> DataFrame:
    """id, at (place of the last word), window (hash): every window of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            take, ats, hashes = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                for i in range(len(words) - n + 1):
                    take.append(row), ats.append(i + n - 1)
                    hashes.append(xxhash.xxh3_64_intdigest("\0".join(words[i : i + n])) - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(ats, pa.int32()), pa.array(hashes, pa.int64())], names=["id", "at", "window"])

    return df.mapInArrow(run, f"id {df.dtypes[0][1]}, at int, window bigint")


def _by_hash(docs: DataFrame, items: DataFrame, n: int, schema: str) -> DataFrame:
    """leaks() of an evaluation set of any size: windows joined by hash, then the joined texts compared word for word."""
    held = _windows(items, n).select(F.col("id").alias("item"), "window").distinct()
    hits = _windows(docs, n).withColumnRenamed("id", "doc").join(held, "window")
    pairs = cut_lineage(hits.groupBy("doc", "item").agg(F.array_sort(F.collect_set("at")).alias("ends")))
    doc_name, item_name = docs.columns[0], items.columns[0]
    texts = docs.select(F.col(doc_name).alias("doc"), F.col("text").alias("whole")).groupBy("doc", "whole").agg(F.count("*").alias("copies"))
    wanted = items.select(F.col(item_name).alias("item"), "text").groupBy("item").agg(F.collect_set("text").alias("held"))
    checked = pairs.join(texts, "doc").join(wanted, "item").select("doc", "item", "ends", "whole", "held", "copies")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, item, ends, whole, texts_, copies in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(whole)
                known = {tuple(own[i : i + n]) for own in map(words_of, texts_) for i in range(len(own) - n + 1)}
                true = [e for e in ends if e < len(words) and tuple(words[e - n + 1 : e + 1]) in known]
                rows += [(doc, item, *x) for x in _rows(whole, passages(true, n))] * copies
            yield _batch(rows, batch.schema[0].type, batch.schema[1].type)

    return checked.mapInArrow(verify, schema)
