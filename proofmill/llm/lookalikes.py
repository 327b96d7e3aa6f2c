"""Text that looks the same in different characters, brought to one form.

Look-alike classes are built by union-find over strings and code points: compatibility forms, composed and decomposed
spellings, invisible characters (one class with the empty string), blanks, hyphens and a table of letters of different
scripts.  Unions are transitive, and every letter with a mark joins the marked letters of its base's class.  Each class
is represented by its member that is most frequent in the texts (ties: the lowest code points).  Texts are rewritten
greedily, longest match first, by a multi-pattern automaton, until nothing changes.

Sizes: classes are made from the distinct characters of the corpus, at most the 1,114,112 code points of Unicode
whatever the number of texts; they are counted distributed and only that count table reaches the driver.

Defined results: null and blank texts have no form (no row); letter case, accents and visible punctuation are kept apart;
runs of blanks count as one and blanks at the ends as none; repeated rows each give their own row; a text that equals
several reference texts in form gives a row for each.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.runtime import spread

#: Letters of other scripts that look like a Latin letter in common fonts.
SAME_LOOK = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "Q": "Ԛ", "W": "Ԝ", "G": "Ԍ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү", "к": "κ", "ι": "ı",
}
#: Armenian, Cherokee and Lisu letters that look like a Latin capital or small letter.
SAME_LOOK_FAR = {
    "A": "Ꭺꓮ", "B": "Ᏼꓐ", "C": "Ꮯꓚ", "D": "Ꭰꓓ", "E": "Ꭼꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "Ꮋꓧ", "I": "ꓲ", "J": "Ꭻꓙ", "K": "Ꮶꓗ", "L": "Ꮮꓡ", "M": "Ꮇꓟ",
    "N": "ꓠ", "O": "Օꓳ", "P": "Ꮲꓑ", "R": "Ꭱꓣ", "S": "ՏꓢᏚ", "T": "Ꭲꓔ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "Ꮃꓪ", "X": "ꓫ", "Y": "Ꭹꓬ", "Z": "Ꮓꓜ",
    "g": "ց", "h": "հ", "n": "ո", "o": "օ", "q": "զ", "u": "ս",
}
#: Marks that look like a hyphen-minus or an apostrophe.
SAME_MARK = {"-": "‐‑‒−﹣－﹘", "'": "ʼ＇ʹ"}
#: Reference texts sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_JOINED_OTHERS = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿͏؜ᅟᅠ឴឵᠎"


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def invisible(c: str) -> bool:
    return c in _JOINED_OTHERS or unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


@cache
def compositions() -> list[tuple[str, str, str]]:
    """(whole, base, mark) of every character that is canonically one character and one mark, by the Unicode data."""
    out = []
    for point in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            base, mark = (chr(int(p, 16)) for p in parts)
            if unicodedata.combining(mark) and unicodedata.normalize("NFC", base + mark) == chr(point):
                out.append((chr(point), base, mark))
    return out


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """string -> representative for every string of a class that is not its own representative."""
    classes, alphabet = Classes(), set(counts)
    letters = {c for c in alphabet if len(c) == 1}
    for table in (SAME_LOOK, SAME_LOOK_FAR, SAME_MARK):
        for latin, others in table.items():
            for c in others:
                classes.union(latin, c)
            letters |= {latin, *others}
    for c in alphabet:
        if invisible(c):
            classes.union("", c)
        elif c.isspace():
            classes.union(" ", c)
        else:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain.strip():
                classes.union(c, plain)
                letters |= set(plain)
            split = unicodedata.normalize("NFKD", c)
            if split not in (c, plain) and split.strip():
                classes.union(c, split)
    # Marked letters: whatever looks like the base looks, with the mark, like the marked letter.  Only the pairs that
    # compose are visited, once each, bases before the letters made from them.
    marks = {m for c in letters for m in unicodedata.normalize("NFD", c) if unicodedata.combining(m)}
    groups = classes.members()
    for whole, base, mark in compositions():
        if mark not in marks or base not in letters:
            continue
        letters.add(whole)
        for other in [base, *groups.get(classes.find(base), ())]:
            if len(other) == 1:
                classes.union(whole, other + mark)
                twin = unicodedata.normalize("NFC", other + mark)
                if twin != whole:
                    classes.union(whole, twin)
    table = {}
    for members in classes.members().values():
        # The empty string and the plain blank stand for their classes whatever their count.
        best = "" if "" in members else " " if " " in members else min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        table |= {m: best for m in members if m != best and m}
    return table


def rewriter(table: dict[str, str]):
    """A function that rewrites a text to its form."""
    import ahocorasick

    singles = str.maketrans({k: v for k, v in table.items() if len(k) == 1})
    automaton = ahocorasick.Automaton()
    for k, v in table.items():
        automaton.add_word(k, (len(k), v))
    automaton.make_automaton()
    several = {c for k in table if len(k) > 1 for c in k[1:]}

    def rewrite(text: str) -> str:
        seen = set()
        while text not in seen:  # until nothing changes
            seen.add(text)
            if several.isdisjoint(text):
                new = text.translate(singles)
            else:
                parts, at = [], 0
                for end, (size, v) in automaton.iter_long(text):
                    parts += (text[at : end - size + 1], v)
                    at = end + 1
                new = "".join(parts) + text[at:]
            text = new
        return " ".join(text.split())

    return rewrite


def character_counts(texts: DataFrame, text: str) -> DataFrame:
    """c, n: how often each character stands in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(t or "")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(count, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))


def canonical(texts: DataFrame, key: list[str], text: str, table: dict[str, str]) -> DataFrame:
    """key, text, form."""
    fields = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(table)
        known: dict[str, str] = {}
        for batch in batches:
            forms = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                form = known.get(t)
                if form is None:
                    if len(known) > 20_000 or len(t) > 10_000:
                        known.clear()
                    form = known[t] = rewrite(t)
                forms.append(form)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*key, "text", "form"])

    rows = texts.select(*key, F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(run, f"{fields}, text string, form string").where("form != ''")


def same_look(texts: DataFrame, key: list[str], text: str, reference: DataFrame, ref_key: str, ref_text: str) -> DataFrame:
    """key, text, ref_key: texts that look like a reference text but are another sequence of characters."""
    texts = spread(texts.select(*key, F.col(text).cast("string").alias("text")))
    both = texts.select("text").unionByName(reference.select(F.col(ref_text).cast("string").alias("text")))
    counts = {r["c"]: r["n"] for r in character_counts(both, "text").collect()}  # bounded: one row per code point
    table = rewriting(counts)
    wanted = canonical(reference.select(ref_key, F.col(ref_text).alias("ref")), [ref_key], "ref", table).withColumnRenamed("text", "ref")
    if reference.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a checked size: texts then stay where they are
        wanted = F.broadcast(wanted)
    found = canonical(texts, key, "text", table).join(wanted, "form")
    return found.where(F.col("text") != F.col("ref")).select(*key, "text", ref_key)
