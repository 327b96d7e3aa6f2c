"""Text functions as Column expressions: folding, blanks, capitals, fragments.  A null text folds to the empty string."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds for Java and RE2 patterns.
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


@cache
def fold_tables() -> tuple[str, str, dict[str, str], str]:
    """(from, to) of one-to-one compatibility folding without marks, the longer foldings, and the class of all marks.

    Made by rule from the Unicode data for the Basic Multilingual Plane (without Hangul and CJK compatibility signs).
    """
    source, target, longer, marks = [], [], {}, []
    for point in range(0xA0, 0xFFFF):
        if 0xAC00 <= point <= 0xDFFF or 0x3200 <= point <= 0x33FF or 0xF900 <= point <= 0xFAD9 or 0xFB50 <= point <= 0xFDFF:
            continue
        c = chr(point)
        if unicodedata.combining(c):
            marks.append(point)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) == 1:
            source.append(c), target.append(plain)
        elif c in "ĳĲŉǆǅǄǉǈǇǌǋǊ…‥™№℡½¼¾⅓⅔ﬀﬁﬂﬃﬄﬅﬆำຳ":
            longer[c] = plain
    ranges, start = [], None
    for a, b in zip(marks, [*marks[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(rf"\x{{{start:x}}}-\x{{{a:x}}}")
            start = None
    return "".join(source), "".join(target), longer, "[" + "".join(ranges) + "]"


#: Signs folded besides their compatibility forms.
SIGNS = {"➕": "+", "‐": "-", "–": "-", "—": "-"}


def strip_marks(text: Column) -> Column:
    """Compatibility forms folded and marks removed; only texts that need a step take it."""
    source, target, longer, marks = fold_tables()
    plain = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(F.translate(plain, source, target), rf"(?=\p{{M}}){marks}", "")
    spelled = out
    for c, long in longer.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(long))
    out = F.when(out.rlike(f"[{''.join(longer)}]"), spelled).otherwise(out)
    return F.when(plain.rlike(r"[^\x{0}-\x{7f}]"), out).otherwise(plain)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def strip(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def normalize(text: Column) -> Column:
    """Compatibility form without marks, plain hyphens, lower case (one form of sigma), single blanks."""
    return squeeze(F.translate(F.lower(F.translate(strip_marks(text), "".join(SIGNS), "".join(SIGNS.values()))), "ς", "σ"))


#: Quotes and separators folded by the looser comparison.
LOOSE = {"＋": "+", "・": "•", "／": "/", "‚": ",", "‐": "-", "–": "-", "—": "-", "“": '"', "”": '"', "’": "'", "´": "'", "`": "'"}


def latin_fold(text: Column) -> Column:
    """normalize(), with quotes unified and separators read as blanks."""
    plain = F.lower(strip_marks(F.translate(F.coalesce(text, F.lit("")), "".join(LOOSE), "".join(LOOSE.values()))))
    return squeeze(F.regexp_replace(plain, r"[ \t\x{a0}./\\|•·;,:\-]+", " "))


def all_caps(text: Column) -> Column:
    """At least one letter, and none that has a capital of its own."""
    return F.coalesce(text.rlike(r"\p{L}") & ~text.rlike(r"[\p{Ll}\p{Lt}]"), F.lit(False))


def risky(text: Column) -> Column:
    """A term too short or too full of signs for a plain search to be sure."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(rf"[^\p{{L}}\p{{N}}\s\p{{Z}}]") | (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) <= 3)


def dashify(text: Column) -> Column:
    """Blank in any of its spellings becomes a dash."""
    t = F.trim(text)
    return F.when(text.isNull() | t.rlike(r"(?i)^(?:none|nan|null|[-–—=\s]*)$"), "-").otherwise(t)


def underlined(html: Column) -> Column:
    """Texts of the <u> parts, tags inside removed, blank ones dropped."""
    parts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<u>(.*?)</u>"), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "<[^>]+>", ""))), lambda p: p != "")


def tokens_upper(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9_]+"), lambda t: t != ""))


def linkify(text: Column) -> Column:
    """Web addresses as anchors; www. gets http://."""
    web = F.regexp_replace(text, r"(?i)(^|[^/\w])(www\.[^\s<>\"]+)", '$1<a href="http://$2">$2</a>')
    return F.regexp_replace(web, r"(?i)(^|[^\"\w>/])(https?://[^\s<>\"]+)", '$1<a href="$2">$2</a>')
