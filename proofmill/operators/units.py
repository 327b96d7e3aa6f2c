"""Quantities recorded in different units, brought to micrometres.

A multi-pattern automaton finds unit names in the text, the longest match next to a number is taken, the field decides
what an absent or unclear unit means, and the factors are joined from a fixed table of a few dozen rows (its size is
known, so it is broadcast).  All arithmetic is on exact integers, so no rounding happens before the last step.

Numbers may be whole, decimal (point or comma), grouped by thousands (blank, apostrophe, point or comma), fractions a/b or
single fraction signs, alone or after a whole number.  One group of three digits behind a point or comma is read as decimals.

Defined results: a null, blank or number-less text states no quantity (no row); a size of 10^18 units or more, or one whose
micrometres do not fit 64 bits, is no height (no row), nor is a number written in more than 4,000 characters; decimals count to
17 places; repeated rows each give their own row; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.runtime import cut_lineage, spread

#: One micrometre count per unit as numerator / denominator (1 in = 72 pt = 6 pica = 1000 mil = 25.4 mm).
FACTORS = {
    "um": (1, 1),
    "mm": (1000, 1),
    "cm": (10000, 1),
    "in": (25400, 1),
    "pt": (25400, 72),
    "pica": (25400, 6),
    "mil": (254, 10),
    "dm": (100000, 1),
    "m": (1000000, 1),
    "ft": (304800, 1),
    "q": (250, 1),
    "didot": (376065, 1000),
    "cicero": (4512780, 1000),
}
#: The names each unit goes by, in lower case.
ALIASES = {
    "um": ["um", "um.", "µm", "μm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"],
    "mm": ["mm", "mm.", "millimetre", "millimetres", "millimeter", "millimeters", "мм"],
    "cm": ["cm", "cm.", "centimetre", "centimetres", "centimeter", "centimeters", "см"],
    "in": ["in", "in.", "inch", "inches", '"', "″", "”", "''", "zoll"],
    "pt": ["pt", "pt.", "pts", "point", "points"],
    "pica": ["pc", "pc.", "pica", "picas"],
    "mil": ["mil", "mils", "thou"],
    "dm": ["dm", "decimetre", "decimetres", "decimeter", "decimeters"],
    "m": ["m", "metre", "metres", "meter", "meters"],
    "ft": ["ft", "ft.", "foot", "feet", "′"],
    "q": ["q"],
    "didot": ["dd", "didot", "didots"],
    "cicero": ["cicero", "ciceros"],
}
_FRACTIONS = "".join(c for c in map(chr, range(0xBC, 0x218A)) if "VULGAR FRACTION" in unicodedata.name(c, "") and 0 < unicodedata.numeric(c, 0) < 1)
_THIN = "    "
_NUMBER = re.compile(
    rf"(?<![\w.,])(?:(?P<whole>\d+)[{_THIN}]+)?(?P<top>\d+)\s*[/⁄]\s*(?P<bottom>\d+)(?![\d/])"
    rf"|(?<![\w.,])(?P<ones>\d*)[{_THIN}]?(?P<sign>[{_FRACTIONS}])"
    rf"|(?<![\w.,])(?P<spaced>\d{{1,3}}(?:[{_THIN}'’]\d{{3}})+(?:[.,]\d+)?)(?![\d])"
    r"|(?<![\w.,])(?P<grouped>\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:\.\d{3}){2,}|\d{1,3}(?:,\d{3}){2,})(?![\d.,]\d|\d)"
    r"|(?P<plain>\d+(?:[.,]\d+)?|[.,]\d+)"
)
_GAP = re.compile(rf"[\s{_THIN}-]*")
#: Words before a number that make it a reference, not a height, in the eight languages of the texts.
_REFERENCE = re.compile(
    r"(?:clause|drawing|class|sheet|no\.?|page|item|fig\.?|figure|section|step|week|rev\.?|type|lot|panel|zeichnung|klasse|blatt|seite|abb\.?|abschnitt|dessin|classe|feuille|étape|"
    r"plano|clase|hoja|página|sección|disegno|foglio|pagina|sezione|tekening|blad|stap|rysunek|klasa|strona|krok|nr\.?|чертеж|класс|лист|рис\.?|стр\.?)\s*[\d/-]*\s*$"
)
#: Signs and words that make a number without a unit a height, in the same languages.
_HEIGHT = re.compile(
    r"[≥>≧]=?|\b(?:min(?:imum)?|mind(?:estens)?|at least|not (?:under|below)|no less than|from|height|höhe|hauteur|au moins|altura|al menos|mínim[oa]|altezza|almeno|minim[oa]|"
    r"hoogte|minstens|minimaal|wysokość|co najmniej|высота|не менее)\b"
)
#: Units of a size and places of a decimal lie below this, so that all products fit the exact arithmetic.
_LIMIT, _LONGEST = 10**18, 4000
#: Usual units (one per extractor and level) sent to every executor; more are joined by a shuffle.
USUAL_ROWS = 100_000


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for name in names:
            a.add_word(name, (len(name), unit))
    a.make_automaton()
    return a


def read_quantity(text: str | None, automaton, heights_only: bool = False) -> tuple[int, int, str | None] | None:
    """(numerator, denominator, unit or None) of the quantity that a text states, or None.

    The first number with a unit beside it wins; else, with heights_only, the first number that a height word or sign
    of comparison introduces (or that is the whole text); without heights_only the first number at all.
    """
    if not text:
        return None
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case, which would shift places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    names: dict[int, tuple[int, str]] = {}
    for end, (size, unit) in automaton.iter(low):
        start = end - size + 1
        after = low[end + 1 : end + 2]
        if low[end].isalpha() and after.isalpha():
            continue
        if start not in names or names[start][0] < size:
            names[start] = (size, unit)
    bare = None
    for m in _NUMBER.finditer(low):
        value = _value(low, m)
        if value is None:
            continue
        n, d = value
        at = _GAP.match(low, m.end()).end()
        if at in names and not (at > m.end() and names[at][1] == "in" and low[at] == '"' and low.count('"') % 2 == 0 and '"' in low[: m.start()]):
            return n, d, names[at][1]
        if bare is None and not (heights_only and not _bare_height(low, m)):
            bare = n, d, None
    return bare


def _decimal(digits: str) -> tuple[int, int]:
    left, _, right = digits.replace(",", ".").partition(".")
    return int((left or "0") + right), 10 ** len(right)


def _value(low: str, m: re.Match) -> tuple[int, int] | None:
    """Numerator and denominator of a number as written; None for one that no height has."""
    if len(m[0]) > _LONGEST:
        return None
    if m["plain"] is not None:
        n, d = _decimal(m["plain"])
    elif m["spaced"] is not None:
        # Digits after "clause 4" and the like belong to the reference; what follows is a number of its own.
        parts = re.split(rf"[{_THIN}'’]", m["spaced"])
        n, d = _decimal(parts[-1] if _REFERENCE.search(low[: m.start()]) else "".join(parts))
    elif m["grouped"] is not None:
        last = max(m["grouped"].rfind("."), m["grouped"].rfind(","))
        ends = m["grouped"][last] not in m["grouped"][:last]  # a mark used once, behind another one, starts the decimals
        left, right = (m["grouped"][:last], m["grouped"][last + 1 :]) if ends else (m["grouped"], "")
        n, d = _decimal(re.sub("[.,]", "", left) + "." + right)
    elif m["sign"] is not None:
        part = Fraction(unicodedata.numeric(m["sign"])).limit_denominator(1000) + int(m["ones"] or 0)
        n, d = part.numerator, part.denominator
    else:
        d = int(m["bottom"])
        if not d:
            return None
        n = int(m["whole"] or 0) * d + int(m["top"])
    if n >= _LIMIT or d >= _LIMIT:
        shared = gcd(n, d)
        n, d = n // shared, d // shared
        if d >= _LIMIT:
            n, d = n * 10**17 // d, 10**17
    return None if n >= _LIMIT else (n, d)


def _bare_height(low: str, m: re.Match) -> bool:
    before, after = low[: m.start()], low[m.end() :]
    if m["plain"] is None and m["spaced"] is None and m["grouped"] is None or _REFERENCE.search(before) or after[:1].isalpha() or re.match(r"\s*[/x×]\s*\d|-\d", after) or re.search(r"\d\s*[/x×-]\s*$", before):
        return False
    return not (before.strip() or after.strip()) or bool(_HEIGHT.search(before)) or bool(re.match(r"\s*(?:minimum|or more)", after))


def quantities(df: DataFrame, keep: list[str], text: str, heights_only: bool = False) -> DataFrame:
    """keep, num, den, unit of every row whose text states a quantity (unit null where the text names none)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        known: dict[str, tuple | None] = {}
        for batch in batches:
            at, nums, dens, units = [], [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                if t not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[t] = read_quantity(t, automaton, heights_only)
                if q := known[t]:
                    at.append(i), nums.append(q[0]), dens.append(q[1]), units.append(q[2])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(nums, pa.int64()), pa.array(dens, pa.int64()), pa.array(units, pa.string())], names=[*keep, "num", "den", "unit"])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    stated = F.col("__text").rlike(f"[0-9{_FRACTIONS}]")
    return df.select(*keep, F.col(text).cast("string").alias("__text")).where(stated).mapInArrow(parse, f"{fields}, num bigint, den bigint, unit string")


def unit_names(spark: SparkSession) -> DataFrame:
    """alias -> unit; a fixed table of some 60 rows."""
    return spark.createDataFrame([(a, u) for u, names in ALIASES.items() for a in names], "alias string, named_unit string")


def factors(spark: SparkSession) -> DataFrame:
    """unit -> micrometres as f_num / f_den; a row per unit."""
    return spark.createDataFrame([(u, n, d) for u, (n, d) in FACTORS.items()], "unit string, f_num bigint, f_den bigint")


def micrometres(num: str = "num", den: str = "den", f_num: str = "f_num", f_den: str = "f_den") -> tuple[Column, Column]:
    """(rounded, exact as double).  Halves go to the even neighbour."""
    top = (F.col(num).cast("decimal(38,0)") * F.col(f_num)).cast("decimal(38,0)")
    bottom = (F.col(den).cast("decimal(38,0)") * F.col(f_den)).cast("decimal(38,0)")
    rest = top % bottom
    whole = ((top - rest) / bottom).cast("decimal(38,0)")
    up = (rest * 2 > bottom) | ((rest * 2 == bottom) & (whole % 2 == 1))
    return whole + up.cast("bigint"), F.col(num).cast("double") * F.col(f_num) / (F.col(den) * F.col(f_den))


def in_micrometres(sized: DataFrame) -> DataFrame:
    """sized, size_um: the factors joined by unit; sizes whose micrometres do not fit 64 bits are left out."""
    um, _ = micrometres()
    joined = sized.join(F.broadcast(factors(sized.sparkSession)), "unit")  # a row per unit
    return joined.withColumn("size_um", um.try_cast("bigint")).where("size_um is not null")


def item_sizes(items: DataFrame) -> DataFrame:
    """item_id, size_mm, num, den, unit of page items, the unit resolved.

    A unit written in `size` outranks `size_unit`; where neither names one, the unit that most rows of the same
    extractor and level name holds (ties: the alphabetically first).  Rows for which nothing names a unit are left out.
    Sizes are parsed once and written out, as they are counted before they are completed.
    """
    keep = ["item_id", "size_unit", "size_mm", "extractor", "level"]
    read = quantities(spread(items.select(*keep, "size").where(F.col("size").isNotNull())), keep, "size")
    alias = F.lower(F.trim("size_unit"))
    named = read.join(F.broadcast(unit_names(items.sparkSession)), alias == F.col("alias"), "left")
    named = cut_lineage(named.select("item_id", "size_mm", "extractor", "level", "num", "den", F.coalesce("unit", "named_unit").alias("unit")))
    counted = named.where(F.col("unit").isNotNull()).groupBy("extractor", "level", "unit").count()
    usual = counted.groupBy(F.col("extractor").alias("x"), F.col("level").alias("l")).agg(F.min_by("unit", F.struct(-F.col("count"), F.col("unit"))).alias("usual"))
    if usual.limit(USUAL_ROWS + 1).count() <= USUAL_ROWS:  # a checked size; otherwise the join shuffles
        usual = F.broadcast(usual)
    same = F.col("extractor").eqNullSafe(F.col("x")) & F.col("level").eqNullSafe(F.col("l"))
    resolved = named.join(usual, same, "left").withColumn("unit", F.coalesce("unit", "usual"))
    return resolved.where("unit is not null").select("item_id", "size_mm", "num", "den", "unit")


def wrong_sizes(items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """row_id, size_um of items whose size_mm is null (or not a number) or further than the tolerance from `size`."""
    _, exact = micrometres()
    told = F.col("size_mm") * 1000
    off = F.col("size_mm").isNull() | F.isnan("size_mm") | (F.abs(told - exact) > exact * tolerance)
    return in_micrometres(item_sizes(items)).where(off).select(F.col("item_id").alias("row_id"), "size_um")


def stated_heights(checklist: DataFrame) -> DataFrame:
    """row_id, size_um of checklist rows whose specification states a height; no unit means millimetres."""
    read = quantities(spread(checklist.select("row_id", "specification")), ["row_id"], "specification", heights_only=True)
    return in_micrometres(read.withColumn("unit", F.coalesce("unit", F.lit("mm")))).select("row_id", "size_um")


def common_unit(items: DataFrame, checklist: DataFrame) -> DataFrame:
    """table_name, row_id, size_um: both kinds of cases together."""
    return (
        wrong_sizes(items).select(F.lit("page_items").alias("table_name"), "row_id", "size_um")
        .unionByName(stated_heights(checklist).select(F.lit("checklist").alias("table_name"), "row_id", "size_um"))
    )
