"""Several values packed in one field, split into one value per row with its place kept.

Every distinct cell is parsed under every dialect that applies to it (delimiter families, with or without quoting or
numbering, or "one value").  A parse costs the code lengths of its values plus a few bits for the dialect; the cheapest
parse is the cell's.  Code lengths are learned over all cells of a field: a value that stands in other distinct cells too
costs -log2 of its share of them, any other value is spelled out, delimiter marks being dear characters.

Sizes: rows of equal cells are parsed once; the joins on cell and on value have one row per key on one side, so the other,
which may hold a hot key, is split by the adaptive skew join.  Page ranges are expanded in runs of CHUNK pages, so no array
grows with a range.

Defined results: null and blank cells, and cells of one value, give no row; empty places are no values but the places
that follow are counted on without them; repeated rows each give their own values; texts of any length are parsed whole;
ties between dialects go to the one with fewer values, then to the alphabetically first.  A page number has at most nine
digits; a cell of which a piece is no page under any dialect is no list of pages.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.runtime import cut_lineage

#: Delimiter families.  An entity's closing mark (as in "&amp;") and a slash inside a word are no delimiters.
FAMILIES = {
    "line": r"\r\n|\r|\n",
    "tab": r"\t",
    "semicolon": r"(?<!&amp)(?<!&lt)(?<!&gt)(?<!&quot)(?<!&apos)(?<!&nbsp)(?<!&#\d\d)(?<!&#\d\d\d);|；",
    "pipe": r"[|｜]",
    "break": r"<[bB][rR]\s*/?>",
    "slash": r"(?<=\s)/(?=\s)",
    "bullet": r"[•▪‣●]",
}
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
_BULLET = re.compile(r"^\s*(?:[•▪‣●*–-]\s+|[•▪‣●])")
_NUMBER = re.compile(r"^\s*(?:\((\d{1,3})\)|(\d{1,3})[.)])\s+")
_INLINE = re.compile(r"(?:^|(?<=\s))(?:\((\d{1,3})\)|(\d{1,3})[.)])\s+")
_PLAIN_BITS, _MARK_BITS, _DIALECT_BITS, _NUMBER_BITS = 5.0, 12.0, 3.0, 1.0
#: Pages of a range that are expanded at once.
CHUNK = 10_000


_DELIMITER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in [*FAMILIES.items(), ("comma", ",")]))
_FIRST = re.compile(r"[^\S\r\n\t]*(\S)")


def _tokens(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Texts and the delimiters (family, mark) between them, outside quotations; a quotation opens only at the start or after a delimiter."""
    texts, marks, start, at = [], [], 0, 0
    while True:
        opening = _FIRST.match(text, at)
        if opening and opening[1] in _QUOTES and (end := _quote_end(text, opening.start(1))) > 0:
            at = end
        m = _DELIMITER.search(text, at)
        if m is None:
            texts.append(text[start:])
            return texts, marks
        texts.append(text[start : m.start()])
        marks.append((m.lastgroup, m[0]))
        start = at = m.end()


def _pieces(tokens: tuple[list[str], list[tuple[str, str]]], families: Collection[str]) -> list[str]:
    """The cell split at the marks of the given families; others are text."""
    texts, marks = tokens
    out, piece = [], [texts[0]]
    for (family, mark), text in zip(marks, texts[1:]):
        if family in families:
            out.append("".join(piece))
            piece = [text]
        else:
            piece += (mark, text)
    return [*out, "".join(piece)]


def _quote_end(text: str, at: int) -> int:
    """Place after the quotation that starts at `at`, doubled marks inside skipped; -1 if it never ends."""
    close = _QUOTES[text[at]]
    i = at + 1
    while (i := text.find(close, i)) >= 0:
        if text.startswith(close, i + 1):
            i += 2
            continue
        return i + 1
    return -1


def _clean(piece: str) -> str:
    s = piece.strip()
    if s and s[0] in _QUOTES and _quote_end(s, 0) == len(s):
        close = _QUOTES[s[0]]
        s = s[1:-1].replace(close * 2, close).strip()
    return s


def _strip_marks(pieces: list[str]) -> list[str]:
    """Bullets off every value; numbers off only where they count 1, 2, 3 ... over the values."""
    pieces = [_BULLET.sub("", p) if _BULLET.match(p) else p for p in pieces]
    full = [p for p in pieces if p.strip()]
    marks = [_NUMBER.match(p) for p in full]
    if full and all(marks) and [int(m[1] or m[2]) for m in marks] == list(range(1, len(full) + 1)):
        return [p[m.end() :] for p, m in zip(full, marks)]
    return pieces


def _numbered(text: str) -> list[str] | None:
    """Values of "1. a  2. b" on one line: marks that count up from 1 at the cell's start."""
    cuts, want = [], 1
    for m in _INLINE.finditer(text):
        if int(m[1] or m[2]) == want and (want > 1 or not text[: m.start()].strip()):
            if want > 1 and not re.search(r"\s{2}$|\n\s*$", text[: m.start()]):
                continue
            cuts.append((m.start(), m.end()))
            want += 1
    if len(cuts) < 2:
        return None
    return [text[b : cuts[i + 1][0] if i + 1 < len(cuts) else len(text)] for i, (_, b) in enumerate(cuts)]


def _comma_quoted(tokens: tuple[list[str], list[tuple[str, str]]]) -> list[str] | None:
    """Values of a comma list of which every non-empty value is quoted; commas between unquoted words do not part."""
    pieces = _pieces(tokens, ("comma",))
    full = [p.strip() for p in pieces if p.strip()]
    if len(full) > 1 and all(p[0] in _QUOTES and _quote_end(p, 0) == len(p) for p in full):
        return pieces
    return None


def parses(text: str) -> dict[str, list[str]]:
    """Dialect -> values (two or more) of the cell; "one" -> the cell as a single value."""
    found, tokens = {"one": [_clean(text)]}, _tokens(text)
    if pieces := _comma_quoted(tokens):
        found["comma"] = [v for p in pieces if (v := _clean(p))]
    seen = {family for family, _ in tokens[1]}
    present = [name for name in FAMILIES if name in seen]
    for size in range(1, len(present) + 1):  # a cell may mix families; there are seven at most
        for names in combinations(present, size):
            values = [v for p in _strip_marks(_pieces(tokens, names)) if (v := _clean(p))]
            if len(values) > 1:
                found["+".join(names)] = values
    if pieces := _numbered(text):
        values = [v for p in pieces if (v := _clean(p))]
        if len(values) > 1:
            found["number"] = values
    return found


_MARKS = re.compile(r"[\r\n\t;；|｜•▪‣●]|<[bB][rR]\s*/?>|(?<=\s)/(?=\s)|^\s*(?:\(\d{1,3}\)|\d{1,3}[.)])\s|\s{2,}(?:\(\d{1,3}\)|\d{1,3}[.)])\s")


def _spelled(value: str, quoted: bool) -> float:
    marks = 0 if quoted else len(_MARKS.findall(value))
    return _PLAIN_BITS * (len(value) + 1) + marks * _MARK_BITS


#: Delimiter families of page cells.
PAGE_FAMILIES = {
    "line": r"\r\n|\r|\n", "tab": r"\t", "semicolon": "[;；]", "pipe": "[|｜]", "slash": "/", "comma": "[,，、]", "sign": "[&+＆＋]",
    "word": r"(?<=[\s\d)])(?:and|und|et|y|e|en|i|и|och|og)(?=\s)", "blank": r"[^\S\r\n\t]+",
}
_PAGE_MARK = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PAGE_FAMILIES.items()), re.I)
_PAGE_WORD = r"(?:(?:pages?|pgs?|pp?|seiten?|s|str(?:on[ay]?)?|стр|с|página|páginas|pagina|pagine|pág|pag|blz)\.?\s*)?"
_TO = r"(?:[-‐‑‒–—−]|to|bis|through|à|a|al|t/m|tot|do|до|по)"
_PAGE = re.compile(rf"\s*{_PAGE_WORD}(\d{{1,9}})(?!\d)(?:\s*{_TO}\s*{_PAGE_WORD}(\d{{1,9}})(?!\d))?\s*", re.I)
_ASIDE = re.compile(r"\([^()]*\)")
#: What may stand in a page cell at all; everything else is no list of pages.
_PAGE_CELL = re.compile(rf"(?:[\s\d,;/|&+，；、｜＆＋.]|[-‐‑‒–—−]|[^\W\d_]+|/)*")


def page_runs(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Dialect -> first and last page of each place of a page cell, for every dialect under which all its pieces are pages."""
    if not text:
        return {}
    bare = text.translate({ord(c): " " for c in "\"“”„«»"})
    while (less := _ASIDE.sub(" ", bare)) != bare:  # remarks in brackets, such as (back), are no pages
        bare = less
    if not re.search(r"\d", bare) or not _PAGE_CELL.fullmatch(bare):
        return {}
    texts, marks, at = [], [], 0
    for m in _PAGE_MARK.finditer(bare):
        texts.append(bare[at : m.start()]), marks.append((m.lastgroup, m[0]))
        at = m.end()
    texts.append(bare[at:])
    seen = {family for family, _ in marks}
    present, out = [name for name in PAGE_FAMILIES if name in seen], {}
    for size in range(len(present) + 1):
        for names in combinations(present, size):
            runs = []
            for piece in _pieces((texts, marks), names):
                if not piece.strip():
                    continue
                if not (m := _PAGE.fullmatch(piece)):
                    break
                runs.append((int(m[1]), int(m[2] or m[1])))
            else:
                if sum(abs(b - a) + 1 for a, b in runs) > 1:
                    out["+".join(names) or "one"] = runs
    return out


def _page_parses(text: str) -> dict[str, list[str]]:
    return {dialect: [f"{a}-{b}" if a != b else str(a) for a, b in runs] for dialect, runs in page_runs(text).items()}


def _candidates(field: str, cell: str) -> tuple[dict[str, list[str]], bool]:
    """The parses of a cell, and whether the whole of it is quoted."""
    if field == "pages":
        return _page_parses(cell), True
    stripped = cell.strip()
    return parses(cell), stripped[0] in _QUOTES and _quote_end(stripped, 0) == len(stripped)


def _cheapest(cells: DataFrame) -> DataFrame:
    """field, cell, items of the cheapest parse of every distinct cell (field, cell) that gives several values."""
    spark = cells.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt anew, as parsing is dear and what is left of the rows may fit into one partition.
    cells = cells.distinct().repartition(slots)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for field, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, quoted = _candidates(field, cell)
                for dialect, values in found.items():
                    out.append((field, cell, dialect, len(found), values, [_spelled(v, dialect != "one" or quoted) for v in values]))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), ty) for x, ty in zip(cols, types)], names=["field", "cell", "dialect", "rivals", "items", "spelled"])

    parsed = cells.mapInArrow(candidates, "field string, cell string, dialect string, rivals int, items array<string>, spelled array<double>")
    parsed = cut_lineage(parsed.withColumn("cell_id", F.xxhash64("field", "cell", F.lit(7))))
    whole = F.col("dialect") == "one"
    several = F.col("rivals") > 1
    # A whole cell that could also be split says nothing about itself; every other value speaks once per distinct cell.
    evidence = parsed.where(~whole | ~several).select("field", "cell_id", F.explode(F.array_distinct("items")).alias("item")).distinct().groupBy("field", "item").agg(F.count("*").alias("seen"))
    totals = {r[0]: r[1] for r in parsed.where(several).groupBy("field").agg(F.countDistinct("cell_id")).collect()}  # a row per field
    total = F.element_at(F.create_map(*[F.lit(x) for f in ("wordings", "pages") for x in (f, totals.get(f, 0) + 1000.0)]), F.col("field"))
    open_cells = parsed.where(several)
    values = open_cells.select("field", "cell_id", "dialect", F.explode(F.arrays_zip("items", "spelled")).alias("v")).select("field", "cell_id", "dialect", F.col("v.items").alias("item"), F.col("v.spelled").alias("spelled"))
    known = evidence.where("seen > 1")
    # Its own cell does not count as evidence for a value.
    bits = F.least(F.col("spelled"), F.coalesce(-F.log2((F.col("seen") - F.when(whole, 0).otherwise(1)) / total), F.col("spelled")))
    cost = (
        values.join(known, ["field", "item"], "left")
        .groupBy("cell_id", "dialect").agg((F.sum(bits + F.lit(_NUMBER_BITS)) + F.when(whole, 0.0).otherwise(_DIALECT_BITS * F.size(F.split("dialect", r"\+")))).alias("bits"), F.count("*").alias("n_values"))
    )
    best = cost.groupBy("cell_id").agg(F.min_by("dialect", F.struct(F.round("bits", 6), "n_values", "dialect")).alias("dialect"))
    chosen = open_cells.join(best, ["cell_id", "dialect"]).select("field", "cell", "dialect", "items")
    chosen = chosen.unionByName(parsed.where(~several).select("field", "cell", "dialect", "items"))
    return chosen.where((F.col("dialect") != "one") | (F.col("field") == "pages")).select("field", "cell", "items")


def _rows(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    stated = F.col(text).rlike("[0-9]" if field == "pages" else r"\S")
    return df.where(stated).select(F.lit(field).alias("field"), F.col(key).alias("key"), F.col(text).alias("cell"))


def _unpacked(rows: DataFrame) -> DataFrame:
    """field, key, items of all rows (field, key, cell) whose cell holds several values."""
    return rows.join(_cheapest(rows.select("field", "cell")), ["field", "cell"]).select("field", "key", "items")


def _listed(rows: DataFrame) -> DataFrame:
    """key, pos, item of every value."""
    return rows.select("key", F.posexplode("items").alias("pos", "item")).select("key", (F.col("pos") + 1).cast("bigint").alias("pos"), "item")


def _paged(rows: DataFrame) -> DataFrame:
    """key, pos, item of every page of every run, downwards where a run is written so; repeats stay."""
    ends = F.transform("items", lambda r: F.struct(F.split(r, "-")[0].cast("bigint").alias("a"), F.element_at(F.split(r, "-"), -1).cast("bigint").alias("b")))
    simple = ~F.exists("items", lambda r: r.contains("-"))
    ranged = rows.where(~simple).select("key", F.posexplode(ends).alias("run", "r"), ends.alias("all")).select("key", "r.a", "r.b", "run", "all")
    before = F.aggregate(F.slice("all", F.lit(1), F.col("run")), F.lit(0).cast("bigint"), lambda n, r: n + F.abs(r["b"] - r["a"]) + 1)
    ranged = ranged.select("key", "a", "b", before.alias("before"))
    size, way = F.abs(F.col("b") - F.col("a")) + 1, F.when(F.col("b") >= F.col("a"), 1).otherwise(-1)
    chunks = ranged.select("key", "a", "before", way.alias("way"), size.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(CHUNK).cast("bigint"))).alias("from"))
    each = chunks.select("key", "a", "before", "way", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("n")) - 1)).alias("i"))
    pages = each.select("key", (F.col("before") + F.col("i") + 1).alias("pos"), (F.col("a") + F.col("way") * F.col("i")).cast("string").alias("item"))
    return _listed(rows.where(simple)).unionByName(pages)


def split_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, item: the values of every cell that holds two or more."""
    return _listed(_unpacked(_rows(df, "wordings", key, text)))


def split_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, item (page number in digits) of every page cell that gives two or more pages; blank cells, "all pages" and other words are no lists."""
    return _paged(_unpacked(_rows(df, "pages", key, text)))


def unpack(checklist: DataFrame, check_result: DataFrame) -> DataFrame:
    """table_name, row_id, pos, item of both packed fields."""
    both = _rows(checklist, "wordings", "row_id", "symbol_exact_wording").unionByName(_rows(check_result, "pages", "result_id", "pages"))
    found = _unpacked(both)
    words = _listed(found.where("field = 'wordings'")).withColumn("table_name", F.lit("checklist"))
    pages = _paged(found.where("field = 'pages'")).withColumn("table_name", F.lit("check_result"))
    return words.unionByName(pages).select("table_name", F.col("key").alias("row_id"), F.col("pos").cast("int").alias("pos"), "item")
