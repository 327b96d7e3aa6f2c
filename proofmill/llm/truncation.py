"""Texts cut off by field limits.

Two judges.  A cut copy is the beginning of its whole, so near-copies are sought among the beginnings of texts: the word
shingles of the first 16, 32, 64 ... places of a text are min-hashed and banded, a text that does not close with a
sentence mark looks in the buckets of its two longest beginnings for texts that go on, the share of its shingles that the
other text holds is verified (0.8), the pair is aligned, and the copy whose alignment ends early, inside a sentence or word
of the other, is cut.  Every text is also judged by the terminality of its close: after the marks that systems set behind
a text are taken off, a closing sentence must end in a sentence mark; any other closing line (heading, list entry) is
complete where the share of documents in which these words end a line, among all documents in which they begin one, is
large enough, by counts over all documents.

Skew: exact copies count as one text before pairs are made, by an aggregate; buckets that no open text asks for are
left out by a bitmap that grows with what is asked for, before anything is written; the texts of a bucket are dealt into blocks of BLOCK, and
each asking text is joined with every block, so no task holds a large bucket.

Defined results: null and blank texts are not cut; a text of codes only is complete; a text that a system closed with an
ellipsis is cut; repeated texts each get their own row; a text of fewer than 20 words is judged by its close only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.runtime import cut_lineage, spread

SHINGLE, LEAST_SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
#: Shingles of the shortest beginning that is hashed; each further one is twice as long.
BEGINNING = 16
#: Least share of documents in which a line ends behind the words of an open close, less PRIOR documents that go on.
LEAST_TERMINAL, PRIOR = 0.2, 6
#: Ids of texts to compare that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Texts of a bucket in one group; larger buckets are dealt into blocks.
BLOCK = 2000
#: Bits of the bitmap of buckets that are asked for: so many a bucket, at most 64 MB (by estimate 5 bits a bucket for 6 GB of documents; where there are fewer, more pass by chance, none is lost).
BITS_A_BUCKET, MOST_BITS = 12, 1 << 29
#: Counts of lines that a task holds at once.
MOST_COUNTS = 300_000
#: Slots in which offers are counted to find large buckets; places of texts that are hashed at once.
SLOTS, PIECE = 1 << 20, 2048
_LINES = re.compile(r"\r\n|\r|\n| ")
#: Words, signs, and the letters of scripts without blanks between words.
_UNSPACED = "\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+|[^\w\s]")
_DIGIT, _WORD, _LETTERS = re.compile(r"\d"), re.compile(r"\w"), re.compile(r"[^\W\d_]+")
_ELLIPSIS = ("…", "...", "[...]", "[…]", "(...)", "(…)")
_CODE = re.compile(r"\(?\b[A-Z]{1,5}\d[\w-]*\d[\w-]*\)?$")


def ends_sentence(line: str) -> bool:
    """A sentence mark closes the line, behind it at most closing quotes, brackets and blanks."""
    return line.rstrip().rstrip("\"'”’»)] \t\u00a0").endswith((".", "!", "?", "。", "！", "？"))


def ends_open(line: str) -> bool:
    """An ellipsis closes the line."""
    return line.rstrip().endswith(_ELLIPSIS)


def is_mark_line(line: str) -> bool:
    """A line of codes, numbers and marks only, such as a page count, a reference or the rule before one."""
    if not _DIGIT.search(line):  # most lines end here
        return not _WORD.search(line) and not re.search(r"[.!?…]", line)
    n = 0
    for m in _LETTERS.finditer(line):
        w, n = m.group(), n + 1
        if n > 5 or (len(w) > 3 and not (w.isupper() and len(w) <= 5)):
            return False
    return True


def close_of(text: str) -> tuple[str, str]:
    """(verdict, line): "cut" or "whole" where the close itself tells, else "ask" with the closing line in one form."""
    return _close([line for raw in _LINES.split(text) if (line := raw.strip())])


def _close(lines: list[str]) -> tuple[str, str]:
    """close_of() of a text's lines, trimmed and not blank, of which marks behind the close are taken off."""
    while len(lines) > 1 and is_mark_line(lines[-1]) and not ends_open(lines[-1]):
        lines.pop()
    if not lines:
        return "whole", ""
    last = lines[-1]
    if is_mark_line(last) and not ends_open(last):
        return "whole", last
    if last.rfind("(") > last.rfind(")"):
        return "cut", last  # an open bracket
    while True:  # codes behind the close are taken off
        if ends_open(last):
            return "cut", last
        if ends_sentence(last):
            return "whole", last
        bare = without_code(last)
        if bare == last or not bare:
            break
        last = bare
    if not re.search(r"[^\W\d_]", last):
        return "whole", last
    return "ask", line_form(last)


def without_code(line: str) -> str:
    """The line less a code at its end; a word of more than 80 characters is no code."""
    head, _, word = line.rstrip().rpartition(" ")
    if len(word) > 80 or not (m := _CODE.search(word)):
        return line
    return f"{head} {word[: m.start()]}".strip()


def line_form(line: str) -> str:
    return " ".join(without_code(line).lower().split())


def _beginnings(form: str) -> list[int]:
    """Hashes of the first word, the first two words ... of a line; the last one is that of the whole line."""
    import xxhash

    h, out = xxhash.xxh3_64(), []
    for word in form.split(" "):
        h.update(word)
        out.append(h.intdigest() - 2**63)
        h.update(" ")
    return out


def closes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, verdict, line of closes that are cut or ask (line: hash of the close); with a null key, line, n_ends, n_goes_on: in
    how many documents these words are a whole line without a sentence mark, and in how many they only begin one."""

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[int]] = {}  # of the whole task, given out before they are many
        known: dict[str, list[int]] = {}

        def out(rows: list[tuple], type_) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 5
            types = [type_, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), ty) for x, ty in zip(cols, types)], names=["key", "verdict", "line", "n_ends", "n_goes_on"])

        def beginnings(form: str) -> list[int]:
            if (row := known.get(form)) is None:
                row = _beginnings(form)
                if len(form) < 400:
                    if len(known) > 20_000:
                        known.clear()
                    known[form] = row
            return row

        type_ = None
        for batch in batches:
            rows: list[tuple] = []
            type_ = batch.schema[0].type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parted = _LINES.split(t)
                verdict, line = _close([x for raw in parted if (x := raw.strip())])
                if verdict != "whole":
                    rows.append((k, verdict, beginnings(line)[-1] if verdict == "ask" else None, 0, 0))
                forms = {line_form(x) for raw in parted[:-1] if (x := raw.strip()) and not ends_sentence(x)}
                # The last line of content speaks for itself, not for others.
                forms.discard(line if verdict == "ask" else "")
                ends, goes_on = set(), set()
                for form in forms:
                    *some, every = beginnings(form)
                    ends.add(every)
                    goes_on.update(some)
                for which, found in ((0, ends), (1, goes_on)):
                    for h in found:
                        counts.setdefault(h, [0, 0])[which] += 1
                if len(counts) > MOST_COUNTS:
                    rows += [(None, None, h, a, b) for h, (a, b) in counts.items()]
                    counts.clear()
            yield out(rows, type_)
        if counts:
            yield out([(None, None, h, a, b) for h, (a, b) in counts.items()], type_)

    rows = docs.select(key, F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(run, f"key {kind}, verdict string, line bigint, n_ends bigint, n_goes_on bigint")


def _levels(n: int) -> list[int]:
    """Lengths of the beginnings of a text of n shingles."""
    out = []
    while BEGINNING << len(out) <= n:
        out.append(BEGINNING << len(out))
    return out


class _Hashes(dict):
    """Hashes of words, and the multipliers of the min-hashes."""

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(11)
        self.mul = rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
        self.mix = rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.rows = np.empty((0, BANDS * ROWS), np.uint32)

    def room(self, n: int):
        """An array for the min-hashes of n places, used again and again."""
        import numpy as np

        if len(self.rows) < n:
            self.rows = np.empty((n, BANDS * ROWS), np.uint32)
        return self.rows[:n]

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _keys(texts: list[list[str]], asking: bool, known: _Hashes) -> tuple:
    """(buckets, numbers of buckets a text) of texts given by their words, each of BEGINNING shingles or more: of all beginnings, or of the two longest ones.

    All texts go through one array; least values are taken between the lengths of beginnings, then from the start up to each.
    """
    import numpy as np

    prime = np.uint64(0x9E3779B97F4A7C15)
    if len(known) > 200_000:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, (w for words in texts for w in words)), np.uint64, sum(map(len, texts)))
    per_text = [_levels(len(words) - SHINGLE + 1) for words in texts]
    sizes = np.array([len(x) for x in per_text])
    levels = np.array([level for x in per_text for level in x])
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        shingles = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            shingles = (shingles ^ hashes[i : len(shingles) + i]) * prime
            shingles ^= shingles >> np.uint64(29)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        short = np.concatenate([shingles[a : a + x[-1]] for a, x in zip(starts, per_text)])
        short = (short >> np.uint64(32)).astype(np.uint32)[:, None]
        lengths = levels.copy()
        lengths[1:] -= levels[:-1]
        lengths[first] = BEGINNING
        # Stretches between two lengths, long ones in pieces, some PIECE places at a time.
        pieces = -(-lengths // PIECE)
        at_piece = np.cumsum(pieces) - pieces
        stretch = np.repeat(np.cumsum(lengths) - lengths, pieces)
        begins = stretch + (np.arange(len(stretch)) - np.repeat(at_piece, pieces)) * PIECE
        low = np.empty((len(begins), BANDS * ROWS), np.uint32)
        i = 0
        while i < len(begins):
            j = max(i + 1, int(np.searchsorted(begins, begins[i] + PIECE, side="right")) - 1) if begins[-1] > begins[i] + PIECE else len(begins)
            a, b = begins[i], begins[j] if j < len(begins) else len(short)
            mixed = np.multiply(short[a:b], known.mul, out=known.room(b - a))
            mixed += known.add
            np.minimum.reduceat(mixed, begins[i:j] - a, axis=0, out=low[i:j])
            i = j
        if len(begins) > len(levels):
            low = np.minimum.reduceat(low, at_piece, axis=0)
        for k in range(1, int(sizes.max())):
            at = first[sizes > k] + k
            low[at] = np.minimum(low[at], low[at - 1])
        if asking:
            longest = np.concatenate([np.arange(max(0, n - 2), n) + a for a, n in zip(first, sizes)])
            low, levels, sizes = low[longest], levels[longest], np.minimum(sizes, 2)
        # A bucket is the hash of the level, the band (by its multipliers) and the band's least values.
        key = (low.reshape(-1, BANDS, ROWS) * known.mix).sum(axis=2, dtype=np.uint64) + levels[:, None].astype(np.uint64)
        key = (key ^ (key >> np.uint64(31))) * prime
    return (key ^ (key >> np.uint64(29))).ravel(), sizes * BANDS


def _kept(bits, n_hashes: int, key):
    """Which buckets the bitmap holds, by one place or two."""
    import numpy as np

    mask, out = np.uint64(8 * len(bits) - 1), None
    for h in (key, key >> np.uint64(32))[:n_hashes]:
        h = h & mask
        hit = (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 != 0
        out = hit if out is None else out & hit
    return out


def _signatures(texts: DataFrame, asked=None, n_hashes: int = 0) -> DataFrame:
    """id, copy (hash of the text), size, buckets: without `asked`, those that open texts ask for (of their two longest beginnings);
    with `asked` (a bitmap that was sent to the executors), those of all beginnings of all texts that stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        known = _Hashes()
        for batch in batches:
            ids, copies, sizes, counts, found = [], [], [], [], []
            rows: list[tuple[int, str]] = []
            group: list[list[str]] = []
            column, total = batch.column(1).to_pylist(), 0
            for row, t in enumerate([*column, None]):
                if t is not None and (asked is not None or open_end(t)) and len(words := _words(t)) - SHINGLE + 1 >= BEGINNING:
                    rows.append((row, t)), group.append(words)
                    total += len(words)
                if group and (t is None or total > 4 * PIECE):
                    key, n = _keys(group, asked is None, known)
                    if asked is not None:
                        kept = _kept(asked.value, n_hashes, key)
                        key, n = key[kept], np.add.reduceat(kept, np.cumsum(n) - n, dtype=np.int64)
                    some = np.flatnonzero(n)
                    ids += [rows[i][0] for i in some]
                    copies += [xxhash.xxh3_64_intdigest(rows[i][1]) - 2**63 for i in some]
                    sizes += [len(group[i]) - SHINGLE + 1 for i in some]
                    counts.append(n[some]), found.append(key)
                    rows, group, total = [], [], 0
            ends = np.concatenate([[0], *counts]).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(copies, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["id", "copy", "size", "buckets"])

    kind = texts.schema["id"].dataType.simpleString()
    signed = texts.mapInArrow(run, f"id {kind}, copy bigint, size int, buckets array<bigint>")
    # Exact copies (equal `copy`) count as one text.
    return signed.groupBy("copy").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def held(short: str, whole: str) -> float:
    """The share of the shingles of `short` that the beginning of `whole` holds, up to a quarter more words than `short` has."""
    x, y = _words(short), _words(whole)
    y = y[: len(x) * 5 // 4 + SHINGLE]
    a, b = (set(zip(*(w[i:] for i in range(SHINGLE)))) for w in (x, y))
    return len(a & b) / len(a) if a else 0.0


def open_end(text: str) -> int:
    """Where the last line of content ends, less a system's ellipsis; 0 where a sentence mark ends it."""
    last, at, end = "", 0, len(text)
    while end >= 0:  # lines from the end, as most texts need only one
        start = max(text.rfind(c, 0, end) for c in "\n\r\u2028") + 1
        if text[start:end].strip():
            last, at = text[start:end], start
            if not is_mark_line(last.strip()):
                break
        end = start - 1
    last = last.rstrip()
    for mark in sorted(_ELLIPSIS, key=len, reverse=True):
        if last.endswith(mark):
            last = last[: -len(mark)].rstrip()
            break
    return 0 if not last.strip() or ends_sentence(last) else at + len(last)


def ends_early(short: str, whole: str) -> bool:
    """The last word of `short`, where the alignment of the two word sequences puts it in `whole`, goes on there inside the same sentence or word."""
    a = _TOKEN.findall(short[: open_end(short)])
    if not a:
        return False
    last = a.pop()
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    # Most words in common (bit-parallel): a zero bit i of `row` tells that word i of `short` adds one to the count so far.
    every = (1 << len(a)) - 1
    row, ends = every, []
    for m in _TOKEN.finditer(whole):
        if m.group().startswith(last):
            ends.append((len(a) - row.bit_count() + 1, m.start() + len(last)))
        hit = row & where.get(m.group(), 0)
        row = ((row + hit) | (row - hit)) & every
    best = max(ends, default=(0, 0))[0]
    if best < len(a) - row.bit_count():
        return False  # the alignment leaves the last word out
    at = next((end for n, end in ends if n == best), 0)
    return bool(at and re.match(r"\w|[\s,;:]+\(?\w", _LINES.split(whole[at:], maxsplit=1)[0]))


def _bitmap(asks: DataFrame) -> tuple:
    """(bits, places of a bucket in them) of the buckets that are asked for: BITS_A_BUCKET bits a bucket as far as MOST_BITS goes, so the share that passes by chance does not grow with the data."""
    import numpy as np

    n = asks.agg(F.sum(F.size("buckets"))).first()[0] or 0
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_BUCKET * n).bit_length()))
    n_hashes = 2 if size >= 2 * n else 1
    places = F.array(*[F.shiftrightunsigned("bucket", s).bitwiseAND(F.lit(size - 1)) for s in (0, 32)[:n_hashes]])
    at = asks.select(F.explode("buckets").alias("bucket")).select(F.explode(places).alias("at"))
    word = F.shiftright("at", 6).cast("int").alias("word")
    words = at.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits.view(np.uint8), n_hashes


def _bucket_pairs(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """copy, other_copy, id, other, sizes, level: each asking text with the other texts of its buckets (bucket, copy, id, size) that are no shorter, give or take a fifth."""
    # Large buckets are sought among SLOTS of buckets, so that the counts stay few.
    slot = F.pmod("bucket", F.lit(SLOTS)).alias("slot")
    large = cut_lineage(offers.groupBy(slot).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("slot"))
    if large.limit(1).count():
        full = offers.withColumn("slot", slot).join(F.broadcast(large), "slot", "left_semi")
        large = cut_lineage(full.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    else:
        large = offers.select("bucket", F.lit(1).alias("n_blocks")).limit(0)
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a checked size; otherwise the join shuffles
        large = F.broadcast(large)
    blocks = lambda df: df.join(large, "bucket", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    dealt = blocks(offers).withColumn("block", F.pmod(F.xxhash64("copy"), F.col("n_blocks").cast("bigint")).cast("int"))
    asking = blocks(asks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    a, b = asking.alias("a"), dealt.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bucket", "block")]
    met = a.join(b, [*same, (F.col("a.copy") != F.col("b.copy")) & (F.col("b.size") >= F.col("a.size") * LEAST_SIMILAR)])
    return met.select("a.copy", F.col("b.copy").alias("other_copy"), "a.id", F.col("b.id").alias("other"), "a.size", F.col("b.size").alias("other_size"), "a.level")


def near_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, other, held, early: texts that do not close with a sentence mark, verified near-copies of the beginning of another text; early: the other goes on."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    kind = texts.schema["id"].dataType.simpleString()
    # What open texts ask for comes first; of the buckets of all texts only those that may be asked for leave the executors' Python.
    signed = cut_lineage(_signatures(texts))
    bits, n_hashes = _bitmap(signed)
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    asks = signed.select("id", "copy", "size", F.posexplode("buckets").alias("at", "bucket")).withColumn("level", F.floor(F.col("at") / BANDS).cast("int")).drop("at")
    offers = cut_lineage(_signatures(texts, sent, n_hashes)).select("id", "copy", "size", F.explode("buckets").alias("bucket"))
    met = _bucket_pairs(asks, offers).groupBy("copy", "other_copy").agg(*(F.min(c).alias(c) for c in ("id", "other", "size", "other_size")), F.count_distinct("level").alias("levels"))
    # Both of the two longest beginnings must meet, where the shorter of them has 32 shingles or more and the other text is as long as the longer one.
    longest = BEGINNING * F.pow(F.lit(2), F.floor(F.log2(F.col("size") / BEGINNING) + 1e-9))
    links = cut_lineage(met.where((F.col("levels") >= 2) | (F.col("size") < 4 * BEGINNING) | (F.col("other_size") < longest)).select("id", "other"))
    needed = links.select("id").union(links.select("other")).distinct()
    n_needed = needed.limit(BROADCAST_ROWS + 1).count()
    if n_needed <= BROADCAST_ROWS:  # a checked size; otherwise the join shuffles
        needed = F.broadcast(needed)
    texts = texts.join(needed, "id", "left_semi") if n_needed else texts.limit(0)
    pairs = links.join(texts, "id").join(texts.select(F.col("id").alias("other"), F.col("text").alias("whole")), "other").select("id", "other", "text", "whole")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, o, a, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (share := held(a, b)) >= LEAST_SIMILAR:
                    rows.append((i, o, share, ends_early(a, b)))
            cols = list(zip(*rows)) or [[]] * 4
            types = [batch.schema[0].type, batch.schema[1].type, pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), ty) for x, ty in zip(cols, types)], names=["id", "other", "held", "early"])

    return pairs.mapInArrow(verify, f"id {kind}, other {kind}, held double, early boolean")


def cut_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, by ("copy" or "close"): the texts that were cut."""
    docs = spread(docs.select(key, F.col(text).cast("string").alias("text")).where(F.col(text).isNotNull()))
    judged = cut_lineage(closes(docs, key, "text"))  # two uses; a row per cut or open close, and the lines' counts
    counts = judged.where("key is null").groupBy("line").agg(F.sum("n_ends").alias("ends"), F.sum("n_goes_on").alias("goes_on")).where("ends > 0")
    share = F.col("ends") / (F.col("ends") + F.col("goes_on") + PRIOR)
    asked = judged.where("key is not null and verdict = 'ask'").join(counts, "line", "left").where(F.coalesce(share, F.lit(0.0)) < LEAST_TERMINAL).select("key")
    by_close = judged.where("key is not null and verdict = 'cut'").select("key").unionByName(asked)
    early = near_copies(docs, key, "text").where("early").select("id").distinct()
    same = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("h"))
    early_hash = same.join(early, F.col("key") == F.col("id")).select("h").distinct()
    by_copy = same.join(early_hash, "h", "left_semi").select("key")
    both = by_close.withColumn("by", F.lit("close")).unionByName(by_copy.withColumn("by", F.lit("copy")))
    return both.groupBy(F.col("key").alias(key)).agg(F.max("by").alias("by"))


def cut_shares(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """source, n_docs, n_cut, share: how often each source cuts (null sources count together)."""
    cut = cut_texts(docs, key, text).select(key, F.lit(1).alias("cut"))
    rows = docs.select(key, source).join(cut, key, "left")
    return rows.groupBy(source).agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
