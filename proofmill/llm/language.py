"""Language of texts and of every stretch in another language, with a confidence.

A linear-chain conditional random field labels the words: affixes, character n-grams and the word itself are hashed
features, transitions are learned apart for places inside a sentence, after a sentence mark and at a bare line end.
Forward-backward gives every word a probability per language; a sentence takes the language of the highest mean
log-probability (one below SURE follows the sure sentence before it, else the one behind it), and neighbouring sentences
of one language make a segment.

Training: the field is fitted in the driver on TRAIN_TEXTS labelled texts per language (those of the lowest key hash, a
documented bound).  Labels are noisy, so sentences are first relabelled by word frequencies over the sample; of these,
the sentences that show a word for one of its first WORD_SHOWN times are learned from, in sequences spliced from several
texts to show switches.

Sizes: the model is FEATURES x 8 floats (2 MB) whatever the data.  Texts are labelled whole; a text of more than WINDOW
words is worked on in windows that end at sentence ends (a longer sentence is cut).

Defined results: null and blank texts, texts of codes and numbers only, and texts mostly in a script none of the eight
languages uses have no segment; without any labelled text every language gets the same probability; invisible characters do not matter; ties between languages go to the alphabetically
first; repeated rows each give their own rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.lookalikes import SAME_LOOK
from proofmill.llm.truncation import is_mark_line
from proofmill.runtime import spread

LANGS = ["de", "en", "es", "fr", "it", "nl", "pl", "ru"]
#: Other names of the languages; a region after a hyphen or underscore is taken off first.
NAMES = {
    "de": ["deu", "ger", "german", "deutsch"], "en": ["eng", "english"], "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fra", "fre", "french", "français", "francais"], "it": ["ita", "italian", "italiano"], "nl": ["nld", "dut", "dutch", "nederlands"],
    "pl": ["pol", "polish", "polski"], "ru": ["rus", "russian", "русский"],
}
TRAIN_TEXTS, WORD_SHOWN, FEATURES, WINDOW, SURE = 400, 20, 1 << 16, 1000, 0.85
_INVISIBLE = "­​‌‍⁠﻿‎‏"
_BOUNDARY = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[\r\n]+\s*|(?<=\s)[|–—•/](?=\s)")
_WORD = re.compile(r"(?<![\w-])[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w]*\d)")
_WIDE = re.compile("[！-～]")
_FOLD = str.maketrans({c: latin for latin, others in SAME_LOOK.items() if latin.isascii() for c in others})


def visible(text: Column) -> Column:
    """The text without invisible characters; the few texts that hold any are rewritten."""
    return F.when(text.rlike(f"[{_INVISIBLE}]"), F.translate(text, _INVISIBLE, "")).otherwise(text)


def label_code(label: Column) -> Column:
    """The language a label names, or null."""
    clean = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    return F.element_at(F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in [code, *names] for x in (name, code)]), clean)


def _features(word: str) -> list[int]:
    w = word.lower()
    if not w.isascii():
        latin = sum(c.isascii() for c in w)
        if latin * 2 > len(w):
            w = w.translate(_FOLD)
        w = unicodedata.normalize("NFC", w)
    p = f"^{w}$"
    names = dict.fromkeys([f"w{w}", *(f"p{w[:n]}" for n in (1, 2, 3)), *(f"s{w[-n:]}" for n in (1, 2, 3, 4))])
    names.update((f"n{p[i : i + n]}", None) for n in (2, 3, 4) for i in range(len(p) - n + 1))  # only different ones are held, however long the word
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def _foreign(word: str) -> bool:
    """A word mostly of letters that are neither Latin nor Cyrillic."""
    if word.isascii():
        return False
    return 2 * sum(c > "ʯ" and not ("Ѐ" <= c <= "ӿ" or "Ḁ" <= c <= "ỿ" or "̀" <= c <= "ͯ") for c in word) > len(word)


def sentence_words(sentence: str) -> list[str]:
    """Words of a sentence; none for a line of codes."""
    words = _WORD.findall(sentence)
    return [] if len(words) <= 5 and is_mark_line(sentence) else words


def sentences(text: str, words_of=sentence_words) -> list[tuple[list, int]]:
    """(words, kind of the boundary before: 1 after a sentence mark or separator, 2 at a bare line end) of each sentence with words."""
    if not text.isascii() and _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    out, at, kind = [], 0, 1
    for m in _BOUNDARY.finditer(text):
        start, end = m.span()
        if words := words_of(text[at:start]):
            out.append((words, kind))
            kind = 2
        if text[start - 1 : start] in ".!?…" or not text[start:end].isspace():
            kind = 1
        at = end
    if words := words_of(text[at:]):
        out.append((words, kind))
    return out


def _forward_backward(emit, kinds, lengths, trans):
    """Log-probabilities of the labels of packed sequences.

    emit (words, L): scores, sequence after sequence; kinds: boundary kind before each word (3 at a sequence's start);
    lengths: words per sequence, longest first.
    """
    import numpy as np

    n, size = len(lengths), emit.shape[1]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    score = np.exp(emit - emit.max(axis=1, keepdims=True))
    fwd, bwd = np.empty_like(score), np.ones_like(score)
    steps = np.exp(trans)
    longest = int(lengths[0]) if n else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")

    def move(rows, kind, back):
        out = rows @ (steps[0].T if back else steps[0])
        for k in (1, 2):
            at = np.flatnonzero(kind == k)
            if len(at):
                out[at] = rows[at] @ (steps[k].T if back else steps[k])
        return out

    for t in range(longest):
        m = active[t]
        at = starts[:m] + t
        row = score[at]
        if t:
            row = row * move(fwd[at - 1], kinds[at], False)
        fwd[at] = row / row.sum(axis=1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        m = active[t]
        at = starts[:m] + t
        row = move(bwd[at] * score[at], kinds[at], True)
        bwd[at - 1] = row / row.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=1, keepdims=True)
    assert size == len(LANGS)
    return post, fwd, bwd, score


def _relabel(texts: list[tuple[list, int]], rounds: int = 3):
    """Sentence labels by word frequencies, starting from the text labels."""
    import numpy as np

    vocabulary: dict[str, int] = {}
    rows, labels, own = [], [], []
    for sents, label in texts:
        for words, _ in sents:
            rows.append(np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in words]))
            labels.append(label), own.append(label)
    labels = np.array(labels)
    for _ in range(rounds):
        counts = np.full((len(vocabulary), len(LANGS)), 0.05)
        for ids, label in zip(rows, labels):
            counts[ids, label] += 1
        log = np.log(counts / counts.sum(axis=0))
        log -= log.mean(axis=1, keepdims=True)
        scores = np.array([log[ids].sum(axis=0) for ids in rows])
        scores[np.arange(len(own)), own] += 0.5
        labels = scores.argmax(axis=1)
    return labels


def fit(texts: list[tuple[str, str]], epochs: int = 20):
    """(weights, transitions) of the field from (text, language) samples."""
    import numpy as np

    rng = np.random.default_rng(5)
    size = len(LANGS)
    weights, trans = np.zeros((FEATURES, size)), np.stack([np.eye(size) * 4, np.eye(size) * 1.0, np.eye(size) * 2])
    sample = [(s, LANGS.index(code)) for text, code in texts if (s := sentences(text))]
    if not sample:  # nothing labelled: every language is as likely
        return weights.astype(np.float32), trans
    labels = _relabel(sample)
    # A sentence that only has words shown WORD_SHOWN times before teaches nothing new.
    sents, i, shown = [], 0, Counter()
    for parts, _ in sample:
        for words, kind in parts:
            if any(shown[w] < WORD_SHOWN for w in words):
                sents.append((words, kind, labels[i]))
                shown.update(words)
            i += 1
    # Sequences of a few sentences; one in four starts again from another text, which shows a switch after a mark.
    sequences, i = [], 0
    while i < len(sents):
        length = int(rng.integers(1, 6))
        seq = list(sents[i : i + length])
        if rng.random() < 0.25:
            words, _, label = sents[int(rng.integers(len(sents)))]
            seq.append((words, 1, label))
            words, _, label = seq[0]
            seq.append((sents[i][0], 1, label))
        sequences.append(seq)
        i += length
    vocabulary: dict[str, int] = {}
    packed = []
    for seq in sequences:
        ids, kinds, gold = [], [], []
        for words, kind, label in seq:
            for j, w in enumerate(words):
                ids.append(vocabulary.setdefault(w, len(vocabulary)))
                kinds.append((kind if ids[:-1] else 3) if j == 0 else 0)
                gold.append(label)
        packed.append((ids, kinds, gold))
    packed.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(p[0]) for p in packed])
    ids, kinds, gold = (np.concatenate([np.array(p[k]) for p in packed]) for k in range(3))
    feats = [_features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    sum_w, sum_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    inner = np.flatnonzero(kinds != 3)
    truth = np.zeros((len(ids), size))
    truth[np.arange(len(ids)), gold] = 1
    for _ in range(epochs):
        scores = np.zeros((len(feats), size))
        for k in range(size):
            scores[:, k] = np.bincount(owner, weights[flat, k], len(feats))
        post, fwd, bwd, score = _forward_backward(scores[ids], kinds, lengths, trans)
        grad_u = np.stack([np.bincount(ids, (truth - post)[:, k], len(feats)) for k in range(size)], axis=1)
        grad = np.stack([np.bincount(flat, grad_u[owner, k], FEATURES) for k in range(size)], axis=1) - 1e-3 * weights
        sum_w += grad**2
        weights += 0.5 * grad / np.sqrt(sum_w)
        for kind in range(3):
            at = inner[kinds[inner] == kind]
            if not len(at):
                continue
            pair = fwd[at - 1][:, :, None] * np.exp(trans[kind])[None] * (score[at] * bwd[at])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((size, size))
            np.add.at(seen, (gold[at - 1], gold[at]), 1)
            g = seen - pair.sum(axis=0) - 0.05 * trans[kind]
            sum_t[kind] += g**2
            trans[kind] += 0.3 * g / np.sqrt(sum_t[kind])
    return weights.astype(np.float32), trans


def train(docs: DataFrame, key: str, text: str, label: str):
    """The field fitted on the TRAIN_TEXTS texts of lowest key hash of each labelled language."""
    known = docs.where(F.col(text).isNotNull()).select(key, F.xxhash64(key).alias("h"), label_code(F.col(label)).alias("code")).where(F.col("code").isNotNull())
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h", key))
    picked = [r[0] for r in known.withColumn("rank", rank).where(F.col("rank") <= TRAIN_TEXTS).select(key).collect()]  # at most 8 x TRAIN_TEXTS keys
    texts = docs.where(F.col(key).isin(picked)).select(key, visible(F.col(text)).alias("text"), label_code(F.col(label)).alias("code"))
    first = texts.where("text is not null and code is not null").groupBy(key).agg(F.min_by("text", "text").alias("text"), F.min("code").alias("code"))  # a repeated key counts once
    return fit([(r["text"], r["code"]) for r in sorted(first.collect(), key=lambda r: str(r[key]))])


class Labeller:
    """Labels texts by a fitted field; word scores are kept between batches."""

    def __init__(self, weights, trans):
        import numpy as np

        self.np, self.weights, self.trans = np, weights, trans
        self.index: dict[str, int] = {}
        self.known: dict[str, list[int]] = {}
        self.scores = np.zeros((1024, len(LANGS)))

    def word(self, w: str) -> int:
        """Row of the word's scores; -1 for a word of another script."""
        if (i := self.index.get(w)) is not None:
            return i
        if _foreign(w):
            self.index[w] = -1
            return -1
        i = len(self.index)
        if i >= len(self.scores):
            self.scores = self.np.concatenate([self.scores, self.np.zeros_like(self.scores)])
        self.scores[i] = self.weights[_features(w)].sum(axis=0)
        self.index[w] = i
        return i

    def ids(self, sentence: str) -> list[int]:
        """Score rows of a sentence's words; sentences met before are not taken apart again."""
        row = self.known.get(sentence)
        if row is None:
            get, word = self.index.get, self.word
            row = [i if (i := get(w)) is not None else word(w) for w in sentence_words(sentence)]
            if len(sentence) < 400:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[sentence] = row
        return row

    def segments(self, texts: list[str]) -> list[list[tuple[str, float, int]]]:
        """(language, confidence, words) of the segments of each text."""
        np = self.np
        if len(self.index) > 300_000:
            self.index.clear()
            self.known.clear()
        out: list[list] = [[] for _ in texts]
        sequences: list[tuple[int, list[int], list[int], list[int]]] = []  # text, words, kinds, sentence of each word
        n_sentences, of_text = 0, []
        for which, text in enumerate(texts):
            ids: list[int] = []
            kinds: list[int] = []
            sents: list[int] = []
            foreign = total = 0
            begun = len(sequences), n_sentences
            for whole, kind in sentences(text, self.ids):
                for at in range(0, len(whole), WINDOW):
                    row = whole[at : at + WINDOW] if len(whole) > WINDOW else whole
                    total += len(row)
                    if -1 in row:
                        foreign += row.count(-1)
                        row = [i for i in row if i >= 0]
                    if not row:
                        continue
                    if len(ids) + len(row) > WINDOW:
                        sequences.append((which, ids, kinds, sents))
                        ids, kinds, sents = [], [], []
                    kinds.append((kind if at == 0 else 0) if ids else 3)
                    kinds += [0] * (len(row) - 1)
                    ids += row
                    sents += [n_sentences] * len(row)
                of_text.append(which)
                n_sentences += 1
            if ids:
                sequences.append((which, ids, kinds, sents))
            if 2 * foreign > total:
                del sequences[begun[0] :]
        if not sequences:
            return out
        sequences.sort(key=lambda s: -len(s[1]))
        lengths = np.array([len(s[1]) for s in sequences])
        ids, kinds, sents = (np.fromiter(chain.from_iterable(s[k] for s in sequences), kind, lengths.sum()) for k, kind in ((1, np.int32), (2, np.int8), (3, np.int64)))
        post, *_ = _forward_backward(self.scores[ids], kinds, lengths, self.trans)
        count = np.bincount(sents, minlength=n_sentences)
        logs = np.log(np.maximum(post, 1e-12))
        total_log = np.stack([np.bincount(sents, logs[:, k], n_sentences) for k in range(len(LANGS))], axis=1)
        best = total_log.argmax(axis=1)
        mean = np.stack([np.bincount(sents, post[:, k], n_sentences) for k in range(len(LANGS))], axis=1) / np.maximum(count, 1)[:, None]
        sure = mean[np.arange(n_sentences), best] >= SURE
        follow: dict[int, int] = {}  # text -> language of its nearest sure sentence so far
        unsure = [s for s in np.flatnonzero(count > 0) if not sure[s]]
        if unsure:
            wanted = {of_text[s] for s in unsure}
            for order in (range(n_sentences), range(n_sentences - 1, -1, -1)):  # from before, else from behind
                follow.clear()
                for s in order:
                    if of_text[s] in wanted and count[s]:
                        if sure[s]:
                            follow[of_text[s]] = best[s]
                        elif of_text[s] in follow:
                            best[s] = follow[of_text[s]]
                            sure[s] = True
        shares = mean[np.arange(n_sentences), best]
        for which, n, k, share in zip(of_text, count.tolist(), best.tolist(), shares.tolist()):
            if not n:
                continue
            parts = out[which]
            if parts and parts[-1][0] == k:
                _, c, m = parts[-1]
                parts[-1] = (k, c + share * n, m + n)
            else:
                parts.append((k, share * n, n))
        return [[(LANGS[k], float(c / n), n) for k, c, n in parts] for parts in out]


def label_segments(texts: DataFrame, key: list[str], text: str, model) -> DataFrame:
    """key, segment_no, n_segments, lang, confidence, n_words: the segments of every text."""
    weights, trans = model
    fields = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        labeller = Labeller(weights, trans)
        hidden, gone = re.compile(f"[{_INVISIBLE}]").search, dict.fromkeys(map(ord, _INVISIBLE))
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                column = [t if t.isascii() or not hidden(t) else t.translate(gone) for t in batch.column(len(key)).to_pylist()]
                distinct = list(dict.fromkeys(column))
                found = dict(zip(distinct, labeller.segments(distinct)))
                parts = [found[t] for t in column]
                take = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                flat = [s for p in parts for s in p]
                nos = [i for p in parts for i in range(1, len(p) + 1)]
                counts = [len(p) for p in parts for _ in p]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(take)) for i in range(len(key))), pa.array(nos, pa.int32()), pa.array(counts, pa.int32()), pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.int64())],
                    names=[*key, "segment_no", "n_segments", "lang", "confidence", "n_words"],
                )

    # Invisible characters are no letters; they are taken out beside the labelling, as a pattern over every text is dear in the JVM.
    rows = texts.select(*key, F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"\p{L}"))
    return rows.mapInArrow(run, f"{fields}, segment_no int, n_segments int, lang string, confidence double, n_words bigint")


def mislabelled(segments: DataFrame, label: str) -> DataFrame:
    """Segments of mixed texts, and the one segment of texts whose label is missing, means nothing or names another language."""
    code = label_code(F.col(label))
    return segments.where((F.col("n_segments") > 1) | code.isNull() | (code != F.col("lang")))
