"""Language of documents by a linear-chain conditional random field over words.

Every word (a run of letters, cut after ``WORD_CHARS``) has a hidden language.
Emissions weigh affixes, letter n-grams and a lexicon of frequent words,
transitions are learned, and forward-backward gives every word's language
marginals, so text that switches languages is labelled word by word. A
document's language has the largest sum of marginals; the score is its mean.

The field is trained on a bounded sample of labelled documents (about
``docs_per_lang`` of each language, of at most ``train_chars`` characters):
stretches of documents in different languages are strung together, so that
switches are seen, and the conditional likelihood's gradient (forward-backward
counts) is followed with RMS-scaled steps.

Texts without letters, null and empty ones are ``und`` with score 0; so is
everything if nothing can be learned. Ties go to the first language by name.
Repeated rows get one row each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import mix64, small_batches, text_slices

DOCS_PER_LANG, TRAIN_CHARS = 300, 20_000
TRAIN_WORDS = 40_000
LEXICON = 1500
FEATURES = 1 << 16
WORD_CHARS = 24
WORD_BYTES, TAIL_BYTES = 32, 4
EPOCHS = 25
SLICE = 4 << 20
WORDS_KEPT = 1 << 18
UNDETERMINED = "und"

_WORD = re.compile(rf"[^\W\d_]{{1,{WORD_CHARS}}}")


class Numbers(dict):
    """word -> number, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def words_of(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numbers that are no digits (fractions, Roman numerals,
    circled ones): those part words."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def feature_rows(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature numbers (0: none) of words: lexicon entry, prefixes and suffixes of
    1 to 4 bytes, and every byte n-gram of length 2 and 3 of the first 32 bytes."""
    raw = [w.encode("utf-8", "replace") for w in words]
    n = len(raw)
    head = np.frombuffer(np.array(raw, f"S{WORD_BYTES}").tobytes(), np.uint8).reshape(n, WORD_BYTES).astype(np.uint64)
    tail = np.frombuffer(np.array([w[:-TAIL_BYTES - 1:-1] for w in raw], f"S{TAIL_BYTES}").tobytes(),
                         np.uint8).reshape(n, TAIL_BYTES).astype(np.uint64)
    columns = []

    def add(kind: int, codes: np.ndarray, there: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            hashed = mix64(codes + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15))
        columns.append(np.where(there, (hashed % np.uint64(FEATURES - 1)).astype(np.int64) + 1, 0))

    for part, kind in ((head, 10), (tail, 20)):
        code = np.zeros(n, np.uint64)
        for i in range(4):
            code = code << np.uint64(8) | part[:, i]
            add(kind + i, code, part[:, i] > 0)
    for i in range(WORD_BYTES - 1):
        two = head[:, i] << np.uint64(8) | head[:, i + 1]
        add(30, two, head[:, i + 1] > 0)
        if i < WORD_BYTES - 2:
            add(31, two << np.uint64(8) | head[:, i + 2], head[:, i + 2] > 0)
    entry = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, n)
    columns.append(np.where(entry > 0, FEATURES - 1 + entry, FEATURES))
    return np.stack(columns, axis=1)


@dataclass
class Layout:
    """Sequences side by side, longest first: the words at one position of all
    sequences that are that long lie together."""

    order: np.ndarray  # time-major place -> place in the concatenated words
    starts: np.ndarray  # first place of every position
    rank: np.ndarray  # sequence (by length) of every place
    by_length: np.ndarray  # rank -> sequence

    @classmethod
    def of(cls, lengths: np.ndarray) -> Layout:
        by_length = np.argsort(-lengths, kind="stable")
        sizes = lengths[by_length]
        first = (np.cumsum(lengths) - lengths)[by_length]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right") if longest else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        position = np.repeat(np.arange(longest), active)
        rank = np.arange(int(starts[-1])) - starts[position]
        return cls(first[rank] + position, starts, rank, by_length)


def forward_backward(emission: np.ndarray, layout: Layout, transition: np.ndarray,
                     initial: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of every word (time-major), and the summed marginals of label
    pairs on request. ``emission`` is time-major and positive (scores after exp)."""
    starts, steps = layout.starts, len(layout.starts) - 1
    alpha, beta = np.empty_like(emission), np.ones_like(emission)
    for t in range(steps):
        s, e = starts[t], starts[t + 1]
        a = emission[s:e] * (initial if t == 0 else alpha[starts[t - 1]:starts[t - 1] + e - s] @ transition)
        alpha[s:e] = a / a.sum(axis=1, keepdims=True)
    joint = np.zeros_like(transition) if pairs else None
    for t in range(steps - 1, 0, -1):
        s, e = starts[t], starts[t + 1]
        b = emission[s:e] * beta[s:e]
        before = slice(starts[t - 1], starts[t - 1] + e - s)
        if pairs:
            p = alpha[before][:, :, None] * transition[None] * b[:, None, :]
            joint += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ transition.T
        beta[before] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), joint


@dataclass
class Field:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray  # log scores

    def emissions(self, words: list[str], step: int = 4096) -> np.ndarray:
        """exp of the emission scores, scaled to a maximum of one."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        for i in range(0, len(words), step):
            s = self.weights[feature_rows(words[i:i + step], self.lexicon)].sum(axis=1)
            out[i:i + step] = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -30, 0))
        return out


def strung(texts: list[tuple[str, int]], train_words: int, seed: int = 5) -> tuple[list[list[str]], list[np.ndarray]]:
    """Sequences of three stretches each, from the texts in turn."""
    rng = np.random.default_rng(seed)
    pieces = []
    for text, lang in texts:
        words, at = words_of(text), 0
        while at < len(words):
            size = int(rng.integers(4, 40))
            pieces.append((words[at:at + size], lang))
            at += size
    sequences, labels, total = [], [], 0
    order = rng.permutation(len(pieces))
    for i in range(0, len(order), 3):
        part = [pieces[j] for j in order[i:i + 3]]
        sequences.append([w for words, _ in part for w in words])
        labels.append(np.concatenate([np.full(len(words), lang) for words, lang in part]))
        total += len(labels[-1])
        if total >= train_words:
            break
    return sequences, labels


def train(texts: list[tuple[str, str]], train_words: int = TRAIN_WORDS, epochs: int = EPOCHS,
          decay: float = 2e-3, rate: float = 0.3) -> Field | None:
    """Fit a field to ``(text, language)`` pairs; None if there are none."""
    langs = sorted({lang for text, lang in texts if words_of(text)})
    if not langs:
        return None
    k = len(langs)
    counts = [Counter() for _ in langs]
    numbered = [(text, langs.index(lang)) for text, lang in texts if lang in langs]
    for text, lang in numbered:
        counts[lang].update(words_of(text))
    common = sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    lexicon = {w: i + 1 for i, w in enumerate(common)}
    sequences, labels = strung(numbered, train_words * k)
    vocabulary = Numbers()
    word = np.array([vocabulary[w] for s in sequences for w in s])
    layout = Layout.of(np.array([len(s) for s in sequences]))
    gold = np.concatenate(labels)[layout.order]
    word = word[layout.order]
    rows = feature_rows(list(vocabulary), lexicon)
    size = FEATURES + len(lexicon)
    seen = np.zeros((size, k))
    weights, transition = np.zeros((size, k)), np.zeros((k, k))
    square, square_t = np.zeros((size, k)), np.zeros((k, k))
    starts = layout.starts
    told = np.zeros((k, k))
    for t in range(1, len(starts) - 1):
        n = starts[t + 1] - starts[t]
        np.add.at(told, (gold[starts[t - 1]:starts[t - 1] + n], gold[starts[t]:starts[t + 1]]), 1)
    onehot = np.eye(k)[gold]
    for _ in range(epochs):
        score = weights[rows].sum(axis=1)
        emission = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -30, 0))[word]
        gamma, joint = forward_backward(emission, layout, np.exp(transition), np.full(k, 1.0 / k), pairs=True)
        error = onehot - gamma
        by_word = np.stack([np.bincount(word, error[:, j], len(rows)) for j in range(k)], axis=1)
        for j in range(k):
            seen[:, j] = np.bincount(rows.ravel(), np.repeat(by_word[:, j], rows.shape[1]), size)
        gradient = seen / len(word) - decay * weights / size
        gradient[0] = 0  # the empty feature
        square = 0.9 * square + 0.1 * gradient ** 2
        weights += rate * 0.1 * gradient / (np.sqrt(square) + 1e-6)
        step = (told - joint) / len(word)
        square_t = 0.9 * square_t + 0.1 * step ** 2
        transition += rate * step / (np.sqrt(square_t) + 1e-6) * 0.3
    weights[0] = 0
    return Field(langs, lexicon, weights.astype(np.float32), transition)


def predict(texts: list[str], field: Field, table: Numbers, known: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """Language and score of texts; ``table`` and ``known`` keep the emissions
    of words seen before."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    k = len(field.langs)
    if not lengths.sum():
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if len(table) > WORDS_KEPT:
        table.clear()
        known[0] = np.zeros((0, k), np.float32)
    fresh = len(table)
    words = np.fromiter(map(table.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    if len(table) > fresh:
        new = list(table)[fresh:]
        known[0] = np.concatenate([known[0], field.emissions(new)])
    layout = Layout.of(lengths)
    gamma, _ = forward_backward(known[0][words[layout.order]], layout, np.exp(field.transition).astype(np.float32),
                                np.full(k, 1.0 / k, np.float32))
    n = len(texts)
    sums = np.empty((n, k))
    for j in range(k):
        sums[layout.by_length, j] = np.bincount(layout.rank, gamma[:, j], n)
    best = sums.argmax(axis=1)
    score = sums[np.arange(n), best] / np.maximum(lengths, 1)
    return ([field.langs[b] if size else UNDETERMINED for b, size in zip(best, lengths)],
            [float(min(1.0, s)) if size else 0.0 for s, size in zip(score, lengths)])


def held_out(id_col: str = "doc_id"):
    """Ids whose CRC-32 leaves 0 modulo 5, and null ids, are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int,
                   train_chars: int) -> list[tuple[str, str]]:
    """A bounded sample of the documents that may be learned from: in each
    language those whose id hash lies under a share that leaves about ``docs_per_lang``."""
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                         & (F.length(text_col) <= train_chars))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(docs_per_lang) / n)])
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    picked = usable.filter(unit < F.try_element_at(share, F.col(lang_col)))
    rows = picked.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.col(id_col).alias("i"))
    return [(r.t, r.l) for r in sorted(rows.collect(), key=lambda r: (r.l, r.i, r.t))]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             docs_per_lang: int = DOCS_PER_LANG, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    small_batches(docs.sparkSession)
    field = train(training_texts(docs, id_col, text_col, lang_col, docs_per_lang, train_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if field is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        table, known = Numbers(), [np.zeros((0, len(learned.langs)), np.float32)]
        for batch in text_slices(batches, slice_bytes=SLICE):
            langs, scores = predict(batch.column(2).to_pylist(), learned, table, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
