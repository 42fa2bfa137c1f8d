"""Quality rules on repetition.

For every whole text: plain counts (words, code points in words, symbols,
repeated lines, words in repeated three-word windows) and the coverage by
repetition - the share of a text's word characters that lie inside n-grams
(several lengths, found by rolling hashes in numpy) or lines which occur before
in the same text. A text passes when it has at least ``MIN_WORDS`` words, at most
half of its words in repeated windows, and no coverage above its limit.

All texts of an Arrow slice are worked on together: an n-gram's key is its
rolling hash mixed with the number of its text, and one sort finds the repeats.

Null and empty texts have no words and fail. Repeated rows get one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveylens.llm.common import id_text, mix64, runs, text_slices, utf8_flat
from surveylens.llm.words import MULTIPLIER, WordHashes

MIN_WORDS = 50
WINDOW = 3
MAX_REPEAT_PERCENT = 50
#: Largest share of word characters inside repeated n-grams, by n-gram length.
COVERAGE = {3: 0.5, 5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of word characters on repeated lines, and of symbols per word.
LINE_COVERAGE = 0.30
SYMBOLS_PER_WORD = 0.10

# fixed values: bytes that separate words, and symbols that are counted
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_ngram_share array<double>, dup_line_share double, base_failed boolean, kept boolean")


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them not for the first time."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-word windows that begin where ``starts`` is true."""
    edge = np.zeros(size + n + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge)[:size] > 0


def measure(flat: np.ndarray, offsets: np.ndarray, table: WordHashes) -> dict[str, np.ndarray]:
    """The counts and shares of the texts ``flat[offsets[i]:offsets[i + 1]]``."""
    texts = len(offsets) - 1
    data = flat.tobytes()
    space = _table(SPACES)[flat]
    begin, end = runs(flat, ~space, offsets)
    text = np.searchsorted(offsets, begin, side="right") - 1
    n_words = np.bincount(text, minlength=texts)
    # code points: bytes that do not continue a character
    points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    chars = points[end] - points[begin]
    word_chars = np.bincount(text, chars, texts).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_table(SYMBOLS)[flat])])
    n_symbols = marks[offsets[1:]] - marks[offsets[:-1]]

    words = np.concatenate([table.of(data[s:e].split()) for s, e in zip(offsets[:-1], offsets[1:])] or [np.zeros(0, np.uint64)])
    salt = mix64(text.astype(np.uint64) + np.uint64(1))
    shares, n_repeat = np.zeros((texts, len(COVERAGE))), np.zeros(texts, np.int64)
    rolling, length = words.copy(), 1
    total = np.maximum(word_chars, 1)
    for column, n in enumerate(COVERAGE):
        with np.errstate(over="ignore"):
            while length < n and len(rolling) > 1:  # lengthen every window by a word
                rolling = rolling[:-1] * MULTIPLIER + words[length:]
                length += 1
        if length < n or not len(rolling):
            break
        inside = text[:len(rolling)] == text[n - 1:]
        at = np.flatnonzero(inside)
        twice, later = _repeated(mix64(rolling[at]) ^ salt[at])
        starts = np.zeros(len(words), bool)
        if n == WINDOW:
            starts[at[twice]] = True
            n_repeat = np.bincount(text[_covered(starts, n, len(words))], minlength=texts)
            starts[:] = False
        starts[at[later]] = True
        covered = _covered(starts, n, len(words))
        shares[:, column] = np.bincount(text[covered], chars[covered], texts) / total

    n_lines, line_chars = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    for i in range(texts):
        seen: set[bytes] = set()
        for line in data[offsets[i]:offsets[i + 1]].split(b"\n"):
            if line in seen:
                n_lines[i] += 1
                line_chars[i] += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            elif line.strip(SPACES):
                seen.add(line)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_lines,
            "n_repeat_words": n_repeat, "shares": shares, "line_share": line_chars / total}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, coverage and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        limits = np.array(list(COVERAGE.values()))
        for batch in text_slices(batches):
            m = measure(*utf8_flat(batch.column(1)), table)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            bad = ((m["shares"] > limits).any(axis=1) | (m["line_share"] > LINE_COVERAGE)
                   | (m["n_symbols"] > SYMBOLS_PER_WORD * m["n_words"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(m[k].astype(np.int64)) for k in (
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [pa.array(list(m["shares"]), pa.list_(pa.float64())), pa.array(m["line_share"]),
                   pa.array(failed), pa.array(~failed & ~bad)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "dup_ngram_share", "dup_line_share", "base_failed", "kept"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
