"""Spelling variants of a corpus by dense prefix-suffix tiling.

``vocabulary`` counts the words of all texts. Two words are near if one inserted, deleted
or replaced code point parts them: then their common prefix and common suffix together reach the
longer length less one. A tile holds words as padded code-point matrices, one aligned left and one
right, and compares a block of words with another block at once: prefix and suffix lengths of all
their pairs, from which the near ones follow.

Which blocks meet: the place of the edit lies in the front or the back half of the longer word, so near
words share all of the other half. A bucket is a range of places and the text around it; each word
stands in the buckets of both halves, for its own length and for the next. A bucket of
more than ``BLOCK`` words is divided: its range is halved, which puts more text into the keys, until
it is small or its range is one place (then all its words are near, and there are no more of them
than letters and one). So no bucket grows with the corpus. A pair counts in the bucket whose range
holds the end of its common prefix, once. A tile gives counts and the best neighbour of each of its
words, never pairs.

A word's form is its near word of largest count, if that is at least twice its own; roots are passed
from forms to their words, one step at a time: a form has no more words than one edit away.

Null texts have no words; ids may be null (``None`` in the check sum's text is empty) and repeat, every
row counts. Words and texts may be of any length. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, id_text, rows_with_ids, rows_without_ids, shards_for, small_batches, text_slices

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many, by its check sum, loses a code point.
TYPO = 97
#: Words of a block; a bucket with more is divided.
BLOCK = 256
#: Cells of a tile that are compared at once.
CELLS = 1 << 20
#: Words that one group of buckets holds, about.
SLOT_WORDS = 1 << 13
#: Different words that a task counts before it hands them on.
TABLE_WORDS = 1 << 17

RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def word_of(run: str, prefix_crc: int, typo: int = TYPO) -> str:
    """The run as a word: one code point goes where ``typo`` divides the check sum of ``<id>:<run>``."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words with ``LEAST_LENGTH`` code points and ``least_count`` occurrences or more."""
    small_batches(docs.sparkSession)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower touches A-Z only
                runs = Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode()))
                for word, n in runs.items():
                    counts[word_of(word, prefix)] += n
                if len(counts) >= TABLE_WORDS:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return id_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").filter(
        F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, aligned left and aligned right, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, place] = flat
    right[row, np.repeat(lengths, lengths) - 1 - place] = flat
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``a`` with every row of ``b``
    (padding of both agrees too)."""
    total = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones((len(a), len(b)), bool)
    step = max(1, CELLS // (len(a) * len(b)))
    for at in range(0, a.shape[1], step):
        same = a[:, None, at:at + step] == b[None, :, at:at + step]
        total += alive * np.where(same.all(axis=2), same.shape[2], same.argmin(axis=2))
        alive &= same.all(axis=2)
        if not alive.any():
            break
    return total


def tile(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a block of words against another: which pairs are near, and their common prefixes."""
    left, right, length = _matrices([*a, *b])
    n = len(a)
    longer = np.maximum(length[:n, None], length[None, n:])
    prefix = np.minimum(_common(left[:n], left[n:]), np.minimum(length[:n, None], length[None, n:]))
    suffix = np.minimum(_common(right[:n], right[n:]), np.minimum(length[:n, None], length[None, n:]))
    apart = np.abs(length[:n, None] - length[None, n:])
    # the prefix and suffix of equal words overlap: those are no pair
    equal = (apart == 0) & (prefix == longer)
    return (apart <= 1) & ~equal & (prefix + suffix >= longer - 1), prefix


def _key(word: Column, length: Column, low: Column, high: Column) -> Column:
    """A bucket: the longer length, the range of places, and the text before and after it."""
    n = F.char_length(word)
    return F.xxhash64(length, low, high, F.substring(word, F.lit(1), low),
                      F.substring(word, n - (length - high) + 1, length - high))


def _divided(rows: DataFrame) -> DataFrame:
    """Both halves of the rows' ranges."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    return rows.withColumn("half", F.explode(halves)).select(
        "word", "n", "length", F.col("half.low").alias("low"), F.col("half.high").alias("high"))


def _buckets(words: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``key, length, low, high, word, n`` of the buckets with two words or more, none of which is
    larger than a block unless its range is one place; and the number of rows."""
    n = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n + 1)).alias("length")).withColumn(
        "low", F.lit(0)).withColumn("high", F.col("length"))
    rows, done, total = _divided(rows), None, 0
    while True:
        rows = cut_lineage(rows.withColumn("key", _key(F.col("word"), F.col("length"), F.col("low"), F.col("high"))))
        sizes = cut_lineage(rows.groupBy("key", (F.col("high") - F.col("low")).alias("places")).agg(
            F.count(F.lit(1)).alias("size")).filter("size > 1"))
        large = sizes.filter((F.col("size") > block) & (F.col("places") > 1)).select("key")
        open_ = rows_with_ids(rows, large, "key")
        kept = rows_with_ids(rows_without_ids(rows, large, "key"), sizes.select("key"), "key")
        done = kept if done is None else done.unionByName(kept)
        total += sizes.agg(F.sum("size")).first()[0] or 0
        if not large.limit(1).count():
            return done, total
        rows = _divided(open_)


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` of the words (``word, n``) with a near one; the best has the largest
    count, then the smallest text."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        key, low, high, longer = (rows[c].to_numpy() for c in ("key", "low", "high", "length"))
        word, count = rows.word.tolist(), rows.n.to_numpy()
        length = np.fromiter(map(len, word), np.int64, len(word))
        order = np.empty(len(word), np.int64)  # by count, then by text from the largest on: the last one is the best
        order[np.lexsort((-np.argsort(np.argsort(np.array(word, object))), count))] = np.arange(len(word))
        rank_to_row = np.argsort(order)
        near_count, best = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        # small buckets share a block, a larger one has blocks of its own
        at = 0
        while at < len(starts):
            last = at
            while last + 1 < len(starts) and ends[last + 1] - starts[at] <= block:
                last += 1
            spans = [(s, min(s + block, ends[last])) for s in range(starts[at], ends[last], block)]
            for i, (s, e) in enumerate(spans):
                for t, u in spans[i:]:
                    near, prefix = tile(word[s:e], word[t:u])
                    near &= (key[s:e, None] == key[None, t:u]) & (prefix >= low[s:e, None]) & (prefix < high[s:e, None])
                    near &= np.maximum(length[s:e, None], length[None, t:u]) == longer[s:e, None]
                    for near, (a, b), (c, d) in ((near, (s, e), (t, u)), *([(near.T, (t, u), (s, e))] if t > s else [])):
                        near_count[a:b] += near.sum(axis=1)
                        best[a:b] = np.maximum(best[a:b], np.where(near, order[None, c:d], -1).max(axis=1, initial=-1))
            at = last + 1
        hit = np.flatnonzero(near_count)
        chosen = rank_to_row[best[hit]]
        return pd.DataFrame({"word": [word[i] for i in hit], "n_near": near_count[hit], "best_n": count[chosen],
                             "best": [word[i] for i in chosen]})

    placed, total = _buckets(words, block)
    slots = shards_for(total, SLOT_WORDS)
    found = placed.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).groupBy("slot").applyInPandas(
        run, "word string, n_near long, best_n long, best string")
    # largest count, then smallest text: the minimum of (-count, text)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (``word, form``)."""
    spark = forms.sparkSession
    tops = forms.select(F.col("form").alias("word")).distinct().join(forms.select("word"), "word", "left_anti")
    front, found = cut_lineage(tops.withColumn("root", F.col("word"))), spark.createDataFrame([], "word string, root string")
    while front.limit(1).count():
        front = cut_lineage(forms.join(front.withColumnRenamed("word", "form"), "form").select("word", "root"))
        found = found.unionByName(front)
    return found


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT,
             block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = cut_lineage(vocabulary(docs, id_col, text_col, least_count))
    near = words.join(neighbours(words, block), "word", "left")
    leads = F.col("best_n") >= 2 * F.col("n")
    rows = cut_lineage(near.select("word", F.when(leads, F.col("best")).alias("form"), "n",
                                   F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                   F.when(leads, F.col("best_n")).alias("form_n")))
    roots = _roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
