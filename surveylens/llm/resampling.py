"""Quality by importance resampling over hashed n-gram models.

Two generative models count hashed n-grams: the target model those of documents
labelled good (a bounded sample of ``target_docs`` labels), the raw model those
of all documents. A document's log weight is the sum over its n-grams of
``log p_target - log p_raw``. N-grams are taken over words and over word forms
(letter case and the marks around a word, and whether it repeats its
predecessor), one and two at a time.

The bar is the weight per n-gram that separates the labels at the least cost,
a lost good document costing ``GOOD_COST`` kept bad ones; of equal choices the
middle. Resampling without replacement is a Gumbel top-k: a standard Gumbel
variate, made from a hash of the id, is added to ``SHARPNESS * (log weight -
bar * n-grams)``, and the ``k`` largest sums stay, ``k`` being by default the
number of documents that reach the bar. The k-th largest key is found by four
counting passes over 16-bit digits, so nothing is sorted or collected; keys
that tie with it stay.

Null and empty texts have no n-grams and a weight of 0. Without labels of both
kinds every document is kept. Documents with several labels are good if all of
them say so. Repeated rows get one row each. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, id_text, mix64, rows_without_ids, text_slices, utf8_flat
from surveylens.llm.words import MULTIPLIER

BUCKETS = 1 << 16
#: Labelled documents that the target model counts, those of the smallest id hashes.
TARGET_DOCS = 50_000
#: Pseudo-count of every bucket.
SMOOTHING = 1.0
GOOD_COST = 20
SHARPNESS = 4.0
#: Bins, and range of the weight per n-gram, that the bar is looked for in.
GRID, RANGE = 4000, 20.0
SEED = 11
#: Words whose hashes a task remembers; their forms cost more than a hash.
TABLE_WORDS = 1 << 18
#: Keys are kept in steps of 1 / KEY_STEPS.
KEY_STEPS = 1 << 20

_MARKS = re.compile(rb"^([^\w\x80-\xff]*)(.*?)([^\w\x80-\xff]*)$", re.DOTALL)


def word_form(word: bytes) -> int:
    """Hash of a word's form: case class, and the marks around it."""
    before, core, after = _MARKS.match(word).groups()
    text = core.decode("utf-8", "replace")
    case = (b"digit" if any(c.isdigit() for c in text) else b"upper" if text.isupper() and len(text) > 1
            else b"title" if text[:1].isupper() else b"lower" if text else b"none")
    return xxhash.xxh3_64_intdigest(before[-4:] + b"\0" + case + b"\0" + after[:4])


class WordTable(dict):
    """word -> number; ``hashes`` and ``forms`` hold the hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.forms = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.hashes):
            self.hashes, self.forms = np.resize(self.hashes, 2 * number), np.resize(self.forms, 2 * number)
        self.hashes[number], self.forms[number] = xxhash.xxh3_64_intdigest(word), word_form(word)
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > TABLE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ngrams(flat: np.ndarray, offsets: np.ndarray, table: WordTable,
           buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of the texts: words and forms,
    one and two at a time. The four kinds share the buckets, salted."""
    data, words, counts = flat.tobytes(), [], []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        split = data[s:e].split()
        words += split
        counts.append(len(split))
    text = np.repeat(np.arange(len(counts)), counts)
    number = table.of(words)
    word, form = table.hashes[number], table.forms[number]
    joined = text[1:] == text[:-1]
    with np.errstate(over="ignore"):
        form[1:] += ((word[1:] == word[:-1]) & joined).astype(np.uint64)  # repeats its predecessor
        parts = [word, form, (word[:-1] * MULTIPLIER + word[1:])[joined], (form[:-1] * MULTIPLIER + form[1:])[joined]]
        hashed = [mix64(p + np.uint64(k + 1) * MULTIPLIER) for k, p in enumerate(parts)]
    bucket = (np.concatenate(hashed) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.concatenate([text, text, text[1:][joined], text[1:][joined]])


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target`` over all ``(text, target)`` rows; a task sends
    one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, table = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), WordTable()
        for batch in text_slices(batches):
            bucket, text = ngrams(*utf8_flat(batch.column(0)), table, buckets)
            good = np.array(batch.column(1).to_pylist(), bool)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[good[text]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])

    return rows.select("text", "target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: pd.DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """``log p_target - log p_raw`` of every bucket."""
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    raw[counts.bucket] += counts.raw
    target[counts.bucket] += counts.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighted(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id, n_ngrams, log_weight`` of ``(doc_id, text)`` rows."""
    model = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, table = model.value, WordTable()
        for batch in text_slices(batches):
            bucket, text = ngrams(*utf8_flat(batch.column(1)), table, len(ratios))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, ratios[bucket], n).astype(np.float64))],
                ["doc_id", "n_ngrams", "log_weight"])

    return rows.mapInArrow(run, "doc_id long, n_ngrams long, log_weight double")


def per_ngram():
    return F.col("log_weight") / F.greatest("n_ngrams", F.lit(1))


def find_bar(scored: DataFrame, labels: DataFrame, good_cost: float = GOOD_COST) -> float | None:
    """Weight per n-gram that separates ``labels (doc_id, good)`` at the least
    cost; None without labels of both kinds."""
    step = 2 * RANGE / GRID
    place = F.floor((F.greatest(F.least(per_ngram(), F.lit(RANGE - step)), F.lit(-RANGE)) + RANGE) / step)
    seen = scored.filter("n_ngrams > 0").join(labels, "doc_id").groupBy(place.cast("int").alias("bin")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).toPandas()
    good, bad = np.zeros(GRID, np.int64), np.zeros(GRID, np.int64)
    good[seen.bin], bad[seen.bin] = seen.good, seen.bad
    if not good.sum() or not bad.sum():
        return None
    # cost of a bar at the lower end of each bin
    cost = good_cost * (np.cumsum(good) - good) + bad[::-1].cumsum()[::-1]
    best = np.flatnonzero(cost == cost.min())
    run = best[:1 + int((np.diff(best) == 1).cumprod().sum())]  # the first stretch of equal cost
    return -RANGE + step * float(run[0] + run[-1]) / 2


def gumbel(seed: int = SEED):
    """Standard Gumbel variates from a hash of the id."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The ``k``-th largest value of a long column (None: there are fewer), by
    counting passes over 16-bit digits, each of at most 65,536 counts."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.filter(F.shiftright(F.col(key), shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(F.col(key), shift).alias("digit")).count().toPandas()
        counts = counts.sort_values("digit", ascending=False)
        total = counts["count"].cumsum().to_numpy()
        if not len(total) or total[-1] < left:
            return None
        at = int(np.searchsorted(total, left))
        left -= int(total[at - 1]) if at else 0
        prefix = int(counts["digit"].iloc[at])
    return prefix


def target_ids(labels: DataFrame, target_docs: int) -> DataFrame:
    """At most ``target_docs`` good ids (of the smallest hashes)."""
    hashed = labels.filter("good").select("doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("_h"))
    return hashed.orderBy("_h", "doc_id").limit(target_docs).select("doc_id", F.lit(True).alias("target"))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             quality_col: str = "quality", k: int | None = None, target_docs: int = TARGET_DOCS,
             seed: int = SEED) -> DataFrame:
    """``doc_id, n_ngrams, log_weight, gumbel_key, kept`` of every document."""
    rows = id_text(docs, id_col, text_col)
    known = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg((F.min(quality_col) == 1).alias("good"))
    # at most target_docs ids of eight bytes: small by its limit
    chosen = F.broadcast(target_ids(known, target_docs))
    marked = rows.join(chosen, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    ratio = log_ratio(bucket_counts(marked).toPandas())
    scored = cut_lineage(weighted(rows, ratio))
    bar = find_bar(scored, known)
    shift = F.lit(0.0 if bar is None else bar) * F.col("n_ngrams")
    key = F.round((SHARPNESS * (F.col("log_weight") - shift) + gumbel(seed)) * KEY_STEPS).cast("long")
    keyed = scored.withColumn("key", key)
    if k is None and bar is not None:
        k = keyed.filter(F.col("log_weight") >= shift).count()
    least = kth_largest(keyed, "key", k) if k else None
    kept = F.lit(k != 0) if least is None else F.col("key") >= least
    return keyed.select("doc_id", "n_ngrams", "log_weight", (F.col("key") / KEY_STEPS).alias("gumbel_key"),
                        kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with all columns. Rows that
    share an id go together; rows without one stay."""
    lost = resample(docs, labels, id_col, **settings).filter(~F.col("kept")).select("doc_id").distinct()
    return rows_without_ids(docs, cut_lineage(lost), id_col)
