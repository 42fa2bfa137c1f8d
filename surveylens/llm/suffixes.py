"""Repeated substrings of a corpus by suffix sorting, and their removal.

A window is ``width`` bytes of a text; it is repeated if the same bytes also start anywhere else, in the same
text or another. Every byte that a repeated window covers goes.

* Each window has an anchor: the smallest hash of its ``GRAM``-byte grams. Equal windows have equal
  anchors. Consecutive windows of one anchor are a segment (at most ``RUN`` windows); its text is that of its windows.
* Anchors that come once have no repeated window. Of the others, equal segments are counted first, before any
  shuffle, so a passage of a third of all texts is one segment with a number of copies.
* The texts of the different segments are dealt by anchor into shards of about ``SHARD_BYTES``. An anchor with more
  than ``HOT_BYTES`` is divided by the hash of its whole windows, so no shard grows with one passage.
* A shard is one text, its segments parted by a separator, whose suffixes are put in order by ``induced.sort_suffixes``,
  an external induced sort that carries common prefixes. Windows that share ``width`` bytes with a neighbour in that
  order are repeated, as are all windows of a segment with copies.
* The places go back to the segments of all documents, and from there to spans of bytes.

Spans may part a multi-byte character, so what is kept is bytes. Null texts are empty; a text shorter than
a window has none. Rows that repeat id and text are each other's repeats. A null id is an id. Texts of any
length are worked on in pieces. Columns other than id and text are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, id_text, is_few, mix64, shards_for, small_batches, text_slices, utf8_flat
from surveylens.llm.induced import sort_suffixes

WIDTH = 200
GRAM = 32
RUN = 512
SHARD_BYTES = 1 << 19
#: Text of one anchor's different segments beyond which it is divided over several shards.
HOT_BYTES = 1 << 22
#: Bytes of text that are hashed at once; places within it fit ``PLACE_BITS``.
PIECE, PLACE_BITS = 1 << 18, 21

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


class Hasher:
    """Hashes of all grams of a piece: a polynomial over its bytes, mixed."""

    def __init__(self, size: int):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(size, MULTIPLIER))
            self.down = np.cumprod(np.full(size, INVERSE))

    def grams(self, flat: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.up[:len(flat)], out=sums[1:])
            return mix64((sums[n:] - sums[:-n]) * self.down[:len(flat) - n + 1])


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values: of the end of one block and the beginning of the next."""
    n = len(values) - w + 1
    blocks = np.concatenate([values, np.full(-len(values) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def anchor_runs(flat: np.ndarray, hasher: Hasher, width: int = WIDTH, gram: int = GRAM):
    """``start, count, anchor, twice`` of the runs of windows of a piece with one anchor;
    ``twice``: the anchor's gram is found more than once in the run, which may then repeat itself."""
    n = len(flat) - width + 1
    grams = hasher.grams(flat, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    first = (_sliding_min(grams & ~low | place, width - gram + 1) & low).astype(np.int64)[:n]
    last = (low - (_sliding_min(grams & ~low | (low - place), width - gram + 1) & low)).astype(np.int64)[:n]
    anchor = grams[first]
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, n))
    return start, count, anchor[start], first[start] != last[start + count - 1]


def _cut(start: np.ndarray, count: np.ndarray, *more: np.ndarray):
    """Runs of more than ``RUN`` windows as several."""
    pieces = -(-count // RUN)
    row = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return start[row] + k * RUN, np.minimum(count[row] - k * RUN, RUN), *(x[row] for x in more)


SEGMENTS = "array<struct<anchor: long, segment: long, start: long, count: int, twice: boolean>>"


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """``row, doc_id, hash, segments`` of every document, without its text."""

    def of_text(flat: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
        found = []
        for at in range(0, len(flat) - width + 1, PIECE):
            piece = flat[at:at + PIECE + width - 1]
            start, count, anchor, twice = _cut(*anchor_runs(piece, hasher, width, min(GRAM, width)))
            data = piece.tobytes()
            segment = np.fromiter((xxhash.xxh3_64_intdigest(data[s:s + c + width - 1]) for s, c in zip(start.tolist(), count.tolist())),
                                  np.uint64, len(start))
            found.append((anchor.view(np.int64), segment.view(np.int64), start + at, count.astype(np.int32), twice))
        return [np.concatenate(x) for x in zip(*found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + width)
        fields = [("anchor", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("twice", pa.bool_())]
        for batch in text_slices(batches):
            flat, offsets = utf8_flat(batch.column(2))
            parts, ends = [], [0]
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if e - s >= width:
                    parts.append(of_text(flat[s:e], hasher))
                ends.append(ends[-1] + (len(parts[-1][0]) if e - s >= width else 0))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * len(fields)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                                fields=[pa.field(*f) for f in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                                             ["doc_id", "hash", "segments"])

    rows = docs.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id long, hash long, segments {SEGMENTS}")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def _with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) joined with ``found`` by ``doc_id, hash``; where few texts are
    asked for, the others are not shuffled."""
    asked = found.select("hash").distinct()
    if is_few(asked):
        docs = docs.join(F.broadcast(asked), "hash", "left_semi")
    right = found.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).drop("_id", "_hash")


def _shard_rows(texts: DataFrame, shards: int, width: int) -> DataFrame:
    """The texts of segments, dealt into shards; one whose anchor has ``parts`` is divided by
    the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                for s in segments:
                    own = data[s["start"]:s["start"] + s["count"] + width - 1]
                    if s["parts"] == 1:
                        rows.append((s["anchor"], s["segment"], s["copies"], 0, 0, s["count"], own))
                        continue
                    part = [xxhash.xxh3_64_intdigest(own[i:i + width]) % s["parts"] for i in range(s["count"])]
                    begin = 0
                    for i in range(1, len(part) + 1):
                        if i == len(part) or part[i] != part[begin]:
                            rows.append((s["anchor"], s["segment"], s["copies"], part[begin], begin, i - begin, own[begin:i + width - 1]))
                            begin = i
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["anchor", "segment", "copies", "part", "at", "count", "data"])

    return texts.select("text", "segments").mapInArrow(
        run, "anchor long, segment long, copies long, part long, at int, count int, data binary").withColumn(
        "shard", F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)))


def repeated_windows(data: list[bytes], counts: np.ndarray, copies: np.ndarray, width: int = WIDTH, **limits):
    """For segments with so many windows and copies each: a flag for every place of their joined
    texts whose window is repeated, and the place where each segment begins."""
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int(lengths.sum()) + len(data) + 1, np.uint16)  # 0: the end, 1: between segments, bytes from 2 on
    symbols[:-1] = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    symbols[:-1] += 2
    symbols[begin + lengths] = 1
    hit = np.zeros(len(symbols), bool)
    for places, prefixes in sort_suffixes(symbols, width, **limits):
        same = np.flatnonzero(prefixes >= width)
        hit[places[same]] = True
        hit[places[same - 1]] = True
    window, whole = np.zeros(len(symbols), np.int8), np.zeros(len(symbols), np.int8)
    window[begin], whole[begin[copies > 1]] = 1, 1
    window[begin + counts] -= 1
    whole[(begin + counts)[copies > 1]] -= 1
    return (hit | (np.cumsum(whole) > 0)) & (np.cumsum(window) > 0), begin


def _sorted_shards(rows: DataFrame, width: int) -> DataFrame:
    """``anchor, segment, ranges``: places of repeated windows of every segment that has any."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows["count"].to_numpy(np.int64)
        hit, begin = repeated_windows(rows["data"].tolist(), counts, rows.copies.to_numpy(), width)
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run of places ends with its segment: behind the last window there are more bytes
        row = np.searchsorted(begin, first, "right") - 1
        shift = rows["at"].to_numpy(np.int64)[row] - begin[row]
        return pd.DataFrame({"anchor": rows.anchor.to_numpy()[row], "segment": rows.segment.to_numpy()[row],
                             "first": first + shift, "end": end + shift})

    return rows.groupBy("shard").applyInPandas(run, "anchor long, segment long, first long, end long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, hash, spans``: of the texts (by id and ``xxhash64``) with repeated windows, the
    bytes that those cover, as maximal spans ``begin, end`` in order."""
    if width < 8:
        raise ValueError(f"width {width} is too small for anchors")
    small_batches(docs.sparkSession)
    texts = id_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    by_row = _segments(texts, width)
    each = by_row.select("row", F.inline("segments"))
    often = each.groupBy("anchor").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).filter("n > 1").select("anchor")
    kept = cut_lineage(each.drop("twice").join(often, "anchor", "left_semi"))
    # different segments, each with one row that holds it
    different = kept.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "count")).alias("one"))
    different = cut_lineage(different.select("anchor", "segment", "copies", "one.*"))
    length = F.col("count") + F.lit(width - 1)
    total = different.agg(F.sum(length)).first()[0] or 0
    # divided, a segment falls apart into its windows, nearly
    hot = different.groupBy("anchor").agg(F.sum(length).alias("bytes"), F.sum(F.col("count") * F.lit(width).cast("long")).alias("windows")).filter(
        F.col("bytes") > hot_bytes).select("anchor", F.greatest(F.ceil(F.col("windows") / shard_bytes), F.lit(2)).alias("parts"))
    divided = different.join(F.broadcast(hot) if is_few(hot) else hot, "anchor", "left_semi").agg(F.sum("count")).first()[0] or 0
    shards = shards_for(total + divided * width, shard_bytes)
    sized = different.join(F.broadcast(hot) if is_few(hot) else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    ids = by_row.select("row", "doc_id", "hash")
    asked = sized.groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "copies", "start", "count", "parts")).alias("segments"))
    held = _with_texts(texts, cut_lineage(asked.join(ids, "row").drop("row")))
    ranges = _sorted_shards(_shard_rows(held, shards, width), width)
    # a segment's ranges, in one row, go to all rows that hold the segment
    ranges = cut_lineage(ranges.groupBy("anchor", "segment").agg(F.collect_list(F.struct("first", "end")).alias("ranges")))
    covered = F.transform("ranges", lambda r: F.struct((F.col("start") + r["first"]).alias("begin"),
                                                       (F.col("start") + r["end"] + width - 1).alias("end")))
    spans = kept.join(ranges, ["anchor", "segment"]).select("row", covered.alias("spans")).groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # rows that repeat id and text have the same spans
    return cut_lineage(spans.join(ids, "row").groupBy("doc_id", "hash").agg(F.first("spans").alias("spans")))


REMOVED = "array<struct<begin: long, end: long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, removed`` (maximal spans) and ``kept``, the bytes that stay."""
    spans = repeated_spans(docs, id_col, text_col, width, shard_bytes, hot_bytes)
    texts = id_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            removed, kept, sizes = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, merged = text.encode("utf-8", "replace"), []
                for span in spans:
                    if merged and span["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], span["end"])
                    else:
                        merged.append(dict(span))
                edges = [0, *(x for s in merged for x in (s["begin"], s["end"])), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(merged)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    schema = f"doc_id long, n_bytes long, removed {REMOVED}, kept binary"
    cut = _with_texts(texts, spans).select("doc_id", "text", "spans").mapInArrow(run, schema)
    ids = spans.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    whole = texts.join(F.broadcast(ids) if is_few(ids) else ids, same, "left_anti")
    return cut.unionByName(whole.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(REMOVED).alias("removed"),
        F.col("text").cast("binary").alias("kept")))
