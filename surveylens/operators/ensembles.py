"""Random forests of full trees, grown out of core, and the statistics of single splits.

``fit_stored_forest`` bins every feature (``max_bins`` cut points at most) and keeps the coded rows in the
checkpoint folder, in the order of their codes and in chunks: all rows of a cell (of equal codes) stand
together, in one chunk or in neighbouring ones, however many they are. A row's part in a tree, how often the
bootstrap draws it, is a hash of row, tree and seed, so it depends neither on tasks nor on partitions.
Trees grow in batches:

* A task draws the rows of its chunks for every tree and sums them by cell: what a tree takes on is
  its cells (and one more for each border between chunks), not its rows.
* Nodes of more than ``local_rows`` cells are split from histograms: every task adds up its cells per
  ``(tree, node, feature, bin)``, a group per node merges them, and only the chosen cuts reach the driver.
* Cells then walk down those cuts; what remains of a tree below a node, bounded by ``local_rows``, is one
  group, which grows it to the end (``grow_tree``).
* The subtrees of a batch are written to shared storage before the next begins.

Prediction sends the distinct codes of the rows, in chunks, to the subtrees they end in, and a group per chunk adds
up the trees. So no whole tree, row set or forest is ever held in the driver or broadcast, and what a lost
executor held is read or computed again.

``best_splits`` states the first split of a regression tree as one aggregate over
``(feature, value)``: the sums left of every cut, and the variance gain of each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import rows_of
from ..session import bounded_broadcast, ensure_checkpoint_dir

BATCH_TREES = 50
#: Cells of a node that one group may grow to the end; larger nodes are split from histograms.
LOCAL_ROWS = 1 << 19
#: Rows of a chunk, and chunks and least rows of a partition.
CHUNK_ROWS, CHUNKS, LEAST_ROWS = 1 << 17, 8, 1 << 14
#: Bytes of cells that a task gathers before it hands them on.
SENT_BYTES = 1 << 24
#: Cells that are predicted together.
SCORE_CELLS = 1 << 12
MAX_TASKS = 4096
BINS = 256  # a code is a byte

#: How often a bootstrap of many rows draws one row: cumulative Poisson(1), of 53 bits.
DRAWS = [math.ceil(float(x) * 2.0 ** 53) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])]


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Number of times that the bootstrap of ``tree`` draws each row id."""
    with np.errstate(over="ignore"):
        x = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed * 0x2545F4914F6CDD1D + tree * 0xD1342543DE82EF95) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    out = np.zeros(len(x), np.uint8)
    for least in DRAWS:
        more = x >= np.uint64(least)
        if not more.any():
            break
        out += more
    return out


@dataclass
class Tree:
    """Nodes in arrays: rows whose code of ``feature`` is at most ``cut`` go to ``left``, others to
    the node after it; ``feature`` is -1 in a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row of codes."""
        node = np.zeros(len(codes), np.int64)
        open_ = np.flatnonzero(self.feature[node] >= 0)
        while len(open_):
            at = node[open_]
            node[open_] = self.left[at] + (codes[open_, self.feature[at]] > self.cut[at])
            open_ = open_[self.feature[node[open_]] >= 0]
        return node

    def importance(self, size: int) -> np.ndarray:
        inner = self.feature >= 0
        return np.bincount(self.feature[inner], self.gain[inner], size)


def _first_best(gain: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest gain of each node and the first candidate that reaches it, but for rounding;
    candidates are ordered by node."""
    best, at = np.zeros(n), np.full(n, -1, np.int64)
    if len(gain):
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        best[node[start]] = np.maximum.reduceat(gain, start)
        near = np.flatnonzero(gain >= best[node] * (1 - 1e-9))
        first = near[np.concatenate([[True], node[near][1:] != node[near][:-1]])]
        at[node[first]] = first
    return best, at


def _sums_gain(lw: np.ndarray, ly: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a cut takes off the sum of squares, over the weight of the node, from weights and sums left of it and in all."""
    off = ly - lw * (y / np.maximum(w, 1e-300))
    both = lw * (w - lw)
    off *= off
    return np.divide(off, both, out=np.zeros_like(off), where=both > 0)


def grow_tree(codes: np.ndarray, w: np.ndarray, wy: np.ndarray, max_depth: int | None = None, least_gain: float = 0.0) -> Tree:
    """A tree over rows of codes with weights and weighted labels, all its levels at once: the rows are
    sorted by node and code for each feature, and running sums give every cut's gain."""
    width = codes.max(axis=0).astype(np.int64) + 1
    columns = codes.T.astype(np.int64)
    feature, cut, left, value, gains = [], [], [], [], []
    node, n, total, depth = np.zeros(len(codes), np.int64), 1, 0, 0
    while n:
        all_w, all_y = np.bincount(node, w, n), np.bincount(node, wy, n)
        best, chosen, place = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if max_depth is None or depth < max_depth:
            for f, column in enumerate(columns):
                if width[f] < 2:
                    continue
                if n * width[f] <= 2 * len(node) + 4096:  # few enough cells: a histogram, else sorted rows
                    key = node * width[f] + column
                    sum_w, sum_y = (np.bincount(key, x, n * width[f]).reshape(n, -1)[:, :-1].cumsum(axis=1) for x in (w, wy))
                    gain = _sums_gain(sum_w, sum_y, all_w[:, None], all_y[:, None])
                    top = gain.max(axis=1, initial=0.0)
                    first = code = (gain >= top[:, None] * (1 - 1e-9)).argmax(axis=1)
                else:
                    key = node * BINS + column
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    sum_w, sum_y = np.cumsum(w[order]), np.cumsum(wy[order])
                    of = key // BINS
                    at = np.flatnonzero((key[1:] != key[:-1]) & (of[1:] == of[:-1]))
                    begin = np.searchsorted(of, np.arange(n))
                    before_w, before_y = (np.concatenate([[0.0], s])[begin] for s in (sum_w, sum_y))
                    k = of[at]
                    gain = _sums_gain(sum_w[at] - before_w[k], sum_y[at] - before_y[k], all_w[k], all_y[k])
                    top, first = _first_best(gain, k, n)
                    code = (key[at] % BINS)[first] if len(at) else first
                top = top * all_w
                better = (first >= 0) & (top > best * (1 + 1e-9)) & (top > least_gain)
                best[better], chosen[better] = top[better], f
                place[better] = code[better]
        split = chosen >= 0
        child = total + n + 2 * (np.cumsum(split) - 1)
        feature.append(chosen)
        cut.append(place)
        left.append(np.where(split, child, -1))
        value.append(all_y / np.maximum(all_w, 1e-300))
        gains.append(best)
        stay = np.flatnonzero(split[node])
        node, w, wy, columns = node[stay], w[stay], wy[stay], columns[:, stay]
        node = child[node] - (total + n) + (columns[chosen[node], np.arange(len(node))] > place[node])
        total, n, depth = total + n, 2 * int(split.sum()), depth + 1
    return Tree(*(np.concatenate(x) for x in (feature, cut, left, value, gains)))


def cut_points(rows: DataFrame, size: int, max_bins: int) -> list[np.ndarray]:
    """At most ``max_bins - 1`` cuts of each feature: midway between all its values if those are few, else
    at its approximate quantiles."""
    x = F.col("_x")
    few = max_bins - 1
    shares = F.array(*[F.lit((k + 1) / max_bins) for k in range(few)])
    aggs = [c for i in range(size) for c in (F.approx_count_distinct(x[i]).alias(f"n{i}"),
                                             F.percentile_approx(x[i], shares, 10_000).alias(f"q{i}"))]
    row = rows.select("_x").agg(*aggs).first()
    # an estimate may be off by some percent: such features are looked at, up to a bound
    small = [i for i in range(size) if row[f"n{i}"] <= 2 * max_bins]
    values: dict[int, list[float]] = {i: [] for i in small}
    if small:
        pairs = rows.select(rows_of(["i", "v"], [(F.lit(i), x[i]) for i in small])).distinct()
        for r in pairs.limit(len(small) * 4 * max_bins).collect():
            values[r.i].append(r.v)
    out = []
    for i in range(size):
        known = np.unique(values.get(i, []))
        if 0 < len(known) <= max_bins:
            out.append((known[1:] + known[:-1]) / 2)
        else:
            out.append(np.unique(np.array(row[f"q{i}"] or [], float)))
    return out


def _coded(rows: DataFrame, cuts: list[np.ndarray], columns: Sequence[str]) -> DataFrame:
    """``columns`` and ``code``, a byte for each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            codes = np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8) if n else x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _cells_column(codes)], [*columns, "code"])
    fields = rows.select(*columns).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code binary"
    return rows.select(*columns, "_x").mapInArrow(run, schema)


def _cells_column(codes: np.ndarray) -> pa.Array:
    """Rows of codes as an Arrow column."""
    n, size = codes.shape
    return pa.array([], pa.binary()) if not n else pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(size), n, [None, pa.py_buffer(np.ascontiguousarray(codes, np.uint8).tobytes())]).cast(pa.binary())


def _matrix(codes, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, size)


def _matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """The rows of codes of an Arrow column."""
    column = column.cast(pa.large_binary())
    begin = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[begin:begin + len(column) * size].reshape(-1, size)


def _merged(codes: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of codes with their sums."""
    size = codes.shape[1]
    if size <= 8:  # as one number, which sorts faster
        wide = np.zeros((len(codes), 8), np.uint8)
        wide[:, 8 - size:] = codes
        flat = wide.view(">u8").reshape(-1).astype(np.uint64)
    else:
        flat = np.ascontiguousarray(codes).view(np.dtype((np.void, size))).reshape(-1)
    _, first, at = np.unique(flat, return_index=True, return_inverse=True)
    return codes[first], *(np.bincount(at.reshape(-1), s, len(first)) for s in sums)


def tasks_for(frame: DataFrame, n: int, most: int, least: int = LEAST_ROWS) -> int:
    """Partitions for ``n`` rows: at most ``most`` rows in one; where that leaves cores idle more, but not of
    fewer than ``least`` rows."""
    spark = frame.sparkSession
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, math.ceil(n / most), min(cores, math.ceil(n / least)))


CHUNK_SCHEMA = "cells long, codes binary, starts binary, ids binary, w binary, wy binary"


def _chunks(coded: DataFrame, n: int, size: int) -> DataFrame:
    """``coded`` (``_row, _w, _wy, code``) by code, up to ``CHUNK_ROWS`` rows in a row: its ``cells`` (number, codes, and
    where the rows of each begin), row ids, weights and weighted labels. A cell of many rows goes on
    in the next partition, so its rows never meet in one task."""
    def packed(rows: pa.Table) -> pa.RecordBatch:
        ids, w, wy = (rows.column(i).to_numpy() for i in range(3))
        codes = _matrix_of(rows.column(3).combine_chunks(), size)
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
        arrays = (codes[starts], starts, ids, w, wy)
        return pa.RecordBatch.from_arrays([pa.array([len(starts)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
                                          ["cells", "codes", "starts", "ids", "w", "wy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, CHUNK_ROWS - count))
                batch = batch.slice(held[-1].num_rows)
                count += held[-1].num_rows
                if count == CHUNK_ROWS:
                    yield packed(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield packed(pa.Table.from_batches(held))

    parts = tasks_for(coded, n, CHUNKS * CHUNK_ROWS)
    by_code = coded.repartitionByRange(parts, "code", "_row").sortWithinPartitions("code", "_row")
    return by_code.mapInArrow(run, CHUNK_SCHEMA)


TREE_FIELDS = ("feature", "cut", "left", "value", "gain")
TREE_SCHEMA = ("tree int, node long, feature array<int>, cut array<int>, left array<long>, "
               "value array<double>, gain array<double>")
#: The arrays of a stored tree, each as its bytes, and its gains by feature.
STORED_SCHEMA = "tree int, node long, " + ", ".join(f"{f} binary" for f in TREE_FIELDS) + ", gains array<double>"
_PACKED = dict(zip(TREE_FIELDS, (np.int32, np.uint8, np.int32, np.float64, np.float64)))


def _stored(tree: Tree) -> dict[str, list[bytes]]:
    return {f: [getattr(tree, f).astype(t).tobytes()] for f, t in _PACKED.items()}


def _read(row) -> Tree:
    return Tree(*(np.frombuffer(row[f], t).astype(np.result_type(t, np.int64)) for f, t in _PACKED.items()))


@dataclass
class StoredForest:
    """Subtrees on shared storage, and the few cuts above them (``tops``, by tree)."""

    spark: SparkSession
    folder: str
    cuts: list[np.ndarray]
    tops: list[Tree]
    mean: float
    importance: np.ndarray

    @property
    def num_trees(self) -> int:
        return len(self.tops)

    @property
    def featureImportances(self) -> DenseVector:  # the name MLlib's models have
        return DenseVector(self.importance)

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/*")

    def subtrees(self) -> DataFrame:
        """``tree, node`` and the nodes of each subtree as arrays."""
        def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                trees = [_read(row) for _, row in frame.iterrows()]
                yield frame[["tree", "node"]].assign(**{f: [getattr(t, f) for t in trees] for f in TREE_FIELDS})
        return self.stored().mapInPandas(unpack, TREE_SCHEMA)

    def predict(self, rows: DataFrame, key: str | Sequence[str], features: str = "features") -> DataFrame:
        """``key`` (a column, or several) and ``prediction`` of ``rows``."""
        size, tops, mean, n_trees = len(self.cuts), self.tops, self.mean, self.num_trees
        keys = [key] if isinstance(key, str) else list(key)
        coded = _coded(rows.withColumn("_x", vector_to_array(features)), self.cuts, keys).checkpoint()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for i in range(0, batch.num_rows, SCORE_CELLS):
                    codes = _matrix_of(batch.column(0).slice(i, SCORE_CELLS), size)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([codes.tobytes()], pa.binary())], ["chunk", "codes"])
                    number += 1

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                    codes = _matrix([cells.as_py()], size)
                    out = []
                    for t, top in enumerate(tops):
                        leaf = top.walk(codes)
                        for k in np.unique(leaf).tolist():
                            at = np.flatnonzero(leaf == k).astype(np.int32)
                            out.append((t, k, chunk, at.tobytes(), codes[at].tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        ["tree", "node", "chunk", "at", "codes"])

        def score(key: tuple, cells: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            found: list[bytes] = []
            if len(cells) and len(trees):
                tree = _read(trees.iloc[0])
                found = [tree.value[tree.walk(_matrix([c], size))].tobytes() for c in cells.codes]
            return cells.iloc[:len(found)][["tree", "node", "chunk", "at"]].assign(scores=found)

        def add(key: tuple, scores: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            codes = _matrix(cells.codes, size)
            sums = np.zeros(len(codes))
            scores = scores.sort_values(["tree", "node"])  # one order of adding, however the rows came
            for at, values in zip(scores["at"], scores["scores"]):
                sums[np.frombuffer(at, np.int32)] += np.frombuffer(values)
            return pd.DataFrame({"code": [c.tobytes() for c in codes], "prediction": sums / n_trees + mean})

        chunks = coded.select("code").distinct().mapInArrow(pack, "chunk long, codes binary").checkpoint()
        cells = chunks.mapInArrow(spread, "tree int, node long, chunk long, at binary, codes binary")
        scores = cells.groupBy("tree", "node").cogroup(self.stored().groupBy("tree", "node")).applyInPandas(
            score, "tree int, node long, chunk long, at binary, scores binary")
        sums = scores.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInPandas(add, "code binary, prediction double").checkpoint()
        return coded.join(bounded_broadcast(sums), "code").select(*keys, "prediction")


def _batch_rows(chunks: DataFrame, tops: dict[int, Tree], seed: int | None, size: int) -> DataFrame:
    """``tree, node, n, codes, sums``: what the bootstraps of the trees draw, by the node where it ends, as cells
    (``n``; their codes, weights and weighted labels)."""
    last = max(tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, starts, ids, w, wy = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(
                    (np.uint8, np.int64, np.int64, np.float64, np.float64), 1))
                codes = codes.reshape(-1, size)
                found, held = [], 0
                for t, top in tops.items():
                    if seed is None:
                        drawn, sums = np.ones(len(codes), bool), np.stack([np.add.reduceat(x, starts) for x in (w, wy)])
                    else:
                        k = draws(ids, t, seed)
                        drawn = np.maximum.reduceat(k, starts) > 0
                        sums = np.stack([np.add.reduceat(k * x, starts) for x in (w, wy)])
                    leaf = top.walk(codes)
                    for node in np.unique(leaf[drawn]).tolist():
                        own = drawn & (leaf == node)
                        found.append((t, node, int(own.sum()), codes[own].tobytes(), sums[:, own].tobytes()))
                        held += len(found[-1][3]) + len(found[-1][4])
                    if found and (held > SENT_BYTES or t == last):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                            ["tree", "node", "n", "codes", "sums"])
                        found, held = [], 0

    return chunks.mapInArrow(run, "tree int, node long, n long, codes binary, sums binary")


def _unpacked(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, ...]:
    parts = [np.frombuffer(b, np.float64).reshape(2, -1) for b in rows.sums]
    return _merged(_matrix(rows.codes, size), *np.concatenate(parts, axis=1))


def _split_large(chunks: DataFrame, trees: list[int], seed: int | None, size: int, n_cells: int, local_rows: int, least_gain: float) -> dict[int, Tree]:
    """The cuts above the nodes that fit a group, level by level, from histograms."""
    leaf = (np.array([-1]), np.zeros(1, np.int64), np.array([-1]), np.zeros(1), np.zeros(1))
    tops = {t: Tree(*(x.copy() for x in leaf)) for t in trees}
    large = {(t, 0) for t in trees} if n_cells > local_rows else set()

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, node, n, codes, sums in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (t, node) not in large:
                    continue
                codes, sums = _matrix([codes], size), np.frombuffer(sums, np.float64).reshape(2, -1)
                cells = (codes + np.arange(size) * BINS).ravel()
                dense = [np.bincount(cells, np.repeat(s, size), size * BINS) for s in sums]
                out.append((t, node, n, np.concatenate(dense).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["tree", "node", "n", "sums"])

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = np.sum([np.frombuffer(b, np.float64) for b in rows.sums], axis=0).reshape(2, size, BINS)
        lw, ly = both.cumsum(axis=2)
        gain = _sums_gain(lw, ly, lw[:, -1:], ly[:, -1:]) * lw[:, -1:]
        gain[:, -1] = 0.0
        tops_of = gain.max(axis=1)
        f = int(np.flatnonzero(tops_of >= tops_of.max() * (1 - 1e-9))[0])
        c = int(np.flatnonzero(gain[f] >= tops_of[f] * (1 - 1e-9))[0])
        return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "n": [rows.n.sum()], "feature": [f], "cut": [c], "gain": [gain[f, c]]})

    while large:
        sums = _batch_rows(chunks, tops, seed, size).mapInArrow(histogram, "tree int, node long, n long, sums binary")
        chosen = sums.groupBy("tree", "node").applyInPandas(choose, "tree int, node long, n long, feature int, cut int, gain double").collect()
        large = set()
        for r in chosen:
            if r.n <= local_rows or r.gain <= least_gain:
                continue
            top = tops[r.tree]
            top.feature[r.node], top.cut[r.node], top.left[r.node], top.gain[r.node] = r.feature, r.cut, len(top.feature), r.gain
            tops[r.tree] = Tree(*(np.append(a, [b, b]) for a, b in zip((top.feature, top.cut, top.left, top.value, top.gain), (-1, 0, -1, 0.0, 0.0))))
            large |= {(r.tree, int(top.left[r.node])), (r.tree, int(top.left[r.node]) + 1)}
    return tops


def fit_stored_forest(train: DataFrame, num_trees: int, batch_trees: int = BATCH_TREES, seed: int | None = 42,
                      weight_col: str | None = None, max_bins: int = 64, max_depth: int | None = None,
                      local_rows: int = LOCAL_ROWS, features: str = "features", label: str = "label") -> StoredForest:
    """A forest of ``num_trees`` regression trees, all features per split, on Poisson bootstraps (``seed`` None: on
    all rows as they are); trees grow until nothing is left to split, or to ``max_depth`` below the nodes split
    from histograms."""
    if num_trees < 1 or batch_trees < 1:
        raise ValueError("a forest needs one tree at least, and so does a batch")
    if not 2 <= max_bins <= BINS:
        raise ValueError(f"max_bins must lie between 2 and {BINS}")
    spark = train.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = train.select(vector_to_array(features).alias("_x"), F.col(label).cast("double").alias("_y"), w.alias("_w"))
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.max(F.size("_x")).alias("size"),
                     F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("squares")).first()
    if not first.n:
        raise ValueError("no rows to grow trees on")
    size, mean = first.size, first.mean
    cuts = cut_points(rows, size, max_bins)
    # labels are taken from their mean, so that running sums stay small
    named = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_wy", F.col("_w") * (F.col("_y") - mean))
    chunks = _chunks(_coded(named, cuts, ["_row", "_w", "_wy"]), first.n, size).checkpoint()
    n_cells = chunks.agg(F.sum("cells")).first()[0]
    least = 1e-12 * max(first.squares, 1e-300)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, w, wy = _unpacked(rows, size)
        tree = grow_tree(codes, w, wy, max_depth, least)
        return pd.DataFrame({"tree": [key[0]], "node": [key[1]], **_stored(tree), "gains": [tree.importance(size)]})

    tops: dict[int, Tree] = {}
    for begin in range(0, num_trees, batch_trees):
        batch = list(range(begin, min(begin + batch_trees, num_trees)))
        own = _split_large(chunks, batch, seed, size, n_cells, local_rows, least)
        # a task for each group, not a few for many of them: some cores would get half as many again as others
        groups = sum(int((top.feature < 0).sum()) for top in own.values())
        grown = _batch_rows(chunks, own, seed, size).repartition(min(groups, MAX_TASKS), "tree", "node").groupBy("tree", "node").applyInPandas(grow, STORED_SCHEMA)
        grown.write.parquet(f"{folder}/trees-{begin:06d}")
        tops |= own
    # a tree's gains by feature, in shares of 1; then the mean over the trees
    gains = spark.read.parquet(f"{folder}/*").select("tree", F.posexplode("gains").alias("feature", "gain")).groupBy(
        "tree", "feature").agg(F.sum("gain").alias("gain")).collect()
    total = np.stack([tops[t].importance(size) for t in range(num_trees)])
    for r in gains:
        total[r.tree, r.feature] += r.gain
    shares = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    whole = shares.sum()
    return StoredForest(spark, folder, cuts, [tops[t] for t in range(num_trees)], mean, shares.sum(axis=0) / (whole if whole else 1.0))


def best_splits(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """One row per feature that can be cut: ``feature, threshold, gain, left_mean, right_mean, n_left``
    of the cut with the largest variance gain (ties: the smallest threshold).

    A cut lies midway between neighbouring values. Rows are summed per ``(feature, value)``
    first, so the window runs over distinct values only; null and NaN have no part.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.select(rows_of(["feature", "value", "w", "y"], [
        (F.lit(c), F.col(f"`{c}`").cast("double"), w.cast("double"), F.col(label).cast("double")) for c in features])).where(
        F.col("value").isNotNull() & ~F.isnan("value") & F.col("y").isNotNull()).groupBy("feature", "value").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("feature")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = sums.select(
        "feature", "value", F.lead("value").over(whole.orderBy("value")).alias("next"),
        *[F.sum(c).over(upto).alias(f"l_{c}") for c in ("w", "wy", "wyy", "n")],
        *[F.sum(c).over(whole).alias(f"t_{c}") for c in ("w", "wy", "wyy")]).where(F.col("next").isNotNull())

    def spread(w, wy, wyy):
        return wyy - wy * wy / w
    left = [F.col(f"l_{c}") for c in ("w", "wy", "wyy")]
    all_ = [F.col(f"t_{c}") for c in ("w", "wy", "wyy")]
    right = [t - x for t, x in zip(all_, left)]
    gain = (spread(*all_) - spread(*left) - spread(*right)) / all_[0]
    scored = cuts.select("feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"),
                         (left[1] / left[0]).alias("left_mean"), (right[1] / right[0]).alias("right_mean"),
                         F.col("l_n").alias("n_left"))
    best = F.max(F.struct("gain", (-F.col("threshold")).alias("less"), "left_mean", "right_mean", "n_left"))
    return scored.groupBy("feature").agg(best.alias("b")).select(
        "feature", (-F.col("b.less")).alias("threshold"), "b.gain", "b.left_mean", "b.right_mean", "b.n_left")
