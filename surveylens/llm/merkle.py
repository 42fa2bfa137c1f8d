"""Merkle manifest of a table as a SHA midstate tree.

A row's leaf is the SHA-256 of its fields, each with its length before it. The
leaves of one branch (a language) ascend by id; every ``FAN`` consecutive nodes become a
parent, level by level, until one is left: the branch's subroot. The subroots,
in order of their branches (null first, then bytewise), become the root by the same rule.

A parent keeps a copy of its hash state before each child slot (``Parent``). To
learn the root after one child changed, ``Parent.fold`` goes on from the copy of that slot with
the replacement and the siblings to the right; those to the left are not hashed again.

Nodes are ranked by a range sort and per-partition counts, not by a window over a
branch, so a branch may hold any share of the rows. ``SPAN`` consecutive nodes are one
task's group: it grows ``SPAN_LEVELS`` levels at once. Going down again, a group gets the parents
above it (at most ``FAN`` digests a level) and folds every row of its own.

Null fields count as ``-``. Rows that share an id stand in order of their leaves; equal rows are
leaves of their own. A null id comes first in its branch. Texts are hashed whole,
by the JVM. Columns other than the fields are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
SPAN_LEVELS = 4
SPAN = FAN ** SPAN_LEVELS
HEX = 64  # characters of a digest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """A node over up to ``FAN`` children (hex digests), with the hash state
    as it was before each of them."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: bytes):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for at in range(0, len(children), HEX):
            self.states.append(state.copy())
            state.update(children[at:at + HEX])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with ``child`` in that slot."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.children[HEX * (slot + 1):])
        return state.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return self.children[:HEX * slot] + self.children[HEX * (slot + 1):]


def levels_above(n: int) -> int:
    """Levels until ``n`` nodes have become one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(digests: Sequence[str], levels: int) -> list[list[Parent]]:
    """Parents over consecutive nodes, lowest level first."""
    row, tree = "".join(digests).encode(), []
    for _ in range(levels):
        tree.append([Parent(row[at:at + FAN * HEX]) for at in range(0, len(row), FAN * HEX)])
        row = b"".join(p.digest for p in tree[-1])
    return tree


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else bytes, ``:`` and value."""
    def said(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*map(said, fields)).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with their position ``pos`` in their ``branch`` and its size ``n``."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows have a place too, so that any number of them can be parted
    keys = ["branch", *order, "_row"]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    dealt = dealt.sortWithinPartitions(*keys).drop("_row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = np.empty(batch.num_rows, np.int64)
            for i, branch in enumerate(batch.column("branch").to_pylist()):
                count = count + 1 if branch == last else 0
                last, local[i] = branch, count
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local)],
                [*batch.schema.names, "_part", "_local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    held = cut_lineage(dealt.mapInArrow(number, f"{fields}, _part int, _local long"))
    # a branch has at most one count for each partition
    counts = held.groupBy("branch", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("branch")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("branch", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    return held.join(counts, ["branch", "_part"]).withColumn("pos", F.col("_before") + F.col("_local")).drop(
        "_part", "_local", "_before")


def _spans(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("span", F.floor(F.col("pos") / SPAN).cast("long"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """``branch, pos, n, digest`` of the nodes after each ``SPAN_LEVELS`` levels; in
    the last one every branch is a single node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows.n.iloc[0])
        tree = grow(rows.digest.tolist(), min(SPAN_LEVELS, levels_above(n)))
        digest = tree[-1][0].digest.decode() if tree else rows.digest.iloc[0]
        return pd.DataFrame({"branch": [key[0]], "pos": [key[1]], "n": [-(-n // SPAN)], "digest": [digest]})

    stages = [nodes.select("branch", "pos", "n", "digest")]
    while True:
        stages.append(cut_lineage(_spans(stages[-1]).groupBy("branch", "span").applyInPandas(
            run, "branch string, pos long, n long, digest string")))
        if not stages[-1].filter("n > 1").limit(1).count():
            return stages


PATH = "array<struct<children: string, slot: int>>"


def _descend(stages: list[DataFrame], top: DataFrame) -> DataFrame:
    """``branch, pos, path`` of the nodes of ``stages[1]``; ``top`` has those of the last."""
    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = grow(rows.digest.tolist(), min(SPAN_LEVELS, levels_above(int(rows.n.iloc[0])))) if len(rows) else []
        path = [(step["children"], step["slot"]) for step in above.path.iloc[0]]
        paths = []
        for i in range(len(rows)):
            own = [(level[i // FAN ** (k + 1)].children.decode(), i // FAN ** k % FAN) for k, level in enumerate(tree)]
            paths.append([{"children": c, "slot": s} for c, s in own + path])
        return pd.DataFrame({"branch": rows.branch, "pos": rows.pos, "path": paths})

    for nodes in reversed(stages[1:-1]):
        top = cut_lineage(_spans(nodes).groupBy("branch", "span").cogroup(
            top.withColumnRenamed("pos", "span").groupBy("branch", "span")).applyInPandas(
            run, f"branch string, pos long, path {PATH}"))
    return top


def verify(docs: DataFrame, altered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS,
           id_col: str = "doc_id", branch_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, pos, leaf, subroot, root, proof_sha256, folded_root,
    verified``. ``altered`` gives fields as they are found now; the root is folded
    from the leaf over them and the manifest's own siblings."""
    found = altered or {}
    branch = F.col(branch_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(branch.isNull(), "").otherwise(F.concat(F.lit("="), branch)).alias("branch"),
        leaf_digest([F.col(c) for c in fields]).alias("leaf"),
        leaf_digest([found.get(c, F.col(c)) for c in fields]).alias("found"))
    leaves = cut_lineage(_ranked(rows, ["doc_id", "leaf"]))
    stages = _climb(leaves.withColumn("digest", F.col("leaf")))
    # the subroots are the leaves of a tree of their own
    subroots = cut_lineage(_ranked(stages[-1].select(
        F.lit("").alias("branch"), F.col("branch").alias("name"), "digest"), ["name"]))
    upper = _climb(subroots)
    root = upper[-1].select("digest").first()
    empty = F.array().cast(PATH)
    paths = _descend([None, *upper], upper[-1].select("branch", "pos", empty.alias("path")))
    top = subroots.join(paths, ["branch", "pos"]).select(
        F.col("name").alias("branch"), F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("pos"), "path")
    paths = _descend(stages, top.drop("subroot"))

    def fold(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = grow(rows.leaf.tolist(), min(SPAN_LEVELS, levels_above(int(rows.n.iloc[0])))) if len(rows) else []
        upper = [(Parent(step["children"].encode()), step["slot"]) for step in above.path.iloc[0]]
        proofs, folded = [], []
        for i, digest in enumerate(rows.found):
            digest, proof = digest.encode(), hashlib.sha256()
            own = [(level[i // FAN ** (k + 1)], i // FAN ** k % FAN) for k, level in enumerate(tree)]
            for parent, slot in own + upper:
                proof.update(parent.others(slot))
                digest = parent.fold(slot, digest)
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        return pd.DataFrame({"doc_id": rows.doc_id, "branch": rows.branch, "pos": rows.pos, "leaf": rows.leaf,
                             "proof_sha256": proofs, "folded_root": folded})

    # ids travel as text: pandas would turn a column with nulls into floats
    folded = _spans(leaves.withColumn("doc_id", F.col("doc_id").cast("string"))).groupBy("branch", "span").cogroup(
        paths.withColumnRenamed("pos", "span").groupBy("branch", "span")).applyInPandas(
        fold, "doc_id string, branch string, pos long, leaf string, proof_sha256 string, folded_root string")
    whole = F.lit(root.digest if root else None).cast("string")
    return folded.join(top.select("branch", "subroot"), "branch").select(
        F.col("doc_id").cast("long").alias("doc_id"), "pos", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == whole).alias("verified"))
