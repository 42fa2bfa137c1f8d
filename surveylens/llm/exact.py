"""Exact deduplication through a minimal perfect hash over historical digests.

``build_index`` takes the distinct digests of the texts already seen, deals
them into shards of bounded size and builds for each a minimal perfect hash
(levels of bit arrays; a key lives on the first level where it is alone, its
slot is the rank of its bit). A slot holds the full digest, the winner's id and
the group size. ``lookup`` sends the digests of incoming texts, grouped first,
to their shard; the 32 bytes in the slot are compared, since a digest that was
never indexed also hashes to some slot. Members join their historical group,
nonmembers form groups of their own.

Texts are equal when their UTF-8 bytes are; null counts as empty. The largest
id of a group stays. Rows that repeat both id and text are one document: all
of them carry the same answer, and ``drop_copies`` leaves one. A group whose ids
are all null has a null ``keep_id``. Texts of any length are hashed whole. Columns other than id and
text are carried or not read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, id_text, is_few, mix64, shards_for

SHARD_KEYS = 1 << 16
GAMMA = 1.5
LEVELS = 48
#: Stands for a null id inside the index, where ids are plain 64-bit numbers.
NO_ID = -(1 << 63)

GROUP_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of every whole text."""
    return id_text(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with winner and size; map-side sums, so a text that is
    a third of all rows leaves one row per task."""
    return rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digest.view("<u8").reshape(-1, 4)
    return words[:, 0].copy(), words[:, 1] | np.uint64(1)


def _spots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(a + b * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def build_hash(digest: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels for distinct 32-byte digests (n x 32 uint8)."""
    a, b = _halves(digest)
    levels = []
    while len(a):
        if len(levels) == LEVELS:
            raise ValueError("digests repeat: the index takes distinct ones")
        size = max(64, int(GAMMA * len(a)))
        at = _spots(a, b, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = ~alone[at]
        a, b = a[left], b[left]
    return levels


def slots_of(digest: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of every digest; -1 for those that no level takes (nonmembers)."""
    a, b = _halves(digest)
    slot, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, bits in enumerate(levels):
        if not len(open_):
            break
        at = _spots(a[open_], b[open_], level, len(bits))
        hit = bits[at]
        slot[open_[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        open_ = open_[~hit]
    return slot


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the levels' bits, and the slots in hash order."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digest = _matrix(rows.digest)
        levels = build_hash(digest)
        order = np.empty(len(rows), np.int64)
        order[slots_of(digest, levels)] = np.arange(len(rows))
        return pd.DataFrame({
            "shard": [int(key[0])], "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(np.concatenate(levels)).tobytes()],
            "digests": [digest[order].tobytes()], "winners": [rows.keep_id.to_numpy()[order].tolist()],
            "counts": [rows.group_size.to_numpy()[order].tolist()]})

    return _sharded(groups, shards).groupBy("shard").applyInPandas(
        build, "shard int, sizes array<int>, bits binary, digests binary, winners array<long>, counts array<long>")


def _levels(sizes, bits: bytes) -> list[np.ndarray]:
    flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    ends = np.cumsum(list(sizes))
    return [flat[e - s:e] for s, e in zip(sizes, ends)]


def lookup(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups after the incoming digests met the index: ``digest, keep_id,
    group_size, member`` (true: the digest is historical)."""

    def probe(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(old):
            return new[["digest", "keep_id", "group_size"]].assign(member=False)
        row = old.iloc[0]
        slots = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
        winners, counts = np.array(row.winners, np.int64), np.array(row.counts, np.int64)
        digest = _matrix(new.digest)
        keep, size = new.keep_id.to_numpy(np.int64), new.group_size.to_numpy(np.int64)
        slot = slots_of(digest, _levels(row.sizes, row.bits))
        member = slot >= 0
        member[member] = (slots[slot[member]] == digest[member]).all(axis=1)
        at = slot[member]  # incoming digests are distinct, so no slot comes twice
        counts[at] += size[member]
        winners[at] = np.maximum(winners[at], keep[member])
        fresh = ~member
        return pd.DataFrame({
            "digest": [x.tobytes() for x in slots] + [x.tobytes() for x in digest[fresh]],
            "keep_id": np.concatenate([winners, keep[fresh]]),
            "group_size": np.concatenate([counts, size[fresh]]),
            "member": np.arange(len(slots) + int(fresh.sum())) < len(slots)})

    return _sharded(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(
        probe, GROUP_SCHEMA)


def copy_groups(rows: DataFrame, is_history, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Groups of equal digests over all ``(doc_id, digest)`` rows, of which
    ``is_history`` (a boolean column) says which are indexed and which arrive."""
    old = cut_lineage(digest_groups(rows.filter(F.coalesce(is_history, F.lit(False)))))
    new = cut_lineage(digest_groups(rows.filter(~F.coalesce(is_history, F.lit(False)))))
    # both sides of the lookup meet by shard: the larger one sets their number
    shards = shards_for(max(old.count(), new.count()), shard_keys)
    groups = lookup(new, build_index(old, shards), shards)
    return cut_lineage(groups.withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID))))


def older_half(docs: DataFrame, id_col: str = "doc_id"):
    """Ids up to the middle of the id range count as the history."""
    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    return F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2).cast("long")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                is_history=None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``."""
    rows = digests(docs, id_col, text_col)
    groups = copy_groups(rows, older_half(docs, id_col) if is_history is None else is_history)
    # the joined key may be hot: both sides are plain exchanges, which AQE can split
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_history=None) -> DataFrame:
    """The rows that stay, with all columns of ``docs``. Only ids and digests of those that go
    meet the rows, as a broadcast while they are few, so the texts are not shuffled."""
    rows = digests(docs, id_col, text_col)
    groups = copy_groups(rows, older_half(docs, id_col) if is_history is None else is_history)
    lost = cut_lineage(rows.join(groups, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct())
    repeats = cut_lineage(rows.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest"))
    # names that no column of docs has
    name = "_" * (1 + max(map(len, docs.columns)))
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256))
    marked = docs.withColumn(f"{name}digest", digest)

    def met(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(f"{name}id"), F.col("digest").alias(f"{name}key"))
        same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"{name}id")) & (F.col(f"{name}digest") == F.col(f"{name}key"))
        return df.join(F.broadcast(keys) if is_few(keys) else keys, same, how)

    stay = met(marked, lost, "left_anti")
    if repeats.limit(1).count():
        once = met(stay, repeats, "left_semi").dropDuplicates([id_col, f"{name}digest"])
        stay = met(stay, repeats, "left_anti").unionByName(once)
    return stay.drop(f"{name}digest")
