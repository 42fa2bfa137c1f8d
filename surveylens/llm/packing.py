"""Best-fit packing of token pieces by the sum-of-squares rule.

A document becomes byte-pair ids plus an end id; longer ones than ``capacity``
are cut into pieces of ``capacity`` tokens of which only the first may be
shorter. Full pieces fill a sequence alone. The others are placed, longest
first, where the sum over gaps ``g`` of ``N(g) ** 2`` becomes smallest, ``N(g)``
being the open sequences with ``g`` free places; of equal choices the smallest
gap is taken, and a sequence is opened only when no open one has room.

Documents are dealt by a hash into groups of about ``group_docs``; every group
is packed by itself, so a task holds a few thousand lengths whatever the table
size, and leaves a handful of sequences less than full.

Null text is an empty document (one piece that holds the end id); an empty
table gives no rows; repeated rows are packed each by itself, in any group. Texts are encoded whole,
whatever their length. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import id_text, shards_for, small_batches, text_slices

CAPACITY = 1024
END_ID = 2
GROUP_DOCS = 4096
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokenizers file of a rank file's vocabulary.
LIBRARY_FILE = {VOCABULARY: "byte_bpe_50k.json"}

PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
                "sequence_id long, offset long")


class Encoder:
    """Byte-pair ids of texts as the tokenizers library gives them for a public vocabulary.

    ``tiktoken`` with the rank file of the same vocabulary gives the same ids (tests compare them) at
    several times the speed; a text that it cannot split (it gives up on very long runs of white space)
    goes to the library itself. With ``added_tokens`` the added tokens of the library's file become
    their ids where a text holds them, as the library does unless told otherwise (its
    ``add_special_tokens=False`` concerns the ends of a text only); else they are ordinary text."""

    def __init__(self, vocabulary: str = VOCABULARY, added_tokens: bool = False):
        import public_tokenizers
        import tiktoken
        self.file, self.added = public_tokenizers.path(LIBRARY_FILE[vocabulary]), added_tokens
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.file, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens=added if added_tokens else {})
        self.whole = None

    def library(self):
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.file)
            self.whole.encode_special_tokens = not self.added
        return self.whole

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return np.array(self.library().encode(text, add_special_tokens=False).ids, np.uint32)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids; only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(max(0, e - capacity), e) for e in range(first, n + 1, capacity)]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
              vocabulary: str = VOCABULARY, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, crcs`` (CRC-32 of every
    piece's little-endian ids) and, on request, ``ids``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary, added_tokens)
        end = np.array([end_id], dtype="<u4")
        for batch in text_slices(batches):
            counts, crcs, ids = [], [], []
            for text in batch.column(1).to_pylist():
                a = np.concatenate([enc.ids(text), end]).astype("<u4")
                counts.append(len(a))
                crcs.append([zlib.crc32(a[s:e].tobytes()) for s, e in piece_bounds(len(a), capacity)])
                if with_ids:
                    ids.append(a.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            names = ["doc_id", "n_tokens", "crcs"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, crcs array<long>" + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(encode, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of every size (in the given order), and the
    number of sequences."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    squares = np.zeros(capacity + 1, dtype=np.int64)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used = 0
    for i, size in enumerate(sizes.tolist()):
        have = squares[size:]
        # half of the change of the sum when a sequence moves from gap g to g - size
        change = squares[:capacity + 1 - size] - have + 1.0
        change[0] = 0.5 - have[0]  # a filled sequence is no longer open
        change[have == 0] = np.inf
        best = int(change.argmin())
        if np.isfinite(change[best]):
            gap = best + size
            where[i] = open_bins[gap].pop()
            squares[gap] -= 1
        else:
            gap, where[i] = capacity, used
            used += 1
        offset[i] = capacity - gap
        if gap > size:
            open_bins[gap - size].append(int(where[i]))
            squares[gap - size] += 1
    return where, offset, used


def place(tokens: DataFrame, n_docs: int, capacity: int = CAPACITY,
          group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of ``tokenized`` rows with ``sequence_id`` and ``offset``."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=(rows.n_tokens - 1) % capacity + 1)
        rows = rows.sort_values(["first", "doc_id", "n_tokens"], ascending=[False, True, True],
                                kind="stable").reset_index(drop=True)
        where, offset, used = sum_of_squares(rows["first"].to_numpy(), capacity)
        n_pieces = rows.crcs.map(len).to_numpy()
        ends = np.cumsum(n_pieces)
        at = np.repeat(np.arange(len(rows)), n_pieces)
        piece = np.arange(len(at)) - (ends - n_pieces)[at]
        head = piece == 0
        first = rows["first"].to_numpy()[at]
        sequence = np.where(head, where[at], used + np.cumsum(~head) - 1)
        return pd.DataFrame({
            "doc_id": rows.doc_id.to_numpy()[at], "piece": piece.astype(np.int32),
            "start": np.where(head, 0, first + (piece - 1) * capacity),
            "length": np.where(head, first, capacity),
            "ids_crc32": np.fromiter((c for cs in rows.crcs for c in cs), np.int64, len(at)),
            "sequence_id": (int(key[0]) << 40) + sequence,
            "offset": np.where(head, offset[at], 0)})

    groups = shards_for(n_docs, group_docs)
    # rows that repeat are dealt too: their place in the table takes part
    dealt = tokens.withColumn("_group", F.pmod(F.xxhash64("doc_id", "n_tokens", "crcs", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
                   group_docs: int = GROUP_DOCS, added_tokens: bool = False) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``."""
    rows = id_text(docs, id_col, text_col)
    return place(tokenized(rows, capacity, end_id, vocabulary, added_tokens=added_tokens), docs.count(), capacity, group_docs)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The packed sequences themselves, ready to be written: ``sequence_id,
    length, ids`` with the pieces' ids in offset order. ``id_col`` must be a key."""
    capacity = settings.get("capacity", CAPACITY)
    rows = id_text(docs, id_col, text_col)
    ids = tokenized(rows, capacity, settings.get("end_id", END_ID),
                    settings.get("vocabulary", VOCABULARY), with_ids=True, added_tokens=settings.get("added_tokens", False))
    placed = pack_documents(docs, id_col, text_col, **settings)
    part = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    joined = placed.join(ids.select("doc_id", "ids"), "doc_id").select(
        "sequence_id", "length", F.struct("offset", part.alias("ids")).alias("p"))
    # at most ``capacity`` ids meet in a group
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
