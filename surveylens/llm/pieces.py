"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text's spaces become the mark U+2581 and one is put in front (as the model's
normaliser says). It is cut into words - a run of marks and what follows up to
the next mark or line end - which no piece crosses. Words of equal length advance together:
at every end position the hashes of all substrings that end there are probed in
the sorted hashes of the pieces, the best sum of scores is taken by a
vectorised maximum, and its piece length is stored as a backpointer. Characters
that no piece covers cost ``lowest score - 10`` and become their UTF-8 byte
pieces, or the unknown piece.

The path of the largest sum of piece scores is what SentencePiece's own unigram
search gives for the same pieces and scores (tests hold both against each
other). For a model file of the merge type it is not the merge order.

Decoding maps ids to pieces, joins byte pieces to characters and takes the
leading mark away: ``decode(encode(t)) == t`` for every text.

Null and empty texts have no ids. Repeated rows get one row each; empty tables
give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import id_text, mix64, text_slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
MULTIPLIER = np.uint64(0x100000001B3)
LEADING_SHIFT = np.uint64(42)
#: Stands for a mark that is in the text itself; it becomes byte pieces.
LITERAL = "\udbff"
#: Words that one numpy step advances, and words whose ids a task remembers.
STEP_CHARS, WORDS_KEPT = 1 << 18, 1 << 19
#: Bytes of text in a slice: the more words meet, the fewer steps the search takes.
SLICE = 4 << 20
# fixed values: piece types of the model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

# a line end is a word of its own: no piece holds one
_WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@dataclass
class Pieces:
    """A model's pieces: texts and types by id; for the search the hashes of
    the searchable ones in order, their ids and scores."""

    texts: list[str]
    types: list[int]
    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: int
    unknown_score: float
    leading: np.ndarray  # which leading bits of a hash occur
    bytes_: np.ndarray  # id of each byte's piece, or -1
    prefix: bool

    @classmethod
    def load(cls, name: str = MODEL) -> Pieces:
        import public_tokenizers
        with open(public_tokenizers.path(name), "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto
        m = proto.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep text as it is can be decoded exactly")
        texts, types = [p.piece for p in m.pieces], [p.type for p in m.pieces]
        at = [i for i, t in enumerate(types) if t in (NORMAL, USER)]
        crossing = [texts[i] for i in at if MARK in texts[i].lstrip(MARK) or "\n" in texts[i]]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        hashes = np.array([substring_hash(texts[i]) for i in at], np.uint64)
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) == 0).any():
            raise ValueError("two pieces share a hash")
        scores = np.array([m.pieces[i].score for i in at], np.float64)
        byte_ids = np.full(256, -1, np.int64)
        for i, t in enumerate(types):
            if t == BYTE:
                byte_ids[int(texts[i][3:5], 16)] = i
        normal = scores[[types[i] == NORMAL for i in at]]
        leading = np.zeros(1 << (64 - int(LEADING_SHIFT)), bool)
        leading[(hashes >> LEADING_SHIFT).astype(np.int64)] = True
        return cls(texts, types, hashes[order], np.array(at, np.int64)[order], scores[order],
                   max(len(texts[i]) for i in at), types.index(UNKNOWN), float(normal.min()) - UNKNOWN_COST,
                   leading, byte_ids, spec.add_dummy_prefix)


def substring_hash(text: str) -> int:
    """The hash that the search rolls, of one whole string."""
    value = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for c in text:
            value = (value + np.uint64(ord(c) + 1)) * MULTIPLIER
    return int(mix64(value ^ np.uint64(len(text)))[0])


def viterbi(codes: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of words of one length: ``codes`` is (words, length) of
    code points. Gives (words, length) backpointers - the length of the piece
    that ends there - and the index of that piece in the sorted pieces (-1: unknown)."""
    n, length = codes.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.ones((n, length), np.int64), np.full((n, length), -1, np.int64)
    values = codes.astype(np.uint64) + np.uint64(1)
    width = min(p.longest, length)
    # rolling[s] is the hash of the substring that began at s positions before the end
    rolling = np.zeros((n, width), np.uint64)
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for end in range(1, length + 1):
            size = min(width, end)
            # substrings that end here, the shortest first
            rolling[:, 1:] = rolling[:, :-1].copy()
            rolling[:, 0] = 0
            rolling[:, :size] = (rolling[:, :size] + values[:, end - 1:end]) * MULTIPLIER
            probe = mix64(rolling[:, :size] ^ np.arange(1, size + 1, dtype=np.uint64))
            # few substrings are pieces: a table of leading bits spares most searches
            maybe = p.leading[(probe >> LEADING_SHIFT).astype(np.int64)]
            at = np.zeros(probe.shape, np.int64)
            at[maybe] = np.minimum(np.searchsorted(p.hashes, probe[maybe]), len(p.hashes) - 1)
            there = maybe & (p.hashes[at] == probe)
            score = np.where(there, p.scores[at], -np.inf)
            score[:, 0] = np.where(there[:, 0], score[:, 0], p.unknown_score)
            total = best[:, end - 1::-1][:, :size] + score
            choice = size - 1 - total[:, ::-1].argmax(axis=1)  # of equal sums the longest piece
            best[:, end] = total[rows, choice]
            back[:, end - 1] = choice + 1
            piece[:, end - 1] = np.where(there[rows, choice], at[rows, choice], -1)
    return back, piece


def segment(words: list[str], p: Pieces) -> list[bytes]:
    """Little-endian ids of every word; words of one length go through
    ``viterbi`` together."""
    out = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        step = max(1, STEP_CHARS // length)
        for first in range(0, len(members), step):
            part = members[first:first + step]
            codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"),
                                  np.uint32).reshape(len(part), length)
            back, piece = viterbi(codes, p)
            # walk back from the end, all words together; -2 marks those that have arrived
            rows, position, found = np.arange(len(part)), np.full(len(part), length), []
            while (position > 0).any():
                live, here = position > 0, np.maximum(position - 1, 0)
                found.append(np.where(live, piece[rows, here], -2))
                position = np.where(live, position - back[rows, here], 0)
            steps = np.stack(found[::-1], axis=1)
            known = steps >= 0
            data = p.ids[steps[known]].astype("<i4").tobytes()
            ends = 4 * np.cumsum(known.sum(axis=1))
            start = 0
            for i, end in zip(part, ends.tolist()):
                out[i] = data[start:end]
                start = end
            for row in np.flatnonzero((steps == -1).any(axis=1)).tolist():
                out[part[row]] = _with_unknown(words[part[row]], steps[row][steps[row] != -2], p)
    return out


def _with_unknown(word: str, chosen: np.ndarray, p: Pieces) -> bytes:
    """Ids of a word in which some characters have no piece: their bytes', or
    one unknown id for a run of them."""
    ids: list[int] = []
    at, after_unknown = 0, False
    for c in chosen.tolist():
        if c >= 0:
            ids.append(int(p.ids[c]))
            at += len(p.texts[ids[-1]])
            after_unknown = False
            continue
        raw = p.bytes_[list(word[at].replace(LITERAL, MARK).encode("utf-8", "replace"))]
        at += 1
        if (raw >= 0).all():
            ids += raw.tolist()
        elif not after_unknown:
            ids.append(p.unknown)
            after_unknown = True
    return np.array(ids, "<i4").tobytes()


class Encoder(dict):
    """word -> little-endian ids, for the words met so far."""

    def __init__(self, p: Pieces) -> None:
        super().__init__()
        self.pieces = p

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return _WORDS.findall((MARK if self.pieces.prefix else "") + text.replace(MARK, LITERAL).replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > WORDS_KEPT:
            self.clear()
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)) - self.keys())
        self.update(zip(new, segment(new, self.pieces)))
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]


def decode_ids(ids: list[int], p: Pieces) -> str:
    """The text of ids; control pieces have none."""
    out, pending = [], bytearray()
    for i in ids:
        kind = p.types[i]
        if kind == BYTE:
            pending.append(int(p.texts[i][3:5], 16))
            continue
        if pending:
            out.append(pending.decode("utf-8", "replace"))
            pending.clear()
        if kind != CONTROL:
            out.append(p.texts[i].replace(MARK, " "))
    out.append(pending.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:] if p.prefix and text[:1] == " " else text


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, ids`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces.load(model))
        for batch in text_slices(batches, slice_bytes=SLICE):
            ids = encoder.encode(batch.column(1).to_pylist())
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))],
                ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` rows; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model)
        for batch in batches:
            texts = [decode_ids(ids or [], p) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def encode_and_back(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text_crc32, decoded_crc32``: both ways in one
    pass, the ids' and texts' check sums instead of themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model)
        encoder = Encoder(p)
        for batch in text_slices(batches, slice_bytes=SLICE):
            texts = batch.column(1).to_pylist()
            ids = encoder.encode(texts)
            decoded = [decode_ids(x.tolist(), p) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                 pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in decoded], pa.int64())],
                ["doc_id", "n_ids", "ids_crc32", "text_crc32", "decoded_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, decoded_crc32 long")
