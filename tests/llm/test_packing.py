import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from surveylens.llm import packing

from .helpers import documents, empty, frame, prose, text_of


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(pieces, rows, capacity):
    """Every id is in exactly one piece, check sums hold, sequences have no gaps."""
    ids = dict(zip([i for i, _ in rows], library_ids([t or "" for _, t in rows])))
    places, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        places[p.sequence_id].append((p.offset, p.length))
        part = np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes())
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) == len(ids[i])
        assert all(p.length == capacity for p in own[1:]) and 0 < own[0].length <= capacity
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
        assert sum(n for _, n in own) <= capacity
    return len(places), math.ceil(sum(map(len, ids.values())) / capacity)


def test_whole_table(spark):
    used, least = check(packing.pack_documents(documents(spark)).collect(), text_of(spark), 1024)
    assert used <= least + 3


def test_small_capacity_and_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, prose(1, 300)), (5, "<|endoftext|> \n\n  é漢字🎉"), (6, prose(2, 31)),
            (7, prose(2, 31)), (8, "x" * 5000), (9, " ")]
    df = frame(spark, rows)
    used, least = check(packing.pack_documents(df, capacity=32, group_docs=4).collect(), rows, 32)
    assert used <= least + 6
    assert packing.pack_documents(empty(spark)).collect() == []


def test_repeated_rows_are_packed_each(spark):
    out = packing.pack_documents(frame(spark, [(1, "one two"), (1, "one two")])).collect()
    assert len(out) == 2 and {p.offset for p in out} == {0, out[0].length}


def test_sequences_hold_the_ids(spark):
    rows = [(i, prose(i, 5 + 7 * i)) for i in range(9)]
    df = frame(spark, rows)
    ids = dict(zip(range(9), library_ids([t for _, t in rows])))
    pieces = {(p.sequence_id, p.offset): p for p in packing.pack_documents(df, capacity=64).collect()}
    for s in packing.sequences(df, capacity=64).collect():
        assert len(s.ids) == s.length <= 64
        at = 0
        while at < s.length:
            p = pieces[s.sequence_id, at]
            assert s.ids[at:at + p.length] == ids[p.doc_id][p.start:p.start + p.length]
            at += p.length


@pytest.mark.parametrize("seed", range(5))
def test_each_step_is_the_best_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 40, 120))[::-1]
    where, offset, used = packing.sum_of_squares(sizes, 40)
    room = {}
    for size, s, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):
        def squares(gaps):
            return sum(v ** 2 for v in np.bincount([g for g in gaps if g > 0], minlength=1).tolist())
        fits = [k for k, g in room.items() if g >= size]
        if s not in room:
            assert not fits and o == 0
            room[s] = 40 - size
            continue
        assert o == 40 - room[s]
        costs = [squares([g - size if q == k else g for q, g in room.items()]) for k in fits]
        room[s] -= size
        assert squares(room.values()) == min(costs)
    assert used == len(room)


ADDED = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>\n\n x", "x  <|endoftext|>  y", "<|endoftext|", "é<|endoftext|>é "]


def test_added_tokens_as_the_library_encodes_by_default(spark, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        assert {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} == packing.ADDED_TOKENS
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in ADDED]
    got = packing.tokenized(frame(spark, list(enumerate(ADDED))).select("doc_id", "text"), with_ids=True, added_tokens=True)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == dict(enumerate(want))
    # the query and the pipeline's stage ask for them
    import corpus_pipeline
    from surveylens.llm import queries
    docs = frame(spark, list(enumerate(ADDED)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op1_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()} == {
            i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}


def test_texts_that_the_fast_encoder_gives_up_on(spark):
    """A million blanks, between words and with the added token: the library's ids."""
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x <|endoftext|> y")]
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(added_tokens=True)
    for _, text in rows:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    pieces = packing.pack_documents(frame(spark, rows[:2])).collect()
    check(pieces, rows[:2], packing.CAPACITY)


def test_repeated_rows_spread_over_groups(spark):
    out = packing.pack_documents(frame(spark, [(1, "one two three")] * 400), group_docs=20).collect()
    assert len({p.sequence_id >> 40 for p in out}) > 10
