import pytest
from pyspark.sql import functions as F

from surveylens.llm import pieces

from .helpers import documents, empty, frame, prose, text_of

AWKWARD = ["", " ", "  a  b ", "\n", "漢字 テスト 🎉🎉 x", "tab\tx  ", "é" * 50, "a" * 40, "   lead", "x y", "a\n\n b\n"]


@pytest.fixture(scope="module")
def library():
    """The library's own unigram search over the same pieces. Scores of -1e9 are
    raised: the library adds in single precision and would lose all others."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000)
    raw = m.SerializeToString()
    return sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces.parse(raw)


def test_same_ids_as_the_library(spark, library):
    sp, p = library
    texts = AWKWARD + [t for _, t in text_of(spark)]
    got = pieces.Encoder(p).encode(texts)
    assert [g.tolist() for g in got] == sp.encode(texts, num_threads=1)


def test_best_sum_by_brute_force():
    p = pieces.Pieces.load()
    score = {p.texts[i]: s for i, s in zip(p.ids.tolist(), p.scores.tolist())}
    for word in ["▁the", "▁hend", "▁internationally", "▁▁▁x", "▁étrange", "ing"]:
        best = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                s = score.get(word[start:end], p.unknown_score if end - start == 1 else float("-inf"))
                best[end] = max(best[end], best[start] + s)
        ids = [int.from_bytes(x, "little") for x in _chunks(pieces.segment([word], p)[0])]
        assert sum(score[p.texts[i]] for i in ids) == best[-1]


def _chunks(data):
    return [data[i:i + 4] for i in range(0, len(data), 4)]


def test_round_trip(spark):
    rows = list(enumerate(AWKWARD + ["a▁b", "▁ ▁▁", "\U0010ffff\x00", prose(1, 3000), None]))
    df = frame(spark, rows)
    encoded = pieces.encode(df)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in rows}
    sums = pieces.encode_and_back(documents(spark)).collect()
    assert len(sums) == 200 and all(r.text_crc32 == r.decoded_crc32 for r in sums)


def test_empty_and_null_ids(spark):
    assert pieces.encode(empty(spark)).collect() == []
    ids = spark.range(2).select(F.col("id").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids"))
    assert [r.text for r in pieces.decode(ids).collect()] == ["", ""]
