import itertools
import zlib

import numpy as np

from surveylens.llm import langid

from .helpers import documents, empty, frame


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert set(out) == set(truth)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i in out if out[i].held_out]
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.95


def test_words_of_switching_text_get_their_own_language():
    en = ["the house and the garden with the tree", "this is what they thought and then went there"] * 6
    de = ["das Haus und der Garten mit dem Baum", "dies ist was sie dachten und dann gingen sie"] * 6
    field = langid.train([(t, "en") for t in en] + [(t, "de") for t in de])
    words = langid.words_of(en[0] + " " + de[0])
    layout = langid.Layout.of(np.array([len(words)]))
    gamma, _ = langid.forward_backward(field.emissions(words)[layout.order], layout, np.exp(field.transition),
                                       np.full(2, 0.5))
    got = [field.langs[i] for i in gamma.argmax(axis=1)]
    assert got == ["en"] * 8 + ["de"] * 8
    assert field.transition[0, 0] > field.transition[0, 1]  # staying is likelier than switching


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 0, 2])
    k = 3
    emission = rng.uniform(0.1, 1, (int(lengths.sum()), k))
    transition, initial = rng.uniform(0.1, 1, (k, k)), np.full(k, 1 / k)
    layout = langid.Layout.of(lengths)
    gamma, joint = langid.forward_backward(emission[layout.order], layout, transition, initial, pairs=True)
    want, pairs = np.zeros_like(emission), np.zeros((k, k))
    for first, n in zip(np.cumsum(lengths) - lengths, lengths):
        total, own, both = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.prod([emission[first + t, s] for t, s in enumerate(path)]) * np.prod(
                [transition[a, b] for a, b in zip(path, path[1:])])
            total += w
            for t, s in enumerate(path):
                own[t, s] += w
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        want[first:first + n] = own / total if n else own
        pairs += both / total if n else 0
    assert np.allclose(gamma, want[layout.order]) and np.allclose(joint, pairs)


def test_awkward_rows(spark):
    from pyspark.sql import functions as F
    rows = [(i, "the house and the garden") for i in range(20)] + [(i, "das Haus und der Garten") for i in range(20, 40)]
    rows += [(50, None), (51, ""), (52, "12 + 3 !!"), (53, "x" * 90_000), (None, "the garden"), (1, "the house and the garden")]
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 20, "en").when(F.col("doc_id") < 40, "de"))
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.lang_pred for r in out}
    assert got[3] == "en" and got[25] == "de" and {got[50], got[51], got[52]} == {"und"}
    assert {r.score for r in out if r.lang_pred == "und"} == {0.0}
    assert langid.identify(empty(spark).withColumn("lang", F.lit("en"))).collect() == []
    nothing = frame(spark, rows[:3]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_language_is_no_input(spark):
    from pyspark.sql import functions as F
    docs = documents(spark)
    field = langid.train([("the house and garden", "en"), ("das haus und garten", "de")] * 5)
    a = langid.predict(["the garden", "das haus"], field, langid.Numbers(), [np.zeros((0, 2), np.float32)])[0]
    assert a == ["en", "de"] and docs.filter(F.col("lang").isNull()).count() == 0


def test_numbers_that_are_no_letters():
    assert [langid.words_of(t) for t in ("½ ²", "Ⅷ", "①", "a½b cd", "Éa ß")] == [[], [], [], ["a", "b", "cd"], ["éa", "ß"]]
