import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from surveylens.llm import merkle, queries
from tests.llm.helpers import SF

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, branch string, pos int, _row string, leaf int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Root of a list of digests, and the siblings of each of them, level by level."""
    above = [([], i) for i in range(len(nodes))]
    while len(nodes) > 1:
        nxt = [H(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
        above = [(path + [(nodes[i // 8 * 8:i // 8 * 8 + 8], i % 8)], i // 8) for path, i in above]
        nodes = nxt
    return nodes[0], [path for path, _ in above]


def brute(rows, tamper):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    subroots, paths = {}, {}
    for lang in order:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroots[lang], paths[lang] = climb([leaf_of(r) for r in by[lang]])
    root, upper = climb([subroots[lang] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for r, path in zip(by[lang], paths[lang]):
            now = r
            if tamper(r[0]) and r[4] is not None:
                now = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            digest, proof = leaf_of(now), []
            for run, i in path + upper[k]:
                proof += run[:i] + run[i + 1:]
                digest = H(*run[:i], digest, *run[i + 1:])
            out.append((r[0], leaf_of(r), subroots[lang], root, H(*proof), digest, digest == root))
    return sorted(out, key=repr)


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def altered():
    t = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(t, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text"))}


def rows_of(n, seed=1, langs=("de", "en", None, "", "é")):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, None, 7, 2 ** 60 + i]), rng.choice(["a", None]), rng.choice(langs), rng.choice([i, None]),
             rng.choice([f"Text {i} ÄÖ", "", None, "same", "x" * 5000 + "Y"])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 9, 300])
def test_sizes(spark, n):
    rows = [(i, "s", "en", i, f"Row {i}") for i in range(n)]
    df = spark.createDataFrame([(*r, "b", 1, "r", 2) for r in rows], SCHEMA).repartition(3)
    assert result(merkle.verify(df, altered())) == brute(rows, third)


@pytest.mark.parametrize("span_levels", [1, 4])
def test_awkward_rows_and_small_groups(spark, monkeypatch, span_levels):
    """Nulls, ids and whole rows that repeat, clashing columns; several stages."""
    monkeypatch.setattr(merkle, "SPAN_LEVELS", span_levels)
    monkeypatch.setattr(merkle, "SPAN", 8 ** span_levels)
    rows = rows_of(400) + rows_of(30)
    df = spark.createDataFrame([(*r, "b", 1, "r", 2) for r in rows], SCHEMA)
    assert result(merkle.verify(df, altered())) == brute(rows, third)


def test_many_branches_and_one_hot_branch(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN_LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    rows = [(i, None, f"l{i}" if i % 2 else "hot", i, None) for i in range(160)]
    df = spark.createDataFrame([(*r, "b", 1, "r", 2) for r in rows], SCHEMA)
    assert result(merkle.verify(df)) == brute(rows, lambda i: False)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(df, altered()).collect() == []


def test_only_altered_leaves_miss_the_root(spark):
    rows = [(i, "s", "en", i, "lower only" if i % 2 else "Upper") for i in range(200)]
    out = result(merkle.verify(spark.createDataFrame([(*r, "b", 1, "r", 2) for r in rows], SCHEMA), altered()))
    assert {r[0] for r in out if not r[6]} == {i for i in range(0, 200, 2) if third(i)}


def test_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert result(queries.op13_sha_midstate_tree(spark, SF)) == brute([tuple(r) for r in table.collect()], third)


def test_parent_folds_from_its_states():
    kids = [H(str(i)) for i in range(6)]
    parent = merkle.Parent("".join(kids).encode())
    assert parent.digest.decode() == H(*kids) and len(parent.states) == 6
    for slot in range(6):
        assert parent.fold(slot, H("new").encode()).decode() == H(*kids[:slot], H("new"), *kids[slot + 1:])
        assert parent.others(slot).decode() == "".join(kids[:slot] + kids[slot + 1:])
    assert [merkle.levels_above(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
