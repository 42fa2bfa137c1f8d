import random

import numpy as np
import pytest

from surveylens.llm import near
from surveylens.llm.words import WordHashes

from .helpers import WORDS, documents, empty, frame, near_brute, prose, text_of


def result(df):
    out = {}
    for r in near.near_groups(df).collect():
        out[r.doc_id] = (r.n_shingles, r.component_id)
        assert r.kept == (r.component_id == r.doc_id)
    return out


def test_whole_table(spark):
    rows = text_of(spark)
    assert result(documents(spark)) == near_brute(rows)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "q"
    return " ".join(w)


def test_families_of_copies(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)  # several blocks in a bucket
    rng, rows = random.Random(3), [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b")]
    for family in range(4):
        text = prose(family, 60 + 80 * family)
        # edits about the threshold, so that links, chains and near misses occur
        rows += [(10 + 100 * family + k, edited(rng, text, k % 4)) for k in range(30)]
    rows += [(1000 + k, rows[20][1].upper()) for k in range(5)]
    assert result(frame(spark, rows)) == near_brute(rows)


def test_empty_table_nulls_and_repeats(spark):
    assert near.near_groups(empty(spark)).collect() == []
    rows = [(None, prose(1, 30)), (3, prose(1, 30)), (3, prose(1, 30)), (9, prose(1, 30))]
    out = sorted(near.near_groups(frame(spark, rows)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.component_id) for r in out] == [(None, 3), (3, 3), (3, 3), (9, 3)]
    assert out[0].kept and out[1].kept and not out[3].kept
    assert {r.doc_id for r in near.keep_one(frame(spark, rows)).collect()} == {None, 3}
    kept = near.keep_one(frame(spark, rows[1:]))
    assert {r.doc_id for r in kept.collect()} == {3} and kept.columns == frame(spark, rows).columns


def test_components_of_a_long_chain(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 101)]
    out = near.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("n,jaccard", [(12, 0.6), (60, 0.85), (400, 0.5), (2000, 0.9)])
def test_register_estimate(n, jaccard):
    rng = np.random.default_rng(n)
    estimates = []
    for _ in range(60):
        common = int(round(n * 2 * jaccard / (1 + jaccard)))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.unique(np.concatenate([pool[:common], pool[common:n]]))
        b = np.unique(np.concatenate([pool[:common], pool[n:2 * n - common]]))
        estimates.append(near.estimate((near.sketch(a) == near.sketch(b)).sum()))
    true = common / (2 * n - common)
    assert abs(np.mean(estimates) - true) < 0.02


def test_shingles_of_short_texts():
    table = WordHashes()
    sizes = [len(near.shingle_set(t, table)) for t in ("", " ", "a", "a b c d", "a b c d e", "a a a a a a a", "a b c d e f")]
    assert sizes == [0, 0, 1, 1, 1, 1, 2]
    assert set(near.shingle_set("A b\tc", table)) == set(near.shingle_set("a B c", table))


def test_bar_of_a_threshold():
    assert (near.Bar.of(0.85).bands, near.Bar.of(0.85).registers) == (25, near.REGISTERS)
    for t in (0.5, 0.8, 0.85, 0.9, 1):
        bar = near.Bar.of(t)
        assert (1 - t ** near.ROWS) ** bar.bands <= near.MISS and bar.screen <= t
    assert near.Bar.of(0.8).links(8, 9, 9) and not near.Bar.of(0.85).links(8, 9, 9)


@pytest.mark.parametrize("percent", [80, 85])
def test_whole_table_at_a_threshold(spark, percent):
    rows = text_of(spark, "/root/testdata/sf0.01")
    out = near.near_groups(documents(spark, "/root/testdata/sf0.01"), threshold=percent / 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_brute(rows, percent)


def test_pipeline_stage_links_at_80_percent(spark):
    import corpus_pipeline
    rows = text_of(spark, "/root/testdata/sf0.01")
    docs = documents(spark, "/root/testdata/sf0.01")
    stay = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "/root/testdata/sf0.01").collect()}
    at80, at85 = ({i for i, (_, low) in near_brute(rows, p).items() if low == i} for p in (80, 85))
    assert stay == at80 != at85


@pytest.mark.parametrize("n", [600])
def test_links_of_a_group_grow_with_its_rows(spark, monkeypatch, n):
    """Near copies of one text, and one text that shares bands with them but is unlike: the
    smallest member of their buckets. Links stay in proportion to the members."""
    rng = random.Random(5)
    text = prose(1, 120).split()
    unlike = text[:84] + prose(2, 36).split()
    rows = [(0, " ".join(unlike))] + [(k, edited(rng, " ".join(text), 2)) for k in range(1, n)]
    seen, found = [], near.components
    monkeypatch.setattr(near, "components", lambda links: seen.append(links.count()) or found(links))
    out = result(frame(spark, rows))
    assert out == near_brute_by_base(rows)
    assert max(seen) <= 8 * n


def near_brute_by_base(rows):
    """Groups by comparing every pair of sets."""
    sets = [set(zip(*[t.lower().split()[k:] for k in range(5)])) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if find(i) != find(j) and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_a_column_named_like_a_helper(spark):
    df = frame(spark, [(1, prose(1, 30)), (2, prose(1, 30))]).withColumnRenamed("node", "_id")
    assert [r.doc_id for r in near.keep_one(df).collect()] == [1]


def many_heads():
    """Copies of one text that an unlike text parts into several components of its buckets."""
    rng = random.Random(5)
    text = prose(1, 120).split()
    return [(0, " ".join(text[:84] + prose(2, 36).split()))] + [(k, edited(rng, " ".join(text), 2)) for k in range(1, 40)]


def test_tasks_of_few_nodes(spark):
    """Stages are few, as each has a task, and most a shuffle file, for every partition however few
    the nodes are: 256 stages when every join was shuffled and every count a job."""
    sc = spark.sparkContext
    df = frame(spark, many_heads())
    df.count()
    sc.setJobGroup("tasks of few nodes", "")
    try:
        found = result(df)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("tasks of few nodes") for s in tracker.getJobInfo(j).stageIds}
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(name, None)
    assert found == near_brute_by_base(many_heads())
    assert 0 < len(stages) <= 150


@pytest.mark.parametrize("names", [["HOT_NODES"], ["HOT_NODES", "BROADCAST_IDS"]])
def test_the_plan_of_many_nodes_gives_the_same(spark, monkeypatch, names):
    for name in names:
        monkeypatch.setattr(near, name, 0)
    assert result(frame(spark, many_heads())) == near_brute_by_base(many_heads())


def own_words(n):
    """``n`` texts about one text: two parts of three with one or none of its words replaced by a word
    of their own; one part with four such words, unlike all others and yet in their buckets. Then texts
    that end early, among them one that a text with words of its own is like, and shared edits."""
    rng, text, new = random.Random(7), prose(1, 120).split(), iter(range(10 ** 6))
    rows = []
    for k in range(n):
        w = list(text)
        for at in rng.sample(range(0, 120, 6), 4 if k % 3 == 1 else rng.randrange(2)):
            w[at] = f"own{next(new)}"
        rows.append((k, " ".join(w)))
    rows += [(n + k, " ".join(text[:120 - k])) for k in range(12, 26, 2)]
    rows += [(n + 30 + k, " ".join(text[:100 - k] + [f"tail{k}x{j}" for j in range(6)])) for k in range(4)]
    return rows + [(n + 40 + k, " ".join(text[:60] + ["both"] * (k % 2) + text[64:])) for k in range(6)]


def test_members_with_words_of_their_own_meet_no_other(spark, monkeypatch):
    """Rows dealt into block pairs stay within one for each band of each text: 8,240 for 257 texts when
    all outside a bucket's largest component met all of its members."""
    monkeypatch.setattr(near, "BLOCK", 8)
    rows, seen, linked = own_words(240), [], near._linked
    monkeypatch.setattr(near, "_linked", lambda dealt, n, *a: seen.append(n) or linked(dealt, n, *a))
    assert result(frame(spark, rows)) == near_brute_by_base(rows)
    assert max(seen, default=0) <= len(rows) * near.REGISTERS // near.ROWS


def test_own_shingles(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 5)  # sums of several parts of a task
    texts = [(1, "a b c d e f g"), (2, "a b c d e f x"), (3, "A b c d e"), (4, "p q"), (5, "")]
    df = spark.createDataFrame(texts, "node long, text string")
    assert {r.node: r.own for r in near._own_shingles(df).collect()} == {1: 1, 2: 1, 4: 1}
