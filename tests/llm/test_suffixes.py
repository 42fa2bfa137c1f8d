import hashlib
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from surveylens.llm import induced, queries, suffixes
from tests.llm.helpers import SF, empty, frame, prose, text_of


def sorted_brute(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = [0] * len(text)
    for k in range(1, len(text)):
        a, b = text[order[k - 1]:], text[order[k]:]
        prefixes[k] = next((i for i, (x, y) in enumerate(zip(a[:cap], b[:cap])) if x != y), min(len(a), len(b), cap))
    return order, prefixes


@pytest.mark.parametrize("base,memory", [(1, 64), (1, 1 << 20), (1000, 1 << 20)])
def test_induced_sort(base, memory):
    """All suffixes and common prefixes; deep recursion, and queues that spill after eight tuples."""
    rng = np.random.default_rng(0)
    for step in range(120):
        n, letters = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        text = rng.integers(1, 1 + letters, n)
        if step % 3 == 0:
            text = np.tile(text[:max(1, n // 6)], 6)[:n]
        text = np.append(text, 0)
        blocks = list(induced.sort_suffixes(text, 200, base, memory))[::-1]
        found = [np.concatenate(x).tolist() for x in zip(*blocks)]
        assert found == list(sorted_brute(text.tolist(), 200))


def test_large_words_and_cap():
    rng = np.random.default_rng(1)
    text = np.append(np.tile(rng.integers(1, 1 << 20, 30), 9), 0)
    blocks = list(induced.sort_suffixes(text, 50, 1))[::-1]
    places, prefixes = (np.concatenate(x) for x in zip(*blocks))
    order = sorted_brute(text.tolist(), 50)
    assert prefixes.tolist() == order[1]
    assert [text[p:p + 50].tolist() for p in places] == [text[p:p + 50].tolist() for p in order[0]]


def test_spill_queue_keeps_order():
    queue, rng = induced.SpillQueue(100), random.Random(2)
    sent = {s: [] for s in range(5)}
    for k in range(200):
        s, n = rng.randrange(5), rng.randrange(1, 9)
        places = np.arange(n) + 1000 * k
        queue.push(s, places, places % 200)
        sent[s] += places.tolist()
        if rng.random() < 0.1:
            assert queue.pop(s)[0].tolist() == sent[s]
            sent[s] = []
    assert queue.written
    for s in sent:
        places, prefixes = queue.pop(s)
        assert places.tolist() == sent[s] and (prefixes == places % 200).all()


def brute(rows, width=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k:k + width] for _, d in data for k in range(len(d) - width + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in df.collect()), key=repr)


def planted(seed):
    rng = random.Random(seed)
    passages = [prose(seed + k, 60) for k in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(1000 * seed + i, 30)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.randrange(150, 400)], prose(7000 * seed + 31 * i + len(parts), 10)]
        texts.append((i, " ".join(parts)))
    return texts


AWKWARD = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "ab" * 2000), (6, "Straße é " * 300), (None, "z" * 201), (None, None),
           (7, prose(1, 300)), (7, prose(1, 300)), (8, prose(1, 300)[37:]), (9, prose(1, 300)[:-90] + "!"), (7, prose(2, 300))]


def test_planted_passages(spark):
    rows = planted(1)
    assert result(suffixes.remove_repeats(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    assert result(suffixes.remove_repeats(frame(spark, AWKWARD))) == brute(AWKWARD)
    assert result(suffixes.remove_repeats(empty(spark))) == []


@pytest.mark.parametrize("width", [40, 200])
def test_hot_anchor_is_divided(spark, monkeypatch, width):
    """Tiny shards: the anchors of a passage that most texts share, in changing company, are
    dealt by their windows; runs of windows are cut."""
    monkeypatch.setattr(suffixes, "RUN", 16)
    rows = planted(3)[:30] + AWKWARD[3:8]
    assert result(suffixes.remove_repeats(frame(spark, rows), width=width, shard_bytes=2000, hot_bytes=2000)) == brute(rows, width)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 500)
    rows = planted(4)[:20] + [(100, prose(9, 2000)), (101, prose(9, 2000)[1234:])]
    assert result(suffixes.remove_repeats(frame(spark, rows))) == brute(rows)


def test_windows_share_anchors_exactly():
    """Windows with equal bytes get one anchor; a run that holds its anchor's gram once repeats nothing."""
    text = np.frombuffer((prose(5, 200) + prose(5, 100) + "ab" * 300).encode(), np.uint8)
    start, count, anchor, twice = suffixes.anchor_runs(text, suffixes.Hasher(len(text)))
    of, data = {}, text.tobytes()
    for s, c, a, t in zip(start, count, anchor, twice):
        windows = [data[k:k + 200] for k in range(s, s + c)]
        assert t or len(set(windows)) == len(windows)
        for w in windows:
            assert of.setdefault(w, a) == a
    assert count.sum() == len(data) - 199


def test_no_scratch_file_stays(tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    text = np.append(np.tile(np.random.default_rng(3).integers(1, 9, 500), 4), 0)
    assert sum(len(p) for p, _ in induced.sort_suffixes(text, 200, 1, 64)) == len(text)
    assert not list(tmp_path.iterdir())


def test_query(spark):
    rows = [tuple(r) for r in queries.op12_external_induced_sorting(spark, SF).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(rows, key=repr) == brute(text_of(spark))
