import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from surveylens.llm import queries, spelling
from tests.llm.helpers import SF, empty, frame, text_of


def near(a, b):
    """One insertion, deletion or replacement, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows, least=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    holes = {}
    for w in n:  # words that agree but for one place, or one of which lacks it, meet here
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1:], set()).add(w)
        holes.setdefault(w, set()).add(w)
    close = {w: set() for w in n}
    for met in holes.values():
        for a in met:
            close[a] |= {b for b in met if near(a, b)}
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def family(seed, n, alphabet="abcé"):
    """Words one or two edits apart, with counts that fall off."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 7))) for _ in range(4)]
    while len(words) < n:
        w = list(rng.choice(words) + "a")
        i = rng.randrange(len(w))
        w[i:i + 1] = rng.choice([[], [rng.choice(alphabet)], [w[i], rng.choice(alphabet)]])
        words.append("".join(w))
    return words


def texts(seed, n=150):
    rng = random.Random(seed)
    words = family(seed, 120)
    return [(i, " ".join(rng.choice(words[:1 + int(len(words) * rng.random() ** 3)]) for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize("block", [4, 256])
def test_against_brute_force(spark, block):
    """Few letters, so that most words are near some; small blocks divide many buckets."""
    rows = texts(3)
    assert result(spelling.variants(frame(spark, rows), block=block)) == brute(rows)


def test_awkward_rows(spark):
    long = "abcdefghij" * 2000
    rows = [(1, None), (2, ""), (3, "1 2 3 ÷÷÷÷÷ ××××× ÷÷÷÷÷ ÷÷÷÷÷"), (None, "ABCDEÉ abcdeÉ abcdeé " * 3), (4, "aaaaa aaaaaa " * 50),
            (4, "aaaaa aaaaaa " * 50), (5, f"{long} {long}x {long} {long} {long}x {long}x {long[:-2]} " * 2), (6, "abcd abc")]
    assert result(spelling.variants(frame(spark, rows))) == brute(rows)
    assert result(spelling.variants(empty(spark))) == []


def test_query(spark):
    assert result(queries.op11_prefix_suffix_tiling(spark, SF)) == brute(text_of(spark))


def test_tile_finds_single_edits():
    words = sorted(set(family(5, 300, "ab")) - {""})
    found, prefix = spelling.tile(words, words[:50])
    for i, a in enumerate(words):
        for j, b in enumerate(words[:50]):
            assert found[i, j] == near(a, b), (a, b)
            assert prefix[i, j] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_hot_bucket_is_divided(spark):
    """3000 words that share their beginning: no group of more than a block is left."""
    rng = np.random.default_rng(1)
    words = sorted({"prefixes" + "".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    rows, _ = spelling._buckets(df, 32)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= 32
