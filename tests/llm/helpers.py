"""Small tables that hold the awkward cases, and brute-force versions."""

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    import random
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "x", "ing"]) for _ in range(n))


def frame(spark, rows):
    """``doc_id, text`` with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, f"k{i}", True) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, node int, component string, kept boolean")


def empty(spark):
    return frame(spark, []).limit(0)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_of(spark, sf=SF):
    return [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_brute(rows, percent=85):
    """id -> (set size, smallest id reachable) with all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    common = Counter((a, b) for ids in having.values() for a in ids for b in ids if a < b)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
