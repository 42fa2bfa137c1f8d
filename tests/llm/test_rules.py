import re
from collections import Counter

from surveylens.llm import rules

from .helpers import documents, empty, frame, prose, text_of, words


def brute(text):
    w = words(text)
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k:k + 3])] > 1}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def coverage(text, n):
    w, seen, inside = words(text), set(), set()
    for k in range(len(w) - n + 1):
        gram = tuple(w[k:k + n])
        if gram in seen:
            inside |= set(range(k, k + n))
        seen.add(gram)
    return sum(len(w[k]) for k in inside) / max(1, sum(map(len, w)))


def check(out, rows):
    texts = dict(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        for n, share in zip(rules.COVERAGE, r.dup_ngram_share):
            assert abs(share - coverage(texts[r.doc_id], n)) < 1e-9
        assert not (r.kept and r.base_failed)


def test_whole_table(spark):
    out = rules.quality_rules(documents(spark)).collect()
    check(out, text_of(spark))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    bad = [r.kept for r in out if labels.get(r.doc_id) == 0 and not r.base_failed]
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert not any(bad) and sum(good) >= 0.99 * len(good)


def test_awkward_texts(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n \t"), (4, "a"), (5, "é漢 🎉 x \x1c y"), (6, "l1\nl1\n\nl1 \n l1\nl1"),
            (7, "a b c a b c a b"), (8, prose(4, 4000)), (9, (prose(5, 30) + "\n") * 20), (10, "# $ & | < > * %"),
            (11, "a b"), (12, "a b c")]
    out = rules.quality_rules(frame(spark, rows)).collect()
    check(out, rows)
    kept = {r.doc_id: r.kept for r in out}
    assert not kept[9] and not kept[1]
    assert rules.quality_rules(empty(spark)).collect() == []


def test_texts_do_not_run_into_each_other(spark):
    rows = [(i, "one two three four five") for i in range(40)]
    assert all(r.n_repeat_words == 0 and r.n_dup_lines == 0 for r in rules.quality_rules(frame(spark, rows)).collect())
