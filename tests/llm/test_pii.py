import re

import numpy as np
import pytest

from surveylens.llm import pii

from .helpers import documents, empty, frame, prose, text_of

FIXED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
]
AWKWARD = [
    "a@b.c_d@e.f x@@y.z a.b@c @a.b.c a@b..c a@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 256.1.1.1 1.2.3",
    "+1 234 567 8901 +1+2 (3) 4567890123 +1..........9", "4111 1111 1111 1111 4111-1111-1111-1112 12-34--5",
    "411111111111111111111111", "é 🎉 mail@ex.org, 10.0.0.1.", "4" * 3000 + "." + "a" * 3000 + "@" + "b" * 3000 + ".c", "٣٤٥ １２.3.4.5",
]


def brute(text):
    found = [(m.start(), m.end(), k) for k, p, ok in FIXED for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@pytest.mark.parametrize("text", AWKWARD)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    assert pii.base_spans("9" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == []
    assert pii.base_spans("@" * 100_000) == []


def test_whole_table(spark):
    texts = dict(text_of(spark))
    for r in pii.find_personal_data(documents(spark)).collect():
        base = [(s.start, s.end, s.kind) for s in r.spans if s.base]
        assert base == brute(texts[r.doc_id])
        for s in r.spans:
            assert s.base or not any(s.start < e and b < s.end for b, e, _ in base)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "none")] + list(enumerate(AWKWARD, 10)) + [(10, AWKWARD[0]), (None, "a@b.c")]
    out = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.spans for r in out}[2] == [] and len({r.doc_id: r.spans for r in out}[None]) == 1
    assert pii.find_personal_data(empty(spark)).collect() == []


def field():
    rng = np.random.default_rng(1)
    texts = []
    for i in range(300):
        card = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card += str(next(d for d in range(10) if pii.luhn(card + str(d))))
        other = "".join(map(str, rng.integers(0, 10, 16)))
        texts.append(f"{prose(i, 8)} card {card} {prose(i + 1, 5)} 10.{i % 200}.3.4 order {other} "
                     f"+1 (523) 555-{1000 + i} {prose(i + 2, 4)} u{i}@mail{i % 7}.example.com done")
    return pii.train(texts)


def test_field_adds_what_the_patterns_drop():
    f = field()
    card = "4111111111111111"
    # beside other digits the pattern's match fails as a whole
    text = f"{prose(1, 8)} card {card} 12 {prose(2, 9)}"
    assert brute(text) == []
    graph = pii.Graph.of([(0, text)])
    added = pii.added_spans(graph, f.marginals(graph), {0: text}, {0: []})
    assert [(text[s:e], k) for s, e, k in added[0]] == [(card, "card")]
    plain = "room 12, 1999 and 4.5 or 2-3"
    graph = pii.Graph.of([(0, plain)])
    assert pii.added_spans(graph, f.marginals(graph), {0: plain}, {0: []}) == {}


def test_skip_links_join_repeats_in_a_line():
    token = "4111111111111111"
    graph = pii.Graph.of([(0, " x ".join([token, "4111-1111-1111-1111"] * 10))])
    skips = [e for e in graph.edges if e[2] == 1]
    assert 19 <= len(skips) <= 40  # not all pairs
    # messages reach a copy whose own features say nothing
    n = len(graph.doc)
    f = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((2, 5, 5)))
    f.pairs[1] = np.eye(5) * 3
    scores = np.zeros((n, 5))
    scores[0, 2] = 6
    f.scores = lambda rows: scores
    p = f.marginals(graph, iterations=40)
    repeats = sorted({i for a, b, k in skips for i in (a, b)})
    assert (p[repeats].argmax(axis=1) == 2).all()


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    f = pii.Field(np.zeros((pii.FEATURES, 5)), rng.normal(size=(2, 5, 5)))
    scores = rng.normal(size=(4, 5))
    f.scores = lambda rows: scores
    graph = pii.Graph([0] * 4, [(0, 1)] * 4, [[0]] * 4, [(0, 1, 0), (1, 2, 1), (1, 3, 0)])
    joint = np.exp(scores[0][:, None, None, None] + scores[1][None, :, None, None] + scores[2][None, None, :, None]
                   + scores[3][None, None, None, :] + f.pairs[0][:, :, None, None] + f.pairs[1][None, :, :, None]
                   + f.pairs[0][None, :, None, :])
    joint /= joint.sum()
    want = np.stack([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.abs(f.marginals(graph, iterations=60) - want).max() < 1e-6


def test_masked_documents(spark):
    rows = [(1, None), (2, "mail a@b.c now"), (3, "none"), (4, "10.0.0.1 10.0.0.1")]
    df = frame(spark, rows).withColumnRenamed("node", "n_chars")
    out = pii.masked_documents(df)
    assert out.schema.names == df.schema.names
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (None, 1), 2: ("mail <EMAIL> now", 16), 3: ("none", 4), 4: ("<IP> <IP>", 9)}
    assert pii.mask("abcdef", [(0, 3, "ip"), (1, 4, "card"), (5, 6, "ip")]) == "<IP>e<IP>"


def mixed_field():
    """Trained on cards in groups and in one piece, beside other numbers."""
    rng = np.random.default_rng(2)
    texts = []
    for i in range(300):
        card = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card += str(next(d for d in range(10) if pii.luhn(card + str(d))))
        card = " ".join(card[k:k + 4] for k in range(0, 16, 4)) if i % 2 else card
        years = " ".join(map(str, rng.integers(1900, 2030, 2)))
        texts.append(f"{prose(i, 8)} card {card} {prose(i + 1, 5)} years {years} {prose(i + 3, 4)} order {i} {prose(i + 2, 4)}")
    return pii.train(texts)


@pytest.mark.parametrize("beside", ["7 {}", "{} 7", "no 12 {}", "({} 7)", "123 {}"])
def test_field_adds_a_card_in_groups_beside_other_digits(beside):
    f = mixed_field()
    card = "4111 1111 1111 1111"
    text = f"{prose(1, 8)} card {beside.format(card)} {prose(2, 9)}"
    base = {0: pii.base_spans(text)}
    assert base == {0: []}  # the pattern's match fails as a whole
    graph = pii.Graph.of([(0, text)])
    added = pii.added_spans(graph, f.marginals(graph), {0: text}, base)
    assert [(text[s:e], k) for s, e, k in added[0]] == [(card, "card")]
    assert card not in pii.mask(text, added[0])


def test_skip_links_join_notations_of_a_card():
    text = "4111 1111 1111 1111 x 4111111111111111 x (4111-1111 1111-1111) x 4111-1111-1111-1111"
    graph = pii.Graph.of([(0, text)])
    first = {}
    for i, (s, e) in enumerate(graph.spans):
        first[s] = i
    at = [first[text.index(t)] for t in ("4111 1111", "4111111111111111", "(4111", "4111-1111-1111-1111")]
    skips = {(a, b) for a, b, k in graph.edges if k == 1}
    assert all(pair in skips for pair in zip(at, at[1:]))
