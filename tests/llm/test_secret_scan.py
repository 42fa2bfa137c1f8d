import re

import numpy as np
import pytest

from surveylens.llm import secret_scan

from .helpers import documents, empty, frame, prose, text_of

FIXED = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
AWKWARD = ["", "token=abc", 'API_KEY : "abcdef"', "apikey='a.b-c=d'", "passwd =  x" * 3, "AKIA" + "A" * 16, "AKIA" + "Z" * 15,
           "f" * 24, "f" * 23 + "g", "é" * 9 + "secret:hunter22", "toKen=TOKEN=abcdefg", "ſecret=abcdefgh", "x" * 5000 + "0"]


def brute(text):
    found = [(m.start(), m.end(), k) for k, p, ok in FIXED for m in p.finditer(text or "") if ok(m)]
    return sorted(found, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def test_whole_table(spark):
    texts = dict(text_of(spark))
    for r in secret_scan.find_secrets(documents(spark)).collect():
        base = [(s.start, s.end, s.kind) for s in r.spans if s.base]
        assert base == brute(texts[r.doc_id])
        for s in r.spans:
            assert s.base or not any(s.start < e and b < s.end for b, e, _ in base)


def test_awkward_rows(spark):
    rows = [(0, None)] + list(enumerate(AWKWARD, 1)) + [(1, ""), (99, "token=abcdefgh")]
    out = secret_scan.find_secrets(frame(spark, rows)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == brute(texts[r.doc_id])
    assert secret_scan.find_secrets(empty(spark)).collect() == []


def findings():
    rng = np.random.default_rng(2)
    hexes = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    out = []
    for i in range(160):
        out.append(f'{prose(i, 6)} token = "{hexes(40)}" {prose(i + 1, 6)}')
        out.append(f"{prose(i, 6)} AKIA{''.join(chr(65 + j) for j in rng.integers(0, 26, 15))}7 {prose(i, 3)}")
        out.append(f"{prose(i, 4)} 4{''.join(map(str, rng.integers(0, 10, 15)))} {prose(i, 4)}")
        out.append(f"{prose(i, 4)} version-{i}.{i % 7}.0-final {prose(i, 4)}")
    return out


@pytest.fixture(scope="module")
def net():
    return secret_scan.train(findings())


def test_network_finds_findings_and_leaves_others(net):
    x, y = [], []
    for text in findings()[400:]:
        for s, e, k in secret_scan.candidates(text, secret_scan.base_spans(text)):
            x.append(secret_scan.window(text, s, e))
            y.append(k >= 0)
    p = net.probability(np.array(x))
    assert ((p >= 0.5) == np.array(y)).mean() > 0.97
    assert all(0 < t <= 1 for t in net.thresholds.values()) and net.precision > 0.9


def test_threshold_keeps_the_recall(net):
    held = [(secret_scan.window(t, s, e), k) for t in findings()[::4]
            for s, e, k in secret_scan.candidates(t, secret_scan.base_spans(t)) if k >= 0]
    p = net.probability(np.array([w for w, _ in held]))
    reach = [q >= net.thresholds[secret_scan.KINDS[k]] for q, (_, k) in zip(p, held)]
    assert np.mean(reach) >= 0.95


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    net = secret_scan.CharNet(size=3, width=3, filters=4, hidden=5)
    net.start()
    x = rng.integers(1, 127, (6, secret_scan.BEFORE + secret_scan.BODY + secret_scan.AFTER))
    y = rng.integers(0, 2, 6).astype(float)

    def loss():
        s = net.forward(x)[0]
        return np.mean(np.logaddexp(0, s) - y * s)

    score, cache = net.forward(x)
    grads = net.gradients(x, (1 / (1 + np.exp(-score)) - y) / len(y), cache)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            if name == "emb" and i < 3:
                continue
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-5, name


def test_nothing_to_learn_from():
    assert secret_scan.train([]) is None and secret_scan.train([prose(1, 50)]) is None


def test_long_candidates_are_seen_to_their_end():
    text = "x = " + "a1" * 100 + "Z9" + "b2" * 100
    s, e = 4, len(text)
    pieces = secret_scan.windows(text, s, e)
    seen = [p[secret_scan.BEFORE:secret_scan.BEFORE + secret_scan.BODY] for p in pieces]
    assert all((p > 0).all() for p in seen) and len(pieces) == 1 + -(-(e - s - secret_scan.BODY) // (secret_scan.BODY // 2))
    assert any(bytes(p.astype(np.uint8).tolist()).find(b"Z9") >= 0 for p in seen)
    assert (seen[-1] == [ord(c) for c in text[-secret_scan.BODY:]]).all()


@pytest.mark.parametrize("text,found", [
    ("my key: abcdefghij here", ["abcdefghij"]), ("say abcdefghij here", []), ('x="QwErTyUiOp"', ["QwErTyUiOp"]),
    ("Understanding words of Wonderland", []), ("id 7fk39dk2 ok", ["7fk39dk2"]), ("short a1b2c3", []), ("XkcdPassPhrase", ["XkcdPassPhrase"]),
])
def test_candidates(text, found):
    assert [text[s:e] for s, e, k in secret_scan.candidates(text, secret_scan.base_spans(text)) if k < 0] == found


def test_the_network_adds_what_the_patterns_drop(spark, net):
    """Access keys and hex runs that are a few characters too short or part of another run: found by the
    network, not by the patterns; with the network's thresholds out of reach nothing is added."""
    rng = np.random.default_rng(7)
    hexes = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    rows = [(i, f'{prose(i, 6)} token = "{hexes(40)}" AKIA{"ABCDEFGHJK"[i % 10] * 3}{hexes(6).upper()}Q7 {prose(i, 5)}') for i in range(40)]
    rows += [(100 + i, f"{prose(i, 8)} version-{i}.{i % 7}.0-final {prose(i, 8)}") for i in range(40)]
    added = {r.doc_id: [s for s in r.spans if not s.base] for r in secret_scan.find_secrets(frame(spark, rows), net=net).collect()}
    assert sum(len(added[i]) > 0 for i in range(40)) >= 36 and not any(added[100 + i] for i in range(40))


def test_the_network_learns_from_every_document(spark):
    """No document is too long or too many: candidates of all texts train the network, copies once, in any partitions."""
    long_ = " ".join(prose(i, 40) for i in range(200)) + " id 7fk39dk2q8 end"
    texts = findings() * 2 + [long_]
    assert len(long_) > 20_000
    rows = secret_scan.id_text(frame(spark, list(enumerate(texts))))
    seen = secret_scan.candidate_windows(rows).collect()
    want = {(k, np.array(secret_scan.windows(t, s, e), np.uint8).tobytes()) for t in texts
            for s, e, k in secret_scan.candidates(t, secret_scan.base_spans(t))}
    assert {(r.kind, bytes(r.windows)) for r in seen} == want and len(seen) == len(want) > 600
    a = secret_scan.train_on(rows, 3, 400)
    b = secret_scan.train_on(rows.repartition(7), 3, 400)
    assert all(np.allclose(a.p[k], b.p[k]) for k in a.p) and all(abs(a.thresholds[k] - b.thresholds[k]) < 1e-6 for k in a.thresholds)
    held = [r for r in seen if r.aside]
    p = [a.probability(np.frombuffer(r.windows, np.uint8).reshape(-1, secret_scan.WIDTH)).max() for r in held]
    right = [(q >= min(a.thresholds.values())) == (r.kind >= 0) for q, r in zip(p, held)]
    assert np.mean(right) > 0.95 and a.precision > 0.9
    own = sorted(q for q, r in zip(p, held) if r.kind == 2)
    assert a.thresholds["hex"] <= own[int(0.01 * len(own))] + 1e-9
