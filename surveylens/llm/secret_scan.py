"""Secrets by fixed patterns and a character convolutional network.

Patterns find assigned passwords and tokens, access keys and long hex strings;
what they find always stays. The network, written in numpy, looks at every
candidate - each pattern match, and each run of 8 or more key characters that holds a digit or
changes case inside, or that a colon or equals sign goes before, letters only or not - together
with the text around it: characters become vectors, two
banks of filters run over the candidate and over its context, their maxima go
through a hidden layer. A candidate longer than ``BODY`` is seen piece by piece, from end to end; its
score is that of its highest piece. The network is trained on the candidates of all documents (equal ones with
equal surroundings count once), which the
patterns label (positives with their characters drawn anew as further
examples): in shards by a hash of the candidate, each of which goes on from the mean of all shards'
weights, round by round (``train_on``). A quarter of the candidates is kept aside to calibrate its scores (Platt)
and to set, for each kind, the highest threshold that still finds ``RECALL`` of
them, or a lower one that lets through no more of the other candidates kept aside (a kind
without findings takes those of all kinds). Candidates over the threshold that no base span
touches are added, as ``hex`` if they are lower-case hex, ``access`` if they
are upper-case letters and digits, otherwise ``assign``.

Null and empty texts have no spans; without findings to learn from nothing is
added. Repeated rows get one row each, empty tables give empty results; texts of any length are read
whole, columns other than id and text are not read, whatever their names. Offsets
count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, id_text, runs, shards_for, small_batches, text_slices, utf8_flat

KINDS = ("assign", "access", "hex")
#: Windows that one task learns from; rounds, and epochs of each round.
SHARD_WINDOWS, ROUNDS, EPOCHS = 1 << 13, 5, 5
RECALL = 0.99
SHORTEST = 8
BEFORE, BODY, AFTER = 24, 44, 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are the dropped matches
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of whole matches, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """``(start, end, kind number or -1)``: base spans and other runs of key characters."""
    found = [(s, e, KINDS.index(k)) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    reach = list(itertools.accumulate((e for _, e in taken), max))
    for m in _CANDIDATE.finditer(text):
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in ".-/+":
            e -= 1
        if e - s < SHORTEST or not _looks(text, s, e):
            continue
        at = bisect.bisect_left(taken, (e,)) - 1  # the last finding that begins before the end
        if at < 0 or reach[at] <= s:
            found.append((s, e, -1))
    return found


_CHANGES = re.compile(r"[0-9]|[a-z][A-Z]")
_GIVEN = re.compile(r"""[:=]["']?\x20*["']?\Z""")


def _looks(text: str, s: int, e: int) -> bool:
    """Whether a run may be a secret at all: a digit, a change of case inside, or an assignment."""
    return bool(_CHANGES.search(text, s, e) or _GIVEN.search(text[max(0, s - 6):s]))


def window(text: str, s: int, e: int, first: int | None = None) -> np.ndarray:
    """Character codes (0 pads, 127 stands for all beyond ASCII): context, ``BODY`` characters of the
    candidate from ``first`` on, context."""
    first = s if first is None else first
    out = np.zeros(BEFORE + BODY + AFTER, np.int64)
    for part, at, right in ((text[max(0, s - BEFORE):s], 0, BEFORE), (text[first:min(e, first + BODY)], BEFORE, 0),
                            (text[e:e + AFTER], BEFORE + BODY, 0)):
        codes = [min(ord(c), 127) for c in part]
        start = at + (right - len(codes) if right else 0)
        out[start:start + len(codes)] = codes
    return out


def windows(text: str, s: int, e: int) -> list[np.ndarray]:
    """The windows of a candidate: one, or pieces that overlap by half and end with its end."""
    if e - s <= BODY:
        return [window(text, s, e)]
    return [window(text, s, e, at) for at in [*range(s, e - BODY, BODY // 2), e - BODY]]


def _windows(x: np.ndarray, width: int) -> np.ndarray:
    """All windows of ``width`` vectors: (n, positions, width * size)."""
    n, length, size = x.shape
    view = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)  # n, positions, size, width
    return view.transpose(0, 1, 3, 2).reshape(n, length - width + 1, width * size)


@dataclass
class CharNet:
    """Embedding, two filter banks (candidate, context), hidden layer, output."""

    size: int = 8
    width: int = 4
    filters: int = 24
    hidden: int = 16
    p: dict = field(default_factory=dict)
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    precision: float = 1.0

    def start(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        k = self.width * self.size
        self.p = {"emb": rng.normal(0, 0.5, (128, self.size)), "body": rng.normal(0, k ** -0.5, (k, self.filters)),
                  "around": rng.normal(0, k ** -0.5, (k, self.filters)), "bias": np.zeros(2 * self.filters),
                  "w1": rng.normal(0, 0.2, (2 * self.filters, self.hidden)), "b1": np.zeros(self.hidden),
                  "w2": rng.normal(0, 0.3, self.hidden), "b2": np.zeros(1)}
        self.p["emb"][0] = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        vectors = self.p["emb"][x]
        body, around = vectors[:, BEFORE:BEFORE + BODY], vectors.copy()
        around[:, BEFORE:BEFORE + BODY] = 0
        wb, wa = _windows(body, self.width), _windows(around, self.width)
        cb, ca = wb @ self.p["body"], wa @ self.p["around"]
        ib, ia = cb.argmax(axis=1), ca.argmax(axis=1)
        pooled = np.concatenate([cb.max(axis=1), ca.max(axis=1)], axis=1) + self.p["bias"]
        relu = np.maximum(pooled, 0)
        h = np.tanh(relu @ self.p["w1"] + self.p["b1"])
        return h @ self.p["w2"] + self.p["b2"], {"wb": wb, "wa": wa, "ib": ib, "ia": ia, "pooled": pooled, "relu": relu, "h": h}

    def gradients(self, x: np.ndarray, error: np.ndarray, c: dict) -> dict:
        """Of the mean cross-entropy; ``error`` is (probability - label) / n."""
        g = {"w2": c["h"].T @ error, "b2": error.sum(keepdims=True)}
        dh = error[:, None] * self.p["w2"] * (1 - c["h"] ** 2)
        g["w1"], g["b1"] = c["relu"].T @ dh, dh.sum(axis=0)
        dp = (dh @ self.p["w1"].T) * (c["pooled"] > 0)
        g["bias"] = dp.sum(axis=0)
        n, f = len(x), self.filters
        g["emb"] = np.zeros_like(self.p["emb"])
        for name, at, windows, part, first in (("body", c["ib"], c["wb"], dp[:, :f], BEFORE), ("around", c["ia"], c["wa"], dp[:, f:], 0)):
            rows = np.arange(n)[:, None]
            chosen = windows[rows, at]  # n, filters, width * size
            g[name] = np.einsum("nf,nfk->kf", part, chosen)
            back = (part[:, :, None] * self.p[name].T[None]).reshape(n, f, self.width, self.size)
            places = first + at[:, :, None] + np.arange(self.width)
            codes = x[np.arange(n)[:, None, None], places]
            if name == "around":
                back = back * ((places < BEFORE) | (places >= BEFORE + BODY))[..., None]
            np.add.at(g["emb"], codes.reshape(-1), back.reshape(-1, self.size))
        g["emb"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 4e-3, seed: int = 4,
            positive: float | None = None) -> None:
        """From the start; with ``positive`` (their share of all examples) on from the weights that are there."""
        if positive is None:
            self.start()
            positive = y.mean() if len(y) else 0.0
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                at = order[i:i + batch]
                score, cache = self.forward(x[at])
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[at]) * weight[at] / len(at)
                step += 1
                for k, grad in self.gradients(x[at], error, cache).items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    def scores(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + step])[0] for i in range(0, len(x), step)] or [np.zeros(0)])

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * np.asarray(scores) + b, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.scores(x))

    def calibrate(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, of: np.ndarray | None = None, recall: float = RECALL) -> None:
        """Platt scaling, and for each kind the threshold of the wanted recall, on findings kept aside; ``of`` says
        which candidate a window is a piece of. ``precision`` is that on the candidates kept aside, all kinds."""
        s = self.scores(x)
        a, b = 1.0, 0.0
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(400):
            error = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - goal
            a, b = a - 0.05 * (error * s).mean() / max(1e-3, (s ** 2).mean()) * 10, b - 0.5 * error.mean()
        self.platt = (float(max(a, 1e-3)), float(b))
        _, first, of = np.unique(np.arange(len(y)) if of is None else of, return_index=True, return_inverse=True)
        p = highest(self.probability(x), of.reshape(-1), len(first))
        y, kind = y[first], kind[first]
        rest = p[y == 0].max(initial=0.0)
        for k, name in enumerate(KINDS):
            own = p[(y == 1) & (kind == k)]
            own = np.sort(own if len(own) else p[y == 1])  # without findings of its own: of all kinds
            bar = own[int((1 - recall) * len(own))] if len(own) else np.inf
            self.thresholds[name] = _threshold(bar, rest)
        over = p >= min(self.thresholds.values())
        self.precision = float(y[over].mean()) if over.any() else 1.0


def _threshold(bar: float, rest: float) -> float:
    """Where nothing else scores as high, half way down to what does (in logits): no less precise, more recall."""
    return float(bar if rest >= bar or bar == np.inf else _sigmoid((_logit(rest) + _logit(bar)) / 2))


def _logit(p: float) -> float:
    p = min(max(float(p), 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x)))


def highest(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each of ``n`` candidates."""
    out = np.zeros(n)
    np.maximum.at(out, of, values)
    return out


def _redrawn(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same candidate with its letters and digits drawn anew, class by class."""
    out = codes.copy()
    body = out[BEFORE:BEFORE + BODY]
    for low, high in ((48, 58), (65, 91)):
        at = (body >= low) & (body < high)
        body[at] = rng.integers(low, high, int(at.sum()))
    at = (body >= 97) & (body < 123)
    top = 103 if at.any() and body[at].max() < 103 else 123  # hex stays hex
    body[at] = rng.integers(97, top, int(at.sum()))
    return out


def train(texts: list[str], seed: int = 8) -> CharNet | None:
    """Fit and calibrate the network on the candidates of texts, labelled by
    the patterns; None without findings or without other candidates."""
    x, kind, of = [], [], []
    for text in texts:
        for s, e, k in candidates(text, base_spans(text)):
            pieces = windows(text, s, e)
            of += [of[-1] + 1 if of else 0] * len(pieces)
            x += pieces
            kind += [k] * len(pieces)
    x, kind = np.array(x, np.int64).reshape(-1, BEFORE + BODY + AFTER), np.array(kind, np.int64)
    y, of = (kind >= 0).astype(float), np.array(of, np.int64)
    aside = of % 4 == 0
    if not all(part.any() for part in (y[aside] == 1, y[aside] == 0, y[~aside] == 1, y[~aside] == 0)):
        return None
    rng = np.random.default_rng(seed)
    fit_x, fit_y = x[~aside], y[~aside]
    more = np.array([_redrawn(w, rng) for w in fit_x[fit_y == 1]])
    net = CharNet()
    net.fit(np.concatenate([fit_x, more]), np.concatenate([fit_y, np.ones(len(more))]))
    net.calibrate(x[aside], y[aside], kind[aside], of[aside])
    return net


def kind_of(token: str) -> str:
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex"
    return "access" if re.fullmatch(r"[A-Z0-9]+", token) else "assign"


def _asked(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a candidate: those with an equals sign or colon, with a long run of key
    characters, or with one that holds a digit or a capital letter after its first character.
    Every match needs one of these."""
    key = np.zeros(256, bool)
    key[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
    begin, end = runs(flat, key[flat], offsets)
    telling = (flat >= 48) & (flat <= 57)
    telling[1:] |= (flat[1:] >= 65) & (flat[1:] <= 90) & key[flat[:-1]]
    told = np.concatenate([[0], np.cumsum(telling)])
    long_ = ((end - begin >= SHORTEST) & (told[end] > told[begin])) | (end - begin >= 20)
    at = np.concatenate([begin[long_], np.flatnonzero((flat == 58) | (flat == 61))])
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


WIDTH = BEFORE + BODY + AFTER


def candidate_windows(rows: DataFrame) -> DataFrame:
    """The distinct candidates of all texts, with what stands around them: ``kind`` (number, or -1), ``windows`` (a byte for
    a character) and their number ``n``, ``aside`` and a ``hash`` that tells shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            kinds, found = [], []
            for i in _asked(*utf8_flat(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py()
                for s, e, k in candidates(text, base_spans(text)):
                    kinds.append(k)
                    found.append(np.array(windows(text, s, e), np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.binary())], ["kind", "windows"])

    return rows.select("doc_id", "text").mapInArrow(run, "kind int, windows binary").distinct().select(
        "kind", "windows", (F.octet_length("windows") / WIDTH).cast("long").alias("n"),
        (F.pmod(F.xxhash64("windows"), F.lit(4)) == 0).alias("aside"), F.xxhash64("windows", F.lit(1)).alias("hash"))


def _pieces(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some candidates, and whose each is."""
    x = np.frombuffer(b"".join(frame.windows), np.uint8).reshape(-1, WIDTH)
    return x, np.repeat(np.arange(len(frame)), frame.n)


def train_on(rows: DataFrame, rounds: int = ROUNDS, shard_windows: int = SHARD_WINDOWS, seed: int = 8) -> CharNet | None:
    """Fit and calibrate the network on the candidates of all texts, labelled by the patterns; None without findings or
    without other candidates. A shard learns from its own candidates; after each round the network is the
    mean of the shards', by their windows. Shards are told by the candidates, not by tasks."""
    found = cut_lineage(candidate_windows(rows))
    y, aside = F.col("kind") >= 0, F.col("aside")
    sums = found.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (
        ("fit1", y & ~aside), ("fit0", ~y & ~aside), ("aside1", y & aside), ("aside0", ~y & aside))]).first()
    if not all(sums):
        return None
    shards = shards_for(sums.fit1 + sums.fit0, shard_windows)
    share = 2 * sums.fit1 / (2 * sums.fit1 + sums.fit0)
    net = CharNet()
    net.start()
    names = list(net.p)

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["windows", "kind"])
        x, of = _pieces(frame)
        label = (frame.kind.to_numpy()[of] >= 0).astype(float)
        rng = np.random.default_rng([seed, key[0]])
        more = np.array([_redrawn(w, rng) for w in x[label == 1]], np.uint8).reshape(-1, WIDTH)
        own = CharNet(p={k: v.copy() for k, v in net.p.items()})
        own.fit(np.concatenate([x, more]), np.concatenate([label, np.ones(len(more))]), EPOCHS, seed=seed + number, positive=share)
        return pd.DataFrame({"shard": [key[0]], "n": [len(x)], "p": [np.concatenate([own.p[k].reshape(-1) for k in names]).tolist()]})

    learners = found.filter(~aside).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int")).repartition(4 * shards, "shard")  # few meet in a task
    for number in range(rounds):
        learned = sorted(learners.groupBy("shard").applyInPandas(learn, "shard int, n long, p array<double>").collect())
        mean = reduce(np.add, (r.n * np.array(r.p) for r in learned)) / sum(r.n for r in learned)
        ends = np.cumsum([net.p[k].size for k in names])
        net.p = {k: part.reshape(net.p[k].shape) for k, part in zip(names, np.split(mean, ends[:-1]))}

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, of = _pieces(frame)
            best = np.full(len(frame), -np.inf)
            np.maximum.at(best, of, net.scores(x))
            yield pd.DataFrame({"kind": frame.kind, "s": best})

    _calibrate(net, cut_lineage(found.filter(aside).select("kind", "windows", "n").mapInPandas(score, "kind int, s double")))
    return net


def _calibrate(net: CharNet, scored: DataFrame, recall: float = RECALL) -> None:
    """As ``CharNet.calibrate``, from a table of the scores (``kind, s``) of all candidates kept aside: the optimum by damped
    Newton steps, each an aggregate, and the exact score of the wanted recall."""
    y, s = F.col("kind") >= 0, F.col("s")
    counts = {r.kind: r.n for r in scored.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0 = counts.pop(-1, 0)
    n1 = sum(counts.values())
    goal = F.when(y, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))

    def at(a: float, b: float):
        z = F.greatest(F.least(s * a + b, F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-z))
        return scored.agg(F.sum(F.log1p(F.exp(z)) - goal * z), F.sum((p - goal) * s), F.sum(p - goal),
                          F.sum(p * (1 - p) * s * s), F.sum(p * (1 - p) * s), F.sum(p * (1 - p))).first()
    point, step, now = np.array([1.0, 0.0]), np.zeros(2), at(1.0, 0.0)
    for _ in range(20):
        hessian = np.array([[now[3], now[4]], [now[4], now[5]]])
        step = np.linalg.solve(hessian + np.eye(2) * (1e-6 + 1e-6 * np.trace(hessian)), [now[1], now[2]])
        then = at(*(point - step))
        while then[0] > now[0] + 1e-9 * abs(now[0]) and np.abs(step).max() > 1e-6:
            step = step / 2
            then = at(*(point - step))
        point, now = point - step, then
        if np.abs(step).max() < 1e-4:
            break
    net.platt = (float(max(point[0], 1e-3)), float(point[1]))
    rest = float(net.calibrated(scored.filter(~y).agg(F.max("s")).first()[0]))
    for k, name in enumerate(KINDS):
        own = scored.filter(s.isNotNull() & ((F.col("kind") == k) if counts.get(k) else y))
        lowest = int((1 - recall) * (counts.get(k) or n1)) + 1
        bar = own.select("s").orderBy("s").limit(lowest).agg(F.max("s")).first()[0]
        net.thresholds[name] = _threshold(float(net.calibrated(bar)), rest)
    least = (_logit(min(net.thresholds.values())) - net.platt[1]) / net.platt[0]
    over = scored.filter(s >= least).agg(F.avg(y.cast("double"))).first()[0]
    net.precision = 1.0 if over is None else float(over)


SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 net: CharNet | None = None) -> DataFrame:
    """``doc_id, spans`` of every document: base spans and added ones, by start then kind."""
    small_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    model = net or train_on(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            x, of, where = [], [], []
            for i in _asked(*utf8_flat(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py()
                base = base_spans(text)
                spans[i] = [{"start": s, "end": e, "kind": k, "base": True} for s, e, k in base]
                if model is not None:
                    for s, e, k in candidates(text, base):
                        if k < 0:  # base spans stay whatever the network says
                            pieces = windows(text, s, e)
                            x += pieces
                            of += [len(where)] * len(pieces)
                            where.append((i, s, e, kind_of(text[s:e])))
            if x:
                for (i, s, e, kind), p in zip(where, highest(model.probability(np.array(x)), np.array(of), len(where))):
                    if p >= model.thresholds[kind]:
                        spans[i].append({"start": s, "end": e, "kind": kind, "base": False})
            for own in spans:
                own.sort(key=lambda d: (d["start"], KINDS.index(d["kind"]), d["end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([
                    ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])))],
                ["doc_id", "spans"])

    return rows.mapInArrow(run, SCHEMA)
