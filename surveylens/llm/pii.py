"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find emails, IPv4 addresses, card numbers (Luhn) and phone numbers;
what they find always stays. The field adds spans: its variables are the
tokens that hold a digit or an at sign, and their neighbours; neighbouring
variables share chain potentials, and tokens that repeat (the same token, or
the same digits in another notation) anywhere in a text share skip potentials
with their next occurrence, so n repeats make n - 1 links. Loopy sum-product
message passing over all texts of an Arrow slice at once gives the marginals.

The field is trained on a bounded sample of documents (``train_docs``, each of
at most ``train_chars`` characters) that the patterns label: unary weights by
softmax regression, pair potentials by smoothed log ratios of label pairs
against independence (piecewise training). Its features see single tokens,
their neighbours and whether neighbouring groups of digits pass the card check
together, not the patterns, so it also labels what the patterns drop, for
instance a card number beside other digits, in one piece or in groups.

Null and empty texts have no spans; an empty table or one without personal data
trains a field that adds nothing. Repeated rows get one row each. Offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import id_text, small_batches, text_slices, utf8_flat

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
TRAIN_DOCS, TRAIN_CHARS = 1000, 20_000
FEATURES = 1 << 13
#: Least marginal probability of an added span.
LEAST = 0.9
ITERATIONS = 6
MASKS = {k: f"<{k.upper()}>" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can begin at the start of a run of digits only, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
#: A token that can be part of a number written in groups.
_GROUP = re.compile(r"""(["'(\[<#:,;.]*)([0-9]+(?:-[0-9]+)*)(["')\]>:,;.!?]*)""")
#: Digits of one token that may be such a part; more stand by themselves.
GROUP_DIGITS = range(3, 12)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign, dotted domain; linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind."""
    found = [(s, e, 0) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# -- the field --------------------------------------------------------------

def shape(token: str) -> str:
    """Letters as a, digits as 9, runs of either as one."""
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", _DIGIT.sub("9", token[:64])))


def variables(text: str) -> list[tuple[int, int, int]]:
    """Token spans that become variables, with their token numbers."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    wanted: dict[int, None] = {}
    for i, (s, e) in enumerate(spans):
        token = text[s:e]
        if "@" in token or _DIGIT.search(token):
            for j in (i - 1, i, i + 1):
                if 0 <= j < len(spans):
                    wanted[j] = None
    return [(i, *spans[i]) for i in sorted(wanted)]


def digit_group(text: str, s: int, e: int) -> tuple[int, int, str, bool, bool] | None:
    """``(start, end, digits)`` of a token that may be part of a number in
    groups, and whether nothing stands before and behind it in the token."""
    m = _GROUP.fullmatch(text, s, e)
    digits = m[2].replace("-", "") if m else ""
    return (*m.span(2), digits, not m[1], not m[3]) if len(digits) in GROUP_DIGITS else None


def card_parts(run: list[tuple]) -> list[tuple[int, int]]:
    """``(first, last)`` of the parts of a run of digit groups (``start, end,
    digits, ...``) that are card numbers of several groups; leftmost, longest first."""
    found, at = [], 0
    while at < len(run):
        digits, best = run[at][2], -1
        for j in range(at + 1, len(run)):
            digits += run[j][2]
            if len(digits) > 19:
                break
            if len(digits) >= 14 and luhn(digits):
                best = j
        if best >= 0:
            found.append((at, best))
        at = max(at, best) + 1
    return found


def grouped_cards(text: str, found: list[tuple[int, int, int]]) -> dict[int, str]:
    """Joined digits for every variable of ``found`` that belongs to a card
    number in groups."""
    out: dict[int, str] = {}
    run: list[tuple] = []

    def close() -> None:
        for a, b in card_parts(run):
            out.update(dict.fromkeys((g[5] for g in run[a:b + 1]), "".join(g[2] for g in run[a:b + 1])))
        run.clear()

    for k, (i, s, e) in enumerate(found):
        group = digit_group(text, s, e)
        if run and not (group and group[3] and run[-1][4] and found[k - 1][0] == i - 1):
            close()
        if group:
            run.append((*group, k))
    close()
    return out


def features(text: str, s: int, e: int, before: str, after: str, in_card: bool = False) -> list[int]:
    """Hashed features of one token and its neighbours' forms; ``in_card``: it
    is part of digit groups that are a card number together."""
    token = text[s:e].strip(".,;:!?\"'<>[]{}#$%&*|")
    digits = "".join(_DIGIT.findall(token[:256]))
    parts = token[:64].split(".")
    said = ["bias", "s:" + shape(token), "n:" + str(min(len(digits), 24)),
            "p:" + shape(before) + "|" + shape(token), "q:" + shape(token) + "|" + shape(after),
            "w:" + before.lower()[:16], "@" if "@" in token else "no@"]
    if len(digits) >= 12:
        said.append(f"luhn:{luhn(digits)}:{14 <= len(digits) <= 19}")
    if in_card:
        said.append("groups")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        said.append(f"octets:{all(len(p) < 4 and int(p) < 256 for p in parts)}")
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in said]


@dataclass
class Graph:
    """Variables of many texts, with chain (0) and skip (1) links."""

    doc: list[int]
    spans: list[tuple[int, int]]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]

    @classmethod
    def of(cls, texts: list[tuple[int, str]]) -> Graph:
        g = cls([], [], [], [])
        for number, text in texts:
            seen: dict[str, int] = {}
            found = variables(text)
            words = [text[s:e] for _, s, e in found]
            cards = grouped_cards(text, found)
            for k, (i, s, e) in enumerate(found):
                here = len(g.doc)
                next_to = k > 0 and found[k - 1][0] == i - 1
                follows = k + 1 < len(found) and found[k + 1][0] == i + 1
                g.doc.append(number)
                g.spans.append((s, e))
                g.features.append(features(text, s, e, words[k - 1] if next_to else "", words[k + 1] if follows else "",
                                           k in cards))
                if next_to:
                    g.edges.append((here - 1, here, 0))
                token = words[k].strip(".,;:!?\"'").lower()
                digits = "".join(_DIGIT.findall(token))
                # a card number in groups meets its copies, in whatever notation, at its first group
                whole = "#" + cards[k] if k in cards and not (next_to and cards.get(k - 1) is cards[k]) else ""
                for key in {token if digits or "@" in token else "", "#" + digits if len(digits) >= 6 else "", whole} - {""}:
                    if key in seen and seen[key] != here:
                        g.edges.append((seen[key], here, 1))
                    seen[key] = here
        return g

    def labels(self, spans_of: dict[int, list[tuple[int, int, str]]]) -> np.ndarray:
        out = np.full(len(self.doc), OTHER)
        for i, (d, (s, e)) in enumerate(zip(self.doc, self.spans)):
            for bs, be, kind in spans_of[d]:
                if s < be and bs < e:
                    out[i] = KINDS.index(kind)
                    break
        return out


@dataclass
class Field:
    """Unary weights (features x labels) and pair potentials (chain, skip)."""

    unary: np.ndarray
    pairs: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, OTHER + 1))
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        return np.add.reduceat(self.unary[flat], starts, axis=0)

    def marginals(self, graph: Graph, iterations: int = ITERATIONS) -> np.ndarray:
        """Loopy sum-product: messages both ways along every link."""
        scores = self.scores(graph.features)
        n, k = scores.shape
        if not n:
            return scores
        belief = scores
        if graph.edges:
            a, b, kind = np.array(graph.edges).T
            source, target, kind = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kind, kind])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            potential = np.exp(self.pairs)
            message = np.zeros((len(source), k))
            for _ in range(iterations):
                out = belief[source] - message[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.empty_like(message)
                for t in (0, 1):
                    at = kind == t
                    # potentials read from the earlier to the later variable
                    first = at & (np.arange(len(source)) < len(a))
                    second = at & ~first
                    new[first] = out[first] @ potential[t]
                    new[second] = out[second] @ potential[t].T
                new = np.log(new / new.sum(axis=1, keepdims=True) + 1e-12)
                message = 0.5 * message + 0.5 * new
                belief = scores + np.stack([np.bincount(target, message[:, j], n) for j in range(k)], axis=1)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Fit a field to texts labelled by the patterns."""
    numbered = list(enumerate(texts))
    graph = Graph.of(numbered)
    k = OTHER + 1
    field = Field(np.zeros((FEATURES, k)), np.zeros((2, k, k)))
    if not graph.doc:
        return field
    gold = graph.labels({i: base_spans(t) for i, t in numbered})
    flat = np.fromiter((f for r in graph.features for f in r), np.int64)
    owner = np.repeat(np.arange(len(gold)), [len(r) for r in graph.features])
    onehot = np.eye(k)[gold]
    # classes weigh alike up to a factor: rare kinds are not drowned
    weight = np.sqrt(len(gold) / (np.bincount(gold, minlength=k) + 1.0))[gold]
    weight /= weight.mean()
    seen = np.sqrt(np.bincount(flat, minlength=FEATURES) + 1.0)[:, None]
    for _ in range(epochs):
        s = field.scores(graph.features)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        error = ((onehot - p / p.sum(axis=1, keepdims=True)) * weight[:, None])[owner]
        gradient = np.stack([np.bincount(flat, error[:, j], FEATURES) for j in range(k)], axis=1)
        field.unary += rate * gradient / seen - decay * field.unary
    share = np.bincount(gold, minlength=k) + 1.0
    share /= share.sum()
    for t in (0, 1):
        counts = np.outer(share, share) * 20
        for a, b, kind in graph.edges:
            if kind == t:
                counts[gold[a], gold[b]] += 1
        joint = counts / counts.sum()
        field.pairs[t] = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    # a link moves a belief, it does not decide it
    field.pairs = np.clip(field.pairs, -3, 3)
    return field


def _may_be(kind: str, token: str) -> bool:
    """A label that came from the neighbours alone is not taken for a span."""
    if kind == "email":
        return "@" in token
    if kind == "ip":
        return token.count(".") == 3
    return len(_DIGIT.findall(token)) >= (12 if kind == "card" else 1)


def added_spans(graph: Graph, marginals: np.ndarray, texts: dict[int, str],
                base: dict[int, list[tuple[int, int, str]]], least: float = LEAST) -> dict[int, list]:
    """Spans of labelled tokens that no base span touches; neighbouring phone
    tokens are one span, and so are groups of digits that make a card number."""
    found: dict[int, list] = {}
    runs: list[tuple[int, list[tuple]]] = []  # of neighbouring card tokens that are groups of digits
    label, p = marginals.argmax(axis=1), marginals.max(axis=1)
    last = -2
    for i in np.flatnonzero((label != OTHER) & (p >= least)).tolist():
        d, (s, e) = graph.doc[i], graph.spans[i]
        text = texts[d]
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        token, kind = text[s:e], KINDS[label[i]]
        if any(s < be and bs < e for bs, be, _ in base[d]):
            continue
        if kind == "card" and (group := digit_group(text, *graph.spans[i])):
            if runs and runs[-1][0] == d and last == i - 1 and runs[-1][1][-1][4] and group[3] and text[runs[-1][1][-1][1]:s].isspace():
                runs[-1][1].append(group)
            else:
                runs.append((d, [group]))
            last = i
            continue
        if not _may_be(kind, token):
            continue
        spans = found.setdefault(d, [])
        if last == i - 1 and spans and spans[-1][2] == kind and kind == "phone" and text[spans[-1][1]:s].isspace():
            spans[-1] = (spans[-1][0], e, kind)
        else:
            spans.append((s, e, kind))
        last = i
    for d, run in runs:
        parts = card_parts(run)
        if not parts and 12 <= sum(len(g[2]) for g in run) <= 19:
            parts = [(0, len(run) - 1)]
        if parts:
            found.setdefault(d, []).extend((run[a][0], run[b][1], "card") for a, b in parts)
    return {d: kept for d, spans in found.items()
            if (kept := [x for x in spans if x[2] != "phone" or len(_DIGIT.findall(texts[d][x[0]:x[1]])) >= 7])}


def in_order(spans: list[tuple]) -> list[tuple]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def detect(column: pa.Array, field: Field) -> tuple[dict[int, str], dict[int, list], dict[int, list]]:
    """Texts of the column that hold a digit or an at sign (no other text can
    hold a span), their base spans and the added ones, by row."""
    flat, offsets = utf8_flat(column)
    digit = np.zeros(256, bool)
    digit[list(b"0123456789@")] = True
    hits = np.concatenate([[0], np.cumsum(digit[flat])])
    asked = np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]]).tolist()
    texts = {i: column[i].as_py() for i in asked}
    base = {i: base_spans(t) for i, t in texts.items()}
    graph = Graph.of(list(texts.items()))
    return texts, base, added_spans(graph, field.marginals(graph), texts, base)


def training_texts(rows: DataFrame, train_docs: int, train_chars: int) -> list[str]:
    """A bounded sample, the smallest id hashes among documents that hold a
    digit or an at sign. Ids first, so that few texts reach the driver."""
    usable = rows.filter((F.length("text") <= train_chars) & F.col("text").rlike("[0-9@]")).withColumn(
        "_h", F.xxhash64("doc_id", F.lit(7)))
    top = [r[0] for r in usable.select("_h").orderBy("_h").limit(train_docs).collect()]
    if not top:
        return []
    return [r[0] for r in usable.filter(F.col("_h") <= top[-1]).orderBy("_h", "text").limit(train_docs).select("text").collect()]


SCHEMA = ("doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>, masked string")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS,
                       field: Field | None = None, with_masked: bool = False) -> DataFrame:
    """``doc_id, spans`` (base and added, by start then kind) and, on request,
    the text with every span replaced by its kind."""
    rows = id_text(docs, id_col, text_col)
    model = field or train(training_texts(rows, train_docs, train_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts, base, more = detect(batch.column(1), model)
            spans, masked = [], []
            for i in range(batch.num_rows):
                own = in_order([(*x, True) for x in base.get(i, [])] + [(*x, False) for x in more.get(i, [])])
                spans.append([{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in own])
                masked.append(mask(texts[i], [x[:3] for x in own]) if with_masked and own else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([
                    ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))),
                 pa.array(masked, pa.string())], ["doc_id", "spans", "masked"])

    out = rows.mapInArrow(run, SCHEMA)
    return out if with_masked else out.drop("masked")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with spans replaced; overlapping spans go as one."""
    out, last = [], 0
    for s, e, kind in spans:
        if s >= last:
            out += [text[last:s], MASKS[kind]]
        last = max(last, e)
    return "".join(out + [text[last:]])


def masked_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **settings) -> DataFrame:
    """All columns of ``docs``, personal data in the text replaced; the masking
    runs in the same pass, without a join."""
    model = train(training_texts(id_text(docs, "doc_id", text_col), settings.get("train_docs", TRAIN_DOCS),
                                 settings.get("train_chars", TRAIN_CHARS)))
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            column = batch.column(at)
            texts, base, more = detect(column.fill_null(""), model)
            new = column.to_pylist()
            for i, text in texts.items():
                new[i] = mask(text, in_order(base[i] + more.get(i, [])))
            columns = list(batch.columns)
            columns[at] = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in names:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(
            F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return out
