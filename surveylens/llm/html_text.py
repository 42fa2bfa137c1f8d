"""Main text of web pages by a site style tree.

The DOMs of one host are merged into a tree of style nodes: elements with the
same path of tags and class names from the root are one node. A node's
presentation importance is the entropy of the child sequences that pages show
there; its content importance is one less the mean entropy of its content
features (hashes of all its four-word shingles): what stands on every page of a
host has importance 0, what stands on one page has importance 1. The composite
of both, from the leaves upwards, is smoothed by ``PRIOR_PAGES`` pages that show
an important node, and decides: a branch of which no node reaches ``THRESHOLD``
is removed from each page of the host. Elements whose tag, role or class name is that of a
menu, header, footer, sidebar, notice, advert, form or reader comments have no
importance, whatever they hold. A name with such a word among others (``social-science``) is a
prior only: it counts if the element holds no more than half of the page's text; names that
say something of a page (``has-sidebar``, ``comments-open``) do not count. Where a page marks its article (``article``,
``main``), ``MARK`` is added to the importance inside; outside, it is taken off,
and the pages of the prior show an unimportant node.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by two line ends. Null and empty pages give an empty text;
pages without a url share the host ''. Repeated rows get one row each; columns other than id, url and
html are not read, whatever their names. An empty table gives an empty result. Long and deeply
nested pages take time in proportion to their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import cut_lineage, shards_for, small_batches

SHINGLE = 4
THRESHOLD, GAMMA = 0.5, 0.9
#: Weight of the prior in pages, and what an article mark adds to the importance inside it and takes off outside.
PRIOR_PAGES, MARK = 3, 0.25
LOW, LOW_INSIDE, HIGH_OUTSIDE = 0, 1, 2
#: Pages whose content features one task counts, about.
SLOT_PAGES = 2048
#: Bytes of a feature's hash that are shuffled: two of a million features of a node and slot meet with a chance of a third.
FEATURE_BYTES = 5
#: Child sequences that a task sums up before it passes them on.
HELD_SEQUENCES = 1 << 16
#: Style nodes (of all hosts) that go to every task as a broadcast; more are joined by host.
BROADCAST_NODES = 1 << 18

# fixed values: element names and the words that name page furniture
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
summary table tbody td tfoot th thead tr ul""".split())
SKIPPED = frozenset("""applet audio button canvas datalist embed form head iframe input math meter nav noembed noframes
noscript object optgroup option progress script select style svg template textarea title video""".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search header".split())
FURNITURE_WORDS = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment
comments consent cookie cookies copyright discussion disqus footer gdpr header masthead menu modal nav navbar navigation
newsletter notice notices pager pagination popup promo promoted promotion reactions related replies reply respond share
sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
#: Words that say where or what kind a piece of furniture is, and words that make a name say something of a page.
PLACE_WORDS = frozenset("""area bar block body bottom box buttons center col column container content fixed float global group
inner item items left links list main outer overlay page panel primary right row secondary section site sticky tertiary top
user users wrap wrapper""".split())
STATE_WORDS = frozenset("close closed disabled enabled has hide hidden is no not off on open opened show without with".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_TAGS = frozenset("article main".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An open element: its style path's hash, and what it tells about its content. ``doubt`` is the
    innermost element around (or itself) whose names only may mean furniture."""

    __slots__ = ("tag", "path", "furniture", "main", "children", "doubt", "outer", "size")

    def __init__(self, tag: str, style: str, parent: Node | None, furniture: bool, doubtful: bool = False) -> None:
        self.tag = tag
        self.path = xxhash.xxh3_64_intdigest(style, seed=parent.path if parent else 0) >> 1
        self.main = tag in MAIN_TAGS or bool(parent and parent.main)
        self.furniture = furniture or bool(parent and parent.furniture)
        self.children: list[str] = []
        self.outer = parent.doubt if parent else None
        self.doubt = self if doubtful else self.outer
        self.size = 0  # characters of text, where doubtful


class Stack(list):
    """The open elements, with counts by tag and by path."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.tags, self.paths = Counter([root.tag]), Counter([root.path])

    def push(self, node: Node) -> None:
        self.append(node)
        self.tags[node.tag] += 1
        self.paths[node.path] += 1

    def cut(self, i: int) -> None:
        while len(self) > i:
            node = self.pop()
            self.tags[node.tag] -= 1
            self.paths[node.path] -= 1


def _opens(stack: Stack, tag: str) -> None:
    """Elements that a new block element closes by itself."""
    def drop(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(stack.tags[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                stack.cut(i)
                return
            if stack[i].tag in stop:
                return

    drop(("p",), ("article", "div", "li", "td", "section", "body"))
    if tag == "li":
        drop(("li",), ("ul", "ol", "menu", "dir"))
    elif tag in ("dt", "dd"):
        drop(("dt", "dd"), ("dl",))
    elif tag in ("td", "th"):
        drop(("td", "th"), ("table", "tr"))
    elif tag == "tr":
        drop(("tr",), ("table",))
    elif tag[0] == "h" and tag[1:].isdigit():
        drop(("h1", "h2", "h3", "h4", "h5", "h6"), ("article", "div", "li", "td", "section", "body"))


def _says(token: str) -> int:
    """What one class or id says: 2, it is furniture (only furniture words, and words of place or form);
    1, it may be (a furniture word among others); 0, it is not (``has-sidebar`` says so of a page)."""
    parts = _WORD.findall(token)
    if FURNITURE_WORDS.isdisjoint(parts) or not STATE_WORDS.isdisjoint(parts):
        return 0
    return 2 if all(p in FURNITURE_WORDS or p in PLACE_WORDS for p in parts) else 1


def _marks(attributes: str) -> tuple[str, int]:
    """Class names in order, and what class, id or role say about furniture (``_says``)."""
    classes, says = "", 0
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            says = max(says, 0 if FURNITURE_ROLES.isdisjoint(value.split()) else 2)
        else:
            says = max([says, *map(_says, value.split())])
            if m[1].lower() == "class":
                classes = ".".join(sorted({_DIGITS.sub("0", v) for v in value.split()}))
    return classes, says


def blocks_of(page: str) -> tuple[list[tuple[Node, str]], list[Node], list[tuple[int, int]]]:
    """Text blocks with the element that holds them, all block elements, and
    the (child, parent) paths. Time is in proportion to the page, however it is nested."""
    root = Node("#", "#", None, False)
    stack, nodes, links = Stack(root), [root], []
    last = page.rfind(">")  # behind it are no tags
    blocks: list[tuple[Node, str]] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((stack[-1], text))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at) if at <= last else None
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS and tag not in SKIPPED:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if stack.tags[tag] else ():
                if stack[i].tag == tag:
                    stack.cut(i)
                    break
                if stack[i].main and stack[i].tag in MAIN_TAGS and tag not in ("body", "html"):
                    break  # a stray end tag does not end the article
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            _opens(stack, tag)
        parent = stack[-1]
        classes, says = _marks(m[3]) if m[3] else ("", 0)
        if tag in SKIPPED or (tag in FURNITURE_TAGS and not (tag == "header" and parent.main)):
            says = 2
        if tag in ("html", "body") or tag in MAIN_TAGS:
            says = 0
        parent.children.append(tag)
        node = Node(tag, f"{tag}.{classes}" if classes else tag, parent, says == 2, says == 1)
        if not stack.paths[node.path]:
            links.append((node.path, parent.path))
        stack.push(node)
        nodes.append(node)
    flush()
    # what may be furniture is none if it holds more than half of the page's text
    whole = 0
    for node, text in blocks:
        if not node.furniture:
            whole += len(text)
            if node.doubt:
                node.doubt.size += len(text)
    for node in reversed(nodes):
        if node.doubt is node and node.outer:
            node.outer.size += node.size
    for node in nodes:  # parents come first
        if node.doubt is node:
            node.furniture |= 2 * node.size <= whole or bool(node.outer and node.outer.furniture)
        elif node.doubt:
            node.furniture |= node.doubt.furniture
    return blocks, nodes, links


def _features(text: str) -> list[int]:
    words = text.split()
    n = min(SHINGLE, len(words))
    return [xxhash.xxh3_64_intdigest(" ".join(words[i:i + n])) >> 1 for i in range(len(words) - n + 1)]


FEATURE_SCHEMA = "slot int, host string, path long, parent long, feature long, n long, nodes binary, features binary"
STAT_SCHEMA = ("node long, host string, path long, parent long, pages double, shown double, "
               "occurrences double, repeated double")


def style_features(pages: DataFrame, slots: int) -> DataFrame:
    """Rows ``host, path, parent, feature, n`` with the child sequences of style
    nodes and their numbers of pages, and rows ``nodes, features`` with all
    content features of a batch, packed (besides the slot, ``FEATURE_BYTES`` of
    each); both dealt into ``slots`` by node and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences_of: Counter = Counter()  # summed up over the batches, so that a hot host leaves few rows

        def shown_rows() -> list[tuple]:
            out = [((node_id(host, path) + feature) % slots, host, path, parent, feature, n, None, None)
                   for (host, path, parent, feature), n in sequences_of.items()]
            sequences_of.clear()
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int32(), pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["slot", "host", "path", "parent", "feature", "n", "nodes", "features"])

        for batch in batches:
            rows: list[tuple] = []
            ids, counts, flat = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if not page:
                    continue
                blocks, nodes, links = blocks_of(page)
                parent = dict(links)
                shown: dict[int, set[str]] = {}
                held: dict[int, set[int]] = {}
                for n in nodes:
                    shown.setdefault(n.path, set()).add(" ".join(n.children))
                for n, text in blocks:
                    held.setdefault(n.path, set()).update(_features(text))
                for path, sequences in shown.items():
                    feature = xxhash.xxh3_64_intdigest("|".join(sorted(sequences))) >> 1
                    sequences_of[host, path, parent.get(path, 0), feature] += 1
                for path, found in held.items():
                    ids.append(node_id(host, path))
                    counts.append(len(found))
                    flat.extend(found)
            features = np.array(flat, np.int64)
            owners = np.repeat(np.array(ids, np.int64), counts)
            slot = features % slots
            order = np.lexsort((owners, slot))
            ends = np.searchsorted(slot[order], np.arange(slots + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                at = order[ends[k]:ends[k + 1]]
                rows.append((k, None, 0, 0, 0, 0, owners[at].tobytes(), _packed(features[at])))
            if len(sequences_of) >= HELD_SEQUENCES:
                rows += shown_rows()
            yield batch_of(rows)
        yield batch_of(shown_rows())

    return pages.mapInArrow(run, FEATURE_SCHEMA)


def node_id(host: str, path: int) -> int:
    """One number for a host's style node."""
    return xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace"), seed=path) >> 1


def _packed(features: np.ndarray) -> bytes:
    """The upper ``FEATURE_BYTES`` of each feature (of 63 bits)."""
    return (features >> (63 - 8 * FEATURE_BYTES)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // FEATURE_BYTES, 8), np.uint8)
    out[:, :FEATURE_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, FEATURE_BYTES)
    return out.view("<i8").ravel()


def _counted(nodes: np.ndarray, features: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes, and the sums of ``n`` and ``n ln n`` over their features' counts ``n``."""
    order = np.lexsort((features, nodes))
    nodes, features = nodes[order], features[order]
    first = np.ones(len(nodes), bool)
    first[1:] = (nodes[1:] != nodes[:-1]) | (features[1:] != features[:-1])
    start = np.flatnonzero(first)
    n = np.add.reduceat(times[order].astype(float), start)
    owner, at = np.unique(nodes[start], return_inverse=True)
    return owner, np.bincount(at, n, len(owner)), np.bincount(at, n * np.log(n), len(owner))


def style_stats(features: DataFrame) -> DataFrame:
    """``host, path, parent, pages, shown, occurrences, repeated`` of every style
    node: each slot counts its features, the slots' sums are added up."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = rows.features.notna()
        shows = rows[~packed]
        out = []
        if len(shows):
            ids = np.array([node_id(h, p) for h, p in zip(shows.host, shows.path)], np.int64)
            node, pages, shown = _counted(ids, shows.feature.to_numpy(), shows.n.to_numpy())
            meta = pd.DataFrame({"node": ids, "host": shows.host.to_numpy(), "path": shows.path.to_numpy(),
                                 "parent": shows.parent.to_numpy()}).groupby("node").agg(
                {"host": "first", "path": "first", "parent": "min"}).loc[node].reset_index()
            out.append(meta.assign(pages=pages, shown=shown, occurrences=0.0, repeated=0.0))
        if packed.any():
            nodes = np.frombuffer(b"".join(rows.nodes[packed]), np.int64)
            node, n, repeated = _counted(nodes, _unpacked(b"".join(rows.features[packed])), np.ones(len(nodes)))
            out.append(pd.DataFrame({"node": node, "host": None, "path": 0, "parent": 0, "pages": 0.0, "shown": 0.0,
                                     "occurrences": n, "repeated": repeated}))
        return pd.concat(out)

    sums = [F.sum(c).alias(c) for c in ("pages", "shown", "occurrences", "repeated")]
    return features.groupBy("slot").applyInPandas(count, STAT_SCHEMA).groupBy("node").agg(
        F.max("host").alias("host"), F.max("path").alias("path"), F.min(F.when(F.col("host").isNotNull(), F.col("parent"))).alias("parent"), *sums)


def _downwards(rows, children: dict[int, list[int]], parent: dict[int, int]) -> list[int]:
    """All paths, parents before their children."""
    order, todo = [], [p for p in rows if parent[p] not in rows or parent[p] == p]
    while todo:
        order.append(todo.pop())
        todo += children.get(order[-1], [])
    return order


def importances(stats: pd.DataFrame, gamma: float = GAMMA) -> dict[int, float]:
    """Composite importance of a host's style nodes, from ``path, parent,
    pages, shown, occurrences, repeated`` (the last two sums of ``n`` and ``n ln n``)."""
    rows = {r.path: r for r in stats.itertuples()}
    children: dict[int, list[int]] = {}
    for r in rows.values():
        if r.parent in rows and r.parent != r.path:
            children.setdefault(r.parent, []).append(r.path)
    done: dict[int, float] = {}

    def own(path: int) -> float:
        r = rows[path]
        log_m = math.log(r.pages) if r.pages > 1 else 0.0
        # entropy of shares n_i / m in base m
        presentation = (log_m - r.shown / r.pages) / log_m if log_m else 1.0
        parts = []
        if r.occurrences:
            parts.append((r.pages, 1.0 - r.repeated / r.occurrences / log_m if log_m else 1.0))
        parts += [(rows[c].pages, done[c]) for c in children.get(path, [])]
        if not parts:
            return 0.0  # shows nothing
        below = sum(w * v for w, v in parts) / sum(w for w, _ in parts)
        weight = gamma ** len(children.get(path, []))
        return (1 - weight) * presentation + weight * below

    order = _downwards(rows, children, {p: r.parent for p, r in rows.items()})
    for path in reversed(order):
        done[path] = own(path)
    return done


def smoothed(value: float, pages: float, prior: float) -> float:
    """An importance seen on ``pages`` pages, with ``PRIOR_PAGES`` more that show ``prior``."""
    return (pages * value + PRIOR_PAGES * prior) / (pages + PRIOR_PAGES)


def judged_nodes(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, path, verdict`` of the style nodes that the tree decides:
    ``LOW`` branches go from pages without a mark, ``LOW_INSIDE`` ones from
    inside a mark too, ``HIGH_OUTSIDE`` nodes stay beside a mark. A node on few
    pages cannot get any of them, whatever it holds, so those are left out and a
    host's rows here are as many as its templates have nodes."""
    least = min(n for n in range(1, 1000) if smoothed(0, n, 1) < threshold or smoothed(1, n, 0) - MARK >= threshold)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pages, value = dict(zip(rows.path, rows.pages)), importances(rows)
        best = {p: smoothed(v, pages[p], 1) for p, v in value.items()}  # of a branch
        parent = dict(zip(rows.path, rows.parent))
        children: dict[int, list[int]] = {}
        for path, up in parent.items():
            if up in parent and up != path:
                children.setdefault(up, []).append(path)
        for path in reversed(_downwards(best, children, parent)):
            if parent[path] in best:
                best[parent[path]] = max(best[parent[path]], best[path])
        found = [(p, LOW) for p, v in best.items() if v < threshold]
        found += [(p, LOW_INSIDE) for p, v in best.items() if v + MARK < threshold]
        found += [(p, HIGH_OUTSIDE) for p, v in value.items() if smoothed(v, pages[p], 0) - MARK >= threshold]
        return pd.DataFrame({"host": [key[0]] * len(found), "path": np.array([p for p, _ in found], np.int64),
                             "verdict": np.array([v for _, v in found], np.int32)})

    return stats.filter(F.col("pages") >= least).groupBy("host").applyInPandas(run, "host string, path long, verdict int")


def main_text(page: str | None, noise: frozenset[int], inside: frozenset[int] = frozenset(),
              outside: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that are left, joined: without branches of
    ``noise``; on a page with a mark, without branches of ``inside`` in it and
    with the nodes of ``outside`` beside it."""
    if not page:
        return ""
    blocks, nodes, links = blocks_of(page)
    marked = any(n.tag in MAIN_TAGS and not n.furniture for n in nodes)
    parent = dict(links)

    def removed(gone: frozenset[int]) -> dict[int, bool]:
        """Whether a path lies in a branch of ``gone``, for all paths; parents come first."""
        out: dict[int, bool] = {0: False}
        for n in nodes:
            if n.path not in out:
                out[n.path] = n.path in gone or out.get(parent.get(n.path, 0), False)
        return out

    low = removed(inside if marked else noise)

    def stays(n: Node) -> bool:
        return n.path in outside if marked and not n.main else not low[n.path]

    kept = [text for n, text in blocks if not n.furniture and stays(n)]
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST"))), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host.alias("host"))
    slots = shards_for(pages.count(), SLOT_PAGES)
    judged = cut_lineage(judged_nodes(style_stats(style_features(rows.select("host", "html"), slots))))
    small = judged.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    by_host = judged.groupBy("host").agg(*[
        F.collect_list(F.when(F.col("verdict") == v, F.col("path"))).alias(f"v{v}") for v in (LOW, LOW_INSIDE, HIGH_OUTSIDE)])
    joined = rows.join(F.broadcast(by_host) if small else by_host, "host", "left").select("page_id", "url", "html", "v0", "v1", "v2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, *(frozenset(v or ()) for v in verdicts)) for page, *verdicts in zip(
                *(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
