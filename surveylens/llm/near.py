"""Near-duplicate groups by HyperMinHash.

A document's set holds its distinct five-word shingles. A sketch has
``REGISTERS`` buckets; a bucket keeps the smallest hash dealt to it, compressed
to the count of leading zeros (6 bits) and the next ten bits (mantissa). Buckets
that no shingle reached take the smallest hash of a further round of hashing,
so that a register of two sets agrees with the probability of their Jaccard
similarity, for short texts as well.

Candidates come from bands of compressed registers. Documents with one and the
same set are one node before that. In a bucket every node is held against the
smallest one only; confirmed links make components. Of buckets that still span
several components, members that hold too many shingles which no other member of such buckets has go: they
cannot link, as what they share is too little for the sizes in their bucket (``_may_link``; exact). Of the others
the smallest members of components are compared, in blocks, turn by turn while a
bucket has more than a block of them, which leaves a block's worth of a group of copies whatever its size. What is then still apart is
compared in full: all members of a bucket with those outside its largest component. Only that
step grows with the square of a bucket, namely of one with many members that are unlike each other and yet
have few shingles of their own. A block pair
gives fewer links than it has rows (union-find). Candidates are screened by sizes and by the register estimate,
corrected for chance collisions of compressed registers, and confirmed on the
full sets.

The threshold is a parameter (``THRESHOLD`` unless given); the number of bands of
``ROWS`` registers and the screen follow from it (``Bar``), so that a pair at the
threshold is no candidate with a probability of at most ``MISS``.

Null, empty and blank texts have an empty set and link with nothing. Rows that
share an id are one document. Rows without an id show the group of their set (or
null) and always stay. Texts of any length are read whole. Columns other than id and text are not
read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens.llm.common import (
    BROADCAST_IDS, HOT_ROWS, counted, cut_lineage, id_text, join_hot, mix64, rows_with_ids, rows_without_ids, shards_for,
    small_batches, text_slices)
from surveylens.llm.words import WordHashes, lower_ascii, ngram_hashes

SHINGLE = 5
THRESHOLD = 0.85
REGISTERS = 125  # of the threshold of 0.85
ROWS = 5
MANTISSA = 10
#: Probability, at most, that a pair at the threshold shares no band.
MISS = 5e-7
#: Candidates whose estimate lies so many standard errors under the threshold are not confirmed.
SCREEN_ERRORS = 5
#: Members of a bucket, and shingles of theirs, that one task holds against as many others.
BLOCK, BLOCK_SHINGLES = 128, 1 << 19
#: Rows that are searched in one group of blocks, about.
SLOT_ROWS = 2048
#: Rows (labels of nodes, members of blocks) up to which a side of a join is a broadcast; with more
#: of them rows are shuffled, and a label may be a hot key. The plan differs, not the result.
HOT_NODES = 1 << 16
#: Turns, at most, in which components are joined by their smallest members before all members are.
TURNS = 4


@dataclass(frozen=True)
class Bar:
    """A threshold as a fraction (a link: ``whole`` * intersection >= ``part`` *
    union), and the bands and the screen that find its pairs."""

    part: int
    whole: int
    bands: int
    screen: float

    @classmethod
    def of(cls, threshold: float) -> Bar:
        if not 0 < threshold <= 1:
            raise ValueError(f"threshold {threshold} is not in (0, 1]")
        exact = Fraction(str(threshold))
        share = threshold ** ROWS
        bands = math.ceil(math.log(MISS) / math.log1p(-share)) if share < 1 else 1
        error = math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
        return cls(exact.numerator, exact.denominator, bands, threshold - SCREEN_ERRORS * error)

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    def links(self, common: int, a: int, b: int) -> bool:
        return self.whole * common >= self.part * (a + b - common)

    def fits(self, a, b):
        """Whether sets of these sizes can link (columns or arrays)."""
        return (a * self.whole >= b * self.part) & (b * self.whole >= a * self.part)


def shingle_set(text: str, table: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = lower_ascii(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = table.of(words)
    return np.unique(ngram_hashes(hashes, min(n, len(words))) ^ np.uint64(min(n, len(words)) == n))


def sketch(shingles: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """uint16 registers of a non-empty set."""
    out = np.zeros(registers, np.uint64)
    empty = np.ones(registers, bool)
    first, rest = 0, np.uint64((1 << 48) - 1)
    while empty.any():
        rounds = max(1, min(1 << 15, 1024 // len(shingles)))
        with np.errstate(over="ignore"):
            seeds = (np.arange(first, first + rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
            hashes = mix64(shingles[None, :] + seeds[:, None])
        bucket = ((hashes >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
        value = (mix64(hashes) & rest) | (np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(48))
        low = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, bucket.ravel(), value.ravel())
        found = empty & (low != np.iinfo(np.uint64).max)
        out[found] = low[found] & rest
        empty &= ~found
        first += rounds
    # leading zeros of a 48-bit number, and the bits after the leading one
    _, exponent = np.frexp(out.astype(np.float64))
    zeros = 48 - exponent
    shift = exponent - 1 - mantissa
    bits = np.where(shift >= 0, out >> np.maximum(shift, 0).astype(np.uint64),
                    out << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << mantissa) - 1)
    return (zeros.astype(np.uint64) << np.uint64(mantissa) | bits).astype(np.uint16)


def chance_match(mantissa: int = MANTISSA) -> float:
    """Probability that two independent registers agree: equal leading zeros
    (2^-z each) and equal mantissas."""
    return (1 / 3) * 2.0 ** -mantissa


def estimate(equal: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the share that agrees by chance."""
    c = chance_match()
    return (equal / registers - c) / (1 - c)


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_key binary, registers binary"


def sketches(docs: DataFrame, registers_of_set: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers`` of ``(doc_id, text)`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in text_slices(batches):
            sizes, keys, registers = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, table)
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(b"")
                    registers.append(b"")
                    continue
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                registers.append(sketch(shingles, registers_of_set).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(registers, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "registers"])

    return docs.mapInArrow(run, SKETCH_SCHEMA)


def _of_nodes(df: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows of ``df`` whose ``node`` is among ``ids``, which has ``most`` rows and may repeat one."""
    return rows_with_ids(df, ids, "node", most) if most <= BROADCAST_IDS else rows_with_ids(df, ids.distinct(), "node")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _met(pairs: DataFrame, n: int, left: DataFrame, right: DataFrame) -> DataFrame:
    """``n`` pairs with the columns of both ends."""
    return (F.broadcast(pairs) if n <= HOT_NODES else pairs).join(left, "a").join(right, "b")


def _screened(pairs: DataFrame, n: int, nodes: DataFrame, bar: Bar) -> DataFrame:
    """Those of ``n`` pairs ``(a, b)`` whose sizes and register estimates allow a link."""
    side = _of_nodes(nodes.select("node", "n_shingles", "registers"), _ends(pairs), 2 * n)
    left = side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    both = _met(pairs, n, left, right).filter(bar.fits(F.col("na"), F.col("nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, bar.registers)
                          for i in (2, 3))
                likely = estimate((ra == rb).sum(axis=1), bar.registers) >= bar.screen
                yield batch.select(["a", "b"]).filter(pa.array(likely))

    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, n: int, texts: DataFrame, bar: Bar) -> DataFrame:
    """Those of ``n`` pairs that link on their full sets; ``texts`` has one text per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            links = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sa, sb = shingle_set(ta, table), shingle_set(tb, table)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                links.append(bar.links(common, len(sa), len(sb)))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return _met(pairs, n, left, right).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``, which every round reads: the smallest
    node reachable, by passing the smallest label on and jumping over it. A round of few
    nodes shuffles once, as their labels go to the rows."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = links.select(F.explode(both).alias("e")).select("e.*")
    labels, n = counted(edges.groupBy(F.col("u").alias("node")).agg(
        F.min("v").alias("low")).select("node", F.least("node", "low").alias("component")))
    few = n <= HOT_NODES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    while True:
        near = edges.join(side(labels.withColumnRenamed("node", "v")), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("component").alias("low"))
        passed, _, changed = counted(near.join(side(labels), "node").select(
            "node", "component", F.least("component", "low").alias("next")), F.col("next") != F.col("component"))
        # labels that are equal along all links are the smallest nodes
        if not changed:
            return labels
        up = passed.select(F.col("node").alias("next"), F.col("next").alias("top"))
        if few:
            above = passed.join(F.broadcast(up), "next")
        else:
            hot = passed.groupBy("next").count().filter(F.col("count") > HOT_ROWS).select("next")
            above = join_hot(passed, up, "next", hot)
        labels = cut_lineage(above.select("node", F.least("next", "top").alias("component")))


def _relabeled(labels: DataFrame, n: int, tops: DataFrame, few: bool) -> DataFrame:
    """``n`` labels after components were joined: ``tops``, which are ``few`` or not, has those that were as nodes."""
    up = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    if few:
        above = labels.join(F.broadcast(up), "component", "left")
    else:
        hot = labels.groupBy("component").count().filter(F.col("count") > HOT_ROWS).select("component")
        above = join_hot(labels, up, "component", hot)
    known = labels.select("node")
    alone = tops.join(F.broadcast(known) if n <= HOT_NODES else known, "node", "left_anti")
    return above.select("node", F.coalesce("top", "component").alias("component")).unionByName(alone)


class Joined(dict):
    """Union-find over components: a pair that is joined already needs no link."""

    def top(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up]
            x = up
        return x


MEMBER_SCHEMA = ("bucket long, row int, col int, side int, band int, node long, component long, "
                 "n_shingles long, registers binary")


def _search(members: DataFrame, confirm: bool, slots: int, bar: Bar) -> DataFrame:
    """Compare the rows of each block pair, side 0 with side 1 (2: with all others), across
    components; a pair counts in its first common band only. ``members`` has the columns of
    ``MEMBER_SCHEMA`` and, to ``confirm``, ``text``. Gives confirmed links ``(a, b)`` of components,
    of each group fewer than it has components, or else the members that have a likely
    partner in their block pair. The block pairs, most of which are small, are dealt into ``slots`` groups."""

    def search(rows: pd.DataFrame, table: WordHashes, joined: Joined) -> tuple[list, np.ndarray]:
        band = int(rows.band.iloc[0])
        registers = np.frombuffer(b"".join(rows.registers), np.uint16).reshape(-1, bar.registers)
        size, component = rows.n_shingles.to_numpy(), rows.component.to_numpy()
        side = rows.side.to_numpy()
        right = np.flatnonzero(side != 0)
        sets, links, likely = {}, [], np.zeros(len(rows), bool)

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(rows.text.iloc[i], table)
            return sets[i]

        for i in np.flatnonzero(side != 1):
            at = right[(component[right] != component[i]) & bar.fits(size[right], size[i])]
            if not len(at):
                continue
            equal = registers[at] == registers[i]
            first = equal.reshape(len(at), bar.bands, ROWS).all(axis=2).argmax(axis=1) == band
            at = at[first & (estimate(equal.sum(axis=1), bar.registers) >= bar.screen)]
            likely[at] = True
            likely[i] |= len(at) > 0
            for j in at if confirm else ():
                x, y = joined.top(component[i]), joined.top(component[j])
                if x == y:
                    continue
                common = len(np.intersect1d(set_of(i), set_of(j), assume_unique=True))
                if bar.links(common, int(size[i]), int(size[j])):
                    links.append((component[i], component[j]))
                    joined[max(x, y)] = min(x, y)
        return links, likely

    names = [x.split()[0] for x in MEMBER_SCHEMA.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "row", "col"], kind="stable").reset_index(drop=True)
        keys = rows[["bucket", "row", "col"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        table, joined, links, likely = WordHashes(), Joined(), [], []
        for start, end in zip(starts, [*starts[1:], len(rows)]):
            found, marked = search(rows.iloc[start:end], table, joined)
            links += found
            likely.append(marked)
        if confirm:
            return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        return rows.loc[np.concatenate(likely), names]

    dealt = members.withColumn("slot", F.pmod(F.xxhash64("bucket", "row", "col"), F.lit(slots)))
    return dealt.groupBy("slot").applyInPandas(run, "a long, b long" if confirm else MEMBER_SCHEMA)


def _linked(dealt: DataFrame, n: int, nodes: DataFrame, rows: DataFrame, bar: Bar) -> tuple[DataFrame, int]:
    """Confirmed links of components among ``dealt``, ``n`` members in block pairs (``_search`` without
    sizes, registers and text), and their number: likely partners first, so that only their texts are fetched."""
    side = nodes.select("node", "n_shingles", "registers")
    if n <= HOT_NODES:
        members = side.join(F.broadcast(dealt), "node")
    else:
        members = _of_nodes(side, dealt.select("node"), n).join(dealt, "node")
    likely, n = counted(_search(members, False, shards_for(n, SLOT_ROWS), bar))
    texts = _node_texts(rows, likely.select("node"), n)
    found = _search(likely.join(texts, "node"), True, shards_for(n, SLOT_ROWS // 8), bar)
    return counted(found) if n else (likely, 0)


def _blocks(n, shingles):
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _own_shingles(texts: DataFrame) -> DataFrame:
    """``(node, own)``: the number of a node's shingles that no other of ``texts`` (one per node) has; nodes
    without one may be missing. A task sums up the shingles it has seen before they are shuffled."""

    def summed(nodes: list, sets: list) -> pa.RecordBatch:
        shingles, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        owner = np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])[first]
        return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(owner), pa.array(n)],
                                          ["shingle", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, nodes, sets, held = WordHashes(), [], [], 0
        for batch in text_slices(batches):
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes.append(node)
                sets.append(shingle_set(text, table))
                held += len(sets[-1])
                if held >= BLOCK_SHINGLES:
                    yield summed(nodes, sets)
                    nodes, sets, held = [], [], 0
        if nodes:
            yield summed(nodes, sets)

    seen = texts.select("node", "text").mapInArrow(run, "shingle long, node long, n long")
    return seen.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy(
        "node").agg(F.count(F.lit(1)).alias("own"))


def _may_link(open_: DataFrame, n: int, rows: DataFrame, bar: Bar) -> DataFrame:
    """The rows of ``open_`` (members of buckets that span components, ``n`` rows) that may link with
    another of their bucket. Two members share at most what either holds besides its own shingles, those
    that no other member of any of these buckets has; with the sizes, that rules out members without a
    comparison. The others of a bucket are looked at in classes of about two percent of size, by
    the smallest and the largest size and the most besides own shingles, which rule out no more."""
    ids = open_.select("node").distinct()
    own = _own_shingles(_node_texts(rows, ids, n))
    spare = cut_lineage(open_.join(F.broadcast(own) if n <= HOT_NODES else own, "node", "left").withColumn(
        "most", F.col("n_shingles") - F.coalesce("own", F.lit(0))).drop("own"))
    sizes = spare.groupBy("bucket", F.floor(32 * F.log2("n_shingles"))).agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max("most").alias("most"))
    of_bucket = sizes.groupBy("bucket").agg(F.collect_list(F.struct("low", "high", "most")).alias("sizes"))

    def possible(other):
        size = F.col("n_shingles")
        return ((other["high"] * bar.whole >= size * bar.part) & (size * bar.whole >= other["low"] * bar.part)
                & (F.least(F.col("most"), other["most"]) * (bar.whole + bar.part) >= (size + other["low"]) * bar.part))

    return spare.join(of_bucket, "bucket").filter(F.exists("sizes", possible)).select(open_.columns)


def _heads(placed: DataFrame, turn: int) -> DataFrame:
    """The smallest member of each component in a bucket that has several (``n``), in blocks of
    their own: one in, fewer out."""
    heads = placed.groupBy("bucket", "component").agg(
        F.min("node").alias("node"), F.min("band").alias("band"), F.min_by("n_shingles", "node").alias("s"))
    several = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).filter("n > 1").select(
        "bucket", "n", _blocks(F.col("n"), F.col("s")).alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
    return heads.drop("s").join(several, "bucket").withColumn("row", own).withColumn("col", F.col("row")).withColumn(
        "side", F.lit(2)).drop("blocks")


def _rest(open_: DataFrame) -> DataFrame:
    """All members of a bucket against those outside its largest component: in blocks, the
    one by the other."""
    sizes = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    per = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "s", "component")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "bucket", F.col("most.component").alias("largest"), _blocks(F.col("n"), F.col("s")).alias("cols"),
        _blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("rows"))
    both = open_.join(per, "bucket")
    def grid(side: int, own: str, other: str, out: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("row" if side == 0 else "col")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(out)
        return both.filter("component != largest" if side == 0 else "true").select(
            "bucket", "band", "node", "component", F.lit(side).alias("side"), mine, spread)
    return grid(0, "rows", "cols", "col").unionByName(grid(1, "cols", "rows", "row"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    bar = Bar.of(threshold)
    small_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    sketched = cut_lineage(sketches(rows, bar.registers))
    # equal sets have equal registers: one node for each set, whatever the number of copies
    nodes = cut_lineage(sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(
        "set_key", "n_shingles", "registers").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    # buckets with several members, which are few: all that follows works on these
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.substring("registers", width * i + 1, width), F.lit(i)) for i in range(bar.bands)])
    buckets = nodes.select("node", "n_shingles", F.posexplode(bands).alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last")
    shared = cut_lineage(buckets.join(heads.select("bucket", "head"), "bucket"))
    stars, n = counted(shared.filter("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    likely, n = counted(_screened(stars, n, nodes, bar))
    links, n = counted(_confirmed(likely, n, _node_texts(rows, _ends(likely), 2 * n), bar))
    labels, n_labels = components(links), 2 * n  # at most

    def labeled(df: DataFrame) -> DataFrame:
        side = F.broadcast(labels) if n_labels <= HOT_NODES else labels
        return df.join(side, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # of buckets that span components, the members that may link at all
    placed = labeled(shared.drop("head"))
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    shared, n = counted(placed.join(several, "bucket", "left_semi").drop("component"))
    if n:
        shared = cut_lineage(_may_link(shared, n, rows, bar))
    # a bucket's components by their smallest members, while that joins some; then what is still apart
    turn, joins = 0, 1
    while True:
        if joins:
            placed = labeled(shared)
            dealt, n, wide = counted(_heads(placed, turn), F.col("n") > BLOCK)
        if not n:
            break
        # another turn is of use only where heads of a bucket stood in several blocks
        full = turn > 0 and not (joins and wide and turn < TURNS)
        if full:
            open_ = dealt.select("bucket").distinct()
            placed = cut_lineage(placed.join(F.broadcast(open_) if n <= HOT_NODES else open_, "bucket", "left_semi"))
            members, n = counted(_rest(placed))
        found, joins = _linked(members if full else dealt.drop("n"), n, nodes, rows, bar)
        if joins:
            labels, n_labels = counted(_relabeled(labels, n_labels, components(found), 2 * joins <= HOT_NODES))
        if full:
            break
        turn += 1
    by_set = labeled(nodes.select("set_key", "node")).select("set_key", "component")
    # texts without words have no set; a set of many documents is a hot key
    hot = nodes.filter(F.col("copies") > HOT_ROWS).select("set_key")
    whole = join_hot(sketched.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), by_set, "set_key", hot)
    whole = whole.unionByName(sketched.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", "set_key", F.lit(None).cast("long").alias("component")))
    return whole.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _node_texts(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``(node, text)`` of the given nodes (``most`` rows, which may repeat); an id that repeats counts once."""
    return _of_nodes(rows.withColumnRenamed("doc_id", "node"), nodes, most).groupBy("node").agg(
        F.min("text").alias("text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, with all columns."""
    copies, n = counted(near_groups(docs, id_col, text_col, threshold).filter(~F.col("kept")).select("doc_id").distinct())
    return rows_without_ids(docs, copies, id_col, n)
