"""External induced sorting of suffixes, with common-prefix values.

``sort_suffixes`` orders the suffixes of an integer text that ends in a 0 found nowhere else. The leftmost
suffixes of rising type (each of them smaller than the one before it in the text) are named by their
stretch of text up to the next one and ordered by recursion on the string of names; from them a pass
over the symbols upwards induces the falling suffixes, and one downwards the rising ones.

Both passes work from ``SpillQueue``: a monotone priority queue of suffix tuples (first symbol; order of
the suffix that induced them; place; common prefix with the tuple before it), which keeps what
exceeds its memory in a scratch file. A batch holds all suffixes of one symbol: the symbols before them give
the tuples they induce, and the prefix of two neighbours among those is one more than the smallest
value between their sources. Values count up to ``cap``; suffixes that agree so far stand in any order.

A scratch file belongs to one task, has no name in its folder and vanishes with the task.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Bytes of tuples that a queue holds before it writes them out; texts beyond it are mapped from a file.
MEMORY = 256 << 20
#: Names up to which a recursion ends in memory, by doubling.
BASE = 1 << 22
PREFIX_BITS = 8  # a tuple's low bits hold its common prefix

Pairs = tuple[np.ndarray, np.ndarray]
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class SpillQueue:
    """Blocks of tuples by symbol, in order of arrival."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.size, self.written, self.file = memory, 0, 0, None
        self.blocks: dict[int, list] = defaultdict(list)

    def push(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks[symbol].append(places << PREFIX_BITS | prefixes)
        self.size += 8 * len(places)
        if self.size > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, blocks in self.blocks.items():
            held = [b for b in blocks if isinstance(b, np.ndarray)]
            if held:
                tuples = np.concatenate(held)
                tuples.tofile(self.file)
                # blocks before the held ones were written earlier
                self.blocks[symbol] = [b for b in blocks if not isinstance(b, np.ndarray)] + [(self.written, len(tuples))]
                self.written += len(tuples)
        self.size = 0

    def pop(self, symbol: int) -> Pairs:
        """Places and prefixes of all tuples of a symbol."""
        found = []
        for block in self.blocks.pop(symbol, ()):
            if isinstance(block, np.ndarray):
                self.size -= block.nbytes
            else:
                self.file.seek(8 * block[0])
                block = np.fromfile(self.file, np.int64, block[1])
            found.append(block)
        if not found:
            return NONE
        tuples = np.concatenate(found)
        return tuples >> PREFIX_BITS, tuples & ((1 << PREFIX_BITS) - 1)


def _held(values: np.ndarray, memory: int) -> np.ndarray:
    """The array itself, or mapped from a scratch file if it is larger."""
    if values.nbytes <= memory:
        return values
    with tempfile.TemporaryFile() as file:
        values.tofile(file)
        file.flush()
        return np.memmap(file, values.dtype, "r", shape=values.shape)


class Text:
    """A text with words of several symbols at every place, to compare by."""

    def __init__(self, symbols: np.ndarray, memory: int):
        self.symbols, self.n = symbols, len(symbols)
        self.bits = max(1, int(symbols.max()).bit_length())
        self.per_word = 62 // self.bits
        words = np.zeros(self.n, np.int64)
        for k in range(self.per_word):
            words <<= self.bits
            words[:max(self.n - k, 0)] |= symbols[k:]
        self.words = _held(words, memory)

    def common(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and ``b``, which agree up to ``start``."""
        total = np.minimum(start, cap)
        open_ = np.flatnonzero(total < cap)
        while len(open_):
            at = total[open_]
            pa, pb = a[open_] + at, b[open_] + at
            # the 0 at the end stops every pair of places
            differ = self.words[pa] ^ self.words[pb]
            _, exponent = np.frexp(differ.astype(np.float64))  # rounding up may add one bit
            exponent -= (differ >> np.maximum(exponent - 1, 0)) == 0
            same = np.where(differ == 0, self.per_word, (self.per_word * self.bits - exponent) // self.bits)
            total[open_] = np.minimum(at + same, cap)
            open_ = open_[(differ == 0) & (total[open_] < cap)]
        return total


def _smallest(prefixes: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Minimum of ``prefixes[after + 1 : upto + 1]`` for every pair, by a table of powers of two."""
    if not len(after):
        return np.zeros(0, np.int64)
    row = prefixes.astype(np.uint8)
    width = upto - after
    level = np.frexp(width.astype(np.float64))[1] - 1
    out, span = np.empty(len(after), np.int64), 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[after[at] + 1], row[upto[at] + 1 - span])
        row = np.minimum(row[:-span], row[span:]) if len(row) > span else row
        span *= 2
    return out


def _of_symbol(text: Text, symbol: int, first: Pairs, cap: int) -> Pairs:
    """The suffixes of one symbol and one type in the order of the pass: those from other symbols,
    then those that they induce before them by the same symbol, and so on."""
    places, prefixes = first
    if not len(places):
        return NONE
    prefixes[0] = 0
    rounds = [(places, prefixes)]
    while True:
        hit = np.flatnonzero((places > 0) & (text.symbols[places - 1] == symbol))
        if not len(hit):
            break
        between = _smallest(prefixes, hit[:-1], hit[1:]) + 1
        places = places[hit] - 1
        prefixes = np.minimum(np.concatenate([[len(rounds)], between]), cap)
        rounds.append((places, prefixes))
    return np.concatenate([p for p, _ in rounds]), np.concatenate([c for _, c in rounds])


def _joined(text: Text, first: Pairs, then: Pairs, cap: int) -> Pairs:
    if len(first[0]) and len(then[0]):
        then[1][0] = text.common(first[0][-1:], then[0][:1], np.zeros(1, np.int64), cap)[0]
    return np.concatenate([first[0], then[0]]), np.concatenate([first[1], then[1]])


def _induce(text: Text, sources: Pairs, symbol: int, upwards: bool, queue: SpillQueue, cap: int) -> None:
    """Push what the suffixes of ``symbol``, in order, induce among other symbols."""
    places, prefixes = sources
    before = text.symbols[places - 1]  # place 0 looks at the closing 0
    hit = np.flatnonzero((places > 0) & (before > symbol if upwards else before < symbol))
    if not len(hit):
        return
    symbols = before[hit]
    order = np.argsort(symbols, kind="stable")
    hit, symbols = hit[order], symbols[order]
    own = np.ones(len(hit), np.int64)  # the first of a symbol: its source has another symbol than the one before
    same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
    own[same] = np.minimum(_smallest(prefixes, hit[same - 1], hit[same]) + 1, cap)
    induced = places[hit] - 1
    starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(hit)]):
        queue.push(int(symbols[s]), induced[s:e], own[s:e])


def _reversed(ordered: Pairs) -> Pairs:
    """The same suffixes from the other end, each with its prefix with the one that is now before it."""
    places, prefixes = ordered
    return places[::-1], np.concatenate([[0], prefixes[:0:-1]]) if len(places) else prefixes


def _names(text: Text, starts: np.ndarray) -> np.ndarray:
    """Ranks of the stretches from each start to the next one, inclusive. Where one ends, it
    is larger than any that goes on."""
    lengths = np.append(np.diff(starts) + 1, 1)
    per, bits = text.per_word, text.bits
    rank, open_, offset = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(open_):
        key = text.words[np.minimum(starts[open_] + offset, text.n - 1)]
        left = np.clip(lengths[open_] - offset, 0, per)
        # one more bit says that the stretch ends within this word: ones fill the rest
        fill = (np.int64(1) << (bits * (per - left))) - 1
        key = (key | fill) << 1 | (left < per)
        order = np.lexsort((key, rank[open_]))
        members, key, group = open_[order], key[order], rank[open_][order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        old = np.concatenate([[True], group[1:] != group[:-1]])
        group_first = np.maximum.accumulate(np.where(old, np.arange(len(order)), 0))
        rank[members] = group + first - group_first
        offset += per
        alone = new & np.append(new[1:], True)
        open_ = members[~alone & (lengths[members] > offset)]
    return np.unique(rank, return_inverse=True)[1].reshape(-1)


def _doubled(text: Text, cap: int) -> Pairs:
    """Order by doubled ranks, in memory."""
    rank = np.unique(text.words, return_inverse=True)[1].reshape(-1).astype(np.int64)
    # ranks become places in the order: the number of smaller ones
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]
    open_, step = np.flatnonzero(counts[np.unique(rank, return_inverse=True)[1].reshape(-1)] > 1), text.per_word
    while len(open_) and step < cap:
        nxt = np.append(rank, -1)[np.minimum(open_ + step, text.n)]
        order = np.lexsort((nxt, rank[open_]))
        members, group, nxt = open_[order], rank[open_][order], nxt[order]
        old = np.concatenate([[True], group[1:] != group[:-1]])
        new = old | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        at = np.arange(len(order))
        rank[members] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        open_ = np.sort(members[~(new & np.append(new[1:], True))])
        step *= 2
    places = np.argsort(rank, kind="stable")
    prefixes = np.zeros(text.n, np.int64)
    prefixes[1:] = text.common(places[:-1], places[1:], np.zeros(text.n - 1, np.int64), cap)
    return places, prefixes


def sort_suffixes(symbols: np.ndarray, cap: int, base: int = BASE, memory: int = MEMORY, top: bool = True):
    """Blocks ``(places, prefixes)`` of the sorted suffixes, from the largest symbol to the smallest; within a
    block ascending, with each suffix's common prefix with the one before it (0 for the first of a block)."""
    if not 0 < cap < 1 << PREFIX_BITS:
        raise ValueError(f"cap {cap} does not fit a tuple")
    text = Text(_held(symbols, memory), memory)
    if not top and text.n <= base:
        yield _doubled(text, cap)
        return
    rising = np.zeros(text.n, bool)
    step = np.sign(np.diff(symbols.astype(np.int64))).astype(np.int8)
    flat = np.flatnonzero(step == 0)
    sloped = np.flatnonzero(step)
    step[flat] = step[sloped[np.searchsorted(sloped, flat)]] if len(flat) else 0
    rising[:-1], rising[-1] = step > 0, True
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if not len(starts):  # one symbol only: the 0
        yield np.array([0]), np.array([0])
        return
    del step, flat, sloped, rising
    # order of the starts: by recursion on their names
    names = _names(text, starts).astype(np.int64)
    if int(names.max()) + 1 == len(names):
        order, same = np.argsort(names), np.zeros(len(names), np.int64)
    else:
        blocks = list(sort_suffixes(names, cap, base, memory, top=False))[::-1]
        order, same = (np.concatenate(x) for x in zip(*blocks))
    places = starts[order]
    known = np.zeros(len(places), np.int64)  # equal names are equal stretches, each of which ends where the next begins
    known[1:] = starts[np.minimum(order[1:] + same[1:], len(starts) - 1)] - places[1:]
    prefixes = np.zeros(len(places), np.int64)
    prefixes[1:] = text.common(places[:-1], places[1:], np.minimum(known[1:], cap), cap)
    first = text.symbols[places]
    alphabet = np.unique(text.symbols)
    bounds = np.searchsorted(first, alphabet, "left").tolist(), np.searchsorted(first, alphabet, "right").tolist()
    queue, falling = SpillQueue(memory), SpillQueue(memory)
    for symbol, s, e in zip(alphabet.tolist(), *bounds):
        down = _of_symbol(text, symbol, queue.pop(symbol), cap)
        if len(down[0]):
            falling.push(symbol, *down)
        _induce(text, _joined(text, down, (places[s:e], prefixes[s:e].copy()), cap), symbol, True, queue, cap)
    for symbol in alphabet[::-1].tolist():
        up = _of_symbol(text, symbol, queue.pop(symbol), cap)
        if symbol == 0:
            up = np.array([text.n - 1]), np.array([0])
        whole = _joined(text, up, _reversed(falling.pop(symbol)), cap)
        _induce(text, whole, symbol, False, queue, cap)
        yield _reversed(whole)
