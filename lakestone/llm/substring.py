"""Substring deduplication by compact windows.

A text is the sequence of its five-word shingles.  Under a hash function, a compact window
(l, c, r) stands for all subsequences between l and r that contain c: their min-hash is the
one of shingle c.  Windows are the nodes of the Cartesian tree over the hashes; only nodes
of at least a passage's width are built, and those are the minima of sliding windows, so a
text of n words has about 2 n / 50 of them.  Two texts that share a passage have, under
every function, a window each that covers it and has the same min-hash; similar passages
share one with the probability of their similarity, so with three functions 99.2 % of those
of similarity 0.8 do.  Windows whose min-hash stands in another document are candidates.

Candidates are verified by the words in them.  Every run of ``passage`` words inside a
candidate is looked up: those that stand in another document are repeated passages, without
exception.  For passages that differ in places, runs of ``LOOK`` words are looked up too, but
not where one earlier document has all the words: there its own copy stands for the others.
A near copy holds enough of them whatever its edits (``_hoped``), so they tell where one can be;
stretches of at least ``passage`` words whose shingles match one other document to
``similarity`` are near copies.  All lookups go through ``blocks``: a passage of a third
of the corpus costs an entry a block, and no pairs are made.

The lookup tells which runs stand elsewhere, not in how many documents.  Where all runs
found together could make a near copy, the windows around it are grouped by their min-hash,
those of one text together, and each is matched with every distinct text of its group, in
squares of ``MEMBERS`` texts.  Texts whose runs can't add up to a near copy, or that stand
in an earlier document word for word, look for no partner, and the latter are none either.
The words of a group's texts are compared by 32 bits of each word's hash.

Texts are dealt to blocks once; every pass reads them and the answers so far from the same
shuffle files.  Only places go on from there: rows get theirs by owner and a hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakestone.session import scratch_path

from . import blocks
from .textops import U64, Words, grams, mix, pieces

SHINGLE, PASSAGE, SIMILARITY, FUNCTIONS = 5, 50, 0.8, 3
#: A window's near copies are matched within so many passages around its centre.
REACH = 2
#: Words of the runs that are looked up to find where near copies can be.
LOOK = 10
#: Words that may stand between two matched runs of one stretch, and between two looked-up ones where edits may be close.
GAP, WIDE_GAP = 25, 60
_RUNS, _UNITS, _STRETCHES, _KNOWN, _MARKS = 100, 101, 102, 103, 104
#: Distinct texts on a side of a square of comparisons, and tasks of small groups for a key range.
MEMBERS, RANGE_TASKS = 1024, 4
#: Shared shingles that are matched at once, about.
MATCHED = 1 << 21
#: Values that are worked on at once, in the processor's cache.
CACHED = 1 << 14
#: Runs of parted stretches that are searched at once.
SQUARES = 1 << 18
_ASKED = 200
#: And, with the function added, a block's own windows whose min-hashes stand in another document.
_WINDOWS = 110
#: And, with the function added, which of these windows a near copy can stand in and whether a partner is looked for.
_WANTED = 120
#: Bits, besides those that tell the key range, of the keys that only tell where to look: min-hashes and runs of LOOK words.
VALUE_BITS, LOOK_BITS = 40, 48
_SALT = U64(0x9FB21C651E98DF25)
_NONE = np.iinfo(np.int64).max


def window_minima(g: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some ``width`` values in a row of one text, ascending."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.empty(n, np.int64)
    for a in range(0, n, CACHED):
        least = g[a:a + CACHED + width - 1]
        place, span = np.arange(a, a + len(least)), 1
        while span < width:  # doubling: the minimum of a span and that of the span it is moved on by
            step = min(span, width - span)
            right = least[step:] < least[:-step]
            least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
            span += step
        at[a:a + CACHED] = place
    steps = np.zeros(len(g) + 1, np.int64)
    some = first[1:] - first[:-1] >= width
    np.add.at(steps, first[:-1][some], 1)
    np.add.at(steps, first[1:][some] - width + 1, -1)
    inside = np.cumsum(steps[:n]) > 0
    fresh = inside.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    return at[fresh]


def compact_windows(g: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), bounds inclusive, of all nodes of the texts' Cartesian trees that span ``width`` values.

    A node's bounds are its nearest smaller values, which are ancestors, so they span
    ``width`` themselves and the minima of sliding windows are enough to find them.
    Of equal values the leftmost is the smaller.
    """
    at = window_minima(g, first, width)
    text = np.searchsorted(first, at, "right") - 1
    values, places, same = g[at], np.arange(len(at)), np.diff(text) == 0
    before = _nearest(values, np.where(np.r_[False, same][:len(at)], places - 1, -1), np.greater)
    after = _nearest(values, np.where(np.r_[same, False][:len(at)], places + 1, -1), np.greater_equal)
    l = np.where(before >= 0, at[before] + 1, first[text])
    r = np.where(after >= 0, at[after], first[text + 1]) - 1
    wide = r - l + 1 >= width
    return l[wide], at[wide], r[wide]


def _nearest(values: np.ndarray, to: np.ndarray, passed) -> np.ndarray:
    """``to``, the neighbours on one side (-1: none), moved on until no value is ``passed`` any more.

    What a neighbour has passed is passed by all that pass the neighbour, so they go on from its place, all at once.
    """
    on = np.flatnonzero(to >= 0)
    on = on[passed(values[to[on]], values[on])]
    while len(on):
        to[on] = to[to[on]]
        on = on[to[on] >= 0]
        on = on[passed(values[to[on]], values[on])]
    return to


def _of(table: pa.Table, levels: list[int]) -> pa.Table:
    return table.filter(pc.is_in(table["level"], pa.array(levels, pa.int32())))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Of each key its place among the ascending distinct ones."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(sorted_keys != np.concatenate((sorted_keys[:1], sorted_keys[:-1])))
    return out


def _short(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Keys without their last bits; chance equals stay as rare when the corpus grows."""
    return keys & ~U64((1 << max(0, 64 - bits - (ranges - 1).bit_length())) - 1)


class _Block:
    """The texts of a block, read the same way and in the same order in every pass: rows of a shuffle come in any."""

    def __init__(self, table: pa.Table, text: str, ranges: int, places: bool = False):
        self.ranges = ranges
        self.table = table = table.take(pa.array(np.lexsort((table["_mark"].to_numpy(), table["_owner"].to_numpy()))))
        self.block = table["_block"][0].as_py()
        self.owner = table["_owner"].to_numpy()
        hashes, firsts, starts, ends, base = [], [np.zeros(1, np.int64)], [], [], 0
        for _, _, data, offsets in pieces(table[text].combine_chunks(), CACHED << 3):
            w = Words(data, offsets)
            hashes.append(w.hash)
            firsts.append(base + w.first[1:])
            base += len(w.hash)
            if places:
                at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                shift = np.repeat(at[offsets[:-1]], w.count())
                starts.append(at[w.start] - shift)
                ends.append(at[w.end] - shift)
        self.hash, self.first = np.concatenate(hashes), np.concatenate(firsts)
        if places:  # code points at which words begin and end
            self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def signs(self) -> np.ndarray:
        """A number for each text's sequence of words."""
        place = np.arange(len(self.hash)) - self.first[self.text]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(self.hash + mix(place.astype(U64))), dtype=U64)))
            return (sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64)

    def room(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each word on are of its own text."""
        return np.arange(len(self.hash)) + size <= self.first[self.text + 1]

    def windows(self, passage: int, functions: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each function the windows (l, c, r), in words of the block, and their min-hashes."""
        shingles = grams(self.hash, SHINGLE)
        ok = self.room(SHINGLE)[:len(shingles)]
        at = np.flatnonzero(ok)
        first = np.searchsorted(at, self.first)
        out = []
        for k in range(functions):
            with np.errstate(over="ignore"):
                g = mix(shingles[at] ^ (U64(k + 1) * _SALT))
            l, c, r = compact_windows(g, first, passage - SHINGLE + 1)
            out.append((at[l], at[c], at[r], _short(g[c], VALUE_BITS, self.ranges)))
        return out

    def value(self, k: int, shingles: np.ndarray) -> np.ndarray:
        """Min-hashes of windows by their centres' shingles."""
        with np.errstate(over="ignore"):
            return _short(mix(shingles ^ (U64(k + 1) * _SALT)), VALUE_BITS, self.ranges)

    def keys(self, level: int, size: int) -> np.ndarray:
        """The keys by which runs of ``size`` words are looked up."""
        found = grams(self.hash, size)
        return _short(found, LOOK_BITS, self.ranges) if level == _UNITS else found

    def owners(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct keys and, of each, the two smallest documents that have it."""
        owner = self.owner[self.text[at]]
        order = np.lexsort((owner, keys))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        begin = np.flatnonzero(new)
        other = np.where(o != np.repeat(o[begin], np.diff(np.append(begin, len(k)))), o, _NONE)
        second = np.minimum.reduceat(other, begin) if len(begin) else other
        return k[begin], np.stack([o[begin], second], 1)

    def hits(self, windows: list, answers: dict[int, np.ndarray]) -> list:
        """The windows whose min-hashes stand in another document, their bounds no further off than they matter."""
        out = []
        for k, w in enumerate(windows):
            found = answers[k][_ranks(w[3])] if len(w[3]) else np.zeros((0, 2), np.int64)
            out.append(tuple(x[found[:, 0] != found[:, 1]] for x in w))
        return out

    def known_windows(self, answers: pa.Table, passage: int, functions: int) -> list:
        """The windows of ``hits`` as ``_windows_kept`` wrote them."""
        levels = [_WINDOWS + k for k in range(functions)]
        told = blocks.joined(_of(answers, levels), dict.fromkeys(levels, "<i4"), dict.fromkeys(levels, 3))
        shingles, out = grams(self.hash, SHINGLE), []
        for k, level in enumerate(levels):
            step, left, right = told[level].astype(np.int64).T
            c = np.cumsum(step)
            out.append((c - left, c, c + right, self.value(k, shingles[c])))
        return out

    def run_places(self, windows: list, passage: int) -> np.ndarray:
        """Words where a run of ``passage`` words is to be looked up.

        Under each function the run is inside one window, that of its own minimum.  A run that stands in another
        document has the same minima there, so all of its windows must have been found there.
        """
        steps = np.zeros(len(self.hash) + 1, np.int64)
        for l, c, r, _ in windows:
            np.add.at(steps, np.maximum(l, c + SHINGLE - passage), 1)
            np.add.at(steps, np.minimum(c, r + SHINGLE - passage) + 1, -1)
        return np.flatnonzero((np.cumsum(steps[:-1]) == len(windows)) & self.room(passage))

    def unit_places(self, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Words where a run of LOOK words is to be looked up: those of the ``spans`` of windows."""
        steps = np.zeros(len(self.hash) + 1, np.int64)
        for _, first, after in spans:
            np.add.at(steps, first, 1)
            np.add.at(steps, after, -1)
        return np.flatnonzero((np.cumsum(steps[:-1]) > 0) & self.room(LOOK))


def _span(l: np.ndarray, c: np.ndarray, r: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """The first run of LOOK words, and the one after the last, that near copies of windows are matched in."""
    return np.maximum(l, c - REACH * passage), np.minimum(c + REACH * passage, r + SHINGLE - LOOK) + 1


class _Copies:
    """Which runs of ``passage`` words of a block's texts stand in other documents, by the answers to them."""

    def __init__(self, b: _Block, windows: list, answers: dict[int, np.ndarray], passage: int):
        self.at, self.found = _looked_up(b, answers, _RUNS, passage, b.run_places(windows, passage))
        self.early = self.found[:, 0] < b.owner[b.text[self.at]]
        source = np.full(len(b.hash), _NONE)
        source[self.at[self.early]] = self.found[self.early, 0]
        changes = np.concatenate(([0], np.cumsum((source == _NONE) | np.r_[True, source[1:] != source[:-1]])))
        #: For each function (window, first run, run after the last) of the windows to match near copies in.  Left out
        #: are those that one earlier document has word for word, with a window around them, to be matched in their place.
        self.spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for l, c, r, value in windows:
            first, after = _span(l, c, r, passage)
            last = after + LOOK - 1 - passage
            on = np.flatnonzero((source[first] == _NONE) | (changes[last + 1] != changes[first + 1]))
            self.spans.append((on, first[on], after[on]))


def _two_owners(level: int, keys: np.ndarray, where: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """The two smallest documents of each key; twice the same number for keys of one document.

    Of windows only whether there are two is asked, and of long runs the smallest: the rest
    of their answers is constant.
    """
    low = np.full(len(keys), _NONE)
    for at, v in zip(where, values, strict=True):
        low[at] = np.minimum(low[at], v[:, 0])
    second = np.full(len(keys), _NONE)
    for at, v in zip(where, values, strict=True):
        for i in (0, 1):
            second[at] = np.minimum(second[at], np.where(v[:, i] > low[at], v[:, i], _NONE))
    alone = second == _NONE
    if level != _UNITS:
        low = low if level == _RUNS else np.zeros(len(keys), np.int64)
        second = (low == 0).astype(np.int64)  # any number but the smallest document's
    both = np.stack([np.where(alone, 0, low), np.where(alone, 0, second)], 1)
    return [both[at] for at in where]


def _windows_sent(text: str, ranges: int, passage: int, functions: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, text, ranges)
        return blocks.send(b.block, ranges, [(k, *b.owners(value, c)) for k, (_, c, _, value)
                                             in enumerate(b.windows(passage, functions)) if len(value)])
    return run


def _answers(table: pa.Table, levels: list[int]) -> dict[int, np.ndarray]:
    return blocks.joined(_of(table, levels), dict.fromkeys(levels, "<i8"), dict.fromkeys(levels, 2))


def _runs_sent(text: str, ranges: int, passage: int, functions: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return blocks.SENT_ARROW.empty_table()
        b = _Block(table, text, ranges)
        windows = b.hits(b.windows(passage, functions), _answers(answers, list(range(functions))))
        runs = b.run_places(windows, passage)
        sent = blocks.send(b.block, ranges, [(_RUNS, *b.owners(b.keys(_RUNS, passage)[runs], runs))] if len(runs) else [])
        return pa.concat_tables([sent, _windows_kept(b.block, windows, passage)])
    return run


def _windows_kept(block: int, windows: list, passage: int) -> pa.Table:
    """The block's windows, for its later passes: centres, and as much of the bounds as matters."""
    rows = [(block, _WINDOWS + k, blocks.planes(np.stack([
        np.diff(c, prepend=0), np.minimum(c - l, REACH * passage), np.minimum(r - c, (REACH + 1) * passage)], 1).astype("<i4")))
        for k, (l, c, r, _) in enumerate(windows)]
    return blocks.own(rows)


def _units_sent(text: str, ranges: int, passage: int, functions: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return blocks.SENT_ARROW.empty_table()
        b = _Block(table, text, ranges)
        copies = _Copies(b, b.known_windows(answers, passage, functions), _answers(answers, [_RUNS]), passage)
        units = b.unit_places(copies.spans)
        return blocks.send(b.block, ranges, [(_UNITS, *b.owners(b.keys(_UNITS, LOOK)[units], units))] if len(units) else [])
    return run


def _need(similarity: float) -> float:
    """Matched share of the shingles of two stretches of equal length."""
    return 2 * similarity / (1 + similarity)


def _near(at: np.ndarray, partner: np.ndarray, unit: int, need: float, shortest: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """The rows of ``_stretches``."""
    return list(zip(*(x.tolist() for x in _stretches(at, partner, unit, need, shortest, gap)), strict=True))


def _stretches(at: np.ndarray, partner: np.ndarray, unit: int, need: float, shortest: int,
               gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after, partner) of stretches of ``shortest`` words at least whose shingles, those of the runs
    of ``unit`` words that begin at ``at``, match one partner closely enough."""
    if not len(at):
        return at, at, partner
    if not ((partner[1:] > partner[:-1]) | ((partner[1:] == partner[:-1]) & (at[1:] >= at[:-1]))).all():
        order = np.lexsort((at, partner))
        at, partner = at[order], partner[order]
    step = np.diff(at)
    parts = np.concatenate(([True], (partner[1:] != partner[:-1]) | (step > gap)))
    heads = np.flatnonzero(parts | np.concatenate(([True], step > 1)))
    begin, end = at[heads], at[np.append(heads[1:], len(at)) - 1] + unit
    matched = np.concatenate(([0], np.cumsum(end - begin - SHINGLE + 1)))
    first = np.flatnonzero(parts[heads])
    after = np.append(first[1:], len(heads))
    left, right = begin[first], end[after - 1]
    total, long = matched[after] - matched[first], right - left >= shortest
    whole = total >= need * (right - left - SHINGLE + 1) - 1e-9
    possible = long & (whole | (total >= need * (shortest - SHINGLE + 1) - 1e-6))
    # The longest stretch from each run i to a run j that matches well enough:
    # matched(i..j) >= need * shingles(i..j), with the terms of j and of i on two sides.
    upto, bound = matched[1:] - need * end, matched[:-1] - need * (begin + SHINGLE - 1) - 1e-9
    found = [(first[possible & whole], after[possible & whole] - 1)]
    parted = np.flatnonzero(possible & ~whole)
    size = after[parted] - first[parted]
    parted = parted[np.argsort(size, kind="stable")]
    size = np.sort(size)
    i = 0
    while i < len(parted):  # parts of about the same number of runs at once
        width = 1 << int(size[i] - 1).bit_length()
        j = min(int(np.searchsorted(size, width, "right")), i + max(1, SQUARES // width))
        found.append(_longest(first[parted[i:j]], size[i:j], begin, end, upto, bound, shortest))
        i = j
    head, tail = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(head)
    head, tail = head[order], tail[order]
    return begin[head], end[tail], partner[heads[head]]


def _longest(first: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray, upto: np.ndarray, bound: np.ndarray,
             shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last runs of the stretches in parts of ``size`` runs from ``first`` on, a row of runs for each part."""
    runs = np.arange(size.max())
    inside = runs < size[:, None]
    place = np.where(inside, first[:, None] + runs, 0)
    best = np.maximum.accumulate(np.where(inside, upto[place], -np.inf)[:, ::-1], 1)[:, ::-1]  # of the runs from each on
    asked = np.where(inside, bound[place], np.inf)
    # The largest j above a bound, by halving: ``best`` descends.
    low, high = np.full(place.shape, -1), np.full(place.shape, len(runs))
    row = np.arange(len(size))[:, None]
    while (high - low > 1).any():
        middle = np.maximum(low + high >> 1, 0)
        enough = (best[row, middle] >= asked) & (high - low > 1)
        low, high = np.where(enough, middle, low), np.where(enough | (high - low <= 1), high, middle)
    ok = (low >= runs) & (end[first[:, None] + np.maximum(low, 0)] - begin[place] >= shortest)
    reach = np.maximum.accumulate(np.where(ok, low, -1), 1)
    ok[:, 1:] &= low[:, 1:] > reach[:, :-1]  # stretches may overlap; those inside another are left out
    r, i = np.nonzero(ok)
    return first[r] + i, first[r] + low[r, i]


def _least(passage: int, similarity: float) -> float:
    """Shingles that the shortest near copy shares."""
    return _need(similarity) * (passage - SHINGLE + 1) - 1e-6


def _hoped(passage: int, similarity: float) -> tuple[float, int]:
    """What of a near copy must be found by runs of LOOK words: share of its shingles, and words.

    Of n shingles (1 - need) n at most are lost, SHINGLE by an edit; each edit, and the end, leaves LOOK - SHINGLE
    more at most in a run too short to be looked up.  The share is least for the shortest near copy.
    """
    n = passage - SHINGLE + 1
    lost = (1 - _need(similarity)) * n
    found = n - lost - (lost / SHINGLE + 1) * (LOOK - SHINGLE)
    return found / n - 1e-6, max(LOOK, int(found) + SHINGLE - 1)


def _covered(b: _Block, at: np.ndarray, size: int) -> np.ndarray:
    """Which words are in a run of ``size`` words from one of ``at`` on."""
    steps = np.zeros(len(b.hash) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _looked_up(b: _Block, answers: dict[int, np.ndarray], level: int, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``at`` whose run of ``size`` words stands in two documents, and the two."""
    if not len(at):
        return at, np.zeros((0, 2), np.int64)
    keys = b.keys(level, size)[at]
    found = answers[level][_ranks(keys)]
    hit = found[:, 0] != found[:, 1]
    return at[hit], found[hit]


def _partners(b: _Block, answers: dict[int, np.ndarray], units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``units`` that stand in another document, and the smallest such document."""
    at, found = _looked_up(b, answers, _UNITS, LOOK, units)
    return at, np.where(found[:, 0] == b.owner[b.text[at]], found[:, 1], found[:, 0])


def _credited(b: _Block, at: np.ndarray, partner: np.ndarray, passage: int, similarity: float) -> dict[int, list[tuple[int, int, int]]]:
    """By text the near copies that the runs' smallest documents make."""
    names, number = np.unique(partner, return_inverse=True)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, z, p in _near(at, b.text[at] * len(names) + number, LOOK, _need(similarity), passage):
        out.setdefault(p // len(names), []).append((a, z, int(names[p % len(names)])))
    return out


def _members(b: _Block, windows: list, answers: dict[int, np.ndarray], passage: int,
             similarity: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], _Copies, dict[int, list[tuple[int, int, int]]]]:
    """For each function, the windows that a near copy can stand in, and whether a partner is looked for; and what the
    lookups tell at once, runs and near copies by text.

    Left out are windows whose runs found elsewhere hold too few shingles, and those that ``_Copies`` leaves out.
    """
    copies = _Copies(b, windows, answers, passage)
    at, found = copies.at, copies.found
    units = b.unit_places(copies.spans)
    done = _covered(b, at[copies.early], passage)
    known = _covered(b, at, passage)
    at, partner = _partners(b, answers, units)
    credited = _credited(b, at, partner, passage, similarity)
    for t, near in credited.items():
        for a, z, p in near:
            known[a:z] = True
            done[a:z] |= p < b.owner[t]

    share, shortest = _hoped(passage, similarity)

    def hoped(at: np.ndarray) -> np.ndarray:
        """The words of near copies, if one document had all of ``at``."""
        steps = np.zeros(len(b.hash) + 1, np.int64)
        a, z, _ = _stretches(at, b.text[at], LOOK, share, shortest, WIDE_GAP)
        np.add.at(steps, a, 1)
        np.add.at(steps, z, -1)
        return np.cumsum(steps[:-1]) > 0

    # What is known from an earlier document is settled, and so is what is known from a later one and can be in no earlier one.
    hope = (hoped(at) & ~known) | (hoped(at[partner < b.owner[b.text[at]]]) & ~done)
    wanted = np.concatenate(([0], np.cumsum(hope)))
    elsewhere = np.zeros(len(b.hash), bool)
    elsewhere[at] = True
    hits = np.concatenate(([0], np.cumsum(elsewhere)))
    begun = np.concatenate(([0], np.cumsum(elsewhere & ~np.r_[False, elsewhere[:-1]])))
    least = share * (passage - SHINGLE + 1) - 1e-6
    out = []
    for window, first, after in copies.spans:
        shared = hits[after] - hits[first] + (LOOK - SHINGLE) * (begun[after] - begun[first + 1] + elsewhere[first])
        on = shared >= least
        out.append((window[on], wanted[after[on] + LOOK - 1] > wanted[first[on]]))
    return out, copies, credited


def _known(b: _Block, copies: _Copies, credited: dict[int, list[tuple[int, int, int]]], passage: int) -> np.ndarray:
    """Rows (owner, sign, first word, word after, document, whether a near copy) of what the lookups tell at once.

    Runs that follow each other and have the same smallest document are one row.
    """
    at, first_doc, signs, rows = copies.at, copies.found[:, 0], b.signs(), []
    text = b.text[at]
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) != 0) | (np.diff(first_doc) != 0)) + 1
    for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True) if len(at) else ():
        rows.append((text[i], at[i], at[j - 1] + passage, first_doc[i], 0))
    rows.extend((t, a, z, p, 1) for t, near in credited.items() for a, z, p in near)
    found = [(b.owner[t], signs[t], a - b.first[t], z - b.first[t], p, near) for t, a, z, p, near in rows]
    return np.unique(np.asarray(found, np.int64).reshape(-1, 6), axis=0)  # equal rows of the table are known alike


def _shingles(window: tuple, at: np.ndarray, wanting: np.ndarray, passage: int) -> tuple:
    """Of the windows ``at``: min-hash, first shingle, the one after the last, and whether a partner is looked for."""
    l, c, r, value = (x[at] for x in window)
    first, after = _span(l, c, r, passage)
    return value, first, after + LOOK - SHINGLE, wanting


def _merged(b: _Block, k: int, found: tuple) -> list[tuple[int, int, int, list[tuple[int, int, bool]]]]:
    """The windows of a text that have the same min-hash as one member: (min-hash, mark, text, spans).

    Spans are (first shingle, the one after the last, whether partners are looked for); the mark is a hash of the words.
    """
    value, first, after, wanting = found
    text = b.text[first]
    order = np.lexsort((first, value, text))
    value, first, after, wanting, text = value[order], first[order], after[order], wanting[order], text[order]
    if not len(value):
        return []
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
    lift = np.cumsum(new) * (len(b.hash) + 1)
    reach = np.maximum.accumulate(after + lift) - lift
    begins = new | np.r_[True, first[1:] > reach[:-1]]
    at = np.flatnonzero(begins)
    spans = list(zip(first[at].tolist(), reach[np.r_[at[1:], len(first)] - 1].tolist(),
                     np.logical_or.reduceat(wanting, at).tolist(), strict=True))
    heads = np.flatnonzero(new[at])
    out = []
    for i, j, v, t in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], value[at[heads]].tolist(), text[at[heads]].tolist(), strict=True):
        digest = hashlib.blake2b(f"{k},{v}".encode(), digest_size=8)
        for a, z, _ in spans[i:j]:
            digest.update(b"|")
            digest.update(b.hash[a:z + SHINGLE - 1])
        out.append((v, int.from_bytes(digest.digest()), t, spans[i:j]))
    return out


def _asked(text: str, ranges: int, passage: int, functions: int, similarity: float):
    """Sends the min-hashes of members, with how many there are and whether one looks for partners, and the members' marks.

    What the lookups tell without partners, and which windows are wanted, comes back to the block: no lookup is read again.
    """
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return blocks.SENT_ARROW.empty_table()
        b = _Block(table, text, ranges)
        windows = b.known_windows(answers, passage, functions)
        found, copies, credited = _members(b, windows, _answers(answers, [_RUNS, _UNITS]), passage, similarity)
        levels, marks, owners = [], [], []
        for k, window in enumerate(windows):
            members = _merged(b, k, _shingles(window, *found[k], passage))
            if members:
                keys, at = np.unique(np.asarray([v for v, _, _, _ in members], U64), return_inverse=True)
                looks = np.bincount(at, [any(w for _, _, w in spans) for _, _, _, spans in members]) > 0
                levels.append((k, keys, 2 * np.bincount(at) + looks))
                marks.extend(m for _, m, _, _ in members)
                owners.extend(b.owner[t] for _, _, t, _ in members)
        if marks:
            each, owner = np.asarray(marks, U64), np.asarray(owners, np.int64)
            order = np.lexsort((owner, each))
            each, owner = each[order], owner[order]
            new = np.r_[True, each[1:] != each[:-1]]
            levels.append((_MARKS, each[new], owner[new]))
        return pa.concat_tables([blocks.send(b.block, ranges, levels), blocks.own([
            (b.block, _KNOWN, blocks.planes(_known(b, copies, credited, passage))),
            *((b.block, _WANTED + k, blocks.planes((2 * np.diff(at, prepend=0) + wanting).astype("<u4")))
              for k, (at, wanting) in enumerate(found))])])
    return run


def _groups(level: int, keys: np.ndarray, where: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Of a min-hash the sides of its squares of comparisons, 0 where nothing is to be compared; of a mark its smallest document."""
    if level == _MARKS:
        low = np.full(len(keys), _NONE)
        for at, v in zip(where, values, strict=True):
            low[at] = np.minimum(low[at], v)
        return [low[at] for at in where]
    size, looks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for at, v in zip(where, values, strict=True):
        size[at] += v >> 1
        looks[at] |= v & 1
    side = np.where((size > 1) & (looks > 0), -(-size // MEMBERS), 0)
    return [side[at] for at in where]


_MEMBER = "task long, level int, value long, words binary, spans binary, owner long, block long, sign long, looks int"
_PARTNER, _SEEKER, _BOTH = 0, 1, 2


def _members_sent(text: str, ranges: int, passage: int, functions: int, similarity: float):
    """The words of members, for every square of comparisons that they are in, and a row (level _KNOWN) of what
    the block's lookups tell without partners, so that no pass is run again for it.

    A member that an earlier document has word for word is left out: that document's own copy stands for the others.
    """
    names = [f.split()[0] for f in _MEMBER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(table):
            b = _Block(table, text, ranges)
            known = blocks.joined(_of(answers, [_ASKED + _KNOWN]), {_ASKED + _KNOWN: "<i8"}, {_ASKED + _KNOWN: 6})[_ASKED + _KNOWN]
            if len(known):
                rows.append((-1 - b.block, _KNOWN, None, known.tobytes(), None, None, b.block, None, 0))
            levels = [_ASKED + _WANTED + k for k in range(functions)]
            wanted = blocks.joined(_of(answers, levels), dict.fromkeys(levels, "<u4"))
            members = [_merged(b, k, _shingles(window, np.cumsum(wanted[level] >> 1), wanted[level] & 1, passage))
                       for k, (level, window) in enumerate(zip(levels, b.known_windows(answers, passage, functions), strict=True))]
            levels = [_ASKED + k for k in (*range(functions), _MARKS)]
            told = blocks.joined(_of(answers, levels), dict.fromkeys(levels, "<i8"))
            marks = np.unique(np.asarray([m for x in members for _, m, _, _ in x], U64))
            lowest = dict(zip(marks.tolist(), told[_ASKED + _MARKS].tolist(), strict=True))
            signs, words = b.signs(), (b.hash & U64(0xFFFFFFFF)).astype("<u4")
            for k, x in enumerate(members):
                values = np.unique(np.asarray([v for v, _, _, _ in x], U64))
                sides = dict(zip(values.tolist(), told[_ASKED + k].tolist(), strict=True))
                with np.errstate(over="ignore"):
                    alone = dict(zip(values.tolist(), (mix(values + U64(k)) % U64(ranges * RANGE_TASKS)).tolist(), strict=True))
                for v, mark, t, spans in x:
                    side, owner = sides[v], int(b.owner[t])
                    if not side or lowest[mark] < owner:
                        continue
                    places = np.asarray([(a - b.first[t], z - a, w) for a, z, w in spans], "<i4").tobytes()
                    held = b"".join(words[a:z + SHINGLE - 1].tobytes() for a, z, _ in spans)
                    wants, own = any(w for _, _, w in spans), mark % side
                    squares = {(x, own): _PARTNER for x in range(side)}
                    if wants:
                        squares |= {(own, y): _SEEKER for y in range(side)} | {(own, own): _BOTH}
                    for (x, y), looks in squares.items():
                        if side == 1:
                            rows.append((alone[v], k, v - (v >> 63 << 64), held, places, owner, b.block, int(signs[t]), looks))
                            continue
                        number = int(mix(np.asarray([v + 4 * side * (x * side + y) * 0x9E3779B97F4A7C15 + k & (1 << 64) - 1], U64))[0])
                        rows.append(((1 << 62) + (number >> 2), k, v - (v >> 63 << 64), held, places, owner, b.block, int(signs[t]), looks))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
    return run


def _ramps(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``many``."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _compared(passage: int, similarity: float):
    """Answers of a task's groups: the stretches that match a text of another document, and what was known before.

    Of each span the smallest documents come first; a stretch without a word that a smaller document's lack is left out.
    """
    least, need = _least(passage, similarity), _need(similarity)

    def run(table: pa.Table) -> pa.Table:
        ready = table.filter(pc.equal(table["level"], _KNOWN))
        table = table.filter(pc.not_equal(table["level"], _KNOWN))
        out: dict[int, list] = {}
        if len(table):
            match(table, out)
        return pa.table([
            pa.array([*ready["block"].to_pylist(), *out], pa.int64()), pa.array([0] * (len(ready) + len(out)), pa.int64()),
            pa.array([_KNOWN] * len(ready) + [_STRETCHES] * len(out), pa.int32()),
            pa.array([*ready["words"].to_pylist(), *(np.asarray(x, np.int64).tobytes() for x in out.values())], pa.binary())],
            schema=blocks.ANSWER_ARROW)

    def match(table: pa.Table, out: dict[int, list]) -> None:
        spans = [np.frombuffer(x, "<i4").reshape(-1, 3) for x in table["spans"].to_pylist()]
        row = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
        place, many, wants = np.concatenate(spans).astype(np.int64).T
        words = np.frombuffer(b"".join(table["words"].to_pylist()), "<u4").astype(U64)
        begin = np.cumsum(many + SHINGLE - 1) - (many + SHINGLE - 1)
        # A span's shingles, each with its group, so that all groups are matched at once.
        ramp = _ramps(many)
        span = np.repeat(np.arange(len(many)), many)
        with np.errstate(over="ignore"):
            group = mix(table["value"].to_numpy().view(U64) + mix(table["level"].to_numpy().astype(U64)))
            keys = mix(grams(words, SHINGLE)[np.repeat(begin, many) + ramp] ^ group[row][span])
        names, owner = np.unique(table["owner"].to_numpy(), return_inverse=True)
        owner, looks = owner[row], table["looks"].to_numpy()[row]
        # Shingles go by their rank, and each has its holders, ascending, from ``begins`` on.
        keys = _ranks(keys)
        held = np.flatnonzero((looks != _SEEKER)[span])
        seek = np.flatnonzero(((looks != _PARTNER) & (wants > 0))[span])
        if not len(held) or not len(seek):
            return
        bits = len(names).bit_length()
        have = np.sort(keys[held] << bits | owner[span[held]])
        have = have[np.r_[True, have[1:] != have[:-1]]]
        holder, holders = have & (1 << bits) - 1, np.bincount(have >> bits, minlength=int(keys.max()) + 1)
        begins = np.cumsum(holders) - holders
        seek = seek[holders[keys[seek]] > 0]
        low, some = begins[keys[seek]], holders[keys[seek]]
        blocked, owners, signs = (table[c].to_numpy() for c in ("block", "owner", "sign"))
        first = np.flatnonzero(np.r_[True, span[seek][1:] != span[seek][:-1]]) if len(seek) else seek
        total, step = np.r_[0, np.cumsum(some)], int(many.max()).bit_length()
        i = 0
        while i < len(first):  # whole spans, up to MATCHED shared shingles
            j = max(i + 1, int(np.searchsorted(total[np.r_[first[1:], len(seek)]], total[first[i]] + MATCHED, "right")))
            part = slice(first[i], first[j] if j < len(first) else len(seek))
            i = j
            each_span, n = span[seek[part]], some[part]
            partner = holder[np.repeat(low[part], n) + _ramps(n)]
            mine, where = np.repeat(each_span, n), np.repeat(ramp[seek[part]], n)
            other = partner != owner[mine]
            found = np.sort((mine[other] << bits | partner[other]) << step | where[other])
            pair, where = found >> step, found & (1 << step) - 1
            cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            size = np.diff(cuts, prepend=0, append=len(pair))
            could = np.repeat(size >= least, size)
            last, covered = -1, []
            for x, y, both in _near(where[could], pair[could], SHINGLE, need, passage):
                s, p = both >> bits, both & (1 << bits) - 1
                if s != last:
                    last, covered = s, []
                if not any(a <= x and y <= z for a, z in covered):
                    met = [(x, y), *(w for w in covered if w[0] <= y and x <= w[1])]  # what meets is one stretch
                    covered = [w for w in covered if w not in met] + [(min(a for a, _ in met), max(z for _, z in met))]
                    r = int(row[s])
                    out.setdefault(int(blocked[r]), []).append((owners[r], signs[r], place[s] + x, place[s] + y, names[p]))
    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passages(b: _Block, known: np.ndarray, stretches: np.ndarray) -> list[list[dict]]:
    """Repeated passages of each text: words and code points, the smallest document that has them, whether a near copy.

    ``known`` has the rows of ``_known``, ``stretches`` rows (owner, sign, first word, word after, partner) of near copies.
    """
    out: list[list[dict]] = [[] for _ in range(len(b.first) - 1)]
    exact, earlier = np.zeros(len(b.hash), bool), np.zeros(len(b.hash), bool)

    def add(text: int, a: int, z: int, first_doc: int, near: bool) -> None:
        base = b.first[text]
        out[text].append({"start_word": int(a - base), "end_word": int(z - base), "start": int(b.start[a]),
                          "end": int(b.end[z - 1]), "first_doc": first_doc, "near": near})

    near: dict[int, list[tuple[int, int, int]]] = {}
    places: dict[tuple[int, int], list[int]] = {}
    for t, mark in enumerate(zip(b.owner.tolist(), b.signs().tolist(), strict=True)):
        places.setdefault(mark, []).append(t)
    for owner, sign, a, z, p, close in [*known.tolist(), *([*x, 1] for x in stretches.tolist())]:
        for t in places[owner, sign]:
            base = int(b.first[t])
            if close:
                near.setdefault(t, []).append((base + a, base + z, p))
                continue
            add(t, base + a, base + z, p, False)
            exact[base + a:base + z] = True
            earlier[base + a:base + z] |= p < owner
    for t, found in near.items():
        own, whole = int(b.owner[t]), []
        for a, z, p in sorted(found, key=lambda x: (x[2], x[0], x[1])):
            if whole and whole[-1][2] == p and a <= whole[-1][1]:
                whole[-1] = (whole[-1][0], max(z, whole[-1][1]), p)
            else:
                whole.append((a, z, p))
        for a, z, p in whole:
            covered = earlier if p < own else exact
            if not covered[a:z].all():
                add(t, a, z, min(p, own), True)
                exact[a:z] = True
                earlier[a:z] |= p < own
    return out


_PASSAGES = "array<struct<start_word: int, end_word: int, start: int, end: int, first_doc: long, near: boolean>>"
_ARROW = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()),
                             ("end", pa.int32()), ("first_doc", pa.int64()), ("near", pa.bool_())]))


def _found(dealt: DataFrame, ranges: int, text: str, passage: int, similarity: float, functions: int) -> DataFrame:
    """The passages of every row of ``dealt`` (_block, _owner, _mark, text), without the texts."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(answers: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def told(sent: DataFrame, reduce, width: int) -> DataFrame:
        # Dealt by block at once: every later pass reads the same files.
        return blocks.answered(sent, reduce, "<i8", width).repartition(tasks, "block")

    windows = told(dealt.groupBy("_block").applyInArrow(_windows_sent(text, ranges, passage, functions), blocks.SENT), _two_owners, 2)
    runs = told(met(windows, _runs_sent(text, ranges, passage, functions), blocks.SENT), _two_owners, 2)
    units = told(met(runs, _units_sent(text, ranges, passage, functions), blocks.SENT), _two_owners, 2)
    both = runs.unionByName(units)
    asked = told(met(both, _asked(text, ranges, passage, functions, similarity), blocks.SENT), _groups, 1)
    members = met(runs.unionByName(asked.withColumn("level", F.col("level") + _ASKED)),
                  _members_sent(text, ranges, passage, functions, similarity), _MEMBER)
    answers = members.groupBy("task").applyInArrow(_compared(passage, similarity), blocks.ANSWER)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, block = [], None
        if len(table):
            b = block = _Block(table, text, ranges, places=True)
            table = b.table
            rows = [np.frombuffer(b"".join(answers.filter(pc.equal(answers["level"], level))["answers"].to_pylist()), np.int64)
                    for level in (_KNOWN, _STRETCHES)]
            found = passages(b, rows[0].reshape(-1, 6), rows[1].reshape(-1, 5))
        return table.select(["_block", "_owner", "_mark"]).append_column(
            "_n_words", pa.array(np.diff(block.first) if block else [], pa.int64())).append_column("_passages", pa.array(found, _ARROW))

    return met(answers, finish, f"_block long, _owner long, _mark long, _n_words long, _passages {_PASSAGES}")


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", passage: int = PASSAGE,
             similarity: float = SIMILARITY, functions: int = FUNCTIONS,
             block_chars: int = blocks.BLOCK_CHARS, columns: list[str] | None = None) -> DataFrame:
    """``docs``, or the ``columns`` of them, plus ``_owner`` (long), ``_n_words`` and ``_passages`` for every row.

    A passage has at least ``passage`` words that another document has too, or nearly has.
    ``first_doc`` is the smallest document with it; ``_owner``, the row's own number in that
    order, is its doc_id.  Rows of one doc_id are one document; a null id stands for a
    document of its own text, after all others (2**62 and more).  Null and empty texts, and
    texts of fewer words, have no passages; an empty table gives no rows.
    """
    own = F.coalesce(F.col(key).cast("long"),
                     F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))
    names = [*(docs.columns if columns is None else columns), "_owner"]
    rows = docs.withColumn("_owner", own)
    dealt, ranges = blocks.dealt(rows.withColumn("_mark", F.xxhash64(text)), block_chars, text, key)
    found = _kept(_found(dealt.select("_block", "_owner", "_mark", text), ranges, text, passage, similarity, functions), "passages")
    added = ["_n_words", "_passages"]

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        places = {mark: i for i, mark in enumerate(zip(found["_owner"].to_pylist(), found["_mark"].to_pylist(), strict=True))}
        at = pa.array([places[mark] for mark in zip(table["_owner"].to_pylist(), table["_mark"].to_pylist(), strict=True)], pa.int64())
        table = table.select(names)
        for c in added:
            table = table.append_column(c, found[c].combine_chunks().take(at))
        return table

    schema = StructType([*(rows.schema[c] for c in names), *(found.schema[c] for c in added)])
    return dealt.select(*dict.fromkeys([*names, "_block", "_mark"])).groupBy("_block").cogroup(
        found.groupBy("_block")).applyInArrow(finish, schema)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **kw) -> DataFrame:
    """``docs`` with repeated passages cut from every document but the first that has them.

    A document left without a word is dropped if it had one; other columns are unchanged,
    but a column ``n_chars`` follows the text.  Texts without repeated passages stay as they are.
    """
    found = repeated(docs, text, key, **kw)
    later = F.filter("_passages", lambda p: p["first_doc"] != F.col("_owner"))
    found = found.withColumn("_cuts", F.array_sort(F.transform(later, lambda p: F.struct(p["start"].alias("a"), p["end"].alias("b")))))
    # Left to right: what stands between the cuts, and how far the text is dealt with.
    state = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    kept = F.aggregate("_cuts", state, lambda s, c: F.struct(
        F.concat(s["kept"], F.substr(F.col(text), s["at"] + 1, F.greatest(c["a"] - s["at"], F.lit(0)))).alias("kept"),
        F.greatest(s["at"], c["b"]).alias("at")),
        lambda s: F.concat(s["kept"], F.substr(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    found = found.withColumn("_left", F.when(F.size("_cuts") > 0, kept).otherwise(F.col(text)))
    gone = (F.size("_cuts") > 0) & ~F.coalesce(F.col("_left"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    changed = {text: F.col("_left"), "n_chars": F.when(F.size("_cuts") > 0, F.length("_left")).otherwise(F.col("n_chars"))} \
        if "n_chars" in docs.columns else {text: F.col("_left")}
    return found.filter(~gone).select(*[
        (changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`")) for c in docs.columns])
