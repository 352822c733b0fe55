"""Byte-level BPE by the pre-tokens of many texts at a time.

The library encodes every pre-token alone, so each distinct one is encoded once
and its ids are reused. Pre-tokens are cut on arrays of code points, for texts
of Latin script (up to U+024F, whose classes are the same in every Unicode
version); the others go to ``UnitCache``. A known pre-token is found by a hash
and then compared with the text it is held for, so no hash decides about ids:
texts in which two pre-tokens share a hash go to ``UnitCache`` as well. Texts
that hold an added token of the library's are passed to it whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from heliograph.llm.units import UnitCache
from heliograph.llm.words import SpanHash

LAST = 0x24F
OTHER, LETTER, NUMBER, SPACE = range(4)
WHITE = {*range(9, 14), 32, 0x85, 0xA0}
CLASSES = np.array([SPACE if c in WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LAST + 1)], np.uint8)
BEYOND = re.compile(f"[^\\x00-\\u{LAST:04x}]")
POINT_HASH = SpanHash(LAST + 1, 41)
#: Pre-tokens kept per Python worker; a full cache is emptied, which costs time only.
CACHE_TOKENS = 2_000_000
#: New pre-tokens are merged into the large sorted table when there are so many.
MERGE = 100_000
#: Pre-tokens in one string that is passed to the library.
TOGETHER = 200


def cuts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of texts that lie one after the other; ``rows``: where each begins (none is empty)."""
    kind, n = CLASSES[points], len(points)
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[rows] = True
    run = np.flatnonzero(starts)
    end = np.append(run[1:], n)
    ends_row = np.zeros(n + 1, bool)
    ends_row[rows] = ends_row[n] = True
    # The last white space before other characters stands alone, or opens the next pre-token if it is a space.
    before = end[(kind[run] == SPACE) & ~ends_row[end]]
    starts[before - 1] = True
    starts[before[points[before - 1] == 32]] = False
    # An apostrophe that opens a pre-token takes one of the endings s, t, m, d, re, ve, ll.
    mark = np.flatnonzero((points[run] == 39) & (end - run == 1) & starts[run] & ~ends_row[end])
    mark = mark[kind[end[mark]] == LETTER]
    first, size = end[mark], end[mark + 1] - end[mark]
    a, b = points[first], np.where(size > 1, points[np.minimum(first + 1, n - 1)], 0)
    took = np.isin(a, [ord(c) for c in "stmd"]).astype(np.int64)
    took[(np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))] = 2
    first, size, took = first[took > 0], size[took > 0], took[took > 0]
    starts[first] = False
    starts[(first + took)[size > took]] = True
    return np.flatnonzero(starts)


def unlike(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Mask of the spans that differ from their counterparts; the spans cover ``points`` without a gap, none is empty."""
    at = np.arange(len(points)) + np.repeat(other_starts - starts, sizes)
    differs = others[np.clip(at, 0, len(others) - 1)] != points
    return np.logical_or.reduceat(differs, starts) | (sizes != other_sizes)


class PretokenCache:
    """Ids of whole texts. ``encode`` gives the library's ids of each string; ``added``: strings that it treats apart."""

    def __init__(self, encode: Callable[[Sequence[str]], list[list[int]]], added: Sequence[str] = ()) -> None:
        self.encode = encode
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.units = UnitCache(lambda texts: [np.array(x, "<u4").tobytes() for x in encode(texts)])
        line = encode(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.first, self.pool = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32)
        self.text_first, self.text_pool = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint16)
        self.n = 0

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Where each pre-token's ids are listed; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, slots in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                known = keys[at] == hashes
                out[known] = slots[at[known]]
        return out

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> None:
        """List ids and texts of new pre-tokens, one after the other."""

        def listed(first: np.ndarray, pool: np.ndarray, n: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            used = int(first[self.n])
            while used + len(values) > len(pool):
                pool = np.concatenate([pool, np.zeros_like(pool)])
            pool[used : used + len(values)] = values
            return np.concatenate([first[: self.n + 1], used + np.cumsum(n)]), pool

        self.first, self.pool = listed(self.first, self.pool, counts, ids)
        self.text_first, self.text_pool = listed(self.text_first, self.text_pool, sizes, points)
        slots = np.arange(self.n, self.n + len(hashes))
        self.n += len(hashes)

        def merged(level: tuple, keys: np.ndarray, own: np.ndarray) -> tuple:
            keys, own = np.concatenate([level[0], keys]), np.concatenate([level[1], own])
            order = np.argsort(keys, kind="stable")
            return keys[order], own[order]

        self.levels[1] = merged(self.levels[1], hashes, slots)
        if len(self.levels[1][0]) > MERGE:
            self.levels = [merged(self.levels[0], *self.levels[1]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def encoded(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all of them. Those without white space at the end are passed together, lines apart."""
        counts = np.zeros(len(tokens), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(tokens)
        plain = [i for i, t in enumerate(tokens) if not t[-1].isspace()] if self.line is not None else []
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        alone = set(range(len(tokens))).difference(plain)
        for group, found in zip(groups, self.encode(["\n".join([*(tokens[i] for i in group), ""]) for group in groups]) if groups else [], strict=True):
            ids = np.array(found, np.uint32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(group):
                alone.update(group)
                continue
            for i, a, b in zip(group, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                parts[i] = ids[a:b]
        rest = sorted(alone)
        for i, found in zip(rest, self.encode([tokens[i] for i in rest]) if rest else [], strict=True):
            parts[i] = np.array(found, np.uint32)
        counts[:] = [len(p) for p in parts]
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts and ids of texts of Latin script, none of them empty."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint16)
        rows = np.cumsum([0, *map(len, texts)])
        starts = cuts(points, rows[:-1])
        ends = np.append(starts[1:], len(points))
        sizes = ends - starts
        hashes, at, inverse = np.unique(POINT_HASH(points, starts, ends), return_index=True, return_inverse=True)
        if self.n > CACHE_TOKENS:
            self.clear()
        slot = self.slots(hashes)
        new, old = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
        collided = unlike(points, starts, sizes, points, starts[at[inverse]], sizes[at[inverse]]).any()
        if len(old):
            own, size = at[old], sizes[at[old]]
            first = np.concatenate([[0], np.cumsum(size)])
            some = points[np.repeat(starts[own] - first[:-1], size) + np.arange(first[-1])]
            held = self.text_first[slot[old]]
            collided |= unlike(some, first[:-1], size, self.text_pool, held, self.text_first[slot[old] + 1] - held).any()
        if collided:
            parts = [np.frombuffer(x, "<u4") for x in self.units.whole(texts)]
            return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        if len(new):
            counts, ids = self.encoded([whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            slot[new] = np.arange(self.n, self.n + len(new))
            size = sizes[at[new]]
            first = np.cumsum(size) - size
            self.add(hashes[new], counts, ids, size, points[np.repeat(starts[at[new]] - first, size) + np.arange(size.sum())])
        slot = slot[inverse]
        size = self.first[slot + 1] - self.first[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.first[slot] - before[:-1], size) + np.arange(before[-1])]
        return np.diff(before[np.append(np.searchsorted(starts, rows[:-1]), len(starts))]), flat

    def whole(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts of all texts, and all ids in order."""
        apart = {i for i, t in enumerate(texts) if self.added and self.added.search(t)}
        fast = [i for i, t in enumerate(texts) if t and i not in apart and not BEYOND.search(t)]
        slow = [i for i in set(range(len(texts))).difference(fast) if texts[i]]
        counts, ids = self.latin([texts[i] for i in fast]) if fast else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if not slow:
            out = np.zeros(len(texts), np.int64)
            out[fast] = counts
            return out, ids
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, part in zip(fast, np.split(ids, np.cumsum(counts)[:-1]) if fast else [], strict=True):
            parts[i] = part
        slow.sort()
        plain = [i for i in slow if i not in apart]
        for i, raw in zip(plain, self.units.whole([texts[i] for i in plain]), strict=True):
            parts[i] = np.frombuffer(raw, "<u4")
        for i in apart:
            parts[i] = np.array(self.encode([texts[i]])[0], np.uint32)
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
