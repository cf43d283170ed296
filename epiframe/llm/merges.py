"""Byte-pair merges in vectorised rounds over flat symbol arrays.

The words of a batch lie one after another in one array.  A round finds, per
word, the smallest pair rank (a segmented minimum) and its leftmost place,
merges there in all words at once, looks up the ranks of the two pairs that
changed, and compacts the arrays.  Words without a pair to merge leave.  Each
word so goes through the same merges, in the same order, as one that is
encoded alone: lowest rank first, leftmost first among equals."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, merged symbol); an open-addressing hash table in flat arrays."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = left << 32 | right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            at, who = slot[put], todo[put]
            self.keys[at], self.rank[at], self.merged[at] = keys[who], np.asarray(rank)[who], np.asarray(merged)[who]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left, right):
        """(rank, merged) of each pair; rank NONE where the pair never merges."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


def merge_one(table: PairTable, symbols: list[int]) -> list[int]:
    """The same merges for one long word, by a queue of pairs (rounds would be quadratic in its length)."""
    n = len(symbols)
    sym, prev, nxt = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    arr = np.asarray(symbols, np.int32)
    rank, merged = table(arr[:-1], arr[1:])
    queue = [(r, i, a, b, m) for i, (r, m, a, b) in enumerate(zip(rank.tolist(), merged.tolist(), sym, sym[1:]))
             if r != NONE]
    heapq.heapify(queue)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i, j):
        pair = (sym[i], sym[j])
        if pair not in known:
            r, m = table(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))
            known[pair] = int(r[0]), int(m[0])
        r, m = known[pair]
        if r != NONE:
            heapq.heappush(queue, (r, i, *pair, m))

    while queue:
        _, i, a, b, m = heapq.heappop(queue)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = m, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            push(i, nxt[j])
        if prev[i] >= 0:
            push(prev[i], i)
    return [s for s in sym if s >= 0]


def merge_words(table: PairTable, symbols: np.ndarray, lens: np.ndarray, long_word: int = 400):
    """(flat symbols, lengths) of the merged words, in the order given.

    ``symbols`` (int32) holds the words one after another; no length is 0.
    Words over ``long_word`` symbols go through ``merge_one``: same result."""
    lens = np.asarray(lens, np.int64)
    total = len(lens)
    if not total:
        return np.zeros(0, np.int32), lens
    ends = np.cumsum(lens)
    starts = ends - lens
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    word = np.arange(total)
    long_ = lens > long_word
    if long_.any():
        for w in np.flatnonzero(long_):
            ids = np.array(merge_one(table, symbols[starts[w]:ends[w]].tolist()), np.int32)
            done.append((np.array([w]), np.array([len(ids)]), ids))
        symbols = symbols[np.repeat(~long_, lens)]
        word, lens = word[~long_], lens[~long_]
    sym = np.array(symbols, np.int32)
    rank = np.full(len(sym), NONE, np.int32)
    new = np.zeros(len(sym), np.int32)
    if len(sym):
        rank[:-1], new[:-1] = table(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
    while len(word):
        starts = np.cumsum(lens) - lens
        low = np.minimum.reduceat(rank, starts)
        live = low != NONE
        if not live.all():
            keep = np.repeat(live, lens)
            done.append((word[~live], lens[~live], sym[~keep]))
            sym, rank, new = sym[keep], rank[keep], new[keep]
            word, lens, low = word[live], lens[live], low[live]
            if not len(word):
                break
            starts = np.cumsum(lens) - lens
        at = np.flatnonzero(rank == np.repeat(low, lens))
        of = np.searchsorted(starts, at, "right") - 1
        at = at[np.concatenate(([True], of[1:] != of[:-1]))]
        sym[at] = new[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = at - np.arange(len(at))
        sym, rank, new, lens = sym[keep], rank[keep], new[keep], lens - 1
        starts = np.cumsum(lens) - lens
        last = place == starts + lens - 1
        right = place[~last]
        rank[right], new[right] = table(sym[right], sym[right + 1])
        rank[place[last]] = NONE
        left = place[place > starts] - 1
        rank[left], new[left] = table(sym[left], sym[left + 1])
    words = np.concatenate([w for w, _, _ in done])
    sizes = np.concatenate([n for _, n, _ in done])
    flat = np.concatenate([s for _, _, s in done])
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(words, kind="stable")
    lens = sizes[order]
    index = np.repeat(begin[order] - (np.cumsum(lens) - lens), lens) + np.arange(len(flat))
    return flat[index], lens
