"""Suffix sorting by grouping, and a compressed FM-index. Both work on one bounded shard in memory."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a text whose last symbol is its unique smallest, in linear time.

    First all suffixes are put into groups of equal longest Lyndon prefix: groups start as first symbols and are taken
    from the largest down; each suffix of a group points to the nearest suffix before it in a smaller group, and the
    suffixes pointed to are split off behind their own group, those with more pointers further back. Then the groups
    are emitted: from left to right in the suffix array, the suffix before each entry, and on along the pointers to
    smaller suffixes, takes the first free place of its group. Nothing is renamed or sorted recursively.
    """
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    heads, at = {}, 0
    for c in sorted(counts):
        heads[c] = at
        at += counts[c]
    group = [heads[c] for c in text]  # of each suffix, the first place of its group
    stop = [0] * (n + 1)  # of each group, the place behind its last
    for c, h in heads.items():
        stop[h] = h + counts[c]
    order, place, free = [0] * n, [0] * n, dict(heads)
    for i, c in enumerate(text):
        p = free[c]
        order[p], place[i], free[c] = i, p, p + 1
    smaller = [-1] * n
    end = n
    while end:
        head = group[order[end - 1]]
        members = order[head:end]
        if end - head > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        end = head
        if not pointers:
            continue
        levels: dict[int, list[int]] = {}
        for j, k in pointers.items():
            levels.setdefault(k, []).append(j)
        for k in sorted(levels, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in levels[k]:
                moved.setdefault(group[j], []).append(j)
            for old, those in moved.items():
                last = stop[old]
                new = last - len(those)
                if new == old:
                    continue  # the whole group goes: it stays as it is
                p = last
                for j in those:  # swap to the tail
                    p -= 1
                    q, other = place[j], order[p]
                    order[q], place[other] = other, q
                    order[p], place[j] = j, p
                    group[j] = new
                stop[old], stop[new] = new, last
    out, done, free = [-1] * n, [False] * n, list(range(n + 1))
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            p = free[group[j]]
            free[group[j]] = p + 1
            out[p] = j
            done[j] = True
            j = smaller[j]
    return out


def equal_windows(segments: list[bytes], window: int, alone: list[bool] | None = None) -> list[list[tuple[int, int]]]:
    """Groups of two or more equal windows of ``window`` bytes, as (segment, start in it). Windows of the segments
    marked in ``alone`` are reported without a partner, too."""
    text: list[int] = []
    where: list[tuple[int, int]] = []
    for s, body in enumerate(segments):
        text.extend(b + 2 for b in body)
        last = len(body) - window
        where.extend((s, i) if i <= last else (-1, 0) for i in range(len(body)))
        text.append(1)
        where.append((-1, 0))
    text.append(0)
    where.append((-1, 0))
    found, before = [], None
    for p in suffix_array(text):
        s, i = where[p]
        if s < 0:
            continue  # its window would cross the segment's end; no equal windows lie around it
        body = segments[s][i : i + window]
        if body == before:
            found[-1].append((s, i))
        else:
            before = body
            found.append([(s, i)])
    return [g for g in found if len(g) > 1 or alone and alone[g[0][0]]]


class Wavelet:
    """Wavelet matrix over symbols with rank in packed 64-bit words: one bit per symbol and level, plus 1/16 for counts."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.words, self.blocks, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bits = (now >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            blocks = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=blocks[1:])
            self.words.append(words)
            self.blocks.append(blocks)
            self.zeros.append(self.n - int(blocks[-1]))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.blocks[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class FMIndex:
    """FM-index of a shard of token sequences for matches of up to ``cap`` tokens.

    Kept after the build: the wavelet matrix of the Burrows-Wheeler transform, the first place of each symbol, and where
    the order changes within ``cap`` and within ``cap - 1`` tokens. Suffixes are ordered by their first ``cap`` or more
    tokens, which backward search over patterns of up to that length needs.
    """

    def __init__(self, sequences: list[np.ndarray], sigma: int, cap: int):
        self.cap = cap
        text = np.concatenate([x for s in sequences for x in (s + 1, [0])]).astype(np.int64)  # 0 ends a sequence
        n = len(text)
        rank, span = np.unique(text, return_inverse=True)[1], 1
        while span < cap:
            second = np.zeros(n, np.int64)
            second[:-span] = rank[span:] + 1
            _, rank = np.unique(rank * (n + 2) + second, return_inverse=True)
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.order = order
        self.wavelet = Wavelet(text[order - 1], sigma + 1)
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.whole = self._groups(text, order, cap)
        self.part = self._groups(text, order, cap - 1)
        self.n = n

    @staticmethod
    def _groups(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
        """Starts of the groups of equal ``depth``-token prefixes, in suffix order."""
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        new = np.zeros(len(order), bool)
        new[0] = True
        for d in range(depth):
            column = padded[order + d]
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    def step(self, lo: np.ndarray, hi: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of ``token`` before each interval's pattern."""
        base = self.first[token]
        return base + self.wavelet.rank(token, lo), base + self.wavelet.rank(token, hi)

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From intervals of ``cap`` tokens to those of their first ``cap - 1``."""
        g = np.searchsorted(self.part, lo, "right") - 1
        return self.part[g], np.append(self.part, self.n)[g + 1]

    def stream(self, sequences: list[np.ndarray]):
        """Matching statistics of whole sequences, from their ends, capped at ``cap``.

        Yields ``(sequence numbers, starts, first places, ends)`` of all windows of ``cap`` tokens that occur in the
        index, one position of every sequence at a time.
        """
        size = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences) + 1 if len(sequences) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        who = np.flatnonzero(size >= self.cap)
        at = size[who] - 1
        lo, hi, length = np.zeros(len(who), np.int64), np.full(len(who), self.n), np.zeros(len(who), np.int64)
        while len(who):
            token = flat[begin[who] + at]
            a, b = self.step(lo, hi, token)
            hit = a < b
            # without a match the pattern loses its last token and is searched again from the one before it
            at = np.where(~hit & (length > 0), at + length, at)
            length = np.where(hit, length + 1, 0)
            lo, hi = np.where(hit, a, 0), np.where(hit, b, self.n)
            full = length == self.cap
            if full.any():
                yield who[full], at[full], lo[full], hi[full]
                short = self.shorten(lo[full])
                lo[full], hi[full] = short
                length[full] -= 1
            at -= 1
            go = at >= 0
            who, at, lo, hi, length = who[go], at[go], lo[go], hi[go], length[go]
