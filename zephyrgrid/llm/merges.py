"""Merge rounds of byte-pair encoding over blocks of words of similar length.

A word is a column of symbols, each with its neighbours' places. A round merges the first pair of lowest rank in every word
and looks up the two pairs that are new; the ranks of all others stay. Pairs are found in an open hash table.
"""

from __future__ import annotations

import numpy as np

TOGETHER, LONGEST = 8192, 48  # words of a block; bytes of a word
BITS, PLACE = 20, 6  # of a symbol or a rank; of a place in a word
LOW = np.int64((1 << BITS) - 1)
PAD = np.int32((1 << BITS) - 1)  # stands for no symbol, and at places whose symbol was merged into another
NONE = np.int32(1 << 30)
STEP = np.uint64(0x9E3779B97F4A7C15)
OTHER_WAYS = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in the vocabulary of a byte-level file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def plain(model: dict) -> bool:
    """Whether these rounds are all that the model of a file does: each byte has a symbol and none of ``OTHER_WAYS`` is set."""
    shown, end = map(chr, byte_alphabet().values()), model.get("end_of_word_suffix") or ""
    return model["type"] == "BPE" and not any(model.get(s) is not None and model[s] is not False for s in OTHER_WAYS) and all(
        c in model["vocab"] and c + end in model["vocab"] for c in shown) and max(
        *model["vocab"].values(), len(model["merges"])) < PAD


class Merges:
    """The pairs of a file's model with their rank and merged symbol."""

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [chr(c) for _, c in sorted(byte_alphabet().items())]
        self.of_byte = np.array([vocabulary[c] for c in shown], np.int32)
        self.of_last = np.array([vocabulary[c + end] for c in shown], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {vocabulary[a] << BITS | vocabulary[b]: i for i, (a, b) in enumerate(pairs)}  # of a pair named twice the later rank
        self.into = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        size = 1 << max(8, (4 * len(ranks)).bit_length())
        self.shift, self.mask = np.uint64(65 - size.bit_length()), size - 1
        self.table = np.full(size, -1, np.int64)  # pair and rank
        held = np.array([k << BITS | r for k, r in ranks.items()], np.int64)
        at = self._place(held >> BITS)
        while len(held):
            free = self.table[at] < 0
            self.table[at[free]] = held[free]  # of several for one place, one stays
            left = self.table[at] != held
            held, at = held[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * STEP) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        keys = left.astype(np.int64) << BITS | right
        at = self._place(keys)
        held = self.table[at]
        same = (held >> BITS) == keys
        found = np.where(same, held & LOW, -1).astype(np.int32)
        rest = np.flatnonzero((held >= 0) > same)
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.table[at[rest]]
            same = (held >> BITS) == keys[rest]
            found[rest[same]] = held[same] & LOW
            rest = rest[(held >= 0) > same]
        return found

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has; a word has 1 to ``LONGEST`` bytes of ``raw``."""
        order, lengths = np.argsort(sizes, kind="stable"), np.zeros(len(sizes), np.int64)
        blocks = [order[low:low + TOGETHER] for low in range(0, len(order), TOGETHER)]
        made = []
        for words in blocks:
            ids, lengths[words] = self._block(raw, starts[words], sizes[words])
            made.append(ids)
        first = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), "<u4")
        for words, ids in zip(blocks, made):
            n = lengths[words]
            out[np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, lengths

    def _block(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, count = int(sizes.max()), len(sizes)
        all_words, rows = np.arange(count), np.arange(width + 1)[:, None]
        # a last row of places that hold nothing, for symbols without a neighbour
        symbols = np.full((width + 1, count), PAD)
        inside = rows[:-1] < sizes
        symbols[:-1][inside] = self.of_byte[raw[(starts + rows[:-1])[inside]]]
        symbols[sizes - 1, all_words] = self.of_last[raw[starts + sizes - 1]]
        ranks = np.full((width + 1, count), NONE)  # of each symbol with its follower, and its place
        first = self.rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width, count)
        ranks[:-1] = np.where(first >= 0, first << PLACE | rows[:-1].astype(np.int32), NONE)
        follower = np.repeat(np.minimum(rows + 1, width).astype(np.int32), count)
        leader = np.repeat(np.where(rows > 0, rows - 1, width).astype(np.int32), count)
        grid, symbols, ranks = ranks, symbols.ravel(), ranks.ravel()
        while True:
            lowest = grid.min(axis=0)
            word = np.flatnonzero(lowest < NONE)
            if not len(word):
                break
            lowest = lowest[word]
            place = lowest & ((1 << PLACE) - 1)
            at = place * count + word
            merged = follower[at] * count + word
            after, before = follower[merged], leader[at]
            next_, last = after * count + word, before * count + word
            new = self.into[lowest >> PLACE]
            symbols[at], symbols[merged], ranks[merged] = new, PAD, NONE
            follower[at], leader[next_] = after, place
            found = self.rank(np.concatenate([new, symbols[last]]), np.concatenate([symbols[next_], new]))
            ranks[np.concatenate([at, last])] = np.where(found >= 0, found << PLACE | np.concatenate([place, before]), NONE)
        kept = np.ascontiguousarray(symbols.reshape(width + 1, count).T)
        there = kept != PAD
        return kept[there], there.sum(axis=1)
