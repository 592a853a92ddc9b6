"""Byte-pair encoding and decoding with a byte-level tokenizer file, by batched merge rounds.

Texts are cut into words by the file's pattern; new words of a batch lie as byte symbols in one flat array. A round
finds the rank of every pair of neighbours by binary search in the sorted pair keys, takes the lowest rank of
each word and merges it wherever it stands in the word. Words without a pair to merge leave the array. The ids
of words are kept for later batches up to a fixed number.

Defined cases: a null text has no ids and decodes to an empty text, like an empty one. The text of a special
token is that token, as in the library. Ids that are no token, and nulls, decode to nothing; bytes that are no
UTF-8 become the replacement character. Other columns stay as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from zephyrgrid.llm.texts import map_texts, pieces
from zephyrgrid.llm.tokens import BYTE_WORDS, CHUNK, MEMO_UNITS, SPACED, byte_alphabet, chunks

ROUND_BYTES = 4_000_000
NONE = np.int64(1 << 40)


class Merges:
    """The pairs of a file as sorted keys, with rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.of_byte = np.array([vocabulary[chr(alphabet[b])] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.ranks, self.into = (left << 20 | right)[order], order.astype(np.int64), into[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {v: k for k, v in alphabet.items()}
        self.bytes_of = {i: bytes(back[ord(c)] for c in token) for token, i in vocabulary.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes of 32-bit integers; words are not empty."""
        out: list[bytes] = [b""] * len(words)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.arange(len(words))
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            keys = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ranks = np.full(len(symbols), NONE)
            ranks[:-1] = np.where(self.keys[at] == keys, self.ranks[at], NONE)
            ranks[starts + sizes - 1] = NONE  # the last symbol of a word has no follower
            lowest = np.minimum.reduceat(ranks, starts)
            word_of = np.repeat(np.arange(len(owner)), sizes)
            done = lowest == NONE
            hit = (ranks == lowest[word_of]) & ~done[word_of]
            # neighbouring hits overlap (as in "aaa"): every second one of a run counts, from its left end
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= run % 2 == 0
            merged = np.flatnonzero(hit)
            symbols[merged] = self.into[at[merged]]
            stay = np.ones(len(symbols), bool)
            stay[merged + 1] = False
            if done.any():
                flat = symbols.astype("<u4").tobytes()
                for w in np.flatnonzero(done):
                    out[owner[w]] = flat[4 * starts[w]:4 * (starts[w] + sizes[w])]
                stay &= ~done[word_of]
            sizes = np.bincount(word_of[stay], minlength=len(owner))[~done]
            symbols, owner = symbols[stay], owner[~done]
        return out


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(BYTE_WORDS)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.units, self.words = {}, {}

    def _learn(self, units: list[str]) -> None:
        if len(self.words) > MEMO_UNITS:
            self.words = {}
        cut, special = {}, self.merges.special
        for unit in units:
            parts = self.split.split(unit) if self.split and any(s in unit for s in special) else [unit]
            cut[unit] = [w for p in parts for w in ([p] if p in special else self.pattern.findall(p))]
        fresh = list({w for found in cut.values() for w in found}.difference(self.words).difference(special))
        low, size = 0, 0
        for i, word in enumerate(fresh):
            size += len(word)
            if size > ROUND_BYTES or i + 1 == len(fresh):
                some = fresh[low:i + 1]
                self.words.update(zip(some, self.merges.encode_words([w.encode() for w in some])))
                low, size = i + 1, 0
        for text, i in special.items():
            self.words[text] = np.array([i], "<u4").tobytes()
        for unit, found in cut.items():
            self.units[unit] = b"".join([self.words[w] for w in found])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [[u for c in chunks(t) for u in SPACED.findall(c)] if t and len(t) > CHUNK else SPACED.findall(t or "")
               for t in texts]
        if len(self.units) > MEMO_UNITS:
            self.units = {}
        self._learn(list(set().union(*cut).difference(self.units)))
        return [b"".join(map(self.units.__getitem__, c)) for c in cut]

    def decode(self, ids: list[bytes | None]) -> list[str]:
        table = self.merges.bytes_of
        return [b"".join([table.get(i, b"") for i in np.frombuffer(raw or b"", "<u4").tolist()]).decode("utf-8", "replace")
                for raw in ids]


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``ids``, the ids of ``text`` as 32-bit little-endian integers."""
    def start():
        codec = Codec(path)
        return lambda texts: [codec.encode(texts)]
    return map_texts(docs, keep, "ids binary", start)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of ``ids``."""
    schema = encoded.select("*").schema.add("decoded", "string")

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for part in pieces(batch, "ids"):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(codec.decode(part.column("ids").to_pylist()), pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
