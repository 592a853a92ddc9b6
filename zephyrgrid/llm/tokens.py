"""Token ids of whole texts by a public tokenizer file, with the units of a batch encoded together.

Texts are cut into units at places where the tokenizer of the file never joins two sides: around white space.
The units of a batch of texts are numbered first, so that each different one is looked up once, and the ids of all
are gathered by array operations. The ids of units are kept in memory, for all tasks of a worker, up to a fixed number. New units
of ASCII and Latin letters are cut into words by the classes of their bytes, others of plain letters by the file's own pattern, and
all their words go through the merges of the file together. Units with other characters, or with the text of a special token,
go through the whole tokenizer. Ids are 32-bit little-endian integers.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from zephyrgrid.llm.merges import LONGEST, Merges, byte_alphabet, plain
from zephyrgrid.llm.texts import held

PLAIN = "ſ"  # up to here normal forms, cases and letter classes are the same in all Unicode versions
CHUNK = 1_000_000
MEMO_UNITS = 200_000
BATCH = 2_000_000  # characters whose units are numbered together
BREAK = re.compile(r"(?<=\S) (?=\S)")
SPACED = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
# white space next to other white space, or other than space and line feed: there the pieces between are not units
UNEVEN = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")]
# stand before a unit at the start, after a line feed or after a space, in texts that don't hold them
FIRST, LINE, SPACE = "\x1d", "\x1e", "\x1f"
# fixed values: the word patterns that the two kinds of files state or imply
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks(text: str):
    """Pieces of about ``CHUNK`` characters; a tokenizer gives the same ids for them as for the whole."""
    at = 0
    while len(text) - at > CHUNK:
        found = BREAK.search(text, at + CHUNK)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


def pack(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder != "little":
        made.byteswap()
    return made.tobytes()


def classes(digits: bool) -> np.ndarray:
    """The class of each byte of ASCII: letters, digits, white space, other characters; 0 for the apostrophe and all that is not ASCII.

    A run of one class is a word. Without ``digits`` every digit is a word of its own.
    """
    out = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.isalpha() else (2 if digits else 3) if c.isdigit() else 4 if c.isspace() else 5
    out[ord("'")] = 0
    return out


ALONE = 3


class Encoder:
    """Encodes batches of texts; ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)").search
        self.odd = re.compile("|".join([f"[\x1c-\x1f]|[^\x00-{PLAIN}]", *special])).search
        steps = spec["pre_tokenizer"]
        if spec["normalizer"] is None and steps.get("type") == "ByteLevel" and steps["use_regex"] \
                and not steps["add_prefix_space"]:
            self.lower, self.pattern = False, regex.compile(BYTE_WORDS)
        elif steps.get("type") == "Sequence" and [n["type"] for n in spec["normalizer"]["normalizers"]] == [
                "NFC", "Replace", "Lowercase"]:
            self.lower, self.pattern = True, regex.compile(steps["pretokenizers"][0]["pattern"]["Regex"])
        else:
            self.lower, self.pattern = False, None
        self.alphabet = byte_alphabet()
        self.merges = Merges(spec["model"]) if self.pattern and plain(spec["model"]) else None
        self.special_texts = [t["content"] for t in spec["added_tokens"]]
        self.classes = classes(digits=not self.lower)
        self.may_be_special = np.isin(np.arange(256), [t.encode()[0] for t in self.special_texts if t])
        self.bytes = np.arange(256, dtype=np.uint8)
        if self.lower:
            self.bytes[65:91] += 32
        else:
            self.bytes[[ord(LINE), ord(SPACE)]] = 10, 32
        # letters of two bytes, in lower case if the file wants it; 0 for others
        letters = [chr(c).lower() if self.lower else chr(c) for c in range(0x180)]
        self.of_code = np.array([ord(c) if i >= 0xC0 and len(c) == 1 and c.isalpha() else 0 for i, c in enumerate(letters)])
        self.units, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _word(self, word: str) -> bytes:
        return pack([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of units as they stand in their texts."""
        cut: list[list[str] | bytes] = [
            pack(self.library.encode(unit, add_special_tokens=False).ids) if self.pattern is None or self.odd(unit)
            else self.pattern.findall(unit.lower() if self.lower else unit) for unit in units]
        words = list(dict.fromkeys(w for found in cut if isinstance(found, list) for w in found))
        made = dict(zip(words, self._words(words)))
        return [b"".join(map(made.__getitem__, found)) if isinstance(found, list) else found for found in cut]

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        if self.merges is None or not raw:
            return list(map(self._word, words))
        if max(map(len, raw)) > LONGEST:
            short = iter(self._words([w for w, r in zip(words, raw) if len(r) <= LONGEST]))
            return [next(short) if len(r) <= LONGEST else self._word(w) for w, r in zip(words, raw)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, lengths = self.merges.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
        flat, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, units: pa.Array) -> pa.Array:
        """The ids of units, with their marks if the file is a byte-level one."""
        starts = np.frombuffer(units.buffers()[1], np.int64, len(units) + 1, 8 * units.offset)
        raw = np.frombuffer(units.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
        starts, ends = (starts - starts[0])[:-1], (starts - starts[0])[1:]
        if self.merges is None or not len(raw):
            plain_ = np.zeros(len(units), bool)
        else:
            shown, mark = self.bytes[raw], raw == ord(FIRST)
            kind = self.classes[shown]
            two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # À to ſ
            code = self.of_code[(raw[two] & 31).astype(np.int64) << 6 | raw[two + 1] & 63]
            shown[two], shown[two + 1] = 0xC0 | code >> 6, 0x80 | code & 63
            kind[two] = kind[two + 1] = code > 0
            upto = np.r_[0, np.cumsum((kind == 0) | self.may_be_special[raw])]
            plain_ = (upto[ends] == upto[starts]) & (ends - starts <= LONGEST) & (ends > starts)
        other = np.flatnonzero(~plain_)
        texts = units.take(pa.array(other)).to_numpy(zero_copy_only=False).tolist()
        rest = pa.array(self._units([self._meant(t) if t else t for t in texts]), pa.large_binary())
        if not plain_.any():
            return rest
        own = np.flatnonzero(plain_)
        if not self.lower:
            # a space belongs to the word behind it; the mark of a first unit is left out
            kind[starts[own]] = np.where(shown[starts[own]] == 32, kind[np.minimum(starts[own] + 1, len(kind) - 1)], kind[starts[own]])
            kind[starts[own]] = np.where((shown[starts[own]] == 32) & (ends[own] - starts[own] == 1), 4, kind[starts[own]])
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
        begins[starts[own]] = True
        begins[ends[own]] = True
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[starts[own]] += 1
        inside[ends[own]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(own) < len(units) else np.ones(len(raw), bool)
        at = np.flatnonzero(begins)
        low, high = at[:-1], at[1:]
        keep = inside[low] & ~(mark[low] & (high - low == 1))
        low, high = low[keep], high[keep]
        ids, lengths = self.merges.encode(shown, low, high - low)
        before = np.r_[0, np.cumsum(lengths)]
        # the ids of a unit are those of the words that begin in it
        cuts = before[np.searchsorted(low, np.r_[starts[own], len(raw)])]
        offsets = np.r_[cuts[:-1], cuts[-1]] * 4
        made = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.tobytes())])
        if not len(other):
            return made
        place = np.zeros(len(units), np.int64)
        place[own], place[other] = np.arange(len(own)), len(own) + np.arange(len(other))
        return pa.concat_arrays([made, rest]).take(pa.array(place))

    def _known(self, units: pa.Array) -> pa.Array:
        """The ids of different units; those of the last units are kept."""
        found = pc.index_in(units, value_set=self.units)
        new = found.is_null()
        if not pc.any(new).as_py():
            return self.ids.take(found)
        fresh = units.filter(new)
        learnt = self._learn(fresh)
        at = found.to_numpy(zero_copy_only=False)
        missing = new.to_numpy(zero_copy_only=False)
        place = np.where(missing, len(self.ids) + np.cumsum(missing) - 1, np.nan_to_num(at)).astype(np.int64)
        self.units, self.ids = pa.concat_arrays([self.units, fresh]), pa.concat_arrays([self.ids, learnt])
        ids = self.ids.take(pa.array(place))
        if len(self.units) > MEMO_UNITS:  # those of this batch stay, and of the others the last
            used = np.zeros(len(self.units), bool)
            used[place] = True
            spare = np.flatnonzero(~used)
            left = pa.array(np.r_[spare[max(0, len(spare) - max(0, MEMO_UNITS // 2 - len(place))):], np.flatnonzero(used)])
            self.units, self.ids = self.units.take(left), self.ids.take(left)
        return ids

    def _chunk(self, text: str) -> bytes:
        if self.pattern is None or self.lower or self.special(text):
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        units = SPACED.findall(text)
        different = list(dict.fromkeys(units))
        return b"".join(map(dict(zip(different, self._units(different))).__getitem__, units))

    def _marked(self, text: str) -> str | None:
        """A chunk whose units lie between white space, with marks before those that follow no space; None where they are not plain to see."""
        if self.pattern is None:
            return None
        if self.lower:
            return None if any(c in text for c in SEPARATORS) else text
        if text[0].isspace() or text[-1].isspace() or any(c in text for c in UNEVEN) or self.special(text):
            return None
        return FIRST + text.replace(" ", " " + SPACE).replace("\n", " " + LINE)

    def _meant(self, unit: str) -> str:
        """A unit as it stands in its text, with the white space before it."""
        return unit if self.lower else {FIRST: "", LINE: "\n", SPACE: " "}[unit[0]] + unit[1:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for i, text in enumerate(texts):
            for chunk in chunks(text or ""):
                if not chunk:
                    continue
                marked = self._marked(chunk)
                if marked is None:
                    out[i].append(self._chunk(chunk))
                    continue
                waiting.append((i, len(out[i]), marked))
                out[i].append(b"")
                size += len(chunk)
                if size >= BATCH:
                    self._gather(waiting, out)
                    waiting, size = [], 0
        self._gather(waiting, out)
        return [b"".join(parts) for parts in out]

    def _gather(self, waiting: list, out: list[list[bytes]]) -> None:
        """Fill in the ids of chunks (text, place, marked chunk)."""
        if not waiting:
            return
        marked = pa.array([text for _, _, text in waiting], pa.large_string())
        cut = pc.utf8_split_whitespace(marked) if self.lower else pc.split_pattern(marked, " ")
        units = cut.flatten().dictionary_encode()
        ids = self._known(units.dictionary).take(units.indices)
        ends = pa.Array.from_buffers(pa.int64(), len(ids) + 1, [None, ids.buffers()[1]]).take(cut.offsets).to_pylist()
        made = memoryview(ids.buffers()[2] or b"")
        for (i, place, _), a, b in zip(waiting, ends, ends[1:]):
            out[i][place] = made[a:b]


def encoder(path: str) -> Encoder:
    """One encoder per worker, so that later tasks find what earlier ones have kept, until another operator's task starts."""
    return held(("encoder", path), lambda: Encoder(path))
