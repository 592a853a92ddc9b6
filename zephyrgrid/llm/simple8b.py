"""Token files in a word-aligned binary coding, written in the order of document ids and read back.

A file holds a run of documents. Its ids are replaced by their rank in the file's table of frequent ids, which makes
them small numbers, and every 64-bit word packs as many as fit: a 4-bit selector names how many numbers of how
many bits the word holds. Number 0 is an escape; the ids behind escapes stand in a list of their own. Words
are grouped in blocks of a fixed number of ids with the offsets of their words and escapes, so that a block, or all
blocks together, are decoded with array operations.

The files are binary values of a Parquet table written by Spark to the shared folder, one per row with its place in
the order; each value is complete in itself.

Defined cases: null and empty texts are documents of the end id alone. Rows without an id come first, rows that
share one are ordered by a hash of their text; all keep their own entry. An empty table gives no files and no
rows. Other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.llm.ship import ship
from zephyrgrid.llm.texts import pieces, small_batches
from zephyrgrid.llm.tokens import encoder
from zephyrgrid.session import attach, stable

FILE_IDS = 1 << 20  # a file is closed after the document that brings it to so many ids
BLOCK = 1024
FREQUENT = 4095
MAGIC = b"ZG8B0001"
# selector -> (numbers in a word, bits of each)
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12)]
HEAD = struct.Struct("<8sQQQQQ")  # mark, documents, ids, frequent ids, words, escapes


def _pack_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the number of words in each; greedy, all blocks step by step together."""
    blocks = -(-len(codes) // BLOCK)
    reach = SELECTORS[0][0]
    grid = np.zeros((blocks, BLOCK + reach), np.uint16)
    grid[:, :BLOCK].flat[:len(codes)] = codes
    widths = np.searchsorted(1 << np.array([bits for _, bits in SELECTORS]), np.arange(FREQUENT + 1), "right")
    level = widths.astype(np.uint8)[grid]  # the first selector that is wide enough, by bits
    choice = np.full((blocks, BLOCK), len(SELECTORS) - 1, np.uint8)
    place = np.arange(BLOCK + reach, dtype=np.int16)
    for s in range(len(SELECTORS) - 2, -1, -1):
        n = SELECTORS[s][0]
        # where the next number too wide for this selector stands
        wide = np.where(level > s, place, np.int16(BLOCK + 2 * reach))
        ahead = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1]
        choice[ahead[:, :BLOCK] >= place[:BLOCK] + n] = s
    sizes = np.array([n for n, _ in SELECTORS])
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    ends = np.full(blocks, BLOCK)
    ends[-1:] = len(codes) - BLOCK * (blocks - 1)
    steps = []
    while len(rows):
        chosen = choice[rows, at[rows]]
        steps.append((rows, at[rows].copy(), chosen))
        at[rows] += sizes[chosen]
        rows = rows[at[rows] < ends[rows]]
    row, start, chosen = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(row.astype(np.uint16) if blocks < 1 << 16 else row, kind="stable")  # steps are in order already
    row, start, chosen = row[order], start[order], chosen[order]
    words = chosen.astype(np.uint64)
    for s, (n, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        for i in range(n):
            words[own] |= grid[row[own], start[own] + i].astype(np.uint64) << np.uint64(4 + i * bits)
    return words, np.bincount(row, minlength=blocks)


def _unpack_words(words: np.ndarray, per_block: np.ndarray, ids: int) -> np.ndarray:
    """The numbers of all blocks."""
    chosen = (words & np.uint64(15)).astype(np.int64)
    sizes = np.array([n for n, _ in SELECTORS])[chosen]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_block) - per_block
    start = before - np.repeat(before[first], per_block)
    block = np.repeat(np.arange(len(per_block)), per_block)
    codes = np.zeros(len(per_block) * BLOCK, np.uint32)
    for s, (n, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        for i in range(n):
            inside = own[start[own] + i < BLOCK]
            codes[block[inside] * BLOCK + start[inside] + i] = (
                words[inside] >> np.uint64(4 + i * bits)) & np.uint64((1 << bits) - 1)
    return codes[:ids]


def encode_file(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """One file from documents, each the bytes of its 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    if len(ids) and ids.max() < 1 << 20:
        counts, inverse = np.bincount(ids), ids
        values = np.arange(len(counts))
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    by_count = np.lexsort((values, -counts))[:min(FREQUENT, np.count_nonzero(counts))]
    code_of = np.zeros(len(values), np.uint16)
    code_of[by_count] = np.arange(1, len(by_count) + 1)
    frequent = values[by_count].astype("<u4")
    codes = code_of[inverse]
    escapes = ids[codes == 0].astype("<u4")
    words, per_block = _pack_words(codes) if len(ids) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    per_escape = np.add.reduceat(codes == 0, np.arange(0, len(codes), BLOCK)) if len(ids) else np.zeros(0)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, len(docs), len(ids), len(frequent), len(words), len(escapes)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
        np.array([len(d) // 4 for d in docs], "<u8").tobytes(), frequent.tobytes(),
        np.r_[0, np.cumsum(per_block)].astype("<u8").tobytes(), np.r_[0, np.cumsum(per_escape)].astype("<u8").tobytes(),
        words.astype("<u8").tobytes(), escapes.tobytes()])


class File:
    """A file read from bytes: the documents' ids and lengths, and access to the token ids."""

    def __init__(self, raw: bytes):
        mark, docs, self.ids, frequent, words, escapes = HEAD.unpack_from(raw)
        if mark != MAGIC:
            raise ValueError("not a token file")
        blocks, at = -(-self.ids // BLOCK), HEAD.size

        def take(kind, n):
            nonlocal at
            part = np.frombuffer(raw, kind, n, at)
            at += part.nbytes
            return part

        doc_ids, known = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.frequent = take("<u4", frequent)
        self.word_at, self.escape_at = take("<u8", blocks + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
        self.words, self.escapes = take("<u8", words), take("<u4", escapes)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` (without it)."""
        blocks = len(self.word_at) - 1
        last = blocks if last is None else min(last, blocks)
        if first >= last:
            return np.zeros(0, "<u4")
        codes = _unpack_words(self.words[self.word_at[first]:self.word_at[last]],
                              np.diff(self.word_at[first:last + 1]), min(self.ids, last * BLOCK) - first * BLOCK)
        out = np.r_[np.uint32(0), self.frequent][codes]
        out[codes == 0] = self.escapes[self.escape_at[first]:self.escape_at[last]]
        return out.astype("<u4")


def write(docs: DataFrame, path: str) -> DataFrame:
    """(part, seq, n_ids, file): the files of all documents in ascending order of ids, stored in the shared folder.

    ``path`` is a file of the tokenizers library. Texts are shuffled once, by ranges of ids.
    """
    ship(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id().cast("long"))

    small_batches(docs.sparkSession)

    def encode(batches):
        encode_texts = encoder(path).encode
        end = np.array([0], "<u4").tobytes()
        ids, docs, size, seq, part = [], [], 0, 0, 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([encode_file(ids, docs)], pa.binary())], names=["part", "seq", "n_ids", "file"])

        for batch in batches:
            for some in pieces(batch, "text"):
                part = some.column("part")[0].as_py()
                for doc_id, made in zip(some.column("doc_id").to_pylist(), encode_texts(some.column("text").to_pylist())):
                    ids.append(doc_id)
                    docs.append(made + end)
                    size += len(docs[-1]) // 4
                    if size >= FILE_IDS:
                        yield close()
                        ids, docs, size, seq = [], [], 0, seq + 1
        if docs:
            yield close()

    return stable(ranged.mapInArrow(encode, "part long, seq long, n_ids long, file binary"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ``start`` counts the ids of all before it."""
    ship(files.sparkSession)
    sizes = files.select("part", "seq", "n_ids")
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part", "seq", (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_start"))
    placed = attach(files.select("part", "seq", "file"), starts, ["part", "seq"], "inner", counted=sizes)

    def decode(batches):
        for batch in batches:
            for start, raw in zip(batch.column("_start").to_pylist(), batch.column("file")):
                f = File(raw.as_py())
                ids, ends = f.read(), np.cumsum(f.lengths)
                for low in range(0, len(ends), 256):
                    some = range(low, min(low + 256, len(ends)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[low:some.stop], pa.int64()),
                         pa.array(start + ends[low:some.stop] - f.lengths[low:some.stop], pa.int64()),
                         pa.array(f.lengths[low:some.stop], pa.int64()),
                         pa.array([ids[ends[i] - f.lengths[i]:ends[i]].tobytes() for i in some], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return placed.select("_start", "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
