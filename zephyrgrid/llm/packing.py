"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences of their own. The rest is dealt
to groups of bounded size; each packs its pieces best-fit in descending order. Bins with room left then become
items themselves: groups merge in a tree, and each round packs the open bins of its groups again. After best fit a
group has at most one bin that is half empty, and only such bins can move into another one. So a group
passes on its emptiest bins only, as many as there are groups; the others can't take part in any merge that
these could not take part in, and are final. No piece is dropped and none is cut but for its length.

Defined cases: a null or empty text is a document of the end id alone. Rows that share an id, or have none,
are documents of their own. Equal lengths are taken in the order of the input's rows, which is written
down before packing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.llm.texts import map_texts
from zephyrgrid.llm.tokens import encoder
from zephyrgrid.session import stable

CAPACITY = 2048
GROUP_ITEMS, FAN_IN = 32_768, 16
END = np.array([0], "<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each document and its end id, cut every ``capacity``."""
    def start():
        encode = encoder(path).encode

        def cut(texts):
            rows = []
            for made in encode(texts):
                ids = made + END
                rows.append([{"piece": i, "start": i * capacity, "length": len(part) // 4, "ids": part}
                             for i, part in enumerate(ids[at:at + 4 * capacity] for at in range(0, len(ids), 4 * capacity))])
            return [rows]
        return cut

    made = map_texts(docs, ["doc_id"], "_pieces array<struct<piece:int,start:bigint,length:bigint,ids:binary>>", start)
    return made.select("doc_id", F.inline("_pieces"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in descending order: the bin of each, its place there, and the fill of each bin.

    Bins are kept by the room they have; the bits of one integer tell which amounts of room there are.
    """
    stacks = [[] for _ in range(capacity + 1)]
    rooms, fills, bins, places = 0, [], [], []
    for size in sizes.tolist():
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        places.append(capacity - room)
        fills[b] += size
        if room > size:
            stacks[room - size].append(b)
            rooms |= 1 << (room - size)
    return np.array(bins, np.int64), np.array(places, np.int64), np.array(fills, np.int64)


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
    bins, places, fills = best_fit(pdf["size"].to_numpy(), capacity)
    first = np.flatnonzero(places == 0)  # the piece that opened each bin names it
    return pd.DataFrame({"item": pdf["item"], "bin": pdf["item"].to_numpy()[first][bins], "place": places,
                         "fill": fills[bins], "part": pdf["part"]})


def assign(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """(item, sequence_id, offset) of items with a unique ``item`` and a ``size`` from 1 to ``capacity``."""
    def pack(df):
        return stable(df.groupBy("part").applyInPandas(
            lambda pdf: _pack_group(pdf, capacity), "item long, bin long, place long, fill long, part long"))

    parts = max(1, math.ceil(items.count() / group_items))
    placed = pack(items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")))
    result = placed.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    while parts > 1:
        emptiest = Window.partitionBy("part").orderBy("fill", "bin")
        passed = min(parts, max(1, group_items // fan_in))
        bins = (placed.filter((F.col("place") == 0) & (F.col("fill") < capacity))
                .withColumn("_rank", F.row_number().over(emptiest)).filter(F.col("_rank") <= passed))
        parts = math.ceil(parts / fan_in)
        placed = pack(bins.select(F.col("bin").alias("item"), F.col("fill").alias("size"),
                                  F.floor(F.col("part") / fan_in).alias("part")))
        moved = placed.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_to"), F.col("place").alias("_by"))
        result = result.join(moved, "sequence_id", "left").select(
            "item", F.coalesce("_to", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
    return result


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length``) and, for each, ``sequence_id`` and ``offset``.

    All columns of ``pieces`` are kept; wide ones are written once and joined with the assignment.
    """
    rows = stable(pieces.withColumn("_item", F.monotonically_increasing_id()))
    full = rows.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("_item"), "offset": F.lit(0).cast("bigint")})
    rest = rows.filter(F.col("length") < capacity)
    places = assign(rest.select(F.col("_item").alias("item"), F.col("length").alias("size")), capacity)
    packed = rest.join(places.withColumnRenamed("item", "_item"), "_item")
    return full.unionByName(packed).drop("_item")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed ids, from pieces with their ``ids``."""
    row = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(row)).alias("_rows")).select(
        "sequence_id", "length", F.aggregate("_rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"))
