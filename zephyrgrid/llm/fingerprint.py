"""Document fingerprints: SimHash of weighted word pairs, and block tables for a Hamming radius.

Every word with its follower is a term; its two 64-bit hashes vote on 128 bits with a weight that grows
with the length of the words, so that function words count little. Votes are kept as two 32-bit lanes
of a long, 64 sums per document. Everything is expressions, one aggregation and one shuffle of the texts.

Defined cases: a null text is empty, and an empty text has the fingerprint of zeros; equal texts have
equal fingerprints. Documents without an id come after all others. Rows that share an id stay separate,
ordered by a hash of the text. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.llm.bitmap import in_bitmap
from zephyrgrid.session import stable

BITS = 128
LANES = (1 << 32) | 1
RADIUS = 6


def simhash(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): the 128-bit SimHash of a text; ``keys`` name a row."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    split = df.select(*keys, F.filter(F.split(lowered, r"\s+"), lambda w: w != "").alias("_words"))
    followed = F.transform("_words", lambda w, i: F.struct(
        F.xxhash64(F.lit(1), w, F.get("_words", i + 1)).alias("a"),
        F.xxhash64(F.lit(2), w, F.get("_words", i + 1)).alias("b"),
        F.least(F.lit(24), F.length(w) + F.coalesce(F.length(F.get("_words", i + 1)), F.lit(0)))
        .cast("bigint").alias("w")))
    votes = split.select(*keys, F.inline_outer(followed))
    lane = lambda c, i: F.shiftright(F.col(c), i).bitwiseAND(F.lit(LANES)) * F.col("w")
    sums = votes.groupBy(*keys).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("_all"),
        *[F.coalesce(F.sum(lane(c, i)), F.lit(0)).alias(f"_{c}{i}") for c in "ab" for i in range(32)])

    def bits(c: str) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(32):
            low, high = F.col(f"_{c}{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(F.col(f"_{c}{i}"), 32)
            for votes_for, place in ((low, i), (high, i + 32)):
                bit = F.lit(1 << place if place < 63 else -(1 << 63))
                out = out.bitwiseOR(F.when(votes_for * 2 > F.col("_all"), bit).otherwise(F.lit(0).cast("bigint")))
        return out

    return sums.select(*keys, bits("a").alias("hi"), bits("b").alias("lo"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits."""
    return 1.0 - distance(a, b).cast("double") / BITS


def text_form(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in (hi, lo)]))


def _tables(df: DataFrame, radius: int) -> DataFrame:
    """One row per table: two of ``radius + 2`` blocks in front; at most ``radius`` blocks can differ."""
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def block(start: int, end: int) -> Column:
        parts = []
        for name, base in (("lo", 0), ("hi", 64)):
            a, b = max(start, base) - base, min(end, base + 64) - base
            if a < b:
                mask = -1 if b - a == 64 else (1 << (b - a)) - 1
                parts.append(F.shiftrightunsigned(F.col(name), a).bitwiseAND(F.lit(mask)))
        return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])

    cut = [block(a, b) for a, b in zip(edges, edges[1:])]
    keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(cut[i], cut[j]).alias("front"))
            for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    return df.select("*", F.inline(F.array(*keys)))


def within_radius(queries: DataFrame, classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance): all distinct fingerprints within ``radius`` of the distinct query fingerprints.

    A permuted table proposes pairs that agree in two blocks; the distance of each is then checked, and a
    pair found by several tables is returned once. No bucket is capped.
    """
    entry = F.xxhash64("table", "front").alias("entry")
    q = _tables(queries.select("hi", "lo").distinct(), radius).select(
        F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), entry)
    c = _tables(classes.select("hi", "lo").distinct(), radius).select("hi", "lo", entry)
    far = distance(("hi", "lo"), ("q_hi", "q_lo"))
    # only rows whose front may be that of a query are shuffled
    return (q.join(in_bitmap(c, q.select("entry")), "entry")
            .select("q_hi", "q_lo", "hi", "lo", far.cast("int").alias("distance"))
            .filter(F.col("distance") <= radius).distinct())


def block_bounds(docs: DataFrame) -> list[float]:
    """Approximate quantiles of the ids, so that blocks are even however the ids are spread."""
    pieces = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("double").alias("_id"))
    found = narrow.approxQuantile("_id", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))
    return sorted(set(found or [0.0]))


def in_descending_blocks(docs: DataFrame, bounds: list[float]) -> DataFrame:
    """(block, doc_id, text, hash): blocks of neighbouring ids; a larger block holds smaller ids.

    The quantiles are approximate and may come out otherwise in another run: take them once.
    """
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cutter = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_id", outputCol="_bucket")
    return cutter.transform(placed).select(
        (-F.col("_bucket")).cast("int").alias("block"), "doc_id", "text", F.xxhash64("text").alias("hash"))


def with_next(rows: DataFrame, heads: DataFrame, columns: list[str], order: list) -> DataFrame:
    """Add ``next_<column>`` of the following row; the last row of a block is followed by the next block's head.

    ``heads`` has one row per block with the columns of its first row; after the last block comes the first.
    """
    local = Window.partitionBy("block").orderBy(*order)
    led = rows.withColumns({f"_lead_{c}": F.lead(c).over(local) for c in columns})
    line = Window.orderBy("block")  # one row per block
    around = heads.select("block").withColumns({
        "_after": F.lead("block").over(line),
        "_first": F.min("block").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    follow = around.select("block", F.coalesce("_after", "_first").alias("_after")).join(
        heads.select(F.col("block").alias("_after"), *[F.col(c).alias(f"_head_{c}") for c in columns]), "_after")
    return led.join(follow.drop("_after"), "block", "left").select(
        *rows.columns, *[F.coalesce(f"_lead_{c}", f"_head_{c}").alias(f"next_{c}") for c in columns])


def with_edits(docs: DataFrame) -> DataFrame:
    """(block, pos, doc_id, text, n_chars, edited): each text and its half-replaced version."""
    bounds = block_bounds(docs)
    blocks = in_descending_blocks(docs, bounds)
    order = [F.desc_nulls_last("doc_id"), F.col("hash")]
    # the first row of each block: its greatest id is found without reading texts, its text by that id
    tops = in_descending_blocks(docs.select("doc_id", F.lit("").alias("text")), bounds).groupBy("block").agg(
        F.max("doc_id").alias("doc_id"))
    one = F.broadcast(tops.withColumnRenamed("doc_id", "_top"))  # at most one row per block
    firsts = blocks.join(one, "block").filter(F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = firsts.groupBy("block").agg(F.min_by("text", "hash").alias("text"))
    local = Window.partitionBy("block").orderBy(*order)
    n = F.length("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return with_next(blocks.withColumn("pos", F.row_number().over(local)), heads, ["text"], order).withColumn(
        "n_chars", n).select(
        "block", "pos", "doc_id", "text", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half),
                 F.substring("next_text", F.lit(1), half)).alias("edited"))


def compare_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and its edited version, and their likeness; see the module's text.

    ``n_within`` is, for documents whose id is divisible by 50, the number of documents (itself included)
    with a fingerprint within ``radius``, from the block tables; null for others.
    """
    edits = with_edits(docs)
    versions = edits.select(
        "block", "pos", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")),
                          F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("_v"))
    hashed = simhash(versions.select("block", "pos", "doc_id", "n_chars", "edited_sha256", "_v.*"),
                     ["block", "pos", "doc_id", "n_chars", "edited_sha256", "version"], "text")
    of = lambda c, v: F.max(F.when(F.col("version") == v, F.col(c)))
    marks = stable(hashed.groupBy("block", "pos", "doc_id", "n_chars", "edited_sha256").agg(
        of("hi", 0).alias("hi"), of("lo", 0).alias("lo"), of("hi", 1).alias("e_hi"), of("lo", 1).alias("e_lo")))
    heads = marks.filter("pos = 1").select("block", "hi", "lo")
    linked = with_next(marks, heads, ["hi", "lo"], [F.col("pos")])
    classes = marks.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("_rows"))
    asked = marks.filter(F.col("doc_id") % 50 == 0)
    near = within_radius(asked, classes, radius).join(classes, ["hi", "lo"]).groupBy(
        F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("_rows").alias("_near"))
    return linked.join(near, ["hi", "lo"], "left").select(
        "doc_id", "n_chars", "edited_sha256", text_form("hi", "lo").alias("fingerprint"),
        text_form("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness(("hi", "lo"), ("e_hi", "e_lo")).alias("near_edited"),
        likeness(("hi", "lo"), ("next_hi", "next_lo")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("_near")).alias("n_within"))
