"""Near-duplicate join on word shingles with an exact Jaccard threshold, by token-combination prefixes.

Texts with equal shingle sets form a class; classes are joined. Shingles have a fixed order: rare ones first, by
hash, then the frequent ones by frequency. A class that misses at most m of its shingles in any similar one
indexes a prefix of this order, extended by k: single rare shingles and, of frequent ones, pairs of two that fall
into the same division. The prefix ends when its rare shingles, and its frequent ones less one per division,
are m + k. Two similar classes then share k single entries, with the smaller k of both, or a pair: the first
of the two prefixes to end holds at most m shingles that the other class lacks. Classes that share a
passage only have fewer singles in common. Which shingles are frequent is counted over all prefixes; that
set, and any other choice of it, changes the work only.

Singles stand in few prefixes, so their pairs of classes are counted. In a list that is long all the same nothing is
counted: the counts that two classes need elsewhere fall by what either has in long lists, and a class that has
enough there to need no other entry is linked to the smallest such class of each, as are all classes of a list of a
pair of shingles. Classes linked so form clusters of candidates. A cluster is verified as a whole: each pair of blocks of bounded size is one unit of work, in which the
sizes of all intersections come from products of 0/1 matrices over the shingles that the blocks share. A unit
returns a spanning forest of its links, not pairs. Links are exact up to 64-bit hashes of shingles and sets.

Defined cases: a null or empty text, or one of white space, has an empty set and is linked with nothing, itself
its component; a text with fewer words than a shingle has one shingle of all its words. Rows that share an id or a
text keep their own rows. Components are named by their smallest id; rows without an id get the name of theirs,
if any. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid.llm.bitmap import in_bitmap
from zephyrgrid.llm.components import components
from zephyrgrid.llm.ship import ship
from zephyrgrid.llm.texts import let_go, map_texts
from zephyrgrid.session import BROADCAST_ROWS, attach, stable

FREQUENT_FROM = 16  # prefixes that hold a frequent shingle
COUNTED = 64  # a list of singles up to this length has its pairs counted
MOST_FREQUENT = 200_000  # the frequent shingles that are told to all tasks
DIVISION = 8  # prefix shingles per division of the frequent ones, about
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # classes in a block of a cluster, and the shingles of all of them, about
COLUMNS = 2048  # shingles of one product of matrices
MEMO = 100_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; texts link when ``den * shared >= num * united``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least(self, n):
        """The fewest shingles that a set of ``n`` shares with a similar one."""
        return -(-n * self.num // self.den)

    def prefix(self, n):
        """The length of the prefix of a set of ``n``: what a similar set may lack, and the extension."""
        return n - self.least(n) + self.extension(n)

    def extension(self, n):
        return max(1, (n - self.least(n)) // 2)

    def linked(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)

    def bands(self, n: int) -> range:
        """Powers of two of the sizes that a set similar to one of ``n`` can have."""
        return range(int(math.log2(self.least(n))), int(math.log2(max(n, n * self.den // self.num))) + 1)

    def divisions(self, band: int) -> int:
        missed = (1 << band) - self.least(1 << band)
        return max(1, missed // DIVISION)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts, sorted."""

    def __init__(self, words: int):
        self.n, self.words = words, Words()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > MEMO:
            self.words = Words()
        get, out = self.words.__getitem__, []
        for text in texts:
            split = text.encode().lower().split() if text else []
            if not split:
                out.append(np.zeros(0, np.uint64))
                continue
            hashes = np.fromiter(map(get, split), np.uint64, len(split))
            width = min(self.n, len(split))
            made = np.full(len(split) - width + 1, width, np.uint64)
            for i in range(width):
                made = mixed(made * K1 + hashes[i:len(split) - width + 1 + i])
            out.append(np.unique(made))
        return out


def key_of(shingles: np.ndarray) -> int:
    """A name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text_hash, n, key, prefix): sets by name, with the prefix they have if all shingles are rare.

    A task gives the prefix of a set once; of other rows with the set it is null.
    """
    def start():
        shingler, seen = Shingler(rule.words), set()

        def call(texts):
            sets = shingler.sets(texts)
            keys = [key_of(s) for s in sets]
            prefixes = []
            for key, s in zip(keys, sets):
                prefixes.append(signed(s[:rule.prefix(len(s))]).tolist() if len(s) and key not in seen else None)
                seen.add(key)
            return [[len(s) for s in sets], keys, prefixes]
        return call

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return stable(map_texts(hashed, ["doc_id", "text_hash"], "n bigint, key bigint, prefix array<bigint>", start))


def shared_entries(rows: DataFrame) -> DataFrame:
    """(entry, c): the shingles that stand in more than one prefix. All others can be left out of the index."""
    return stable(rows.select(F.explode("prefix").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("c"))
                  .filter("c > 1"))


def frequent_shingles(shared: DataFrame, least: int = FREQUENT_FROM, most: int = MOST_FREQUENT) -> np.ndarray:
    """The shingles in more than ``least`` prefixes, rarest first; at most ``most``, the most frequent ones."""
    rows = shared.filter(F.col("c") > least).orderBy(F.desc("c"), "entry").limit(most).toPandas()
    return rows["entry"].to_numpy(np.int64)[::-1].view(np.uint64)


class Indexer:
    """Index entries of a set, given the frequent shingles."""

    def __init__(self, rule: Rule, frequent: np.ndarray):
        self.rule, order = rule, np.argsort(frequent)
        self.known, self.rank = frequent[order], order

    def split(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare shingles by hash, frequent ones by frequency."""
        if not len(self.known):
            return shingles, shingles[:0]
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hit = self.known[at] == shingles
        return shingles[~hit], shingles[hit][np.argsort(self.rank[at[hit]])]

    def entries(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single rare shingles, and hashed pairs of frequent ones with their band."""
        n = len(shingles)
        if not n:
            return shingles, shingles
        need = self.rule.prefix(n)
        rare, frequent = self.split(shingles)
        singles, pairs = rare[:need], [shingles[:0]]
        need -= len(rare)
        for band in self.rule.bands(n) if need > 0 and n > 1 else ():
            divisions = self.rule.divisions(band)
            parts: list[list] = [[] for _ in range(divisions)]
            gained = 0
            for s, d in zip(frequent, (frequent % np.uint64(divisions)).tolist()):
                # a frequent shingle counts from the second of its division on
                gained += len(parts[d]) > 0
                parts[d].append(s)
                if gained >= need:
                    break
            for part in parts:
                i, j = np.triu_indices(len(part), 1)
                a, b = np.array(part, np.uint64)[i], np.array(part, np.uint64)[j]
                pairs.append(mixed(mixed(np.minimum(a, b) * K1 + np.uint64(band + 1)) * K1 + np.maximum(a, b)))
        return singles, np.concatenate(pairs)


def once(call, key_at: int = 0):
    """Blank the columns of rows whose key this task has already given out; copies need no second entry."""
    seen: set[int] = set()

    def run(texts):
        columns = call(texts)
        fresh = []
        for key in columns[key_at]:
            fresh.append(key not in seen)
            seen.add(key)
        return [[v if f else None for v, f in zip(c, fresh)] for c in columns]
    return run


def candidate_links(docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): names of classes that may be similar; ``rows`` are the summaries."""
    rows = rows.filter("prefix IS NOT NULL")
    in_several = shared_entries(rows)
    frequent = frequent_shingles(in_several)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    known = spark.createDataFrame(pd.DataFrame({"s": frequent.view(np.int64)}), "s long")  # bounded, see above
    touched = stable(rows.withColumn("_s", F.explode("prefix"))
                     .join(F.broadcast(known), F.col("_s") == F.col("s"), "left_semi")
                     .select("key", "text_hash").distinct())

    def start():
        shingler, indexer = Shingler(rule.words), Indexer(rule, shared.value)

        def call(texts):
            sets = shingler.sets(texts)
            made = [indexer.entries(s) for s in sets]
            return [[key_of(s) for s in sets], [len(s) for s in sets],
                    [signed(a).tolist() for a, _ in made], [signed(b).tolist() for _, b in made]]
        return once(call)

    texts = docs.select("text", F.xxhash64("text").alias("text_hash"))
    again = attach(texts, touched.select("text_hash").distinct(), ["text_hash"], "left_semi", counted=touched)
    remade = stable(map_texts(again, [], "key bigint, n bigint, singles array<bigint>, pairs array<bigint>", start)
                    .filter("key IS NOT NULL"))
    plain = attach(rows, touched.select("key").distinct(), ["key"], "left_anti", counted=touched).select(
        "key", "n", F.explode("prefix").alias("entry"))
    singles = plain.unionByName(remade.select("key", "n", F.explode("singles").alias("entry")))
    # several tasks may give out the same set, so a list has at most as many classes as rows
    lists = stable(singles.groupBy("entry").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1"))
    crowded = stable(lists.filter(F.col("_size") > COUNTED).select("entry"))
    crowds = crowded.count()
    short = (attach(in_bitmap(singles, lists.select("entry")), crowded, ["entry"], "left_anti", counted=crowds)
             .repartition("entry").groupBy("entry").agg(F.collect_set(F.struct("key", "n")).alias("m")))
    met = short.select(F.inline(F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: y["key"] < x["key"]), lambda y: F.struct(
            x["key"].alias("a"), y["key"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b")))))))
    least = lambda n: F.floor((n * rule.num + rule.den - 1) / rule.den)
    missed = lambda n: n - least(n)
    extension = lambda n: F.greatest(F.lit(1), F.floor(missed(n) / 2))
    # of the entries two similar classes share, at most as many stand in long lists as either has there
    crowd = stable(attach(singles, crowded, ["entry"], "inner", counted=crowds).distinct())
    standing = stable(crowd.groupBy("key", "n").agg(F.count(F.lit(1)).alias("_long")))
    long_of = lambda c: standing.select(F.col("key").alias(c), F.col("_long").alias(f"_long_{c}"))
    counted = (met.filter((F.col("n_a") >= least(F.col("n_b"))) & (F.col("n_b") >= least(F.col("n_a"))))
               .groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("_met")))
    for c in ("a", "b"):
        counted = attach(counted, long_of(c), [c], counted=standing)
    elsewhere = F.coalesce(F.least(*[F.coalesce(f"_long_{c}", F.lit(0)) for c in ("a", "b")]), F.lit(0))
    near = counted.filter(F.col("_met") >= F.least(extension(F.col("n_a")), extension(F.col("n_b"))) - elsewhere).select("a", "b")
    # only classes that may share nothing but long lists with a similar one are linked by them
    only = crowd.join(standing.filter(F.col("_long") >= extension(least(F.col("n")))).select("key"), "key", "left_semi")
    long = (only.join(only.groupBy("entry").agg(F.min("key").alias("b")), "entry").filter("key <> b")
            .select(F.col("key").alias("a"), "b"))
    combined = remade.select("key", F.explode("pairs").alias("entry"))
    first = combined.groupBy("entry").agg(F.min("key").alias("b"), F.max("key").alias("_most")).filter("b < _most")
    paired = combined.join(first.drop("_most"), "entry").filter("key <> b").select(F.col("key").alias("a"), "b")
    return near.unionByName(long.unionByName(paired).distinct())


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a 0/1 matrix of links between the nodes ``left`` and ``right``: (node, root)."""
    i, j = np.nonzero(links)
    a, b = left[i], right[j]
    nodes, index = np.unique(np.r_[a, b], return_inverse=True)
    a, b = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], same: bool = False) -> np.ndarray:
    """The sizes of all intersections of two lists of sets; of ``same`` lists, of sets at different places."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(
            len(left), len(right))
    if same:  # a shingle of one set only is in no intersection
        values, held = np.unique(np.concatenate(left), return_counts=True)
        both = values[held > 1]
    else:
        both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out.astype(np.int64)

    def cells(sets):
        """The rows and columns of the ones, by columns."""
        rows, columns = [], []
        for i, tokens in enumerate(sets):
            at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
            at = at[both[at] == tokens].astype(np.int32)
            rows.append(np.full(len(at), i, np.int32))
            columns.append(at)
        row, column = np.concatenate(rows), np.concatenate(columns)
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    def dense(count, row, column, low, high):
        a, b = np.searchsorted(column, [low, high])
        part = np.zeros((count, high - low), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        return part

    of_left = cells(left)
    of_right = of_left if same else cells(right)
    for low in range(0, len(both), COLUMNS):
        high = min(low + COLUMNS, len(both))
        part = dense(len(left), *of_left, low, high)
        out += part @ (part if same else dense(len(right), *of_right, low, high)).T
    return out.astype(np.int64)


def verify(group: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Spanning links of one unit of work: blocks ``i`` and ``j`` of a cluster, or several whole small clusters."""
    group = group.drop_duplicates(["cluster", "key"])
    nodes, roots = [], []
    for _, part in group.groupby("cluster"):
        sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        keys, sizes = part["key"].to_numpy(), np.array([len(s) for s in sets])
        block, i, j = part["block"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(rows) or not len(cols):
            continue
        counts = shared_counts([sets[r] for r in rows], [sets[c] for c in cols], i == j)
        links = rule.linked(counts, sizes[rows][:, None], sizes[cols][None, :])
        links &= keys[rows][:, None] != keys[cols][None, :]
        node, root = forest(links, keys[rows], keys[cols])
        nodes.append(node)
        roots.append(root)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    let_go(all_kept=True)
    return pd.DataFrame({"a": join(nodes), "b": join(roots)}).astype("int64")


def in_blocks(classes: DataFrame, clusters: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, text_hash, n, cluster, blocks, block): the classes of clusters, in blocks bounded by classes and by shingles."""
    held = stable(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(
        classes.select("key", "text_hash", "n"), "key"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / shingles)).cast("int")
    return held.join(held.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning links between the classes of each cluster (node, root)."""
    members = stable(in_blocks(classes, clusters, block))

    def start():
        shingler = Shingler(rule.words)

        def call(texts):
            sets = shingler.sets(texts)
            return [[key_of(s) for s in sets], [s.tobytes() for s in sets]]
        return once(call)

    texts = docs.select("text", F.xxhash64("text").alias("text_hash"))
    place = ["cluster", "blocks", "block"]
    found = attach(texts, members.drop("key", "n"), ["text_hash"], "inner", counted=members)
    sets = map_texts(found, place, "key bigint, shingles binary", start).filter("key IS NOT NULL")
    cells = sets.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", *place, "shingles", F.least("block", "_k").alias("i"), F.greatest("block", "_k").alias("j"))
    small = members.filter("blocks = 1").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles")).first()
    few = max(1, math.ceil(small.classes / (2 * block)), math.ceil((small.shingles or 0) / (2 * BLOCK_SHINGLES)))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(few))).otherwise(F.col("cluster"))
    return cells.withColumn("unit", unit).groupBy("blocks", "unit", "i", "j").applyInPandas(
        lambda pdf: verify(pdf, rule), "a long, b long")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root) of every row; see the text of the module.

    ``root`` names the component also where none of its rows has an id; it is null for rows without shingles.
    """
    ship(docs.sparkSession)
    rows = summaries(docs, rule)
    classes = stable(rows.filter("n > 0").groupBy("key").agg(
        F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("first_id"), F.max("n").alias("n")))
    clusters = stable(components(candidate_links(docs, rows, rule)))
    roots = components(verified_links(docs, classes, clusters, rule))
    named = classes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    names = stable(named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
                   .select("key", "component_id", "root"))
    joined = rows.select("doc_id", "text_hash", "n", "key").join(names, "key", "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def report(docs: DataFrame, rule: Rule = Rule(3, 90, 100)) -> DataFrame:
    return near_duplicates(docs, rule).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component, with all columns: the smallest id, rows without one last, then the smallest hash of the text.

    Rows without shingles stay, but of those with the same id and text one. Texts are moved only where the rows to
    leave out are too many for a broadcast.
    """
    found = stable(near_duplicates(docs, rule).select(
        F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), F.col("root").alias("_root")))
    # null comes last in this order, and hashes decide among equal ids
    place = F.struct(F.col("_llm_id").isNull().alias("x"), F.col("_llm_id").alias("id"), F.col("_llm_hash").alias("hash"))
    best = found.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(place).alias("_best"))
    chosen = F.col("_llm_id").eqNullSafe(F.col("_best.id")) & (F.col("_llm_hash") == F.col("_best.hash"))
    marked = stable(found.join(best, "_root", "left").select(
        "_llm_id", "_llm_hash", (F.col("_root").isNull() | chosen).alias("_keep"), F.col("_root").isNotNull().alias("_linked")))
    same = docs["doc_id"].eqNullSafe(F.col("_llm_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_llm_hash"))

    def where(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, how)

    repeated = stable(marked.filter("_keep AND (_linked OR _llm_id IS NOT NULL)").groupBy("_llm_id", "_llm_hash").count()
                      .filter("count > 1").drop("count"))
    gone = marked.filter("NOT _keep").select("_llm_id", "_llm_hash").distinct().unionByName(repeated)
    kept = where(stable(gone), "left_anti")
    if not repeated.head(1):
        return kept
    return kept.unionByName(where(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
