"""Personal data: fixed kinds by pattern, and terms that disclose a protected entity by co-occurrence.

Mail addresses, IP addresses, card and phone numbers found in the texts are the protected entities. Any word outside
of them is a term, wherever it stands in the text. Over the whole corpus, each distinct text once, it is counted in
how many texts term and entity occur, and in how many both do. The information that a term gives about an entity,
log2(n_te * N / (n_t * n_e)), is compared with the information content of the entity itself, log2(N / n_e). A term that
gives at least ``SHARE`` of it in at least ``SUPPORT`` texts discloses the entity and is generalised wherever it occurs.

As n_te is at most n_e, a term that discloses occurs in at most n_e ** share * N ** (1 - share) texts. Terms are counted
in passes: the first finds the entities. The second counts the words of texts with an entity that ``SUPPORT`` texts
share, the third those words in all texts, both within tasks, and words that are certain to be in more texts than the
bound go. The fourth lists the words left in texts with such entities; joined with these by text they give n_te. The
fifth lists what can still disclose in all texts. Maps of fixed size tell tasks which texts and words to look at; what
else they let through goes later.

Defined cases: null and empty texts have no spans. Copies of a text count once and get the same spans. Rows that
share an id keep their own result. Other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid.llm.texts import let_go, map_texts, pieces
from zephyrgrid.session import attach, stable

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, SHARE = 3, 0.8
BITMAP = 1 << 22
HELD_WORDS = 100_000  # words that a task keeps or counts before it begins anew
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain of two or more parts, in time linear in the text."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and not NOT_LOCAL.match(text[start - 1]):
                start -= 1
        if domain and start < at:
            spans.append((start, domain.end()))
            end = domain.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return spans


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers taken four by four from the left; kept where every part is at most 255."""
    spans = []
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                spans.append((at, at + length))
            at += length + 1
    return spans


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed in ``KINDS``, then start; code points, end exclusive."""
    spans = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        spans += [(1, s, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def entities(text: str) -> list[str]:
    return sorted({f"{KINDS[k]}:{text[start:end].lower()}" for k, start, end in base_spans(text)})


def free_words(text: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words outside some spans."""
    taken, at = sorted((s, e) for _, s, e in taken), 0
    for m in WORD.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            yield m


def words(text: str) -> set[str]:
    """The words outside the entities, in lower case."""
    taken = base_spans(text)
    found = {m.group() for m in free_words(text, taken)} if taken else set(WORD.findall(text))
    return {w.lower() for w in found}


def disclosing(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(key, terms): for the hash of each text that holds some, the terms that disclose an entity anywhere."""
    keyed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = stable(map_texts(keyed, ["key"], "_entities array<string>", lambda: lambda texts: [[entities(t) for t in texts]])
                   .filter(F.size("_entities") > 0).select("key", F.explode("_entities").alias("entity")).distinct())
    rows = stable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    texts, copied = float(rows.count()), _levels(rows.filter("n > 1"), "key", F.least("n", F.lit(255)))
    # of entities that are in the same texts, as told by 128 bits of hashes, one stands for all
    alone = (pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("key")).alias("_a"),
                                         F.bit_xor(F.xxhash64(F.reverse("key"))).alias("_b"))
             .filter((F.col("n_e") >= support) & (F.col("n_e") < texts)))
    alone = stable(alone.groupBy("n_e", "_a", "_b").agg(F.min("entity").alias("entity")).select("entity", "n_e"))
    shared = stable(attach(pairs, alone, ["entity"], "inner"))
    most = lambda n_e: F.pow(n_e, F.lit(share)) * F.lit(texts ** (1 - share)) + 1

    near = _levels(shared, "key", F.ceil(4 * F.log2("n_e")) + 1)

    def shared_words():
        def call(key, text):
            level = int(near.value[_place(key)])
            return level, 1.0, words(text) if level else ()
        return call

    candidates = stable(_counted_by_task(keyed, shared_words).groupBy("term")
                        .agg(F.max("level").alias("level"), F.sum("n").alias("n")).filter(F.col("n") >= support)
                        .select("term", most(F.pow(F.lit(2.0), (F.col("level") - 1) / 4)).alias("_most")))
    known = _levels(candidates, "term", F.lit(1))

    def known_words():
        held, rows_of = _holder(known), copied.value

        def call(key, text):
            # the tasks that see a text are at most its rows, so that all of them together count it once at most
            n = int(rows_of[_place(key)])
            return 0, 1.0 if n == 0 else 1.0 / n if n < 255 else 0.0, held(text)
        return call

    least = (_counted_by_task(keyed, known_words).groupBy("term")
             .agg(F.greatest(F.max("n"), F.sum("weight")).alias("_least")))
    rare = stable(candidates.join(least, "term").filter(F.col("_least") <= F.col("_most")).select("term", "_least"))

    def listed(source, terms, everywhere):
        left = _levels(terms, "term", F.lit(1))

        def start():
            held = _holder(left)
            return lambda both: [[held(x[32:]) if everywhere or near.value[_place(x[:32])] else [] for x in both]]

        return (map_texts(source.select("key", F.concat("key", "text").alias("text")), ["key"], "_terms array<string>", start)
                .filter(F.size("_terms") > 0).dropDuplicates(["key"]).select("key", F.explode("_terms").alias("term")))

    pairs = attach(listed(keyed, rare, False), rare, ["term"], "inner").join(shared, "key")
    together = stable(pairs.groupBy("entity", "n_e", "term", "_least").agg(F.count(F.lit(1)).alias("n_te"))
                      .filter((F.col("n_te") >= support) & (F.col("_least") <= F.col("n_te")
                              * F.pow(F.lit(texts) / F.col("n_e"), F.lit(1 - share)) + 1)))
    left = stable(together.select("term").distinct())
    held = stable(attach(listed(keyed, left, True), left, ["term"], "left_semi"))
    together = together.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "term")
    information = F.log2(F.col("n_te") * F.lit(texts) / (F.col("n_t") * F.col("n_e")))
    content = F.log2(F.lit(texts) / F.col("n_e"))
    flagged = together.filter((content > 0) & (information >= share * content)).select("term").distinct()
    return held.join(flagged, "term").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _place(value: str) -> int:
    return zlib.crc32(value.encode()) % BITMAP


def _levels(rows: DataFrame, column: str, level: Column):
    """A broadcast map of fixed size: the highest level of the values of a column at each place, 0 where there are none."""
    places = (rows.select((F.crc32(F.col(column).cast("binary")) % BITMAP).cast("int").alias("place"),
                          level.cast("int").alias("level")).groupBy("place").agg(F.max("level").alias("level")).toArrow())
    levels = np.zeros(BITMAP, np.uint8)
    levels[places["place"].to_numpy()] = places["level"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(levels)


def _holder(shared):
    """A function from a text to its words that have a level."""
    known, memo = shared.value, {}
    none = not known.any()

    def held(text: str) -> list[str]:
        if none:
            return []
        there = words(text)
        if len(memo) > HELD_WORDS:
            memo.clear()
        for w in there.difference(memo):
            memo[w] = bool(known[_place(w)])
        return sorted(w for w in there if memo[w])
    return held


def _counted_by_task(keyed: DataFrame, start: Callable[[], Callable]) -> DataFrame:
    """(term, level, n, weight): in how many distinct texts a task has seen a term, their highest level and total weight.

    ``start`` runs once per task and returns a function from a key and its text to a level, a weight and
    words. A task may give a term more than once, each time for other texts.
    """
    def count(batches):
        let_go(all_kept=True)
        call, seen, counts, light, levels = start(), set(), Counter(), Counter(), {}
        rows = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([levels.get(t, 0) for t in counts], pa.int32()),
             pa.array(list(counts.values()), pa.int64()), pa.array([n - light[t] for t, n in counts.items()], pa.float64())],
            names=["term", "level", "n", "weight"])
        for batch in batches:
            for part in pieces(batch, "text"):
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    if key not in seen:
                        seen.add(key)
                        level, weight, found = call(key, text)
                        counts.update(found)
                        if weight < 1:
                            for w in found:
                                light[w] += 1 - weight
                        if level:
                            levels.update([(w, level) for w in found if levels.get(w, 0) < level])
                if len(counts) > HELD_WORDS:
                    yield rows()
                    for held in (counts, light, levels):
                        held.clear()
        yield rows()
        del call, seen, counts, light, levels
        let_go()

    return keyed.mapInArrow(count, "term string, level int, n long, weight double")


def term_spans(text: str, terms: list[str] | None, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Where the terms stand outside the spans already found."""
    if not terms:
        return []
    wanted = set(terms)
    return [(4, m.start(), m.end()) for m in free_words(text, taken) if m.group().lower() in wanted]


def _with_terms(docs: DataFrame, keep: list[str], flagged: DataFrame | None) -> DataFrame:
    """The columns ``keep`` and ``_llm_both``: the terms to look for, a line end and the text; null for a null text.

    Terms hold letters only. They are found by the hash of the text; the side that holds them is broadcast
    if it was counted to be small.
    """
    flagged = stable(disclosing(docs) if flagged is None else flagged)
    keyed = docs.select(*keep, docs["text"].alias("_llm_whole"),
                        F.md5(F.coalesce(docs["text"], F.lit(""))).alias("_llm_key"))
    terms = flagged.select(F.col("key").alias("_llm_key"), F.array_join("terms", " ").alias("_llm_terms"))
    both = F.concat(F.coalesce("_llm_terms", F.lit("")), F.lit("\n"), F.col("_llm_whole"))
    return attach(keyed, terms, ["_llm_key"], counted=flagged).select(*keep, both.alias("_llm_both"))


def _found(both: str | None) -> tuple[str | None, list[tuple[int, int, int]]]:
    if both is None:
        return None, []
    terms, text = both.split("\n", 1)
    base = base_spans(text)
    return text, base + term_spans(text, terms.split(), base)


def spans(docs: DataFrame, keep: list[str], flagged: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` and ``_llm_spans``: (kind, start, end) of the base kinds and the disclosing terms."""
    def find(texts):
        return [[[{"kind": k, "start": s, "end": e} for k, s, e in _found(t)[1]] for t in texts]]

    return map_texts(_with_terms(docs, keep, flagged), keep, "_llm_spans array<struct<kind:int,start:int,end:int>>",
                     lambda: find, "_llm_both")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every text."""
    found = spans(docs, ["doc_id"])
    name = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("_llm_spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("_llm_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("_llm_spans", line), ",").alias("spans"))


def replaced(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with a mark in place of each span; spans that overlap share the first one's mark."""
    if not found:
        return text
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """All documents with their columns; spans in the text are replaced and ``n_chars``, if there, is counted anew."""
    columns = [c for c in docs.columns if c != "text"]
    made = map_texts(_with_terms(docs, columns, flagged), columns, "text string",
                     lambda: lambda texts: [[replaced(*_found(t)) for t in texts]], "_llm_both")
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)
