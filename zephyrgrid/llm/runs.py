"""Periodic runs of words: a suffix automaton whose link paths are recoloured at every appended word.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; those of at
least ``LEAST`` words and ``POWER`` periods are found, so that a page that repeats a line, or a generator that got
stuck, can be collapsed to one period.

Words are appended to a suffix automaton. Every state knows where its words last ended; states of one path of suffix links
with the same last end form a segment, held in a splay tree. An appended word walks from its own state to the start,
segment by segment, and gives the whole path the new end (the access of a link-cut tree). A segment whose words
last ended at ``j`` and now end at ``i`` has period ``i - j``; if its longest words are at least as long as that, they
and the period before them are a square or more. Its left end cannot be moved further left, its period is the smallest, and
the last word at which it is seen is its right end.

Before that, words that cannot lie in any run are cut away: each three consecutive words of a run occur in it
``POWER - 1`` times or more, so only unbroken stretches of such triples go to the automaton, each alone. A run lies in one
stretch together with the words that would extend it.

Defined cases: a null text has no words, no runs and collapses to the empty text. A text is read whole, in one
task; a stretch of a text takes about a kilobyte a word while it is searched. Repeated rows and rows without an id are
each treated on their own. Other columns stay out. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid.llm.texts import map_texts
from zephyrgrid.llm.words import flat_words, numbered, owners

LEAST, POWER = 6, 4
RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def repetitions(words: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    # automaton: length of the longest words of a state, suffix link, transitions; state 0 is the start
    size, link, to = [0], [-1], [{}]
    # splay trees over the segments of link paths: 0 is none; ``seen`` counts at the root of a tree only
    left, right, up, seen = [0], [0], [0], [-1]

    def state(length: int, target: int, moves: dict) -> int:
        for column, value in ((size, length), (link, target), (to, moves), (left, 0), (right, 0), (up, 0), (seen, -1)):
            column.append(value)
        return len(size) - 1

    def inner(x: int) -> bool:
        above = up[x]
        return above != 0 and (left[above] == x or right[above] == x)

    def rotate(x: int) -> None:
        above = up[x]
        top = up[above]
        if inner(above):
            if left[top] == above:
                left[top] = x
            else:
                right[top] = x
        else:
            seen[x] = seen[above]
        if left[above] == x:
            middle = left[above] = right[x]
            right[x] = above
        else:
            middle = right[above] = left[x]
            left[x] = above
        if middle:
            up[middle] = above
        up[above], up[x] = x, top

    def splay(x: int) -> None:
        while inner(x):
            above = up[x]
            if inner(above):
                rotate(above if (left[above] == x) == (left[up[above]] == above) else x)
            rotate(x)

    found: dict[tuple[int, int], int] = {}
    whole = 0
    for at, word in enumerate(words):
        new = state(at + 1, 0, {})
        x, whole = whole, new
        while x >= 0 and word not in to[x]:
            to[x][word] = new
            x = link[x]
        if x >= 0:
            held = to[x][word]
            if size[held] > size[x] + 1:
                # the shorter words of the state part from it; they ended last where it did
                twin = state(size[x] + 1, link[held], dict(to[held]))
                while x >= 0 and to[x].get(word) == held:
                    to[x][word] = twin
                    x = link[x]
                splay(held)
                left[twin] = left[held]
                if left[held]:
                    up[left[held]] = twin
                left[held], up[twin], link[held] = twin, held, twin
                held = twin
            link[new] = up[new] = held
        x, below = new, 0
        while x:
            splay(x)
            if right[x]:
                seen[right[x]] = seen[x]
            right[x] = below
            if seen[x] >= 0:
                period = at - seen[x]
                if size[x] >= (power - 1) * period and size[x] + period >= least:
                    found[at - size[x] - period + 1, period] = at
            below, x = x, up[x]
        seen[below] = at
    return [(start, end - start + 1, period) for (start, period), end in sorted(found.items())]


def stretches(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Begin and end of the unbroken stretches of words in which runs may lie, over many texts at once."""
    times = min(power - 1, max(least, power) - 2)
    if times < 2 or least < 3:
        return [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b - a >= least]
    if len(codes) < 3:
        return []
    text = owners(bounds)
    pairs, _ = numbered(codes[:-1] * (codes.max() + 1) + codes[1:])
    triples, kinds = numbered(pairs[:-1] * (codes.max() + 1) + codes[2:])
    keys, _ = numbered(text[:-2] * len(kinds) + triples)
    inside = text[:-2] == text[2:]
    often = inside & (np.bincount(keys[inside], minlength=keys.max() + 1)[keys] >= times)
    # a change of text breaks a stretch, as its last two words begin no triple
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    return [(a, b + 2) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least - 2]


def collapse_batch(texts: list[str | None], least: int = LEAST, power: int = POWER) -> tuple[list, list]:
    """The runs of each text, and the text without what repeats."""
    split = [t.encode().split() if t else [] for t in texts]
    _, codes, bounds = flat_words(split)
    runs: list[list[dict]] = [[] for _ in texts]
    for begin, end in stretches(codes, bounds, least, power):
        text = int(np.searchsorted(bounds, begin, "right")) - 1
        offset = begin - int(bounds[text])
        runs[text] += [{"start": offset + start, "length": length, "period": period}
                       for start, length, period in repetitions(codes[begin:end].tolist(), least, power)]
    collapsed = []
    for words, own in zip(split, runs):
        if own:
            kept = np.ones(len(words), bool)
            for r in own:
                kept[r["start"] + r["period"]:r["start"] + r["length"]] = False
            words = [words[i] for i in np.flatnonzero(kept)]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def collapse(docs: DataFrame, keep: list[str], least: int = LEAST, power: int = POWER, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``runs``, by start and period, and ``collapsed``.

    Words are the stretches between space, tab and line ends of any kind. ``collapsed`` drops each word that a
    run contains after its first period, and joins the others by one space.
    """
    return map_texts(docs, keep, RUNS, lambda: lambda texts: collapse_batch(texts, least, power), text)


def repeat_some(text: Column, doc_id: Column) -> Column:
    """The text of every tenth id by hash with its words, from one on, replaced by repeats of the first of them."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, h = F.size(words), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    begin = (g % n).cast("int")
    period = (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), F.ceil((n - begin) / period).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(cycle, F.lit(1), n - begin)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every text, some of them edited."""
    found = collapse(docs.select("doc_id", repeat_some(F.col("text"), F.col("doc_id")).alias("text")), ["doc_id"])
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"),
                                                              (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
