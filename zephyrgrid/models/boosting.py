"""Boosted trees from histograms, for all groups and all settings at once.

A booster holds one ensemble per value of a key column (a plant group) and per setting (a loss with its parameters). All
ensembles grow one level of one tree together: each task sums gradient, curvature and rows per (ensemble, node, feature,
bin) over its rows and sends one row per feature; the sums of a feature meet in one task, which scans its bins for the best
split; the driver receives one candidate per ensemble, node and task. The number of jobs of a tree thus depends on its
depth only, not on groups, settings or rows.

Rows are written once as bin numbers (one byte a feature) with the running prediction of every setting beside them; trees
grown since then travel with the tasks, and the predictions are written anew every few rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid.session import ship, stable

ROWS = "model int, target double, side tinyint, bins binary, known binary"
TRAIN, VALID = 0, 1
SPLIT = "slot int, feature int, cut int, gain double, g double, h double, n double, gl double, hl double, nl double"
RESIDUAL_BINS = 4096
TASK_ROWS = 100_000  # rows of a task at least, so that its sums are fewer than its rows


@dataclass(frozen=True)
class Absolute:
    """Absolute error: the gradient is a sign, and leaves move to the median of what is left."""

    medians = True

    def steps(self, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.sign(error), np.ones_like(error)


@dataclass(frozen=True)
class Settlement:
    """The smoothed settlement loss, as :func:`functions.scalars.settlement_gradient`."""

    steepness: float = 40.0
    weight: float = 0.7
    medians = False

    def steps(self, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bells = curves = np.zeros_like(error)
        for edge, share in ((0.06, 1.0), (0.08, 3.0)):
            g = 1.0 / (1.0 + np.exp(-self.steepness * (np.abs(error) - edge)))
            bell = g * (1.0 - g)
            bells = bells + share * self.steepness * bell
            curves = curves + share * self.steepness ** 2 * bell * (1.0 - 2.0 * g)
        rest = 1.0 - self.weight
        gradient = np.sign(error) * (self.weight + bells * rest / 4.0)
        return gradient, np.maximum(np.abs(curves) * rest / 4.0, max(1e-2 * rest, 1e-6))


@dataclass
class Trees:
    """One tree per ensemble, as complete trees: (ensembles, nodes) of features (-1: leaf) and cuts, (ensembles, leaves) of values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, ensembles: int, depth: int) -> Trees:
        inner = 2 ** depth - 1
        return cls(np.full((ensembles, inner), -1, np.int32), np.zeros((ensembles, inner), np.int32),
                   np.zeros((ensembles, 2 ** depth)))

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def node(self, bins: np.ndarray, ensemble: np.ndarray, levels: int, swap: tuple[int, np.ndarray] | None = None) -> np.ndarray:
        """The node of each row after ``levels`` decisions; with ``swap`` one feature has other values."""
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(levels):
            at = 2 ** level - 1 + node
            feature = self.feature[ensemble, at]
            value = bins[row, np.maximum(feature, 0)]
            if swap is not None:
                value = np.where(feature == swap[0], swap[1], value)
            node = 2 * node + ((feature >= 0) & (value > self.cut[ensemble, at]))
        return node

    def step(self, bins: np.ndarray, ensemble: np.ndarray, swap: tuple[int, np.ndarray] | None = None) -> np.ndarray:
        return self.value[ensemble, self.node(bins, ensemble, self.depth, swap)]


def edges_of(train: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Cuts of each feature at quantiles of the train rows; a feature with few values is cut between all of them."""
    shares = [i / bins for i in range(1, bins)]
    found = train.select(*[F.col(c).cast("double") for c in columns]).approxQuantile(columns, shares, 0.25 / bins)
    return [np.unique(np.array(q, float)) if q else np.zeros(0) for q in found]


def binned(batch: pa.RecordBatch, columns: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of the features: 0 for a missing value, else 1 + the number of cuts below it."""
    out = np.zeros((batch.num_rows, len(columns)), np.uint8)
    for i, (name, cuts) in enumerate(zip(columns, edges)):
        value = batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = ~np.isnan(value)
        out[known, i] = 1 + np.searchsorted(cuts, value[known], side="left")
    return out


def _bytes(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


@dataclass
class Booster:
    """Settings of the growth; ``fit`` fills the rest.

    ``least_rows`` and ``least_curvature`` hold for both sides of a split. A row with a missing value goes to
    the lower side. ``key`` is null or unknown: the row is not learned from, and predicted as null. ``allowed`` names
    the features that a (group, setting) may test, where that is not all of them.
    """

    columns: list[str]
    target: str
    key: str = "group"
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    least_rows: int = 20
    least_curvature: float = 1e-3
    cut_every: int = 10
    allowed: dict[tuple[str, int], list[str]] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    losses: list = field(default_factory=list)
    trees: list[tuple[Trees, float]] = field(default_factory=list)
    history: list[np.ndarray] = field(default_factory=list)

    # --- rows -----------------------------------------------------------------
    def begin(self, train: DataFrame, valid: DataFrame | None = None) -> Booster:
        """Bins and medians of the train rows; train and validation rows written as bin numbers."""
        ship(train.sparkSession)
        if not 2 <= self.bins <= 250:
            raise ValueError("between 2 and 250 bins")
        self.checked = valid is not None
        starts = train.filter(F.col(self.key).isNotNull() & F.col(self.target).isNotNull()).groupBy(self.key).agg(
            F.percentile_approx(F.col(self.target).cast("double"), 0.5, 10_000).alias("middle"),
            F.max(F.abs(F.col(self.target).cast("double"))).alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # one row per group
        self.keys = sorted(r[self.key] for r in starts)
        self.edges = edges_of(train, self.columns, self.bins)
        self.start = np.array([r.middle for r in sorted(starts, key=lambda r: r[self.key])], float)
        self.reach = 2 * max([r.reach for r in starts], default=1.0) or 1.0
        self.gains = np.zeros((len(self.keys), len(self.columns)))
        wanted = [self.key, self.target, *self.columns]
        both = train.select(*wanted).withColumn("_side", F.lit(TRAIN))
        if valid is not None:
            both = both.unionByName(valid.select(*wanted).withColumn("_side", F.lit(VALID)))
        place = {k: i for i, k in enumerate(self.keys)}
        columns, edges, start, key, target = self.columns, self.edges, self.start, self.key, self.target

        def write(batches):
            for batch in batches:
                ensemble = np.array([place.get(k, -1) for k in batch.column(0).to_pylist()], np.int32)
                y = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x, keep = binned(batch, columns, edges), np.flatnonzero((ensemble >= 0) & ~np.isnan(y))
                side = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ensemble[keep]), pa.array(y[keep]), pa.array(side[keep].astype(np.int8)),
                     pa.array([v.tobytes() for v in x[keep]], pa.binary()),
                     pa.array([v.tobytes() for v in start[ensemble[keep]]], pa.binary())],
                    names=["model", "target", "side", "bins", "known"])
        self.parts = max(1, sum(r.n for r in starts) // TASK_ROWS)
        self.rows = stable(both.mapInArrow(write, ROWS).repartition(self.parts))
        self._written = 0
        return self

    def _reader(self):
        """A function from a batch to (bins, target, group, side, predictions per setting), with the trees not yet written."""
        width, settings = len(self.columns), max(len(self.losses), 1)
        fresh = self.trees[self._written:]

        def read(batch: pa.RecordBatch, until: int | None = None):
            x = _bytes(batch.column(3), np.uint8, width)
            group = batch.column(0).to_numpy(zero_copy_only=False)
            known = _bytes(batch.column(4), float, -1 if batch.num_rows else 1).copy()
            if known.shape[1] < settings:  # settings that have shared their past
                known = np.repeat(known, settings, axis=1)
            for trees, rate in fresh[:until]:
                for k in range(settings):
                    known[:, k] += rate * trees.step(x, group * settings + k)
            return x, batch.column(1).to_numpy(), group, batch.column(2).to_numpy(), known
        return read, fresh

    def _write(self) -> None:
        self.evaluate()
        if len(self.trees) == self._written:
            return
        read, _ = self._reader()

        def renew(batches):
            for batch in batches:
                known = read(batch)[-1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array([v.tobytes() for v in known], pa.binary())], names=batch.schema.names)
        self.rows = stable(self.rows.mapInArrow(renew, ROWS))
        self._written = len(self.trees)

    # --- growth ---------------------------------------------------------------
    def _splits(self, tree: Trees, level: int) -> dict[int, tuple]:
        """The best split of each (ensemble, node) of a level: one job."""
        read, _ = self._reader()
        losses, width, most = self.losses, len(self.columns), max(len(e) for e in self.edges) + 2
        settings, nodes = len(losses), 2 ** level
        slots = len(self.keys) * settings * nodes
        penalty, least_rows, least_curvature = self.penalty, self.least_rows, self.least_curvature
        may = np.ones((slots, width), bool)
        for (key, setting), names in self.allowed.items():
            if key in self.keys:
                at = (self.keys.index(key) * settings + setting) * nodes
                may[at:at + nodes] = [c in set(names) for c in self.columns]

        def add(batches):
            total = np.zeros((width, 3, slots * most))
            for batch in batches:
                x, y, group, side, known = read(batch)
                learn = side == TRAIN
                x, y, group, known = x[learn], y[learn], group[learn], known[learn]
                for k, loss in enumerate(losses):
                    ensemble = group * settings + k
                    slot = (ensemble * nodes + tree.node(x, ensemble, level)) * most
                    g, h = loss.steps(known[:, k] - y)
                    for f in range(width):
                        place = slot + x[:, f]
                        total[f, 0] += np.bincount(place, g, slots * most)
                        total[f, 1] += np.bincount(place, h, slots * most)
                        total[f, 2] += np.bincount(place, minlength=slots * most)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())],
                                             names=["feature", "sums"])

        def scan(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(value.as_buffer(), float)
                    sums[f] = sums[f] + part if f in sums else part
            best: dict[int, tuple] = {}
            for f in sorted(sums):
                g, h, n = sums[f].reshape(3, slots, most)
                left = [np.cumsum(v, axis=1) for v in (g, h, n)]
                gl, hl, nl = left
                ga, ha, na = (v[:, -1:] for v in left)
                open_ = (nl >= least_rows) & (na - nl >= least_rows) & (hl >= least_curvature) & (ha - hl >= least_curvature)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gl ** 2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga ** 2 / (ha + penalty)
                gain = np.where(open_ & may[:, f, None], gain, -np.inf)
                cut = gain.argmax(axis=1)
                for s in range(slots):
                    c = int(cut[s])
                    found = (float(gain[s, c]), -f, -c)
                    if s not in best or found > best[s][0]:
                        best[s] = found, (s, f, c, found[0], float(ga[s, 0]), float(ha[s, 0]), float(na[s, 0]),
                                          float(gl[s, c]), float(hl[s, c]), float(nl[s, c]))
            names = ["slot", "feature", "cut", "gain", "g", "h", "n", "gl", "hl", "nl"]
            kinds = [pa.int32()] * 3 + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*[r for _, r in best.values()]), kinds)]
                                             if best else [pa.array([], k) for k in kinds], names=names)

        sums = self.rows.select("model", "target", "side", "bins", "known").mapInArrow(add, "feature int, sums binary")
        found: dict[int, tuple] = {}
        whole = sums if self.parts == 1 else sums.repartition("feature")  # one task's sums are whole already
        for r in whole.mapInArrow(scan, SPLIT).collect():  # one row per slot and task
            rank = (r.gain, -r.feature, -r.cut)
            if r.slot not in found or rank > found[r.slot][0]:
                found[r.slot] = rank, r
        return {s: r for s, (_, r) in found.items()}

    def _medians(self, tree: Trees) -> np.ndarray:
        """The median of what is left in each leaf, to one part in ``RESIDUAL_BINS`` of the targets' range."""
        read, _ = self._reader()
        settings, leaves, reach = len(self.losses), tree.value.shape[1], self.reach
        slots = len(self.keys) * settings * leaves

        def add(batches):
            total = np.zeros(slots * RESIDUAL_BINS, np.int64)
            for batch in batches:
                x, y, group, side, known = read(batch)
                learn = side == TRAIN
                for k in range(settings):
                    ensemble = group[learn] * settings + k
                    slot = ensemble * leaves + tree.node(x[learn], ensemble, tree.depth)
                    share = (y[learn] - known[learn, k] + reach) / (2 * reach)
                    place = np.clip(share * RESIDUAL_BINS, 0, RESIDUAL_BINS - 1).astype(np.int64)
                    total += np.bincount(slot * RESIDUAL_BINS + place, minlength=len(total))
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["place", "n"])

        counted = self.rows.mapInArrow(add, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        table = np.zeros((slots, RESIDUAL_BINS))
        for r in counted.collect():  # at most RESIDUAL_BINS rows per leaf
            table[divmod(r.place, RESIDUAL_BINS)] = r.n
        upto = np.cumsum(table, axis=1)
        half = upto[:, -1:] / 2
        at = (upto >= np.maximum(half, 0.5)).argmax(axis=1)
        inside = np.take_along_axis(table, at[:, None], 1)[:, 0]
        before = np.take_along_axis(upto, at[:, None], 1)[:, 0] - inside
        middle = (at + (half[:, 0] - before) / np.maximum(inside, 1)) / RESIDUAL_BINS * 2 * reach - reach
        return np.where(upto[:, -1] > 0, middle, 0.0).reshape(-1, leaves)

    def _newton(self, g: float, h: float) -> float:
        return -g / (h + self.penalty) if h + self.penalty > 0 else 0.0

    def grow(self, rounds: int, losses: list, rate: float | None = None) -> Booster:
        """Add ``rounds`` trees to every ensemble; ``losses`` has one loss per setting."""
        if self.losses and len(losses) != len(self.losses):
            self._write()
        self.losses, rate = list(losses), self.rate if rate is None else rate
        ensembles = len(self.keys) * len(losses)
        for _ in range(rounds):
            tree = Trees.empty(ensembles, self.depth)
            value = {}
            for level in range(self.depth):
                found = self._splits(tree, level)
                for slot, r in found.items():
                    ensemble, node = divmod(slot, 2 ** level)
                    value[ensemble, level, node] = self._newton(r.g, r.h)
                    if not r.gain > 1e-12:
                        continue  # its rows stay together on the lower side
                    at = 2 ** level - 1 + node
                    tree.feature[ensemble, at], tree.cut[ensemble, at] = r.feature, r.cut
                    self.gains[ensemble // len(losses), r.feature] += r.gain
                    value[ensemble, level + 1, 2 * node] = self._newton(r.gl, r.hl)
                    value[ensemble, level + 1, 2 * node + 1] = self._newton(r.g - r.gl, r.h - r.hl)
            for ensemble in range(ensembles):
                for leaf in range(2 ** self.depth):
                    at = next(((level, leaf >> (self.depth - level)) for level in range(self.depth, -1, -1)
                               if (ensemble, level, leaf >> (self.depth - level)) in value), None)
                    tree.value[ensemble, leaf] = value[ensemble, *at] if at else 0.0
            if any(loss.medians for loss in losses):
                middle = self._medians(tree)
                for k, loss in enumerate(losses):
                    if loss.medians:
                        tree.value[k::len(losses)] = middle[k::len(losses)]
            self.trees.append((tree, rate))
            if len(self.trees) - self._written >= self.cut_every:
                self._write()
        return self

    def keep(self, settings: list[int]) -> Booster:
        """Go on with some of the settings only; their trees and predictions stay as they are."""
        self._write()
        now = len(self.losses)
        rows = [g * now + k for g in range(len(self.keys)) for k in settings]
        self.trees = [(Trees(t.feature[rows], t.cut[rows], t.value[rows]), rate) if len(t.value) == len(self.keys) * now else (t, rate)
                      for t, rate in self.trees]
        self.history = [h[:, settings] if h.shape[1] == now else h for h in self.history]
        self.losses = [self.losses[k] for k in settings]

        def pick(batches):
            for batch in batches:
                known = _bytes(batch.column(4), float, now)[:, settings] if batch.num_rows else []
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array([v.tobytes() for v in known], pa.binary())], names=batch.schema.names)
        self.rows = stable(self.rows.mapInArrow(pick, ROWS))
        return self

    # --- validation -----------------------------------------------------------
    def evaluate(self) -> None:
        """Absolute validation error after each round since the last call: running sums, one aggregation."""
        read, fresh = self._reader()
        groups, settings = len(self.keys), max(len(self.losses), 1)
        if not self.checked:
            return
        done = len(self.history) - self._written  # rounds of the unwritten ones that are known
        if done >= len(fresh):
            return

        def add(batches):
            total = np.zeros((len(fresh), groups, settings))
            rows = np.zeros(groups)
            for batch in batches:
                x, y, group, side, known = read(batch, 0)
                look = side == VALID
                x, y, group, known = x[look], y[look], group[look], known[look]
                rows += np.bincount(group, minlength=groups)
                for t, (trees, rate) in enumerate(fresh):
                    for k in range(settings):
                        known[:, k] += rate * trees.step(x, group * settings + k)
                        total[t, :, k] += np.bincount(group, np.abs(known[:, k] - y), groups)
            cells = [(t, g, k, total[t, g, k], rows[g]) for t in range(done, len(fresh)) for g in range(groups) for k in range(settings)]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*cells), (
                pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["t", "g", "k", "e", "n"])

        sums = self.rows.mapInArrow(add, "t int, g int, k int, e double, n double").groupBy("t", "g", "k").agg(
            F.sum("e").alias("e"), F.sum("n").alias("n"))
        made = np.full((len(fresh), groups, settings), np.nan)
        for r in sums.collect():  # rounds x ensembles
            made[r.t, r.g, r.k] = r.e / r.n if r.n else np.nan
        self.history += list(made[done:])

    def best_rounds(self, first: int = 0) -> np.ndarray:
        """(groups, settings): the number of trees with the least validation error, the earliest of equals, counted from ``first``."""
        self.evaluate()
        table = np.stack(self.history[first:])
        table = np.where(np.isnan(table), np.inf, table)
        return first + 1 + table.argmin(axis=0)

    def fit(self, train: DataFrame, valid: DataFrame | None = None, rounds: int = 100, patience: int | None = None,
            loss=Absolute()) -> Booster:
        """Grow up to ``rounds`` trees; with validation rows stop once no group has improved for ``patience`` rounds.

        Every group keeps its trees up to its own best round.
        """
        self.begin(train, valid)
        while len(self.trees) < rounds:
            self.grow(min(self.cut_every, rounds - len(self.trees)), [loss])
            if valid is not None and patience is not None and (len(self.trees) - self.best_rounds() >= patience).all():
                break
        self.best = self.best_rounds()[:, 0] if valid is not None else np.full(len(self.keys), len(self.trees))
        return self

    def fit_settings(self, train: DataFrame, valid: DataFrame, settings: int, rounds: int = 100, patience: int | None = 80,
                     loss=Absolute()) -> np.ndarray:
        """As :meth:`fit` for settings that differ in ``allowed`` only; gives the best rounds per (group, setting)."""
        self.begin(train, valid)
        while len(self.trees) < rounds:
            self.grow(min(self.cut_every, rounds - len(self.trees)), [loss] * settings)
            if patience is not None and (len(self.trees) - self.best_rounds() >= patience).all():
                break
        return self.best_rounds()

    # --- use ------------------------------------------------------------------
    def _upto(self, ensemble_rounds: np.ndarray | None) -> np.ndarray:
        return np.full(len(self.keys), len(self.trees)) if ensemble_rounds is None else ensemble_rounds

    def predictor(self, setting: int = 0, rounds: np.ndarray | None = None):
        """A function from bins and groups to predictions, with the best trees of each group or ``rounds`` of them."""
        upto = self._upto(getattr(self, "best", None) if rounds is None else rounds)
        start, trees, groups = self.start, self.trees, len(self.keys)

        def predict(x: np.ndarray, group: np.ndarray) -> np.ndarray:
            out = start[group].copy()
            for t, (tree, rate) in enumerate(trees):
                settings = len(tree.value) // groups
                out += np.where(t < upto[group], rate * tree.step(x, group * settings + min(setting, settings - 1)), 0.0)
            return out
        return predict

    def transform(self, df: DataFrame, out: str = "prediction", setting: int = 0, rounds: np.ndarray | None = None) -> DataFrame:
        """All columns of ``df`` and the prediction; null where the group is not known."""
        ship(df.sparkSession)
        predict, columns, edges, key = self.predictor(setting, rounds), self.columns, self.edges, self.key
        place = {k: i for i, k in enumerate(self.keys)}
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

        def run(batches):
            for batch in batches:
                group = np.array([place.get(k, -1) for k in batch.column(batch.schema.get_field_index(key)).to_pylist()], np.int64)
                made, known = np.full(batch.num_rows, np.nan), group >= 0
                if known.any():
                    made[known] = predict(binned(batch, columns, edges)[known], group[known])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, mask=~known)], names=schema.names)
        return df.mapInArrow(run, schema)

    def transform_settings(self, df: DataFrame, out: str = "predictions") -> DataFrame:
        """All columns of ``df`` and an array of the predictions of all settings, with all trees."""
        ship(df.sparkSession)
        whole = np.full(len(self.keys), len(self.trees))
        predict = [self.predictor(k, whole) for k in range(max(len(self.losses), 1))]
        columns, edges, key, place = self.columns, self.edges, self.key, {k: i for i, k in enumerate(self.keys)}
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches):
            for batch in batches:
                group = np.array([place.get(k, -1) for k in batch.column(batch.schema.get_field_index(key)).to_pylist()], np.int64)
                known = np.flatnonzero(group >= 0)
                x, made = binned(batch, columns, edges)[known], [None] * batch.num_rows
                for i, values in zip(known, np.stack([p(x, group[known]) for p in predict], 1).tolist()):
                    made[i] = values
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=schema.names)
        return df.mapInArrow(run, schema)

    def energy(self, df: DataFrame, capacity: str | Column = "capacity", out: str = "pred", **options) -> DataFrame:
        """Predicted utilisation as energy within the capacity."""
        value = F.col("prediction")
        bounded = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
        return self.transform(df, **options).withColumn(out, bounded * (F.col(capacity) if isinstance(capacity, str) else capacity)).drop(
            "prediction")

    def gain_shares(self) -> dict[str, dict[str, float]]:
        """Per group the share of each feature in the gain of all splits."""
        whole = np.maximum(self.gains.sum(axis=1, keepdims=True), 1e-300)
        return {k: dict(zip(self.columns, row.tolist())) for k, row in zip(self.keys, self.gains / whole)}

    def used(self) -> dict[str, set[str]]:
        """Per group the features that some split of its ensembles tests."""
        out: dict[str, set[str]] = {k: set() for k in self.keys}
        for t, (tree, _) in enumerate(self.trees):
            settings = len(tree.value) // len(self.keys)
            for i, k in enumerate(self.keys):
                if t < self._upto(getattr(self, "best", None))[i]:
                    out[k] |= {self.columns[f] for f in np.unique(tree.feature[i * settings:(i + 1) * settings]) if f >= 0}
        return out

    def swap_effects(self, paired: DataFrame, other: str = "other") -> dict[str, dict[str, float]]:
        """Per group the mean absolute change of the prediction when one feature comes from another row.

        ``paired`` holds the key, the features and a struct ``other`` with some or all of those of the other row. Only trees that
        test a feature are walked again for it, and only by rows whose value changes: the work is rows times
        the features that each tree tests. A feature that no tree tests has no effect.
        """
        ship(paired.sparkSession)
        columns, edges, groups, trees = self.columns, self.edges, len(self.keys), self.trees
        held = set(paired.schema[other].dataType.names)
        swapped = [i for i, c in enumerate(columns) if c in held]
        upto = self._upto(getattr(self, "best", None))
        place = {k: i for i, k in enumerate(self.keys)}
        flat = paired.select(self.key, *columns, *[F.col(f"{other}.`{columns[i]}`").alias(f"_other_{i}") for i in swapped])

        def add(batches):
            total, rows = np.zeros((groups, len(columns))), np.zeros(groups)
            for batch in batches:
                group = np.array([place.get(k, -1) for k in batch.column(0).to_pylist()], np.int64)
                keep = group >= 0
                x = binned(batch, columns, edges)[keep]
                o = x.copy()  # features that are not swapped
                o[:, swapped] = binned(batch, [f"_other_{i}" for i in swapped], [edges[i] for i in swapped])[keep]
                group = group[keep]
                rows += np.bincount(group, minlength=groups)
                moved: dict[int, np.ndarray] = {}
                for t, (tree, rate) in enumerate(trees):
                    settings = len(tree.value) // groups
                    live = t < upto[group]
                    own = tree.step(x, group * settings)
                    for f in np.unique(tree.feature[::settings]):
                        tests = (tree.feature[::settings] == f).any(axis=1)[group] & live if f >= 0 else live[:0]
                        if not tests.any():
                            continue
                        at = np.flatnonzero(tests & (x[:, f] != o[:, f]))
                        new = tree.step(x[at], group[at] * settings, (f, o[at, f]))
                        moved.setdefault(int(f), np.zeros(len(x)))[at] += rate * (new - own[at])
                for f, change in moved.items():
                    total[:, f] += np.bincount(group, np.abs(change), groups)
            cells = [(g, f, total[g, f], rows[g]) for g in range(groups) for f in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*cells), (
                pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["g", "f", "e", "n"])

        sums = flat.mapInArrow(add, "g int, f int, e double, n double").groupBy("g", "f").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
        out = {k: dict.fromkeys(columns, 0.0) for k in self.keys}
        for r in sums.collect():  # groups x features
            out[self.keys[r.g]][columns[r.f]] = r.e / r.n if r.n else 0.0
        return out


def settlement_booster(train: DataFrame, valid: DataFrame | None, columns: list[str], target: str, warmup: int = 10, steps: int = 10,
                       patience: int | None = 80, settings: list[Settlement] = (Settlement(),), least_curvature: float = 0.05,
                       **options) -> Booster:
    """Trees on absolute error first, then Newton steps on the settlement loss, for every group and setting.

    Settings share the warm-up. With validation rows a group keeps its best round after the warm-up.
    """
    model = Booster(columns, target, **options).begin(train, valid)
    model.grow(warmup, [Absolute()])
    model.least_curvature = least_curvature
    while len(model.trees) < warmup + steps:
        model.grow(min(model.cut_every, warmup + steps - len(model.trees)), list(settings))
        if valid is not None and patience is not None and (len(model.trees) - model.best_rounds(warmup) >= patience).all():
            break
    if valid is not None and len(settings) == 1:
        model.best = model.best_rounds(warmup)[:, 0]
    return model
