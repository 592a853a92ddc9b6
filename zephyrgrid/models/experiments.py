"""Feature variants, experiment grids, searches and gates."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid.models import boosting as Bo
from zephyrgrid.models import regress as R
from zephyrgrid.models import selection as Se
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators import stats
from zephyrgrid.session import stable, together


def median_fill(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """The median of each column, 0 for one without values."""
    found = stats.as_dict(stats.medians(train, columns))
    return {c: found[c][0] if c in found else 0.0 for c in columns}


class Variant:
    """Fitted on train rows only: median fill, then a choice or compression of features."""

    def __init__(self, threshold: float = 0.95, variance: float = 0.95, keep_ratio: float = 0.35,
                 minimum: int = 8, trees: int = 200, seed: int = 42):
        self.threshold, self.variance, self.keep_ratio = threshold, variance, keep_ratio
        self.minimum, self.trees, self.seed = minimum, trees, seed

    def fit(self, train: DataFrame, columns: list[str], target: str, fill: dict[str, float] | None = None) -> Variant:
        """``fill`` holds the medians of the train rows where they are known already."""
        self.fill = median_fill(train, columns) if fill is None else fill
        self.columns = self.choose(stats.impute(train, self.fill), columns, target)
        return self

    def choose(self, filled: DataFrame, columns: list[str], target: str) -> list[str]:
        return list(columns)

    def transform(self, df: DataFrame) -> DataFrame:
        return stats.impute(df, self.fill)


class CorrelationFiltered(Variant):
    def choose(self, filled, columns, target):
        return Se.drop_correlated(filled, columns, self.threshold)


class TreeImportance(Variant):
    def choose(self, filled, columns, target):
        self.importance = R.forest_importance(filled, columns, target, self.trees, seed=self.seed)
        return Se.top_features(self.importance, self.keep_ratio, self.minimum)


class Compressed(Variant):
    def choose(self, filled, columns, target):
        self.parts = Se.PrincipalParts(self.variance).fit(filled, columns)
        return self.parts.names

    def transform(self, df):
        rest = [c for c in df.columns if c not in self.fill]
        return self.parts.transform(stats.impute(df, self.fill), rest)


VARIANTS = {"all": Variant, "corr_filtered": CorrelationFiltered, "pca": Compressed, "tree_importance": TreeImportance}


def make_variant(name: str, **options) -> Variant:
    key = name.strip().lower()
    if key not in VARIANTS:
        raise ValueError(f"unknown variant {name}; known: {sorted(VARIANTS)}")
    return VARIANTS[key](**options)


def fitted_variants(train: DataFrame, groups: list[str], columns: list[str], target: str, variants: dict[str, dict],
                    workers: int = 4) -> dict[tuple[str, str], Variant]:
    """Each variant fitted on the train rows of each group; fits are independent jobs, so a few are in flight at once.

    The variants of a group share its medians.
    """
    own = lambda group: train.filter(F.col("group") == group)
    with ThreadPoolExecutor(workers) as pool:
        fills = dict(zip(groups, pool.map(lambda g: median_fill(own(g), columns), groups)))

        def one(task: tuple[str, str]) -> Variant:
            group, name = task
            return make_variant(name, **variants[name]).fit(own(group), columns, target, dict(fills[group]))
        tasks = [(g, v) for g in groups for v in variants]
        return dict(zip(tasks, pool.map(one, tasks)))


MODELS = ("trees", "kernel")
RESULTS = """group string, model_version string, feature_version string, n_features bigint, nmae double, ficr double, score double,
    mae double, rmse double"""


def experiment_matrix(data: DataFrame, groups: list[str], columns: list[str], target: str, variants: dict[str, dict],
                      models: list[str], workers: int = 4, rounds: int = 100, patience: int | None = 80, **booster) -> DataFrame:
    """One result row per group, variant and model.

    ``data`` holds group, split (train or valid), the columns, target (utilisation), actual and capacity. The boosted trees of all
    groups and variants grow together, as ensembles that may test the features of their variant only.
    """
    if set(models) - set(MODELS):
        raise ValueError(f"unknown models; known: {MODELS}")
    spark = data.sparkSession
    fitted = fitted_variants(data.filter("split = 'train'"), groups, columns, target, variants, workers)
    keep = ["group", "split", "actual", "capacity", target]

    def row(group, model, name, s):
        return group, model, name, len(fitted[group, name].columns), s["nmae"], s["ficr"], s["score"], s["mae"], s["rmse"]

    def trees() -> list[tuple]:
        wide, names = None, list(columns)
        for group in groups:
            part = data.filter(F.col("group") == group).select(*keep, *columns)
            ready = Variant.transform(fitted[group, next(iter(variants))], part)
            for v in variants:
                # compressed parts stand beside the columns they come from
                extra = [c for c in fitted[group, v].columns if c not in columns]
                if extra:
                    ready = fitted[group, v].parts.transform(ready, ready.columns)
                    names += [c for c in extra if c not in names]
            wide = ready if wide is None else wide.unionByName(ready, allowMissingColumns=True)
        wide = stable(wide)
        model = Bo.Booster(names, target, allowed={(g, k): fitted[g, v].columns for g in groups for k, v in enumerate(variants)}, **booster)
        best = model.fit_settings(wide.filter("split = 'train'"), wide.filter("split = 'valid'"), len(variants), rounds, patience)
        valid = wide.filter("split = 'valid'")
        made = []
        for k, v in enumerate(variants):
            summary = M.group_summary(model.energy(valid, setting=k, rounds=best[:, k]), ["group"])
            made += [row(s["group"], "trees", v, s) for s in summary.collect()]  # one row per group
        return made

    def kernel(task: tuple[str, str]) -> tuple:
        group, name = task
        rows, variant = data.filter(F.col("group") == group), fitted[task]
        ready = variant.transform(rows.select(*keep, *columns))
        line = R.KernelBaseline(variant.columns, target).fit(ready.filter("split = 'train'"))
        scored = R.predicted(line, ready.filter("split = 'valid'"), variant.columns)
        return row(group, "kernel", name, M.group_summary(scored, ["group"]).first())

    # the trees grow while the lines are fitted
    jobs = {"trees": trees} if "trees" in models else {}
    jobs |= {task: lambda task=task: [kernel(task)] for task in fitted} if "kernel" in models else {}
    out = [r for rows in together(spark, jobs, workers).values() for r in rows]
    return spark.createDataFrame(out, RESULTS)


def normal_noise(index: int, identity: list[str], seed: int = 42) -> Column:
    """A normal value from the hash of the row's identity, the same however rows are partitioned."""
    part = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(index), F.lit(k), *identity), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.sqrt(F.log(part(0)) * -2.0) * F.cos(part(1) * (2 * math.pi))


def swapped_importance(model: Bo.Booster, df: DataFrame, identity: list[str], seed: int = 42) -> dict[str, dict[str, float]]:
    """Per group the mean effect on predictions when a feature comes from another row of the group.

    Only features that some tree tests are paired and swapped; the others have no effect.
    """
    tested = [c for c in model.columns if any(c in names for names in model.used().values())]
    if not tested:
        return {k: dict.fromkeys(model.columns, 0.0) for k in model.keys}
    paired = Se.shuffled_partner(df.select(*dict.fromkeys([model.key, *identity, *model.columns])), tested, identity, seed, [model.key])
    return model.swap_effects(paired)


def noise_floor_importance(train: DataFrame, valid: DataFrame, columns: list[str], target: str, identity: list[str],
                           noise: int = 3, seed: int = 42, rounds: int = 100, **booster) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Per group the importance next to random columns, and the best importance a random column reached."""
    names = [f"noise_{i}" for i in range(noise)]
    add = lambda df: df.withColumns({n: normal_noise(i, identity, seed) for i, n in enumerate(names)})
    model = Bo.Booster([*columns, *names], target, **booster).fit(add(train), rounds=rounds)
    found = swapped_importance(model, add(valid), identity, seed)
    return ({g: {c: found[g][c] for c in columns} for g in found}, {g: max(found[g][n] for n in names) for g in found})


def search_settlement(tune: DataFrame, audit: DataFrame, train: DataFrame, columns: list[str], target: str, draws: int = 20,
                      seed: int = 42, warmup: int = 10, steps: int = 10, halve_every: int = 3, **booster) -> DataFrame:
    """Random (steepness, weight) draws per group; the best on the tune half is judged on the audit half.

    All draws share the warm-up and advance together, one setting each. After every ``halve_every`` steps a draw
    goes on only if it is in the better half of some group, so the number of jobs does not grow with the draws.
    """
    rng = np.random.default_rng(seed)
    drawn = [(float(rng.uniform(10, 100)), float(rng.uniform(0.5, 0.95))) for _ in range(draws)]
    model = Bo.settlement_booster(train, None, columns, target, warmup, 0, None, [], **booster)
    alive, done, scores = list(range(draws)), 0, {}
    model.grow(min(halve_every, steps), [Bo.Settlement(*d) for d in drawn])
    while True:
        done = len(model.trees) - warmup
        scores = setting_scores(model, tune)
        if done >= steps:
            break
        wanted = set()
        for g in model.keys:
            order = sorted(range(len(alive)), key=lambda k: (-scores[g, k], k))
            wanted |= set(order[:max(1, math.ceil(len(alive) / 2))])
        if len(wanted) < len(alive):
            model.keep(sorted(wanted))
            alive = [alive[k] for k in sorted(wanted)]
        model.grow(min(halve_every, steps - done), model.losses)
    audited = setting_scores(model, audit)
    rows = []
    for g in model.keys:
        best = max(range(len(alive)), key=lambda k: (scores[g, k], -k))  # the first of equal scores
        rows += [(g, *drawn[alive[k]], float(scores[g, k]), k == best, float(audited[g, k]) if k == best else None)
                 for k in range(len(alive))]
    return tune.sparkSession.createDataFrame(
        rows, "group string, steepness double, weight double, tune_score double, chosen boolean, audit_score double")


def setting_scores(model: Bo.Booster, df: DataFrame) -> dict[tuple[str, int], float]:
    """The score of every group and setting, in one aggregation."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("col")))
    cells = model.transform_settings(df).select("group", "actual", "capacity", F.posexplode("predictions")).withColumn(
        "pred", value * F.col("capacity"))
    return {(r["group"], r["pos"]): r["score"] for r in M.group_summary(cells, ["group", "pos"]).collect()}  # groups x settings


def feature_gate(train: DataFrame, valid: DataFrame, base: list[str], extra: list[str], target: str, gain: float = 0.005,
                 rounds: int = 100, patience: int | None = 80, **booster) -> DataFrame:
    """Scores per group without and with the extra features; they are adopted for a clear gain only.

    Both ensembles grow together; one may not test the extra features.
    """
    groups = sorted(r[0] for r in train.select("group").distinct().collect())  # plant groups
    model = Bo.Booster([*base, *extra], target, allowed={(g, 0): base for g in groups}, **booster)
    best = model.fit_settings(train, valid, 2, rounds, patience)
    scores = [{r["group"]: r["score"] for r in M.group_summary(model.energy(valid, setting=k, rounds=best[:, k]), ["group"]).collect()}
              for k in (0, 1)]
    rows = [(g, float(scores[0][g]), float(scores[1][g]), scores[1][g] - scores[0][g] >= gain) for g in scores[0]]
    return train.sparkSession.createDataFrame(rows, "group string, score_before double, score_after double, adopt boolean")


def gain_table(data: DataFrame, columns: list[str], target: str, top: int = 20, rounds: int = 100, **booster) -> DataFrame:
    """Importance share per group side by side, the mean over groups, largest first."""
    shares = Bo.Booster(columns, target, **booster).fit(data, rounds=rounds).gain_shares()
    groups = list(shares)
    rows = [(c, *[shares[g][c] for g in groups], float(np.mean([shares[g][c] for g in groups]))) for c in columns]
    schema = "feature string, " + ", ".join(f"{g} double" for g in groups) + ", mean_share double"
    return data.sparkSession.createDataFrame(rows, schema).orderBy(F.col("mean_share").desc(), "feature").limit(top)
