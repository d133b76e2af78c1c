"""Tree ensembles per group, fitted and applied inside grouped tasks.

The ML library fits one ensemble after another and one level of one tree per job, which for
thousands of trees and many (property, fold) pairs is days of scheduling.  Here every pair is one group of a
grouped map, so all pairs fit at the same time with all their trees.  All labelled rows teach: those of equal
features are one entry with their number and their mean, which is all that least squares asks of them, so a group holds
combinations of features and not rows.  Where there are too many combinations, features are cut at quantiles of all
rows, as histograms do.  Fitted ensembles are rows of a table; they meet the rows to predict in a
cogroup whose groups are salted to a bounded number of rows, so neither side passes the driver.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.plans.joins import BROADCAST_ROWS, bounded
from coobs.plans.quantiles import exact_quantiles
from coobs.session import cut_lineage

#: Rows of a property up to which each teaches by itself (beyond, equal ones together), and distinct rows that one task predicts.
TEACH_ROWS, ASK_ROWS = 20_000, 100_000
BINS = 255
#: Numbers (entries times features) that a group's task holds, and parts into which equal rows are dealt where trees see a share of the rows.
CELL_VALUES = 2_000_000
BAGS = {"gbt": 10}
#: Nodes of an ensemble in one row of the table; a larger one is several rows.
PART_NODES = 2_000_000

TIER_SMALL, TIER_MID = 400, 1500
# Capacity by training rows (iterations, depth, rows per leaf; trees, rows per leaf).
BOOSTED = {"small": (900, 4, 5), "mid": (1100, 5, 8), "large": (1200, 6, 10)}
FOREST = {"small": (600, 2), "mid": (600, 1), "large": (600, 1)}
META = (200, 3, 5)


def tier(n_rows: int) -> str:
    if n_rows < TIER_SMALL:
        return "small"
    return "mid" if n_rows < TIER_MID else "large"


class Trees:
    """Nodes of an ensemble in arrays; a leaf has feature -1.  The prediction is ``base`` plus the sum of leaves."""

    def __init__(self, base: float):
        self.base, self.roots, self.parts, self.size = base, [], [], 0

    def add(self, feature, threshold, left, value) -> None:
        """A tree whose children are numbered within it; the right child follows the left one."""
        self.roots.append(self.size)
        self.parts.append((feature, threshold, np.where(left >= 0, left + self.size, -1), value))
        self.size += len(feature)

    def blobs(self) -> list[bytes]:
        """The ensemble in pieces of about ``PART_NODES`` nodes; the first one has the base."""
        out, lo = [], 0
        while lo < len(self.parts) or not out:
            hi, nodes = lo, 0
            while hi < len(self.parts) and (hi == lo or nodes + len(self.parts[hi][0]) <= PART_NODES):
                nodes += len(self.parts[hi][0])
                hi += 1
            start = self.roots[lo] if lo < len(self.roots) else 0
            columns = [np.concatenate(c) if c else np.zeros(0) for c in zip(*self.parts[lo:hi])] or [np.zeros(0)] * 4
            held = io.BytesIO()
            np.savez(
                held, base=self.base if lo == 0 else 0.0, roots=np.array(self.roots[lo:hi], np.int64) - start, feature=columns[0].astype(np.int32),
                threshold=columns[1].astype(np.float64), left=np.where(columns[2] >= 0, columns[2] - start, -1).astype(np.int32), value=columns[3].astype(np.float32),
            )
            out.append(held.getvalue())
            lo = max(hi, lo + 1)
        return out


def applied(blob: bytes, x: np.ndarray) -> np.ndarray:
    """Sum of the leaves that each row reaches, and the base.  Equal rows are walked once."""
    m = np.load(io.BytesIO(blob))
    distinct, inverse = np.unique(x, axis=0, return_inverse=True)
    feature, threshold, left, value = (m[c] for c in ("feature", "threshold", "left", "value"))
    total, row = np.full(len(distinct), float(m["base"])), np.arange(len(distinct))
    for root in m["roots"]:
        node = np.full(len(distinct), root)
        while True:
            f = feature[node]
            if (f < 0).all():
                break
            down = left[node] + (distinct[row, np.maximum(f, 0)] > threshold[node])
            node = np.where(f < 0, node, down)
        total += value[node]
    return total[inverse.reshape(-1)]


class Grower:
    """One tree, level by level; a subclass proposes the splits of all open nodes at once."""

    def __init__(self, x: np.ndarray, leaf: int, w: np.ndarray):
        self.x, self.leaf, self.w = x, leaf, w

    def propose(self, target, node, rows, n_open):
        """(gain, feature, threshold) per open node; ``node`` numbers the open node of each of ``rows``."""
        raise NotImplementedError

    def grow(self, target: np.ndarray, used: np.ndarray, depth: int | None, scale: float):
        """(feature, threshold, left, value) arrays and each row's leaf; values are scaled node means."""
        n = len(self.x)
        at = np.zeros(n, np.int64)  # node of every row, also of those that do not teach
        feature, threshold, left = [np.array([-1])], [np.zeros(1)], [np.array([-1])]
        lo, hi, level = 0, 1, 0
        while hi > lo and (depth is None or level < depth):
            rows = used[at[used] >= lo]
            gain, f, t = self.propose(target, at[rows] - lo, rows, hi - lo)
            split = gain > 1e-12
            child = hi + 2 * (np.cumsum(split) - 1)
            feature[-1], threshold[-1], left[-1] = np.where(split, f, -1), np.where(split, t, 0.0), np.where(split, child, -1)
            move = np.flatnonzero(at >= lo)
            o = at[move] - lo
            move, o = move[split[o]], o[split[o]]
            at[move] = child[o] + (self.x[move, f[o]] > t[o])
            lo, hi, level = hi, hi + 2 * int(split.sum()), level + 1
            feature.append(np.full(hi - lo, -1))
            threshold.append(np.zeros(hi - lo))
            left.append(np.full(hi - lo, -1))
        size = hi
        w = self.w[used]
        n_leaf = np.bincount(at[used], w, size)
        value = np.bincount(at[used], w * target[used], size) / np.maximum(n_leaf, 1) * scale
        return np.concatenate(feature)[:size], np.concatenate(threshold)[:size], np.concatenate(left)[:size], value, at


class Histograms(Grower):
    """The best split of each node over binned features."""

    def __init__(self, x: np.ndarray, leaf: int, w: np.ndarray):
        super().__init__(x, leaf, w)
        self.edges = []
        codes = np.zeros(x.shape, np.int64)
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            if len(v) > BINS:
                v = np.unique(quantiles(x[:, j], w, np.linspace(0, 1, BINS)))
            edges = (v[1:] + v[:-1]) / 2
            codes[:, j] = np.searchsorted(edges, x[:, j], "left")
            self.edges.append(edges)
        self.bins = max((len(e) + 1 for e in self.edges), default=1)
        self.codes = codes + np.arange(x.shape[1]) * self.bins
        self.table = np.zeros((x.shape[1], self.bins))
        for j, e in enumerate(self.edges):
            self.table[j, : len(e)] = e

    def propose(self, target, node, rows, n_open):
        f, b = len(self.edges), self.bins
        key = (node[:, None] * (f * b) + self.codes[rows]).ravel()
        w = self.w[rows]
        n = np.bincount(key, np.repeat(w, f), n_open * f * b).reshape(n_open, f, b).cumsum(axis=2)
        s = np.bincount(key, np.repeat(w * target[rows], f), n_open * f * b).reshape(n_open, f, b).cumsum(axis=2)
        total, whole = n[:, :, -1:], s[:, :, -1:]
        right = total - n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s**2 / n + (whole - s) ** 2 / right - whole**2 / total
        gain = np.where((n >= self.leaf) & (right >= self.leaf), gain, 0.0).reshape(n_open, -1)
        best = gain.argmax(axis=1)
        feature, code = best // b, best % b
        return gain[np.arange(n_open), best], feature, self.table[feature, code]


class RandomCuts(Grower):
    """The best of a few features of each node, each cut at a random place between its extremes there."""

    def __init__(self, x: np.ndarray, leaf: int, share: float, rng: np.random.Generator, w: np.ndarray):
        super().__init__(x, leaf, w)
        self.tries, self.rng = max(1, int(share * x.shape[1])), rng

    def propose(self, target, node, rows, n_open):
        order = np.argsort(node, kind="stable")
        node, rows = node[order], rows[order]
        head = np.searchsorted(node, np.arange(n_open))
        x, w = self.x[rows], self.w[rows]
        y = w * target[rows]
        low, high = np.minimum.reduceat(x, head), np.maximum.reduceat(x, head)
        # features that do not vary in a node are passed over
        rank = np.where(high > low, self.rng.random((n_open, x.shape[1])), 2.0)
        chosen = np.argsort(rank, axis=1)[:, : self.tries]
        at = np.arange(n_open)
        n, s = np.bincount(node, w, n_open), np.bincount(node, y, n_open)
        best, feature, threshold = np.zeros(n_open), np.zeros(n_open, np.int64), np.zeros(n_open)
        for c in range(self.tries):
            f = chosen[:, c]
            cut = low[at, f] + self.rng.random(n_open) * (high[at, f] - low[at, f])
            inside = x[np.arange(len(x)), f[node]] <= cut[node]
            nl, sl = np.bincount(node, np.where(inside, w, 0.0), n_open), np.bincount(node, np.where(inside, y, 0.0), n_open)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl**2 / nl + (s - sl) ** 2 / (n - nl) - s**2 / n
            good = (rank[at, f] < 2) & (nl >= self.leaf) & (n - nl >= self.leaf)
            better = good & (gain > best)
            best, feature, threshold = np.where(better, gain, best), np.where(better, f, feature), np.where(better, cut, threshold)
        return best, feature, threshold


def quantiles(x: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolated quantiles of values that stand for ``w`` rows each."""
    if (w == 1).all():
        return np.quantile(x, at)
    order = np.argsort(x, kind="stable")
    upto, place = np.cumsum(w[order]), at * (w.sum() - 1)
    low, high = (x[order][np.minimum(np.searchsorted(upto, p, "right"), len(x) - 1)] for p in (np.floor(place), np.ceil(place)))
    return low + (high - low) * (place - np.floor(place))


def boosted(x: np.ndarray, y: np.ndarray, iterations: int, depth: int, leaf: int, rate: float, share: float, seed: int, w: np.ndarray | None = None) -> Trees:
    """Least-squares boosting: every tree fits what the ones before leave, on a share of the entries."""
    w = np.ones(len(y)) if w is None else w
    rng, grower, out = np.random.default_rng(seed), Histograms(x, leaf, w), Trees(float((w * y).sum() / w.sum()))
    fitted, take = np.full(len(y), out.base), max(1, int(round(share * len(y))))
    for _ in range(iterations):
        used = np.arange(len(y)) if take == len(y) else np.sort(rng.permutation(len(y))[:take])
        *tree, at = grower.grow(y - fitted, used, depth, rate)
        fitted += tree[3][at]
        out.add(*tree)
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int, leaf: int, share: float, seed: int, w: np.ndarray | None = None) -> Trees:
    """Mean of fully grown trees with random cuts, each on all rows."""
    w = np.ones(len(y)) if w is None else w
    rng, out = np.random.default_rng(seed), Trees(0.0)
    for _ in range(trees):
        *tree, _ = RandomCuts(x, leaf, share, rng, w).grow(y, np.arange(len(y)), None, 1.0 / trees)
        out.add(*tree)
    return out


def fitted(kind: str, x: np.ndarray, y: np.ndarray, seed: int, w: np.ndarray | None = None) -> Trees:
    """An ensemble at the capacity that its number of rows asks for; a constant for fewer than 5 rows or a constant target.

    ``w``: the number of rows that each entry stands for, with their mean in ``y``; one by default.
    """
    w = np.ones(len(y)) if w is None else w
    n = int(w.sum())
    if n < 5 or y.min() == y.max():
        return Trees(float((w * y).sum() / n) if n else 0.0)
    if kind == "gbt":
        iterations, depth, leaf = BOOSTED[tier(n)]
        return boosted(x, y, iterations, depth, leaf, 0.04, 0.8, seed, w)
    if kind == "meta":  # a shallow learner on top of other predictions
        iterations, depth, leaf = META
        return boosted(x, y, iterations, depth, leaf, 0.05, 1.0, seed, w)
    if kind == "forest":
        trees, leaf = FOREST[tier(n)]
        return forest(x, y, trees, leaf, 0.3, seed, w)
    raise ValueError(f"unknown kind {kind!r}")


# -- rows as cells -----------------------------------------------------------------


def vectors_held(kind: str, n_features: int) -> int:
    """Combinations of features that a group's task may hold; a fully grown forest has a node for each in every tree."""
    return TEACH_ROWS if kind == "forest" else CELL_VALUES // (BAGS.get(kind, 1) * max(1, n_features))


def group_facts(rows: DataFrame, group: str, features: Sequence[str], y: str, teach_rows: int) -> DataFrame:
    """(group, ``_few``: whether its rows teach one by one, ``_v``: about how many combinations of features, ``_unit``: in which ``y`` is counted)."""
    unit = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.max(F.abs(y)))) - 53), F.lit(1.0))
    facts = rows.groupBy(group).agg(
        (F.count(F.lit(1)) <= teach_rows).alias("_few"), F.approx_count_distinct(F.xxhash64(*features), 0.02).alias("_v"), unit.alias("_unit")
    )
    return cut_lineage(facts, "tree_facts")


def bin_edges(rows: DataFrame, facts: DataFrame, group: str, features: Sequence[str], vectors: int, max_groups: int) -> DataFrame | None:
    """(group, ``_edges``: an array per feature) for groups of more than about ``vectors`` combinations of features whose rows do
    not teach one by one; None without any.

    A feature's edges are its quantiles over all rows of the group: as many as leave no more combinations than that, two bins at least.
    """
    over = [r[group] for r in facts.where(~F.col("_few") & (F.col("_v") > vectors)).select(group).collect()]  # of a closed domain
    if not over:
        return None
    many, bins = rows.where(F.col(group).isin(*over)), BINS
    while True:
        edges = None
        for j, f in enumerate(features):
            wanted = {f"q{i}": i / bins for i in range(1, bins)}
            mine = exact_quantiles(many.where(~F.isnan(f)), [group], f, wanted, max_groups)
            mine = mine.select(group, F.array_sort(F.array_distinct(F.array(*wanted))).alias(f"_e{j}"))
            edges = mine if edges is None else edges.join(mine, group, "full")
        none = F.array().cast("array<double>")
        edges = edges.select(group, F.array(*[F.coalesce(f"_e{j}", none) for j in range(len(features))]).alias("_edges"))
        edges = cut_lineage(edges, "tree_edges")
        found = with_codes(many, edges, group, features, max_groups).groupBy(group).agg(F.approx_count_distinct(F.xxhash64(*features), 0.02).alias("_v"))
        if bins <= 2 or (found.agg(F.max("_v")).first()[0] or 0) <= vectors:
            return edges
        bins //= 2


def with_codes(rows: DataFrame, edges: DataFrame | None, group: str, features: Sequence[str], max_groups: int) -> DataFrame:
    """Features of the groups that have edges as the number of edges below them (missing ones go left, as in a tree)."""
    if edges is None:
        return rows
    code = lambda f, j: F.size(F.filter(F.col("_edges")[j], lambda e: e < F.col(f))).cast("double")
    known = lambda f: F.col(f).isNotNull() & ~F.isnan(f)
    coded = {f: F.when(F.col("_edges").isNull(), F.col(f)).otherwise(F.when(known(f), code(f, j)).otherwise(0.0)) for j, f in enumerate(features)}
    return rows.join(bounded(edges, max_groups), group, "left").withColumns(coded).drop("_edges")


def with_edges(models: DataFrame, edges: DataFrame | None, group: str, max_groups: int) -> DataFrame:
    """Ensembles that were fitted on codes, with cuts in the features themselves."""
    if edges is None:
        return models

    def placed(batches):
        for pdf in batches:
            pdf["model"] = [m if e is None else moved(m, e) for m, e in zip(pdf["model"], pdf["_edges"])]
            yield pdf.drop(columns="_edges")

    return models.join(bounded(edges, max_groups), group, "left").select(*models.columns, "_edges").mapInPandas(placed, models.schema)


def moved(blob: bytes, edges: Sequence[Sequence[float]]) -> bytes:
    m = dict(np.load(io.BytesIO(blob)))
    for j, e in enumerate(edges):
        at = m["feature"] == j
        # a code above a cut is a value above the edge of that number
        m["threshold"][at] = np.asarray(e, float)[np.floor(m["threshold"][at]).astype(int)]
    held = io.BytesIO()
    np.savez(held, **m)
    return held.getvalue()


def cells_of(rows: DataFrame, facts: DataFrame, group: str, parts: Sequence[str], features: Sequence[str], y: str, key: Sequence[str], kind: str, seed: int, max_groups: int) -> DataFrame:
    """All rows as (group, parts, features, ``_bag``, ``n``, ``_sum``, ``_unit``, ``_m2``, ``_low``, ``_high``): those of equal features together.

    ``_sum`` counts whole units (the group's greatest value has 53 binary digits of them), so it does not depend on the order of rows;
    ``_m2`` is the squared error about the cell's mean.  Where trees see a share of the rows, a hash of ``key`` deals equal rows over bags.
    """
    named = rows.join(bounded(facts.select(group, "_unit"), max_groups), group)
    bag = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(BAGS.get(kind, 1))).cast("int")
    counted = named.withColumn("_bag", bag).groupBy(group, *parts, *features, "_bag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.rint(F.col(y) / F.col("_unit")).cast("decimal(18,0)")).alias("_sum"),
        F.max("_unit").alias("_unit"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_m2"),
        F.min(y).alias("_low"),
        F.max(y).alias("_high"),
    )
    return cut_lineage(counted, "tree_cells")


def cell_mean(total: Column, n: Column) -> Column:
    return total.cast("double") / n * F.col("_unit")


def cells_by(cells: DataFrame, group: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """Cells put together by ``group``: (group, features, ``n``, mean ``y``)."""
    whole = cells.groupBy(*group, *features, "_bag").agg(F.sum("n").alias("n"), F.sum("_sum").alias("_sum"), F.max("_unit").alias("_unit"))
    return whole.select(*group, *features, "n", cell_mean(F.col("_sum"), F.col("n")).alias(y))


def fit_trees(
    teach: DataFrame, group: Sequence[str], features: Sequence[str], y: str, key: Sequence[str], kind: str, seed: int, weight: str | None = None
) -> DataFrame:
    """(group, ``part``, ``n``, ``model``): an ensemble per group of ``teach``, whose groups the caller has bounded.

    Entries are put in the order of ``key``, so a result depends on the rows alone; ``weight`` is the number of rows of an entry.
    """
    group, features, key = list(group), list(features), list(key)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, y, *features], kind="stable")
        name = "|".join(str(pdf[g].iloc[0]) for g in group)
        w = pdf[weight].to_numpy(float) if weight else np.ones(len(pdf))
        made = fitted(kind, pdf[features].to_numpy(float), pdf[y].to_numpy(float), zlib.crc32(f"{name}|{seed}".encode()), w).blobs()
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in group), i, int(w.sum()), b] for i, b in enumerate(made)], columns=[*group, "part", "n", "model"])

    kinds = ", ".join(f"{g} {teach.schema[g].dataType.simpleString()}" for g in group)
    columns = list(dict.fromkeys([*group, *key, y, *features, *([weight] if weight else [])]))
    # few bytes and much work: unless their number is given, adaptive execution would join all groups in one task
    dealt = teach.select(*columns).repartition(4 * teach.sparkSession.sparkContext.defaultParallelism, *group)
    return dealt.groupBy(*group).applyInPandas(fit, f"{kinds}, part int, n long, model binary")


def predict_trees(asks: DataFrame, models: DataFrame, group: Sequence[str], features: Sequence[str], keep: Sequence[str], max_groups: int) -> DataFrame:
    """``keep`` columns of ``asks`` and ``pred`` by the group's ensemble; 0 without one."""
    named = list(dict.fromkeys([*group, *features]))
    return matched(asks, tree_values(asks, models, group, features, max_groups), named).select(*keep, "pred")


def matched(asks: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """``pred`` of ``values`` beside each row; equal values, nulls too, meet."""
    found = values.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(on)], "pred")
    if values.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    match = [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(on)]
    return asks.join(found, match, "left").drop(*[f"_at{i}" for i in range(len(on))])


def tree_values(asks: DataFrame, models: DataFrame, group: Sequence[str], features: Sequence[str], max_groups: int) -> DataFrame:
    """A written table of (group, features, ``pred``).

    Trees cost far more than a join, so each combination of features is walked once per group, wherever its rows are.
    """
    group, features = list(group), list(features)
    asked = asks.select(*group, *features).distinct()
    parts = models.groupBy(*group).agg((F.max("part") + 1).alias("_parts"))
    sizes = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("_salts"))
    sizes = sizes.join(parts, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = (
        asked.join(bounded(sizes, max_groups), group)
        .withColumn("_salt", F.pmod(F.xxhash64(*features), F.col("_salts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_salts", "_parts")
    )
    spread = models.join(bounded(sizes.select(*group, "_salts"), max_groups), group).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    on = [*group, "part", "_salt"]
    named = list(dict.fromkeys([*group, *features]))

    def predict(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = mine[named].copy()
        out["pred"] = applied(model["model"].iloc[0], mine[features].to_numpy(float)) if len(model) and len(mine) else 0.0
        return out

    shape = ", ".join(f"{c} {asks.schema[c].dataType.simpleString()}" for c in named)
    found = rows.groupBy(*on).cogroup(spread.select(*on, "model").groupBy(*on)).applyInPandas(predict, f"{shape}, pred double")
    return cut_lineage(found.groupBy(*named).agg(F.sum("pred").alias("pred")), "tree_values")
