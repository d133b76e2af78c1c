"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Tokens are summed per cell (source x language x topic).  Each cell's weight is its tokens times
one factor per dimension; a step rescales the weights along one dimension so that its marginal
meets the target, in turn, until no factor moves.  A document is kept with the calibrated
probability of its cell: raked weight per token over the largest such ratio.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage

TEMPER = 0.7
TOLERANCE = 1e-10
MAX_ROUNDS = 50


def n_tokens_of(text: Column) -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by rule: what kind of content a text carries, else its length."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("License")), "legal")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(tokens < 100, "short")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def level(c: Column) -> Column:
    """A category that can be joined on: null is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def tempered(cells: DataFrame, dim: str, alpha: float = TEMPER) -> DataFrame:
    """Target shares in proportion to the share of tokens to the power ``alpha``."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").select(dim, F.pow("t", F.lit(alpha)).alias("p"))
    return sums.select(dim, (F.col("p") / sums.agg(F.sum("p").alias("s")).scalar()).alias("target"))


def rake(cells: DataFrame, dims: list[str], targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` with the raked weight ``w``; cells without tokens, or whose level has no target, go.

    ``cells`` has the dimensions and ``tokens``; ``targets`` gives (level, ``target``) with shares of
    all tokens.  Sums combine before their shuffle and come back by a join on the level.
    Targets that contradict each other end after ``rounds`` with the last weights and a warning.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    w = cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double"))
    for d in dims:
        w = w.join(targets[d].select(d, F.col("target").alias(f"_t{d}")), d)
    w = cut_lineage(w, "rake_cells")
    for _ in range(rounds):
        step, moved = w.drop("_moved"), F.lit(0.0)
        for d in dims:
            sums = step.groupBy(d).agg(F.sum("w").alias("_sum"))
            factor = F.col(f"_t{d}") * F.lit(total) / F.col("_sum")
            step = step.join(sums, d).withColumn("w", F.col("w") * factor).withColumn(f"_m{d}", F.abs(factor - 1)).drop("_sum")
            moved = F.greatest(moved, f"_m{d}")
        w = cut_lineage(step.withColumn("_moved", moved).drop(*[f"_m{d}" for d in dims]), "rake_cells")
        if (w.agg(F.max("_moved")).first()[0] or 0.0) < tolerance:
            break
    else:
        warnings.warn(f"raking has not settled after {rounds} rounds; the targets may contradict each other", RuntimeWarning, stacklevel=2)
    return w.select(*dims, "tokens", "w")


def uniform_of(doc_id: Column, text: Column, seed: str) -> Column:
    """A repeatable number in [0, 1) per document; repeated rows share it."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


DIMS = ["source", "lang", "topic"]


def levelled(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, seed: str) -> DataFrame:
    """Per row: all of it in ``row``, its three levels, ``tokens`` and its number ``u``.

    The row travels as one column, so no column of it can be mistaken for a helper's.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = lambda c: F.col("row").getField(c)
    rows = whole.select("row", n_tokens_of(at(text)).alias("tokens"), level(at(source)).alias("source"), level(at(lang)).alias("lang"))
    return rows.select("*", level(topic_of(at(text), F.col("tokens"))).alias("topic"), uniform_of(at(doc_id), at(text), seed).alias("u"))


def cell_probabilities(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(levels, ``probability``) of each cell: its raked weight per token over the largest such ratio."""
    goals = dict(targets or {d: tempered(cells, d) for d in DIMS})
    raked = rake(cells, DIMS, goals).select(*DIMS, (F.col("w") / F.col("tokens")).alias("ratio"))
    top = raked.agg(F.max("ratio")).first()[0] or 1.0
    # a cell without tokens costs nothing and is kept
    every = cells.select(*DIMS, (F.col("tokens") == 0).alias("free")).join(raked, DIMS, "left")
    return every.select(*DIMS, F.coalesce(F.col("ratio") / F.lit(top), F.col("free").cast("double")).alias("probability"))


def calibrated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, DataFrame] | None = None, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), levels, ``tokens``, ``u`` and the ``probability`` of its cell.

    The rows are scanned once for the cells and once for the result, and never written.  Null sources
    or languages are levels of their own; texts that are null or empty have no tokens but get
    the probability of their cell; repeated rows share their number; an empty table stays empty.
    """
    rows = levelled(docs, doc_id, text, source, lang, seed)
    cells = cut_lineage(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "rake_cells")
    return rows.join(cut_lineage(cell_probabilities(cells, targets), "rake_probabilities"), DIMS)


def mix_sample(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` kept with their calibrated probabilities (see ``calibrated``); columns as given."""
    return calibrated(docs, **kw).where("u < probability").select("row.*")
