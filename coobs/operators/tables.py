"""Long and wide measurement tables: checks, duplicates, partners, lookups, unions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.numeric import FLOAT32_MAX, finite, to_number
from coobs.plans.joins import bounded, lookup, salted_join

KEY = [ENTITY, PROPERTY]


# -- checks and normalisation ------------------------------------------------------


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {sorted(df.columns)}")
    return df


def foreign_properties(df: DataFrame, domain: Sequence[str]) -> DataFrame:
    """Values outside the closed domain, with their row counts (case matters)."""
    return (
        df.where(F.col(PROPERTY).isNull() | ~F.col(PROPERTY).isin(*domain))
        .groupBy(PROPERTY)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def assert_domain(df: DataFrame, domain: Sequence[str]) -> DataFrame:
    """Rows pass through; a row outside the domain fails the job and names its value."""
    known = F.col(PROPERTY).isin(*domain)
    message = F.concat(
        F.lit("unexpected property "),
        F.coalesce(F.col(PROPERTY), F.lit("NULL")),
        F.lit(f"; expected one of {list(domain)}"),
    )
    checked = F.when(F.coalesce(known, F.lit(False)), F.col(PROPERTY)).otherwise(
        F.raise_error(message).cast("string")
    )
    return df.withColumn(PROPERTY, checked)


def normalise_labels(df: DataFrame) -> DataFrame:
    """Trim and lower-case the property, coerce the value, drop unusable rows."""
    return (
        df.withColumn(PROPERTY, F.lower(F.trim(F.col(PROPERTY))))
        .withColumn(VALUE, to_number(F.col(VALUE)))
        .where(F.col(VALUE).isNotNull() & F.col(ENTITY).isNotNull())
    )


def clean_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features: clip to +-float32 max, missing to 0, safe names; drop the rest.

    Clipping comes first, so an infinity becomes the bound and only NaN becomes 0.
    """
    out: list[Column] = [F.col(f"`{c}`") for c in keep]
    for field in df.schema.fields:
        if field.name in keep:
            continue
        if field.dataType.typeName() in {"double", "float", "integer", "long", "short", "byte"}:
            x = F.col(f"`{field.name}`").cast("double")
            clipped = F.when(
                x.isNotNull() & ~F.isnan(x),
                F.least(F.greatest(x, F.lit(-FLOAT32_MAX)), F.lit(FLOAT32_MAX)),
            )
            name = field.name
            for ch in "[]<,":
                name = name.replace(ch, "_")
            out.append(F.coalesce(clipped, F.lit(0.0)).alias(name))
    return df.select(*out)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, is_constant) per column, from one min/max aggregate over the train rows."""
    row = df.agg(
        *[
            F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns
        ]
    )
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("is_constant")) for c in columns])
        ).alias("_s")
    ).select("_s.*")


def drop_constant(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Drop from all frames the columns that do not vary on train (a schema decision,
    so one row of booleans is read back)."""
    flags = constant_columns(train, columns).where("is_constant").collect()
    gone = [r["name"] for r in flags]
    return [f.drop(*gone) for f in (train, *others)]


# -- duplicates --------------------------------------------------------------------


def reconcile(df: DataFrame) -> DataFrame:
    """One row per (entity, property): mean value, smallest raw spelling, row count."""
    return df.groupBy(*KEY).agg(
        F.avg(VALUE).alias(VALUE),
        F.min("raw").alias("raw"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.select(*KEY, VALUE).dropDuplicates()


def conflicts(df: DataFrame) -> DataFrame:
    """(entity, property) keys whose rows disagree.  Distinct values are reduced map-side
    first, so a key with many rows ships only its distinct values."""
    return (
        df.groupBy(*KEY, VALUE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*KEY)
        .agg(
            F.count(VALUE).alias("n_values"),
            F.sum("_n").alias("n_rows"),
            F.min(VALUE).alias("lowest"),
            F.max(VALUE).alias("highest"),
        )
        .where("n_values > 1")
    )


def key_collapse(train: DataFrame, test: DataFrame) -> DataFrame:
    """Raw spellings against entity keys: distinct counts, rewritten rows, overlap.

    One row per spelling or key with two membership flags, then plain sums, so no
    distinct set is gathered anywhere.
    """
    both = train.select("raw", ENTITY, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).unionByName(
        test.select("raw", ENTITY, F.lit(0).alias("_tr"), F.lit(1).alias("_te"))
    )
    pairs = both.groupBy("raw", ENTITY).agg(
        F.max("_tr").alias("_tr"), F.max("_te").alias("_te"), F.count(F.lit(1)).alias("_n")
    )

    def side(name: str) -> DataFrame:
        flags = pairs.groupBy(name).agg(F.max("_tr").alias("_tr"), F.max("_te").alias("_te"))
        return flags.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("_tr") * F.col("_te")).alias("n_both")
        )

    moved = pairs.agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("raw") != F.col(ENTITY), F.col("_n")).otherwise(0)).alias("n_moved"),
    )
    # three single-row tables
    parts = [
        side("raw").select(F.lit("raw").alias("side"), "n", "n_both"),
        side(ENTITY).select(F.lit("key").alias("side"), "n", "n_both"),
        moved.select(F.lit("rows").alias("side"), F.col("n_rows").alias("n"), F.col("n_moved").alias("n_both")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def pick(s: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c)))

    return stacked.agg(
        pick("raw", "n").alias("raw_keys"),
        pick("key", "n").alias("entities"),
        pick("rows", "n").alias("n_rows"),
        pick("rows", "n_both").alias("rows_rewritten"),
        pick("raw", "n_both").alias("raw_overlap"),
        pick("key", "n_both").alias("entity_overlap"),
    )


# -- long to wide, partners --------------------------------------------------------


def wide(df: DataFrame, properties: Sequence[str], prefix: str = "") -> DataFrame:
    """entity x property, mean per cell, NULL where not measured; one shuffle by entity."""
    return df.groupBy(ENTITY).agg(
        *[F.avg(F.when(F.col(PROPERTY) == p, F.col(VALUE))).alias(prefix + p) for p in properties]
    )


def partner_fills(pool: DataFrame, properties: Sequence[str], fill: str = "entity") -> DataFrame:
    """One row: mean of each property over entities (cells) or over rows."""
    if fill == "entity":
        return wide(pool, properties).agg(*[F.avg(p).alias(f"fill_{p}") for p in properties])
    if fill == "row":
        return pool.agg(
            *[
                F.avg(F.when(F.col(PROPERTY) == p, F.col(VALUE))).alias(f"fill_{p}")
                for p in properties
            ]
        )
    raise ValueError(f"fill must be 'entity' or 'row', not {fill!r}")


def partner_block(
    rows: DataFrame, pool: DataFrame, properties: Sequence[str], fill: str = "entity"
) -> DataFrame:
    """Partner columns of each row: true_<p> (mean-filled), has_<p>, n_partners.

    ``pool`` must hold training labels only.  The fill row has one row by construction.
    """
    table = wide(pool, properties, prefix="_v_")
    if fill == "entity":
        # the same wide table also gives the fills, so its shuffle is used twice
        fills = table.agg(*[F.avg(f"_v_{p}").alias(f"fill_{p}") for p in properties])
    else:
        fills = partner_fills(pool, properties, fill)
    one = F.struct(*[F.col(f"fill_{p}").alias(p) for p in properties])
    known = rows.join(table, ENTITY, "left").withColumn("_fill", fills.select(one).scalar())
    cols: list[Column] = [F.col(c) for c in rows.columns]
    for p in properties:
        cols.append(F.coalesce(F.col(f"_v_{p}"), F.col(f"_fill.{p}")).alias(f"true_{p}"))
        cols.append(F.col(f"_v_{p}").isNotNull().cast("int").alias(f"has_{p}"))
    out = known.select(*cols)
    return out.withColumn("n_partners", sum((F.col(f"has_{p}") for p in properties), F.lit(0)))


def partner_lookup(rows: DataFrame, pool: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Left lookup of partner values by entity, NULL where not measured; entities that
    many rows ask for are salted."""
    return salted_join(rows, wide(pool, properties, prefix="p_"), [ENTITY])


def partner_coverage(block: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Per (property, split): rows, mean count of other partners, share per partner.

    The row's own property is not a partner of its own.
    """
    other = sum(
        (F.when(F.col(PROPERTY) != p, F.col(f"has_{p}")).otherwise(0) for p in properties), F.lit(0)
    )
    return block.groupBy(PROPERTY, "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(other).alias("mean_partners"),
        *[
            F.avg(F.when(F.col(PROPERTY) != p, F.col(f"has_{p}"))).alias(f"share_{p}")
            for p in properties
        ],
    )


def coverage_gaps(
    coverage: DataFrame, properties: Sequence[str], count_gap: float = 0.5, share_gap: float = 0.25
) -> DataFrame:
    """Train against test coverage per property; flags gaps that would break transfer."""

    def side(split: str) -> list[Column]:
        on = F.col("split") == split
        return [F.max(F.when(on, F.col("mean_partners"))).alias(f"{split}_partners")] + [
            F.max(F.when(on, F.col(f"share_{p}"))).alias(f"{split}_{p}") for p in properties
        ]

    both = coverage.groupBy(PROPERTY).agg(*side("train"), *side("test"))
    diffs = [F.abs(F.col(f"train_{p}") - F.col(f"test_{p}")) for p in properties]
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    return both.select(
        PROPERTY,
        "train_partners",
        "test_partners",
        worst.alias("worst_share_gap"),
        (F.abs(F.col("train_partners") - F.col("test_partners")) > count_gap).alias("count_flag"),
        (worst > share_gap).alias("share_flag"),
    )


# -- joins of label tables ---------------------------------------------------------


def measured_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on (entity, property): the known value of each row, if any."""
    known = labels.groupBy(*KEY).agg(F.avg(VALUE).alias("known"))
    return salted_join(rows, known, KEY).withColumn("is_known", F.col("known").isNotNull())


def overlap_agreement(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per property: shared keys, largest and mean difference, keys above tolerance."""
    left = a.groupBy(*KEY).agg(F.avg(VALUE).alias("_a"))
    right = b.groupBy(*KEY).agg(F.avg(VALUE).alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    return (
        left.join(right, KEY)
        .withColumn("_d", d)
        .groupBy(PROPERTY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("_d").alias("max_diff"),
            F.avg("_d").alias("mean_diff"),
            F.sum(F.when(F.col("_d") > tolerance, 1).otherwise(0)).alias("n_above"),
        )
    )


def new_rows(archive: DataFrame, train: DataFrame, pool: DataFrame) -> DataFrame:
    """Archive labels of known entities that train does not have yet, with a status for
    every archive row: new, known (already in train) or outside (entity not in the pool)."""
    entities = pool.select(ENTITY).distinct().withColumn("_in", F.lit(True))
    have = train.select(*KEY).distinct().withColumn("_have", F.lit(True))
    status = (
        F.when(F.col("_in").isNull(), "outside").when(F.col("_have"), "known").otherwise("new")
    )
    return (
        archive.join(entities, ENTITY, "left")
        .join(have, KEY, "left")
        .withColumn("status", status)
        .drop("_in", "_have")
    )


def append_new(train: DataFrame, archive: DataFrame, pool: DataFrame) -> DataFrame:
    """Train plus the archive's new rows of known entities (semi join, anti join, union)."""
    add = archive.join(pool.select(ENTITY).distinct(), ENTITY, "left_semi").join(
        train.select(*KEY).distinct(), KEY, "left_anti"
    )
    cols = [*KEY, VALUE]
    return (
        train.select(*cols)
        .withColumn("source", F.lit("train"))
        .unionByName(add.select(*cols).withColumn("source", F.lit("archive")))
    )


def held_out_view(rows: DataFrame, fold: int | Column, prop: str | Column) -> DataFrame:
    """Training view of one (property, fold): only that property's own fold rows go."""
    fold = F.lit(fold) if isinstance(fold, int) else fold
    prop = F.lit(prop) if isinstance(prop, str) else prop
    return rows.where((F.col("fold") != fold) | (F.col(PROPERTY) != prop))


def per_distinct_key(
    rows: DataFrame, key: str, exprs: Mapping[str, Column], spread_by: Sequence[str] = ()
) -> DataFrame:
    """Evaluate costly expressions once per distinct key and join them back."""
    table = rows.select(key).distinct().select(key, *[c.alias(n) for n, c in exprs.items()])
    return salted_join(rows, table, [key], spread_by=spread_by)


def align_union(a: DataFrame, b: DataFrame, fill: float = 0.0) -> DataFrame:
    """Union of two feature tables over all columns, missing ones filled."""
    return a.unionByName(b, allowMissingColumns=True).fillna(fill)


# -- measured override -------------------------------------------------------------


def override(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured value where one is known, else the model's; the last step of a table.

    ``source`` tells them apart, ``model_pred`` keeps what the model said.
    """
    known = labels.groupBy(*KEY).agg(F.avg(finite(F.col(VALUE))).alias("known"))
    return (
        salted_join(predictions, known, KEY)
        .withColumn("model_pred", F.col("pred"))
        .withColumn("source", F.when(F.col("known").isNotNull(), "measured").otherwise("model"))
        .withColumn("pred", F.coalesce("known", "pred"))
        .drop("known")
    )


def override_report(overridden: DataFrame) -> DataFrame:
    """Per property: rows, overridden rows, share, mean |model - measured| on them."""
    hit = F.col("source") == "measured"
    return overridden.groupBy(PROPERTY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("n_measured"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("share_measured"),
        F.avg(F.when(hit, F.abs(F.col("model_pred") - F.col("pred")))).alias("mae_model"),
    )


# -- profiles ----------------------------------------------------------------------


def profile(df: DataFrame, value: str = VALUE) -> DataFrame:
    return df.groupBy(PROPERTY).agg(
        F.count(value).alias("n"),
        F.min(value).alias("lowest"),
        F.avg(value).alias("mean"),
        F.max(value).alias("highest"),
    )


def label_vectors(df: DataFrame) -> DataFrame:
    """Per entity a map property -> (value, fold); a closed property set bounds the map."""
    cells = df.groupBy(*KEY).agg(F.avg(VALUE).alias(VALUE), F.min("fold").alias("fold"))
    return cells.groupBy(ENTITY).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(PROPERTY, F.struct(VALUE, "fold"))))
        ).alias("labels")
    )


def task_weights(df: DataFrame, properties: Sequence[str], alpha: float = 0.25) -> DataFrame:
    """count ** alpha per property of the domain, 0 when unseen."""
    row = df.agg(
        *[F.sum(F.when(F.col(PROPERTY) == p, 1).otherwise(0)).alias(p) for p in properties]
    )
    pairs = F.array(
        *[F.struct(F.lit(p).alias(PROPERTY), F.coalesce(F.col(p), F.lit(0)).alias("n")) for p in properties]
    )
    return (
        row.select(F.explode(pairs).alias("_s"))
        .select("_s.*")
        .withColumn("weight", F.when(F.col("n") > 0, F.pow("n", F.lit(alpha))).otherwise(0.0))
    )


def gate_small(df: DataFrame, min_rows: int | Column, n_properties: int) -> DataFrame:
    """Keep the rows of properties with at least ``min_rows`` rows (a number or a scalar column)."""
    sizes = df.groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return df.join(bounded(sizes.select(PROPERTY), n_properties), PROPERTY, "left_semi")


# -- sets --------------------------------------------------------------------------


def label_pool(train: DataFrame, archive: DataFrame | None) -> DataFrame:
    """Train plus archive labels, duplicates kept (consumers average)."""
    cols = [*KEY, VALUE]
    base = train.select(*cols)
    return base if archive is None else base.unionByName(archive.select(*cols))


def universe(*frames: DataFrame) -> DataFrame:
    """All distinct entities."""
    out = frames[0].select(ENTITY)
    for f in frames[1:]:
        out = out.unionByName(f.select(ENTITY))
    return out.distinct()


def key_overlap(archive: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Per property how archive keys meet train and test, from one pass with three flags."""

    def flagged(df: DataFrame, which: str) -> DataFrame:
        return df.select(
            *KEY, *[F.lit(1 if w == which else 0).alias(w) for w in ("_a", "_tr", "_te")]
        )

    keys = (
        flagged(archive, "_a")
        .unionByName(flagged(train, "_tr"))
        .unionByName(flagged(test, "_te"))
        .groupBy(*KEY)
        .agg(F.max("_a").alias("_a"), F.max("_tr").alias("_tr"), F.sum("_te").alias("_nte"))
    )
    a, tr, te = F.col("_a") == 1, F.col("_tr") == 1, F.col("_nte") > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return (
        keys.groupBy(PROPERTY)
        .agg(
            count(a).alias("archive_keys"),
            count(a & tr).alias("in_train"),
            count(a & te).alias("in_test"),
            count(a & ~tr & ~te).alias("in_neither"),
            F.sum(F.when(a, F.col("_nte")).otherwise(0)).alias("test_rows_covered"),
            F.sum("_nte").alias("test_rows"),
        )
        .withColumn(
            "share_test_covered",
            F.when(F.col("test_rows") > 0, F.col("test_rows_covered") / F.col("test_rows")),
        )
    )


def provenance_violations(partners: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Partner labels (entity, property) that no allowed source has: must be empty."""
    allowed = sources[0].select(*KEY)
    for s in sources[1:]:
        allowed = allowed.unionByName(s.select(*KEY))
    return partners.select(*KEY).distinct().join(allowed.distinct(), KEY, "left_anti")
