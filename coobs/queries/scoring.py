"""Scores, audits and output validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators import corpus, lineage, score, tables
from coobs.queries import fixtures as fx
from coobs.queries.registry import oracle, query, r2_sql, rounded, rs

KEY = [ENTITY, PROPERTY]
EV = fx.EVENT_TYPES


@query(
    "evl_1_r2_per_property",
    oracle(
        f"SELECT property, count(*) AS n, {rs(r2_sql('value', 'lines'))} AS r2 FROM order_models GROUP BY property",
        "order_models",
    ),
)
def evl_1(spark, sf_dir):
    return rounded(score.r2_by(fx.order_models(spark, sf_dir), [PROPERTY], pred="lines"))


@query(
    "evl_2_macro_score",
    oracle(
        f"""SELECT count(r2) AS n_properties, {rs('avg(r2)')} AS macro_r2 FROM
            (SELECT {r2_sql('value', 'lines')} AS r2 FROM order_models GROUP BY property)""",
        "order_models",
    ),
)
def evl_2(spark, sf_dir):
    return rounded(score.macro_r2(score.r2_by(fx.order_models(spark, sf_dir), [PROPERTY], pred="lines")))


_CMP = {
    "p": f"""SELECT property, {r2_sql('value', 'lines')} AS lines, {r2_sql('value', 'mean')} AS mean,
             {r2_sql('value', 'qty_model')} AS qty FROM order_models GROUP BY property"""
}


@query(
    "evl_3_comparison_table",
    oracle(
        f"""SELECT property, {rs('lines')} AS lines, {rs('mean')} AS mean, {rs('qty')} AS qty FROM p
            UNION ALL SELECT 'MEAN', {rs('avg(lines)')}, {rs('avg(mean)')}, {rs('avg(qty)')} FROM p""",
        "order_models",
        extra=_CMP,
    ),
)
def evl_3(spark, sf_dir):
    return rounded(score.comparison_table(fx.order_preds(spark, sf_dir), fx.MODELS))


_FS = {
    "fs": f"SELECT property, fold, {r2_sql('value', 'lines')} AS r2 FROM order_models GROUP BY property, fold",
    "ps": "SELECT property, count(*) AS n_folds, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2 FROM fs GROUP BY property",
}


@query(
    "evl_4_fold_scores",
    oracle(
        f"SELECT property, n_folds, {rs('mean_r2')} AS mean_r2, {rs('std_r2')} AS std_r2 FROM ps", "order_models", extra=_FS
    ),
)
def evl_4(spark, sf_dir):
    return rounded(score.fold_scores(fx.order_models(spark, sf_dir), pred="lines"))


@query(
    "evl_4_noise_floor",
    oracle(
        f"""SELECT {rs('sqrt(sum((std_r2 / sqrt(n_folds)) ^ 2)) / 5', 8)} AS noise_floor,
            {rs('2 * sqrt(sum((std_r2 / sqrt(n_folds)) ^ 2)) / 5', 8)} AS no_change_below, arg_max(property, std_r2) AS noisiest FROM ps""",
        "order_models",
        extra=_FS,
    ),
)
def evl_4_noise(spark, sf_dir):
    scores = score.fold_scores(fx.order_models(spark, sf_dir), pred="lines")
    return rounded(score.noise_floor(scores, len(fx.AMOUNTS)), 8)


_DOMAIN = {
    "sc": """SELECT CASE l.toxic WHEN 1 THEN 'toxic' ELSE 'plain' END AS property, n.entity,
             CAST(l.quality AS DOUBLE) AS value, 1 - n.share_unseen AS pred,
             n.share_unseen > (SELECT median(share_unseen) FROM novelty) AS ood
             FROM novelty n JOIN labels l ON l.doc_id = n.entity""",
    "side": f"""SELECT property, ood, count(*) AS n, CASE WHEN var_pop(value) > 0 THEN {r2_sql('value', 'pred')} END AS r2,
                avg(abs(value - pred)) AS mae FROM sc GROUP BY property, ood""",
}


@query(
    "evl_5_domain_split",
    oracle(
        f"""SELECT a.property, a.n AS n_in, {rs('a.r2')} AS r2_in, {rs('a.mae')} AS mae_in, b.n AS n_out, {rs('b.r2')} AS r2_out, {rs('b.mae')} AS mae_out
            FROM side a JOIN side b ON a.property = b.property AND NOT a.ood AND b.ood WHERE a.n >= 20 AND b.n >= 20""",
        "novelty",
        extra=_DOMAIN,
    ),
)
def evl_5(spark, sf_dir):
    """A toy score (share of known shingles) against document quality, by domain."""
    ours, others = fx.shingle_sets(spark, sf_dir)
    nov = corpus.flag_above_median(corpus.novelty(ours, corpus.document_frequency(others, ours)))
    labels = fx.raw_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias(ENTITY),
        F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias(PROPERTY),
        F.col("quality").cast("double").alias(VALUE),
    )
    rows = nov.join(labels, ENTITY).withColumn("pred", 1 - F.col("share_unseen"))
    return rounded(score.domain_split(rows))


@query(
    "evl_6_leak_selftest",
    oracle(
        """SELECT property, count(*) AS n_rows, 0.0::DOUBLE AS max_gap, true AS leak_exists, true AS column_guard, true AS row_guard
           FROM train GROUP BY property""",
        "train",
    ),
)
def evl_6(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    block = tables.partner_block(train.select(*KEY, VALUE), train, EV)
    reg = lineage.Lineage().add_partners(EV, {p: -1.0 for p in EV})
    return rounded(lineage.leak_report(block, reg, EV))


@query(
    "evl_9_validate_output",
    oracle(
        """SELECT 'missing_ids' AS "check", NULL::VARCHAR AS property, 'fail' AS severity, count(*) AS n, CAST(min(id) AS VARCHAR) AS example
           FROM test WHERE id NOT IN (SELECT id FROM out)
           UNION ALL SELECT 'extra_ids', NULL, 'fail', count(DISTINCT id), CAST(min(id) AS VARCHAR) FROM out WHERE id NOT IN (SELECT id FROM test)
           UNION ALL SELECT 'duplicate_ids', NULL, 'fail', CAST(sum(n - 1) AS BIGINT), CAST(min(id) AS VARCHAR) FROM (SELECT id, count(*) AS n FROM out GROUP BY id) WHERE n > 1
           UNION ALL SELECT 'not_a_number', NULL, 'fail', count(*), CAST(min(id) AS VARCHAR) FROM out WHERE try_cast(target AS DOUBLE) IS NULL OR isnan(try_cast(target AS DOUBLE))
           UNION ALL SELECT 'infinite', NULL, 'fail', count(*), CAST(min(id) AS VARCHAR) FROM out WHERE isinf(try_cast(target AS DOUBLE))
           UNION ALL SELECT 'row_count', NULL, 'fail', abs((SELECT count(*) FROM out) - (SELECT count(*) FROM test)), CAST((SELECT count(*) FROM out) AS VARCHAR)
           UNION ALL SELECT 'outside_range', property, 'warn', count(*), CAST(min(id) AS VARCHAR) FROM
             (SELECT t.id, t.property, min(try_cast(o.target AS DOUBLE)) FILTER (WHERE NOT isnan(try_cast(o.target AS DOUBLE)) AND NOT isinf(try_cast(o.target AS DOUBLE))) AS v
              FROM test t JOIN out o ON o.id = t.id GROUP BY t.id, t.property)
             JOIN (SELECT property, min(value) AS lo, max(value) AS hi FROM train GROUP BY property) USING (property)
             WHERE v < lo - 0.25 * (hi - lo) OR v > hi + 0.25 * (hi - lo) GROUP BY property
           UNION ALL SELECT 'constant', property, 'fail', count(*), '7.0' FROM test WHERE property = 'error' AND id IN
             (SELECT id FROM out WHERE try_cast(target AS DOUBLE) = 7) GROUP BY property""",
        "train",
        "test",
        extra={
            "base": """SELECT id, property, substr(md5(CAST(id AS VARCHAR)), 1, 2) AS h, value FROM test""",
            "out": """SELECT id, CASE WHEN property = 'error' THEN '7.0' WHEN h < '10' THEN 'oops' WHEN h < '18' THEN 'Infinity'
                      WHEN h < '28' THEN CAST(value * 100 AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS target FROM base WHERE h < 'f0' OR property = 'error'
                      UNION ALL SELECT id, CASE WHEN property = 'error' THEN '7.0' ELSE CAST(value AS VARCHAR) END FROM base WHERE h >= '80' AND h < '88'
                      UNION ALL SELECT -1 - id, '1.0' FROM base WHERE h >= '90' AND h < '98'""",
        },
    ),
)
def evl_9(spark, sf_dir):
    """A deliberately broken output: each kind of defect is injected by a hash of the id."""
    train, test = fx.train_test(spark, sf_dir)
    h = F.substring(F.md5(F.col("id").cast("string")), 1, 2)
    base = test.withColumn("h", h)
    err = F.col(PROPERTY) == "error"
    v = F.col(VALUE).cast("string")
    target = (
        F.when(err, "7.0")
        .when(F.col("h") < "10", "oops")
        .when(F.col("h") < "18", "Infinity")
        .when(F.col("h") < "28", (F.col(VALUE) * 100).cast("string"))
        .otherwise(v)
    )
    kept = base.where((F.col("h") < "f0") | err).select("id", target.alias("target"))
    twice = base.where((F.col("h") >= "80") & (F.col("h") < "88")).select(
        "id", F.when(err, "7.0").otherwise(v).alias("target")
    )
    extra = base.where((F.col("h") >= "90") & (F.col("h") < "98")).select(
        (-1 - F.col("id")).alias("id"), F.lit("1.0").alias("target")
    )
    out = kept.unionByName(twice).unionByName(extra)
    return score.validate_output(out, test, score.train_ranges(train), EV)
