"""Sources, sinks, projections, joins, aggregations and set operations."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.numeric import signed_log1p
from coobs.functions.text import word_tokens
from coobs.operators import corpus, ensemble, lineage, score, tables
from coobs.queries import fixtures as fx
from coobs.queries.registry import oracle, query, r2_sql, rounded, rs
from coobs.session import scratch_path
from coobs.sources import readers, sinks

EV = fx.EVENT_TYPES
KEY = [ENTITY, PROPERTY]


# -- sources -----------------------------------------------------------------------


@query(
    "src_1_labelled_measurements",
    oracle(
        f"SELECT entity, property, min(raw) AS raw, {rs('avg(value)')} AS value, count(*) AS n_obs"
        " FROM meas_rows GROUP BY entity, property",
        "meas_rows",
    ),
)
def src_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(readers.labelled(fx.meas_raw(spark, sf_dir), EV))


@query(
    "src_2_query_rows",
    oracle("SELECT event_id AS id, raw, entity, property FROM meas_rows", "meas_rows"),
)
def src_2(spark, sf_dir):
    rows = fx.meas_raw(spark, sf_dir).withColumnRenamed("event_id", "id").drop(VALUE)
    return readers.query_rows(rows, EV)


@query(
    "src_3_adopt_archive",
    oracle(
        f"""SELECT property, count(*) AS n, {rs('avg(value)')} AS mean, 'archive' AS source
            FROM archive GROUP BY property""",
        "archive",
    ),
)
def src_3(spark, sf_dir):
    candidates = [
        ("missing", lambda: spark.read.parquet(f"{sf_dir}/no_such_table.parquet")),
        ("unlabelled", lambda: fx.raw_table(spark, sf_dir, "part")),
        ("full_table", lambda: fx.meas(spark, sf_dir)),
        ("archive", lambda: fx.archive_raw(spark, sf_dir)),
    ]
    got = readers.adopt_archive(spark, candidates, fx.ARCHIVE_TYPES)
    return rounded(
        got.table.groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("n"), F.avg(VALUE).alias("mean")).withColumn(
            "source", F.lit(got.source)
        )
    )


@query("src_4_corpus_column", "SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")
def src_4(spark, sf_dir):
    return readers.corpus_column(fx.raw_table(spark, sf_dir, "documents"), "tex")


# -- projections -------------------------------------------------------------------


@query(
    "prj_1_closed_domain",
    "SELECT event_type AS property, count(*) AS n_rows FROM events"
    " WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type",
)
def prj_1(spark, sf_dir):
    return tables.foreign_properties(fx.meas_raw(spark, sf_dir), ["view", "click", "purchase"])


@query(
    "prj_2_normalise_labels",
    oracle(
        f"""SELECT entity, lower(trim(property)) AS property, {rs('try_cast(value AS DOUBLE)')} AS value
            FROM archive_raw WHERE try_cast(value AS DOUBLE) IS NOT NULL
            AND NOT isnan(try_cast(value AS DOUBLE)) AND NOT isinf(try_cast(value AS DOUBLE))""",
        "archive_raw",
    ),
)
def prj_2(spark, sf_dir):
    return rounded(tables.normalise_labels(fx.archive_raw(spark, sf_dir)))


def _dirty_parts(spark, sf_dir):
    p = fx.raw_table(spark, sf_dir, "part")
    x = F.col("p_retailprice")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") > 40, F.lit(float("inf"))).when(F.col("p_size") < 5, F.lit(float("nan"))).otherwise(x).alias("price[<usd]"),
        F.when(F.col("p_size") > 20, x * 1e39).alias("huge,x"),
        F.col("p_size").alias("size"),
        "p_name",
    )


_F32 = "3.4028234663852886e38"


@query(
    "prj_3_clean_features",
    f"""SELECT p_partkey,
        CASE WHEN p_size > 40 THEN {_F32} WHEN p_size < 5 THEN 0.0 ELSE p_retailprice END AS "price__usd_",
        CASE WHEN p_size > 20 THEN least(p_retailprice * 1e39, {_F32}) ELSE 0.0 END AS huge_x,
        CAST(p_size AS DOUBLE) AS size FROM part""",
)
def prj_3(spark, sf_dir):
    return tables.clean_features(_dirty_parts(spark, sf_dir), keep=["p_partkey"])


@query(
    "prj_4_drop_constant",
    oracle(
        """SELECT 'flat' AS name, true AS is_constant UNION ALL SELECT 'n_lines', min(n_lines) = max(n_lines) FROM order_meas
           UNION ALL SELECT 'qty', min(qty) = max(qty) FROM order_meas""",
        "order_meas",
    ),
)
def prj_4(spark, sf_dir):
    rows = fx.order_meas(spark, sf_dir).withColumn("flat", F.lit(1.0))
    return tables.constant_columns(rows, ["flat", "n_lines", "qty"])


def event_lineage() -> lineage.Lineage:
    return lineage.Lineage().add_partners(EV, {p: -1.0 for p in EV})


_BLOCK_FILL = (
    "SELECT " + ", ".join(f"avg({p}) AS {p}" for p in EV) + " FROM train_wide"
)


def _block_sql(rows: str) -> str:
    cols = ", ".join(
        f"coalesce(w.{p}, f.{p}) AS true_{p}, CAST(w.{p} IS NOT NULL AS INTEGER) AS has_{p}" for p in EV
    )
    return f"""SELECT r.*, {cols} FROM {rows} r LEFT JOIN train_wide w ON w.entity = r.entity
               CROSS JOIN train_fill f"""


_WIDE = {"train_wide": fx.pivot_sql("train", EV), "train_fill": _BLOCK_FILL}
_BLOCKS = {**_WIDE, "block": _block_sql("(SELECT * FROM meas)")}


@query(
    "prj_5_column_guard",
    oracle(
        "SELECT entity, property, "
        + ", ".join(f"{rs(f'true_{p}')} AS true_{p}, has_{p}" for p in EV if p != "view")
        + " FROM block WHERE property = 'view'",
        "train",
        extra=_BLOCKS,
    ),
)
def prj_5(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    rows = fx.meas(spark, sf_dir).where(F.col(PROPERTY) == "view").select(*KEY)
    block = tables.partner_block(rows, train, EV)
    return rounded(event_lineage().drop_leaky(block, "view").drop("n_partners"))


@query(
    "prj_6_row_guard",
    oracle(
        "SELECT entity, property, "
        + ", ".join(
            f"CASE WHEN property = '{p}' THEN -1.0 ELSE {rs(f'true_{p}')} END AS true_{p},"
            f" CASE WHEN property = '{p}' THEN 0.0 ELSE CAST(has_{p} AS DOUBLE) END AS has_{p}"
            for p in EV
        )
        + " FROM block",
        "train",
        extra=_BLOCKS,
    ),
)
def prj_6(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    block = tables.partner_block(fx.meas(spark, sf_dir).select(*KEY), train, EV)
    return rounded(event_lineage().mask_rows(block).drop("n_partners"))


@query(
    "prj_8_clip_to_train",
    oracle(
        f"""SELECT property, count(*) AS n, sum(CAST(p < lo - w OR p > hi + w AS BIGINT))::BIGINT AS n_clipped,
            {rs('avg(least(greatest(p, lo - w), hi + w))')} AS mean_pred,
            count(*) FILTER (WHERE p IS NULL) AS n_null
            FROM (SELECT t.property, CASE WHEN t.value < 5 THEN NULL ELSE t.value * 2 - 60 END AS p, r.lo, r.hi, 0.05 * (r.hi - r.lo) AS w
                  FROM test t JOIN (SELECT property, min(value) AS lo, max(value) AS hi FROM train GROUP BY property) r
                  ON r.property = t.property)
            GROUP BY property""",
        "train",
        "test",
    ).replace("avg(least(greatest(p, lo - w), hi + w))", "avg(CASE WHEN p IS NOT NULL THEN least(greatest(p, lo - w), hi + w) END)")
    .replace("sum(CAST(p < lo - w OR p > hi + w AS BIGINT))::BIGINT", "CAST(count(*) FILTER (WHERE p < lo - w OR p > hi + w) AS BIGINT)"),
)
def prj_8(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    preds = test.withColumn("pred", F.when(F.col(VALUE) < 5, None).otherwise(F.col(VALUE) * 2 - 60))
    out = score.clip_to_train(preds, score.train_ranges(train), max_groups=len(EV))
    return rounded(
        out.groupBy(PROPERTY).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("was_clipped").cast("long")).alias("n_clipped"),
            F.avg("pred").alias("mean_pred"),
            F.sum(F.col("pred").isNull().cast("long")).alias("n_null"),
        )
    )


@query(
    "prj_9_fill_missing",
    oracle(
        f"""SELECT t.entity, t.property, {rs('''CASE WHEN t.value >= 10 THEN t.value WHEN t.value >= 5 THEN t.value + 1
            ELSE r.mean END''')} AS pred
            FROM test t JOIN (SELECT property, avg(value) AS mean FROM train GROUP BY property) r
            ON r.property = t.property""",
        "train",
        "test",
    ),
)
def prj_9(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    v = F.col(VALUE)
    preds = test.withColumn("pred", F.when(v < 10, F.lit(float("nan"))).otherwise(v)).withColumn(
        "other", F.when(v < 5, F.lit(float("inf"))).otherwise(v + 1)
    )
    out = score.fill_missing(preds, score.train_ranges(train), fallback="other", max_groups=len(EV))
    return rounded(out.select(*KEY, "pred"))


@query(
    "prj_10_signed_log1p",
    f"""SELECT c_custkey, {rs('sign(c_acctbal) * ln(1 + abs(c_acctbal))')} AS y FROM customer""",
)
def prj_10(spark, sf_dir):
    return rounded(fx.raw_table(spark, sf_dir, "customer").select("c_custkey", signed_log1p(F.col("c_acctbal")).alias("y")))


@query(
    "prj_11_stage_gate",
    oracle(
        """SELECT property, count(*) AS n FROM order_meas GROUP BY property
           HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM order_meas GROUP BY property))""",
        "order_meas",
    ),
)
def prj_11(spark, sf_dir):
    rows = fx.order_meas(spark, sf_dir)
    # the gate is a fixed number in real use; here the mean group size makes it bite at any scale
    n = rows.groupBy(PROPERTY).count()
    gate = n.agg(F.avg("count")).scalar()
    return tables.gate_small(rows, gate, len(fx.AMOUNTS)).groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("n"))


# -- joins -------------------------------------------------------------------------


@query(
    "jn_1_partner_lookup",
    oracle(
        "SELECT t.entity, t.property, " + ", ".join(f"{rs(f'w.{p}')} AS p_{p}" for p in EV)
        + " FROM test t LEFT JOIN train_wide w ON w.entity = t.entity",
        "train",
        "test",
        extra={"train_wide": fx.pivot_sql("train", EV)},
    ),
)
def jn_1(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    return rounded(tables.partner_lookup(test.select(*KEY), train, EV))


@query(
    "jn_2_measured_rows",
    oracle(
        f"""SELECT m.entity, m.property, {rs('a.value')} AS known, a.value IS NOT NULL AS is_known
            FROM meas m LEFT JOIN archive a ON a.entity = m.entity AND a.property = m.property""",
        "meas",
        "archive",
    ),
)
def jn_2(spark, sf_dir):
    return rounded(tables.measured_rows(fx.meas(spark, sf_dir).select(*KEY), fx.archive(spark, sf_dir)))


@query(
    "jn_3_overlap_agreement",
    oracle(
        f"""SELECT a.property, count(*) AS n, {rs('max(abs(a.value - t.value))')} AS max_diff,
            {rs('avg(abs(a.value - t.value))')} AS mean_diff,
            CAST(count(*) FILTER (WHERE abs(a.value - t.value) > 1e-6) AS BIGINT) AS n_above
            FROM archive a JOIN train t ON t.entity = a.entity AND t.property = a.property GROUP BY a.property""",
        "archive",
        "train",
    ),
)
def jn_3(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    return rounded(tables.overlap_agreement(fx.archive(spark, sf_dir), train))


@query(
    "jn_4_append_new_rows",
    oracle(
        f"""SELECT entity, property, {rs('value')} AS value, 'train' AS source FROM train
            UNION ALL SELECT entity, property, {rs('value')}, 'archive' FROM archive a
            WHERE entity IN (SELECT entity FROM meas)
            AND NOT EXISTS (SELECT 1 FROM train t WHERE t.entity = a.entity AND t.property = a.property)""",
        "archive",
        "train",
    ),
)
def jn_4(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    return rounded(tables.append_new(train, fx.archive(spark, sf_dir), fx.meas(spark, sf_dir)))


@query(
    "jn_4_status_of_archive_rows",
    oracle(
        """SELECT CASE WHEN NOT e THEN 'outside' WHEN h THEN 'known' ELSE 'new' END AS status, count(*) AS n
           FROM (SELECT entity IN (SELECT entity FROM meas) AS e,
                        EXISTS (SELECT 1 FROM train t WHERE t.entity = a.entity AND t.property = a.property) AS h
                 FROM archive a) GROUP BY 1""",
        "archive",
        "train",
    ),
)
def jn_4_status(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    rows = tables.new_rows(fx.archive(spark, sf_dir), train, fx.meas(spark, sf_dir))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn_5_held_out_view",
    oracle(
        f"""SELECT property, fold, count(*) AS n, {rs('sum(value)', 4)} AS total FROM meas_folds
            WHERE fold <> 2 OR property <> 'click' GROUP BY property, fold""",
        "meas_folds",
    ),
)
def jn_5(spark, sf_dir):
    view = tables.held_out_view(fx.meas_folds(spark, sf_dir), 2, "click")
    return rounded(
        view.groupBy(PROPERTY, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(VALUE).alias("total")), 4
    )


@query(
    "jn_6_once_per_distinct_key",
    r"""SELECT page_id, length(regexp_replace(lower(url), '[^\p{L}\p{N}\s]+', '', 'g')) AS key_len,
        len(regexp_extract_all(lower(url), '[\p{L}\p{N}]+')) AS n_tokens FROM pages""",
)
def jn_6(spark, sf_dir):
    pages = fx.raw_table(spark, sf_dir, "pages").select("page_id", "url")
    exprs = {
        "key_len": F.length(F.regexp_replace(F.lower("url"), r"[^\p{L}\p{N}\s]+", "")).cast("long"),
        "n_tokens": F.size(word_tokens(F.col("url"))).cast("long"),
    }
    return tables.per_distinct_key(pages, "url", exprs, spread_by=["page_id"]).drop("url")


_KNN = """
tr AS (SELECT s.entity, s.shingle FROM doc_shingles s WHERE ours),
tn AS (SELECT t.entity, CAST(l.quality AS DOUBLE) AS value, (SELECT count(DISTINCT shingle) FROM tr x WHERE x.entity = t.entity) AS n
       FROM (SELECT entity FROM docs WHERE ours) t JOIN labels l ON l.doc_id = t.entity),
qn AS (SELECT q.entity, (SELECT count(DISTINCT shingle) FROM doc_shingles x WHERE x.entity = q.entity) AS n
       FROM (SELECT entity FROM docs WHERE NOT ours) q),
inter AS (SELECT a.entity AS q, b.entity AS t, count(*) AS c
          FROM doc_shingles a JOIN tr b ON a.shingle = b.shingle WHERE NOT a.ours GROUP BY 1, 2),
sims AS (SELECT qn.entity AS q, tn.entity AS t, tn.value, coalesce(i.c, 0) / CAST(greatest(qn.n + tn.n - coalesce(i.c, 0), 1) AS DOUBLE) AS sim
         FROM qn CROSS JOIN tn LEFT JOIN inter i ON i.q = qn.entity AND i.t = tn.entity),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, t) AS rk FROM sims),
kk AS (SELECT CAST(greatest(3, least(25, round_even(pow(count(*), 0.4), 0))) AS INTEGER) AS k FROM tn),
nn AS (SELECT * FROM best WHERE rk <= (SELECT k FROM kk))
"""


def _knn_oracle() -> str:
    base = oracle("SELECT 1", "doc_shingles")
    head = base[: base.rindex("SELECT 1")].rstrip()
    return (
        head
        + ","
        + _KNN
        + f"""SELECT q AS entity, count(*) AS n_neighbours,
        {rs('''CASE WHEN count(*) FILTER (WHERE sim = 1) > 0
        THEN avg(value) FILTER (WHERE sim = 1)
        ELSE sum(CASE WHEN sim < 1 THEN value / (1 - sim) END) / sum(CASE WHEN sim < 1 THEN 1 / (1 - sim) END) END''')} AS pred
        FROM nn GROUP BY q"""
    )


@query("jn_7_knn_jaccard", _knn_oracle())
def jn_7(spark, sf_dir):
    ours, others = fx.shingle_sets(spark, sf_dir)
    labels = fx.raw_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias(ENTITY), F.col("quality").cast("double").alias(VALUE)
    )
    nn = corpus.knn_jaccard(ours.join(labels, ENTITY), others)
    return rounded(corpus.knn_predict(nn))


def _preds(test: DataFrame) -> DataFrame:
    return test.select("id", *KEY, VALUE).withColumn("pred", F.lit(50.0) + F.col("id") / 1e4)


@query(
    "jn_8_measured_override",
    oracle(
        f"""SELECT t.id, t.property, {rs('coalesce(a.value, 50.0 + t.id / 1e4)')} AS pred,
            CASE WHEN a.value IS NOT NULL THEN 'measured' ELSE 'model' END AS source
            FROM test t LEFT JOIN archive a ON a.entity = t.entity AND a.property = t.property""",
        "test",
        "archive",
    ),
)
def jn_8(spark, sf_dir):
    _, test = fx.train_test(spark, sf_dir)
    out = tables.override(_preds(test), fx.archive(spark, sf_dir))
    return rounded(out.select("id", PROPERTY, "pred", "source"))


@query(
    "jn_8_override_report",
    oracle(
        f"""SELECT t.property, count(*) AS n_rows, CAST(count(a.value) AS BIGINT) AS n_measured,
            {rs('count(a.value) / count(*)')} AS share_measured,
            {rs('avg(abs(50.0 + t.id / 1e4 - a.value))')} AS mae_model
            FROM test t LEFT JOIN archive a ON a.entity = t.entity AND a.property = t.property GROUP BY t.property""",
        "test",
        "archive",
    ),
)
def jn_8_report(spark, sf_dir):
    _, test = fx.train_test(spark, sf_dir)
    return rounded(tables.override_report(tables.override(_preds(test), fx.archive(spark, sf_dir))))


@query(
    "jn_9_align_columns",
    """SELECT CAST(c_custkey AS BIGINT) AS k, c_acctbal AS bal, 0.0::DOUBLE AS price, 0 AS size FROM customer
       UNION ALL SELECT p_partkey, 0.0, p_retailprice, p_size FROM part""",
)
def jn_9(spark, sf_dir):
    a = fx.raw_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = fx.raw_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")
    )
    return tables.align_union(a, b)


# -- aggregations ------------------------------------------------------------------


@query(
    "agg_1_reconcile_duplicates",
    oracle(
        f"""SELECT entity, property, {rs('avg(value)')} AS value, min(raw) AS raw, count(*) AS n_obs
            FROM meas_rows GROUP BY entity, property""",
        "meas_rows",
    ),
)
def agg_1(spark, sf_dir):
    return rounded(tables.reconcile(fx.meas_rows(spark, sf_dir)))


@query(
    "agg_2_exact_duplicates",
    "SELECT DISTINCT lower(c_mktsegment) AS entity, CAST(c_nationkey AS VARCHAR) AS property,"
    " CAST(c_acctbal > 0 AS INTEGER)::DOUBLE AS value FROM customer",
)
def agg_2(spark, sf_dir):
    c = fx.raw_table(spark, sf_dir, "customer").select(
        F.lower("c_mktsegment").alias(ENTITY),
        F.col("c_nationkey").cast("string").alias(PROPERTY),
        (F.col("c_acctbal") > 0).cast("double").alias(VALUE),
    )
    return tables.drop_exact_duplicates(c)


@query(
    "agg_3_conflicts",
    oracle(
        """SELECT entity, property, count(DISTINCT value) AS n_values, count(*) AS n_rows, min(value) AS lowest, max(value) AS highest
           FROM meas_rows GROUP BY entity, property HAVING count(DISTINCT value) > 1""",
        "meas_rows",
    ),
)
def agg_3(spark, sf_dir):
    return tables.conflicts(fx.meas_rows(spark, sf_dir))


@query(
    "agg_4_wide_table",
    oracle(
        "SELECT entity, " + ", ".join(f"{rs(f'{p}')} AS {p}" for p in EV) + " FROM w",
        "meas_rows",
        extra={"w": fx.pivot_sql("meas_rows", EV)},
    ),
)
def agg_4(spark, sf_dir):
    return rounded(tables.wide(fx.meas_rows(spark, sf_dir), EV))


_BLOCK_COLS = ", ".join(f"{rs(f'true_{p}')} AS true_{p}, has_{p}" for p in EV)
_N_PARTNERS = " + ".join(f"has_{p}" for p in EV)


@query(
    "agg_5_partner_block",
    oracle(
        f"SELECT entity, property, {_BLOCK_COLS}, {_N_PARTNERS} AS n_partners FROM block",
        "train",
        extra=_BLOCKS,
    ),
)
def agg_5(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    return rounded(tables.partner_block(fx.meas(spark, sf_dir).select(*KEY), train, EV))


@query(
    "agg_5_partner_block_row_fill",
    oracle(
        f"SELECT entity, property, {_BLOCK_COLS}, {_N_PARTNERS} AS n_partners FROM block",
        "meas",
        extra={
            "pool_rows": "SELECT r.* FROM meas_rows r JOIN train t ON t.entity = r.entity AND t.property = r.property",
            "train_wide": fx.pivot_sql("pool_rows", EV),
            "train_fill": "SELECT "
            + ", ".join(f"avg(value) FILTER (WHERE property = '{p}') AS {p}" for p in EV)
            + " FROM pool_rows",
            "block": _block_sql("(SELECT * FROM meas)"),
        },
    ).replace("pool_rows AS", "train AS (SELECT * FROM meas WHERE split = 'train'),\npool_rows AS", 1),
)
def agg_5_row(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    pool = fx.meas_rows(spark, sf_dir).join(train.select(*KEY), KEY, "left_semi")
    return rounded(tables.partner_block(fx.meas(spark, sf_dir).select(*KEY), pool, EV, fill="row"))


_OTHER = " + ".join(f"CASE WHEN property <> '{p}' THEN has_{p} ELSE 0 END" for p in EV)


@query(
    "agg_6_coverage",
    oracle(
        f"""SELECT property, split, count(*) AS n_rows, {rs(f'avg({_OTHER})')} AS mean_partners, """
        + ", ".join(f"{rs(f'avg(CASE WHEN property <> {chr(39)}{p}{chr(39)} THEN has_{p} END)')} AS share_{p}" for p in EV)
        + " FROM block GROUP BY property, split",
        "train",
        extra=_BLOCKS,
    ),
)
def agg_6(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    block = tables.partner_block(fx.meas(spark, sf_dir).select(*KEY, "split"), train, EV)
    return rounded(tables.partner_coverage(block, EV))


@query(
    "agg_6_coverage_gaps",
    oracle(
        f"""SELECT property, {rs('tr')} AS train_partners, {rs('te')} AS test_partners, {rs('g')} AS worst_share_gap,
            abs(tr - te) > 0.5 AS count_flag, g > 0.25 AS share_flag FROM (
            SELECT property, avg({_OTHER}) FILTER (WHERE split = 'train') AS tr, avg({_OTHER}) FILTER (WHERE split = 'test') AS te,
            greatest({", ".join(f"abs(avg(CASE WHEN property <> '{p}' THEN has_{p} END) FILTER (WHERE split = 'train') - avg(CASE WHEN property <> '{p}' THEN has_{p} END) FILTER (WHERE split = 'test'))" for p in EV)}) AS g
            FROM block GROUP BY property)""",
        "train",
        extra=_BLOCKS,
    ),
)
def agg_6_gaps(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    block = tables.partner_block(fx.meas(spark, sf_dir).select(*KEY, "split"), train, EV)
    return rounded(tables.coverage_gaps(tables.partner_coverage(block, EV), EV))


@query(
    "agg_7_profile",
    oracle(
        f"SELECT property, count(value) AS n, min(value) AS lowest, {rs('avg(value)')} AS mean, max(value) AS highest"
        " FROM meas_rows GROUP BY property",
        "meas_rows",
    ),
)
def agg_7(spark, sf_dir):
    return rounded(tables.profile(fx.meas_rows(spark, sf_dir)))


_SIDE = {
    "s": """SELECT r.*, m.split FROM meas_rows r JOIN meas m ON m.entity = r.entity AND m.property = r.property"""
}


@query(
    "agg_8_key_collapse",
    oracle(
        """SELECT count(DISTINCT raw) AS raw_keys, count(DISTINCT entity) AS entities, count(*) AS n_rows,
           CAST(count(*) FILTER (WHERE raw <> entity) AS BIGINT) AS rows_rewritten,
           (SELECT count(*) FROM (SELECT raw FROM s WHERE split = 'train' INTERSECT SELECT raw FROM s WHERE split = 'test')) AS raw_overlap,
           (SELECT count(*) FROM (SELECT entity FROM s WHERE split = 'train' INTERSECT SELECT entity FROM s WHERE split = 'test')) AS entity_overlap
           FROM s""",
        "meas",
        extra=_SIDE,
    ),
)
def agg_8(spark, sf_dir):
    split = fx.meas(spark, sf_dir).select(*KEY, "split")
    rows = fx.meas_rows(spark, sf_dir).join(split, KEY)
    return tables.key_collapse(rows.where("split = 'train'"), rows.where("split = 'test'"))


@query(
    "agg_9_label_vector",
    oracle(
        "SELECT entity, "
        + ", ".join(
            f"{rs(f'max(value) FILTER (WHERE property = {chr(39)}{p}{chr(39)})')} AS value_{p},"
            f" max(fold) FILTER (WHERE property = '{p}') AS fold_{p}"
            for p in EV
        )
        + ", count(*) AS n_labels FROM meas_folds GROUP BY entity",
        "meas_folds",
    ),
)
def agg_9(spark, sf_dir):
    vec = tables.label_vectors(fx.meas_folds(spark, sf_dir))
    cell = lambda p: F.try_element_at("labels", F.lit(p))
    cols = []
    for p in EV:
        cols += [cell(p)[VALUE].alias(f"value_{p}"), cell(p)["fold"].alias(f"fold_{p}")]
    return rounded(vec.select(ENTITY, *cols, F.size("labels").cast("long").alias("n_labels")))


@query(
    "agg_10_task_weights",
    oracle(
        f"""SELECT property, CAST(count(*) AS BIGINT) AS n, {rs('pow(count(*), 0.25)')} AS weight FROM meas GROUP BY property
            UNION ALL SELECT 'refund', 0, 0.0""",
        "meas",
    ),
)
def agg_10(spark, sf_dir):
    return rounded(tables.task_weights(fx.meas(spark, sf_dir), [*EV, "refund"]))


@query(
    "agg_11_document_frequency",
    oracle(
        "SELECT df, count(*) AS n_shingles, min(shingle) AS first, max(shingle) AS last FROM shingle_df GROUP BY df",
        "shingle_df",
    ),
)
def agg_11(spark, sf_dir):
    ours, others = fx.shingle_sets(spark, sf_dir)
    df = corpus.document_frequency(others, ours).where("df > 0")
    return df.groupBy("df").agg(
        F.count(F.lit(1)).alias("n_shingles"), F.min("shingle").alias("first"), F.max("shingle").alias("last")
    )


@query(
    "agg_13_average_replicas",
    oracle(
        f"""SELECT entity, property, model, {rs('avg(pred)')} AS pred, count(*) AS n_seeds FROM
            (SELECT * FROM order_preds UNION ALL SELECT * FROM order_preds_b) GROUP BY entity, property, model""",
        "order_preds",
        "order_preds_b",
    ),
)
def agg_13(spark, sf_dir):
    return rounded(ensemble.average_replicas(fx.replica_preds(spark, sf_dir, (42, 43)), KEY))


@query(
    "agg_14_disagreement",
    oracle(
        f"""SELECT entity, property, {rs('avg(pred)')} AS pred, {rs('stddev_pop(pred)')} AS spread, count(*) AS n_models
            FROM order_preds GROUP BY entity, property""",
        "order_preds",
    ),
)
def agg_14(spark, sf_dir):
    return rounded(ensemble.disagreement(fx.order_preds(spark, sf_dir), KEY))


@query(
    "agg_15_percentile_profile",
    f"""SELECT lang, count(*) AS n, {rs('avg(n_chars)')} AS mean, {rs('quantile_cont(n_chars, 0.1)')} AS p10,
        {rs('quantile_cont(n_chars, 0.5)')} AS median, {rs('quantile_cont(n_chars, 0.9)')} AS p90,
        {rs('quantile_cont(n_chars, 0.95)')} AS p95, {rs('quantile_cont(n_chars, 0.99)')} AS p99
        FROM documents GROUP BY lang""",
)
def agg_15(spark, sf_dir):
    d = fx.raw_table(spark, sf_dir, "documents").select("lang", "n_chars")
    wanted = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return rounded(corpus.percentile_profile(d, ["lang"], "n_chars", 1000, wanted))


# -- sets --------------------------------------------------------------------------


@query(
    "set_1_label_pool",
    oracle(
        f"""SELECT property, count(*) AS n, {rs('avg(value)')} AS mean FROM
            (SELECT entity, property, value FROM train UNION ALL SELECT entity, property, value FROM archive) GROUP BY property""",
        "train",
        "archive",
    ),
)
def set_1(spark, sf_dir):
    train, _ = fx.train_test(spark, sf_dir)
    pool = tables.label_pool(train, fx.archive(spark, sf_dir))
    return rounded(pool.groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("n"), F.avg(VALUE).alias("mean")))


@query("set_2_universe", oracle("SELECT DISTINCT entity FROM meas", "meas"))
def set_2(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    return tables.universe(train, test)


@query(
    "set_3_key_overlap",
    oracle(
        f"""SELECT property, CAST(sum(a) AS BIGINT) AS archive_keys, CAST(sum(a * tr) AS BIGINT) AS in_train,
            CAST(sum(a * te) AS BIGINT) AS in_test, CAST(sum(a * (1 - tr) * (1 - te)) AS BIGINT) AS in_neither,
            CAST(sum(a * te) AS BIGINT) AS test_rows_covered, CAST(sum(te) AS BIGINT) AS test_rows,
            {rs('CASE WHEN sum(te) > 0 THEN sum(a * te) / sum(te) END')} AS share_test_covered FROM
            (SELECT entity, property, max(a) AS a, max(tr) AS tr, max(te) AS te FROM
             (SELECT entity, property, 1 AS a, 0 AS tr, 0 AS te FROM archive
              UNION ALL SELECT entity, property, 0, 1, 0 FROM train UNION ALL SELECT entity, property, 0, 0, 1 FROM test)
             GROUP BY entity, property) GROUP BY property""",
        "archive",
        "train",
        "test",
    ),
)
def set_3(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    return rounded(tables.key_overlap(fx.archive(spark, sf_dir), train, test))


@query(
    "set_4_provenance",
    oracle(
        """SELECT entity, property FROM
           (SELECT DISTINCT entity, property FROM train UNION SELECT DISTINCT entity, property FROM archive)
           WHERE (entity, property) NOT IN (SELECT (entity, property) FROM train)""",
        "train",
        "archive",
    ),
)
def set_4(spark, sf_dir):
    """Partner labels from train and archive, checked as if only train were allowed."""
    train, _ = fx.train_test(spark, sf_dir)
    pool = tables.label_pool(train, fx.archive(spark, sf_dir))
    return tables.provenance_violations(pool, [train])


# -- sinks -------------------------------------------------------------------------


def _output(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    train, test = fx.train_test(spark, sf_dir)
    preds = test.withColumn("pred", F.when(F.col(VALUE) > 40, F.col(VALUE) * 2))
    full = score.fill_missing(preds, score.train_ranges(train), max_groups=len(EV))
    return full.select("id", F.col("pred").alias("target")), test


_OUT = f"""SELECT t.id, CASE WHEN t.value > 40 THEN t.value * 2 ELSE r.mean END AS target, t.value, t.property
           FROM test t JOIN (SELECT property, avg(value) AS mean FROM train GROUP BY property) r ON r.property = t.property"""


@query(
    "snk_1_write_output",
    oracle(f"SELECT id, {rs('target')} AS target FROM out", "train", "test", extra={"out": _OUT}),
)
def snk_1(spark, sf_dir):
    out, test = _output(spark, sf_dir)
    return rounded(sinks.write_output(out, test, scratch_path(spark, "output")))


@query(
    "snk_2_two_variants",
    oracle(
        f"""SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE abs(target - c) > 1e-9) AS BIGINT) AS n_differ,
            {rs('max(abs(target - c))')} AS max_diff FROM
            (SELECT target, CASE WHEN value > 60 THEN target - 1 ELSE target END AS c FROM out)""",
        "train",
        "test",
        extra={"out": _OUT},
    ),
)
def snk_2(spark, sf_dir):
    out, test = _output(spark, sf_dir)
    other = out.join(test.select("id", VALUE), "id").select(
        "id", F.when(F.col(VALUE) > 60, F.col("target") - 1).otherwise(F.col("target")).alias("target")
    )
    return rounded(sinks.differing_rows(out, other))


_RUN = {
    "fs": f"SELECT property, fold, {r2_sql('value', 'lines')} AS r2 FROM order_models GROUP BY property, fold",
    "ps": "SELECT property, count(*) AS n_folds, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2 FROM fs GROUP BY property",
    "pr": f"SELECT property, count(*) AS n, {r2_sql('value', 'lines')} AS r2 FROM order_models GROUP BY property",
}


@query(
    "snk_3_run_record",
    oracle(
        f"""SELECT 'lines' AS config, CAST(42 AS BIGINT) AS seed, property, {rs('mean_r2')} AS mean_r2, {rs('std_r2')} AS std_r2,
            (SELECT {rs('avg(r2)')} FROM pr) AS macro_r2, (SELECT {rs('sqrt(sum((std_r2 / sqrt(n_folds)) ^ 2)) / 5', 8)} FROM ps) AS noise_floor,
            true AS dated FROM ps""",
        "order_models",
        extra=_RUN,
    ),
)
def snk_3(spark, sf_dir):
    """A run record, written and read again, as one row per property."""
    rows = fx.order_models(spark, sf_dir).withColumn("pred", F.col("lines"))
    scores = score.fold_scores(rows)
    macro = score.macro_r2(score.r2_by(rows, [PROPERTY]))
    noise = score.noise_floor(scores, len(fx.AMOUNTS))
    record = sinks.append_run(spark, scratch_path(spark, "runs"), "lines", 42, scores, macro, noise, 0.0)
    out = record.select("*", F.explode("per_property").alias(PROPERTY, "mean_r2")).select(
        "config", "seed", PROPERTY, "mean_r2", F.element_at("per_property_std", F.col(PROPERTY)).alias("std_r2"), "macro_r2", "noise_floor",
        F.col("run_at").rlike(r"^\d{8}-\d{6}$").alias("dated"),
    )
    return rounded(out, noise_floor=8)


@query(
    "snk_4_prediction_store",
    oracle(
        f"""SELECT entity, property, fold, model, seed, {rs('pred')} AS pred FROM order_preds
            WHERE model IN ('lines', 'qty')""",
        "order_preds",
    ),
)
def snk_4(spark, sf_dir):
    store = sinks.write_predictions(fx.order_preds(spark, sf_dir), scratch_path(spark, "preds"))
    return rounded(
        store.where(F.col("model").isin("lines", "qty")).select(ENTITY, PROPERTY, "fold", "model", "seed", "pred")
    )


@query(
    "snk_5_reusable_stage",
    oracle(
        """SELECT property, count(*) AS n, false AS first_reused, true AS second_reused, false AS other_config_reused
           FROM meas GROUP BY property""",
        "meas",
    ),
)
def snk_5(spark, sf_dir):
    root = scratch_path(spark, "stages")
    build = lambda: fx.meas(spark, sf_dir).groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("n"))
    _, a = sinks.run_stage(spark, root, "sizes", {"folds": 5}, build)
    df, b = sinks.run_stage(spark, root, "sizes", {"folds": 5}, build)
    _, c = sinks.run_stage(spark, root, "sizes", {"folds": 10}, build)
    return df.withColumns(
        {"first_reused": F.lit(a), "second_reused": F.lit(b), "other_config_reused": F.lit(c)}
    )


@query(
    "snk_6_run_report",
    oracle(f"SELECT 'r2' AS section, property, n, {rs('r2')} AS r2 FROM pr", "order_models", extra=_RUN),
)
def snk_6(spark, sf_dir):
    """A report document, read again: the rows of one of its two sections."""
    rows = fx.order_models(spark, sf_dir).withColumn("pred", F.col("lines"))
    report = sinks.run_report(
        {
            "r2": rounded(score.r2_by(rows, [PROPERTY])),
            "profile": rounded(tables.profile(fx.meas(spark, sf_dir))),
        }
    )
    sections = report.select(F.explode(F.from_json("report", "map<string, string>")).alias("section", "rows")).where("section = 'r2'")
    cells = F.explode(F.from_json("rows", f"array<struct<{PROPERTY}: string, n: bigint, r2: double>>"))
    return sections.select("section", cells.alias("c")).select("section", "c.*")
