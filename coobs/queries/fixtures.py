"""Measurement tables derived from the given parquet tables, in Spark and in SQL.

``meas``: events as (user-day, event type, value) with several spellings of the user-day.
``order_meas``: per order five amounts with exact identities, each known only when the
order has a line of a certain kind; order-level features are always known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.text import char_tokens, compact_key, map_placeholder, word_tokens
from coobs.operators import corpus, folds, relations as R, tables
from coobs.plans.moments import fold_moments, intercept, slope
from coobs.queries.registry import table
from coobs.session import cut_lineage, discard

EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]
ARCHIVE_TYPES = ["view", "click"]
AMOUNTS = ["gross", "disc", "net", "tax", "charge"]
MODELS = ["lines", "mean", "qty"]
MEASURED = [ENTITY, PROPERTY, VALUE, "n_lines", "qty"]
SHINGLE = 3
FOLDS = 5

CATALOGUE = [
    R.Relation("net", ("gross", "disc"), lambda g, d: g - d),
    R.Relation("charge", ("net", "tax"), lambda n, t: n + t),
    R.Relation("gross", ("charge",), lambda c: c),
    R.Relation("tax", ("disc",), lambda d: F.pow(d, F.lit(2.0))),
    R.Relation("disc", ("tax",), lambda t: F.sqrt(F.greatest(t, F.lit(0.0)))),
]
# target -> (sources, SQL of the raw estimate)
CATALOGUE_SQL = {
    "net": (("gross", "disc"), "({p}gross - {p}disc)"),
    "charge": (("net", "tax"), "({p}net + {p}tax)"),
    "gross": (("charge",), "({p}charge)"),
    "tax": (("disc",), "({p}disc * {p}disc)"),
    "disc": (("tax",), "sqrt(greatest({p}tax, 0.0))"),
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- events ------------------------------------------------------------------------


def meas_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, raw, property, value): the user-day in one of three spellings."""
    e = raw_table(spark, sf_dir, "events")
    user, day = F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1)
    raw = (
        F.when(h < "5", F.concat(F.lit("U"), user, F.lit(":"), day))
        .when(h < "a", F.concat(F.lit(" u"), user, F.lit(" : "), day, F.lit(" ")))
        .otherwise(F.concat(F.lit("U"), user, F.lit(" :"), day))
    )
    return e.select("event_id", raw.alias("raw"), F.col("event_type").alias(PROPERTY), VALUE)


table(
    "meas_raw",
    """SELECT event_id,
       CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < '5'
              THEN 'U' || user_id || ':' || CAST(ts AS DATE)
            WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < 'a'
              THEN ' u' || user_id || ' : ' || CAST(ts AS DATE) || ' '
            ELSE 'U' || user_id || ' :' || CAST(ts AS DATE) END AS raw,
       event_type AS property, value FROM events""",
)
table(
    "meas_rows",
    r"""SELECT event_id, raw, lower(regexp_replace(raw, '\s+', '', 'g')) AS entity, property, value
       FROM meas_raw""",
    "meas_raw",
)


def meas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meas_raw(spark, sf_dir).withColumn(ENTITY, compact_key(F.col("raw")))


def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (entity, property) with an id, and a repeatable train/test split."""
    cells = (
        meas_rows(spark, sf_dir)
        .groupBy(ENTITY, PROPERTY)
        .agg(F.avg(VALUE).alias(VALUE), F.min("raw").alias("raw"), F.min("event_id").alias("id"))
    )
    h = F.substring(F.md5(F.concat_ws(":", ENTITY, PROPERTY, F.lit("split"))), 1, 1)
    return cells.withColumn("split", F.when(h <= "5", "test").otherwise("train"))


table(
    "meas",
    """SELECT *, CASE WHEN substr(md5(entity || ':' || property || ':split'), 1, 1) <= '5'
                 THEN 'test' ELSE 'train' END AS split
       FROM (SELECT entity, property, avg(value) AS value, min(raw) AS raw, min(event_id) AS id
             FROM meas_rows GROUP BY entity, property)""",
    "meas_rows",
)
table("train", "SELECT * FROM meas WHERE split = 'train'", "meas")
table("test", "SELECT * FROM meas WHERE split = 'test'", "meas")


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = meas(spark, sf_dir)
    return m.where("split = 'train'").drop("split"), m.where("split = 'test'").drop("split")


def archive_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second label table: two properties, untidy names and numbers, partly overlapping
    train and test, some values shifted, some entities unknown."""
    h = F.substring(F.md5(F.concat_ws(":", ENTITY, PROPERTY, F.lit("arch"))), 1, 1)
    m = meas(spark, sf_dir).where(F.col(PROPERTY).isin(*ARCHIVE_TYPES)).withColumn("h", h)
    shifted = F.col(VALUE) + F.when(F.col("h") == "0", 0.5).otherwise(0.0)
    return m.where((F.col("h") <= "8") | (F.col("h") == "f")).select(
        F.when(F.col("h") == "f", F.concat(ENTITY, F.lit("x"))).otherwise(F.col(ENTITY)).alias(ENTITY),
        F.when(F.col("h") <= "3", F.concat(F.lit(" "), F.upper(PROPERTY), F.lit(" ")))
        .otherwise(F.col(PROPERTY))
        .alias(PROPERTY),
        F.when(F.col("h") == "7", "n/a")
        .when(F.col("h") == "6", "NaN")
        .otherwise(shifted.cast("string"))
        .alias(VALUE),
    )


table(
    "archive_raw",
    """SELECT CASE WHEN h = 'f' THEN entity || 'x' ELSE entity END AS entity,
       CASE WHEN h <= '3' THEN ' ' || upper(property) || ' ' ELSE property END AS property,
       CASE WHEN h = '7' THEN 'n/a' WHEN h = '6' THEN 'NaN'
            ELSE CAST(value + CASE WHEN h = '0' THEN 0.5 ELSE 0.0 END AS VARCHAR) END AS value
       FROM (SELECT *, substr(md5(entity || ':' || property || ':arch'), 1, 1) AS h FROM meas
             WHERE property IN ('view', 'click'))
       WHERE h <= '8' OR h = 'f'""",
    "meas",
)
table(
    "archive",
    """SELECT entity, property, avg(v) AS value FROM
       (SELECT entity, lower(trim(property)) AS property, try_cast(value AS DOUBLE) AS v FROM archive_raw)
       WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY entity, property""",
    "archive_raw",
)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = tables.normalise_labels(archive_raw(spark, sf_dir))
    return tidy.groupBy(ENTITY, PROPERTY).agg(F.avg(VALUE).alias(VALUE))


def pivot_sql(source: str, properties: list[str], prefix: str = "") -> str:
    cells = ", ".join(
        f"avg(value) FILTER (WHERE property = '{p}') AS {prefix}{p}" for p in properties
    )
    return f"SELECT entity, {cells} FROM {source} GROUP BY entity"


# -- orders ------------------------------------------------------------------------


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = raw_table(spark, sf_dir, "lineitem")
    price, d, t = F.col("l_extendedprice") / 997.0, F.col("l_discount"), F.col("l_tax")
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    return (
        li.groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.sum(price).alias("_gross"),
            F.sum(price * d).alias("_disc"),
            F.sum(price * (1 - d) * t).alias("_tax"),
            has(F.col("l_returnflag") == "A").alias("_a"),
            has(F.col("l_returnflag") == "N").alias("_n"),
            has(F.col("l_linestatus") == "F").alias("_f"),
            has(F.col("l_linestatus") == "O").alias("_o"),
            has(t >= 0.04).alias("_t"),
        )
        .withColumn(ENTITY, F.col("l_orderkey").cast("string"))
    )


def order_meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, property, value, n_lines, qty), net = gross - disc, charge = net + tax."""
    o = order_features(spark, sf_dir)
    net = F.col("_gross") - F.col("_disc")
    known = {
        "gross": (F.col("_a") == 1, F.col("_gross")),
        "disc": (F.col("_f") == 1, F.col("_disc")),
        "net": (F.col("_n") == 1, net),
        "tax": (F.col("_t") == 1, F.col("_tax")),
        "charge": (F.col("_o") == 1, net + F.col("_tax")),
    }
    cells = [
        F.struct(F.lit(p).alias(PROPERTY), F.when(c, v).alias(VALUE)) for p, (c, v) in known.items()
    ]
    return (
        o.select(ENTITY, "n_lines", "qty", F.explode(F.array(*cells)).alias("_c"))
        .select(ENTITY, "_c.*", "n_lines", "qty")
        .where(F.col(VALUE).isNotNull())
    )


table(
    "order_features",
    """SELECT CAST(l_orderkey AS VARCHAR) AS entity, CAST(count(*) AS DOUBLE) AS n_lines,
       sum(l_quantity) AS qty, sum(l_extendedprice / 997.0) AS g,
       sum(l_extendedprice / 997.0 * l_discount) AS d,
       sum(l_extendedprice / 997.0 * (1 - l_discount) * l_tax) AS t,
       bool_or(l_returnflag = 'A') AS fa, bool_or(l_returnflag = 'N') AS fn,
       bool_or(l_linestatus = 'F') AS ff, bool_or(l_linestatus = 'O') AS fo,
       bool_or(l_tax >= 0.04) AS ft
       FROM lineitem GROUP BY l_orderkey""",
)
table(
    "order_meas",
    """SELECT entity, 'gross' AS property, g AS value, n_lines, qty FROM order_features WHERE fa
       UNION ALL SELECT entity, 'disc', d, n_lines, qty FROM order_features WHERE ff
       UNION ALL SELECT entity, 'net', g - d, n_lines, qty FROM order_features WHERE fn
       UNION ALL SELECT entity, 'tax', t, n_lines, qty FROM order_features WHERE ft
       UNION ALL SELECT entity, 'charge', g - d + t, n_lines, qty FROM order_features WHERE fo""",
    "order_features",
)
table("order_wide", pivot_sql("order_meas", AMOUNTS), "order_meas")


def fold_sql(source: str, seed: int = 42, k: int = FOLDS) -> str:
    return (
        f"SELECT *, CAST((row_number() OVER (PARTITION BY property ORDER BY md5(entity || '|{seed}'), entity) - 1)"
        f" % {k} AS INTEGER) AS fold FROM {source}"
    )


table("order_folds", fold_sql("order_meas"), "order_meas")
table("meas_folds", fold_sql("meas"), "meas")


def order_folds(spark: SparkSession, sf_dir: str, seed: int = 42, k: int = FOLDS) -> DataFrame:
    """Folds are assigned once and written: every later step reads the same table."""
    # ranks count the rows before they order them, so they are made once as well
    rows = cut_lineage(order_meas(spark, sf_dir), "order_meas")
    dealt = cut_lineage(folds.property_folds(rows, k=k, seed=seed), "folds")
    discard(rows)
    return dealt


def meas_folds(spark: SparkSession, sf_dir: str, seed: int = 42, k: int = FOLDS) -> DataFrame:
    return folds.property_folds(meas(spark, sf_dir), k=k, seed=seed)


def order_models(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Three cross-fitted predictors beside each row: on the line count, the property mean
    and on the quantity."""
    rows = order_folds(spark, sf_dir, seed)
    models = {"lines": "n_lines", "qty_model": "qty"}
    return R.crossfit_many(rows, models, mean="mean", max_groups=len(AMOUNTS))


def _long_preds(models: DataFrame) -> DataFrame:
    """The long prediction store of these models."""
    cells = F.array(
        F.struct(F.lit("lines").alias("model"), F.col("lines").alias("pred")),
        F.struct(F.lit("mean").alias("model"), F.col("mean").alias("pred")),
        F.struct(F.lit("qty").alias("model"), F.col("qty_model").alias("pred")),
    )
    return (
        models
        .select(ENTITY, PROPERTY, VALUE, "fold", "seed", F.explode(cells).alias("_c"))
        .select(ENTITY, PROPERTY, VALUE, "fold", "_c.*", "seed")
    )


def order_preds(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    return _long_preds(order_models(spark, sf_dir, seed).withColumn("seed", F.lit(seed)))


def replica_preds(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...]) -> DataFrame:
    """The stores of several seeds, dealt by row while its models are still one row: aggregates by
    (entity, property) and more need no shuffle after it."""
    models = [order_models(spark, sf_dir, s).withColumn("seed", F.lit(s)) for s in seeds]
    slim = [m.select(ENTITY, PROPERTY, VALUE, "fold", "lines", "mean", "qty_model", "seed") for m in models]
    return _long_preds(reduce(DataFrame.unionByName, slim).repartition(ENTITY, PROPERTY))


def _order_models_sql(folds_table: str) -> str:
    return f"""SELECT t.*, f.a1 * t.n_lines + f.b1 AS lines, f.m AS mean, f.a2 * t.qty + f.b2 AS qty_model
       FROM {folds_table} t JOIN
       (SELECT k.property, k.fold, avg(r.value) AS m,
               regr_slope(r.value, r.n_lines) AS a1, regr_intercept(r.value, r.n_lines) AS b1,
               regr_slope(r.value, r.qty) AS a2, regr_intercept(r.value, r.qty) AS b2
        FROM (SELECT DISTINCT property, fold FROM {folds_table}) k
        JOIN {folds_table} r ON r.property = k.property AND r.fold <> k.fold
        GROUP BY k.property, k.fold) f
       ON f.property = t.property AND f.fold = t.fold"""


def _order_preds_sql(models_table: str, seed: int) -> str:
    one = "SELECT entity, property, value, fold, '{m}' AS model, {c} AS pred, {s} AS seed FROM {t}"
    return " UNION ALL ".join(
        one.format(m=m, c=c, s=seed, t=models_table)
        for m, c in (("lines", "lines"), ("mean", "mean"), ("qty", "qty_model"))
    )


table("order_models", _order_models_sql("order_folds"), "order_folds")
table("order_preds", _order_preds_sql("order_models", 42), "order_models")
table("order_folds_b", fold_sql("order_meas", seed=43), "order_meas")
table("order_models_b", _order_models_sql("order_folds_b"), "order_folds_b")
table("order_preds_b", _order_preds_sql("order_models_b", 43), "order_models_b")


def order_frame(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Partner frame: measured amounts (``rows``, if the caller has written them), else a prediction from the line count alone."""
    rows = order_meas(spark, sf_dir) if rows is None else rows
    feats = order_features(spark, sf_dir).select(ENTITY, "n_lines")
    named = rows.select(PROPERTY, F.col("n_lines").alias("x"), F.col(VALUE).alias("y"))
    fits = fold_moments(named, [PROPERTY], ["x", "y"]).select(
        PROPERTY, slope().alias("a"), intercept().alias("b")
    )
    cells = feats.select(ENTITY, "n_lines", F.explode(F.array(*[F.lit(p) for p in AMOUNTS])).alias(PROPERTY))
    preds = cells.join(F.broadcast(fits), PROPERTY).select(
        ENTITY, PROPERTY, (F.col("a") * F.col("n_lines") + F.col("b")).alias("pred")
    )
    return R.partner_frame(rows, feats.select(ENTITY), preds, AMOUNTS)


table(
    "order_frame",
    """SELECT o.entity, f.property, coalesce(m.value, f.a * o.n_lines + f.b) AS value,
              m.value IS NOT NULL AS is_true
       FROM order_features o
       CROSS JOIN (SELECT property, regr_slope(value, n_lines) AS a, regr_intercept(value, n_lines) AS b
                   FROM order_meas GROUP BY property) f
       LEFT JOIN order_meas m ON m.entity = o.entity AND m.property = f.property""",
    "order_meas",
)
table(
    "order_frame_wide",
    "SELECT entity, "
    + ", ".join(f"max(value) FILTER (WHERE property = '{p}') AS {p}" for p in AMOUNTS)
    + ", "
    + ", ".join(f"bool_or(is_true) FILTER (WHERE property = '{p}') AS is_{p}" for p in AMOUNTS)
    + " FROM order_frame GROUP BY entity",
    "order_frame",
)


def relation_case_sql(prefix: str, known_only: bool = True) -> str:
    """CASE over the row's property giving the raw estimate."""
    arms = []
    for t, (srcs, expr) in CATALOGUE_SQL.items():
        e = expr.format(p=prefix)
        ok = " AND ".join(f"{prefix}{s} IS NOT NULL" for s in srcs)
        arms.append(f"WHEN property = '{t}' AND {ok} THEN {e}" if known_only else f"WHEN property = '{t}' THEN {e}")
    return "CASE " + " ".join(arms) + " END"


def covered_case_sql(prefix: str) -> str:
    arms = [
        f"WHEN property = '{t}' THEN " + " AND ".join(f"{prefix}{s}" for s in srcs)
        for t, (srcs, _) in CATALOGUE_SQL.items()
    ]
    return "CASE " + " ".join(arms) + " ELSE false END"


def blend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an out-of-fold prediction (line count), raw estimate x and covered flag."""
    models = order_models(spark, sf_dir)
    rows = models.select(ENTITY, PROPERTY, VALUE, "fold", "n_lines", F.col("lines").alias("pred"))
    frame = R.frame_wide(order_frame(spark, sf_dir, models.select(*MEASURED)), AMOUNTS)
    # read twice by every blend (moments, then apply), so written once
    return cut_lineage(R.with_frame_estimate(rows, frame, CATALOGUE), "blend_rows")


table(
    "blend_rows",
    f"""SELECT entity, property, value, fold, n_lines, pred, {relation_case_sql("w_", False)} AS x,
        {covered_case_sql("i_")} AS covered
        FROM (SELECT m.entity, m.property, m.value, m.fold, m.n_lines, m.lines AS pred,
              {", ".join(f"w.{p} AS w_{p}, w.is_{p} AS i_{p}" for p in AMOUNTS)}
              FROM order_models m LEFT JOIN order_frame_wide w ON w.entity = m.entity)""",
    "order_models",
    "order_frame_wide",
)


# -- documents ---------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents (ours) and all others (the corpus): (entity, text)."""
    docs = raw_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ENTITY), map_placeholder(F.col("text")).alias("text")
    )
    labels = raw_table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ENTITY)).distinct()
    return docs.join(labels, ENTITY, "left_semi"), docs.join(labels, ENTITY, "left_anti")


def shingle_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ours, others = documents(spark, sf_dir)
    make = lambda d: corpus.entity_shingles(d, word_tokens(F.col("text")), SHINGLE)
    return make(ours), make(others)


table(
    "docs",
    """SELECT doc_id AS entity, regexp_replace(text, '[0-9]', '0', 'g') AS text,
       doc_id IN (SELECT doc_id FROM labels) AS ours, lang FROM documents""",
)
table(
    "doc_tokens",
    r"SELECT entity, ours, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM docs",
    "docs",
)
table(
    "doc_shingles",
    """SELECT DISTINCT entity, ours, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS shingle
       FROM (SELECT entity, ours, tokens, unnest(range(1, len(tokens) - 1)) AS i FROM doc_tokens)""",
    "doc_tokens",
)
table(
    "shingle_df",
    """SELECT shingle, count(*) AS df FROM doc_shingles WHERE NOT ours
       AND shingle IN (SELECT shingle FROM doc_shingles WHERE ours) GROUP BY shingle""",
    "doc_shingles",
)
table(
    "novelty",
    """SELECT d.entity, coalesce(avg(ln(1 + s.df)), 0.0) AS mean_log_df, coalesce(ln(1 + min(s.df)), 0.0) AS min_log_df,
              coalesce(avg(CASE WHEN s.df = 0 THEN 1.0 ELSE 0.0 END), 0.0) AS share_unseen,
              coalesce(avg(CASE WHEN s.df < 10 THEN 1.0 ELSE 0.0 END), 0.0) AS share_rare,
              count(s.shingle) AS n_shingles
       FROM (SELECT entity FROM docs WHERE ours) d
       LEFT JOIN (SELECT o.entity, o.shingle, coalesce(f.df, 0) AS df FROM doc_shingles o
                  LEFT JOIN shingle_df f ON f.shingle = o.shingle WHERE o.ours) s ON s.entity = d.entity
       GROUP BY d.entity""",
    "docs",
    "shingle_df",
)


# -- parts as short sequences ------------------------------------------------------


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, property, value, text, seq): a part name as a sequence of characters."""
    return raw_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(ENTITY),
        F.col("p_type").alias(PROPERTY),
        F.col("p_retailprice").alias(VALUE),
        F.col("p_name").alias("text"),
        char_tokens(F.col("p_name")).alias("seq"),
    )


table(
    "parts",
    """SELECT p_partkey AS entity, p_type AS property, p_retailprice AS value, p_name AS s FROM part""",
)
table(
    "part_variants",
    """SELECT entity, property, value, s, 'permutational' AS kind, 0 AS i, upper(s) AS v FROM parts
       UNION ALL SELECT entity, property, value, s, 'permutational', 1, lower(s[1:1]) || upper(s[2:]) FROM parts
       UNION ALL SELECT entity, property, value, s, 'translational', 0, s[2:] || s[1:1] FROM parts
       UNION ALL SELECT entity, property, value, s, 'translational', 1, s[3:] || s[1:2] FROM parts
       UNION ALL SELECT entity, property, value, s, 'repetition', 0, s || s FROM parts
       UNION ALL SELECT entity, property, value, s, 'repetition', 1, s || s || s FROM parts""",
    "parts",
)


def vowel_share(seq):
    vowels = F.filter(seq, lambda t: F.lower(t).isin("a", "e", "i", "o", "u"))
    return F.size(vowels) / F.greatest(F.size(seq), F.lit(1)).cast("double")


def toy_predictor(seq):
    """An intensive and an extensive term: exact under respelling, moved by repetition."""
    return 10 * vowel_share(seq) + 0.1 * F.size(seq)


def vowel_sql(s: str) -> str:
    return f"(length(regexp_replace(lower({s}), '[^aeiou]', '', 'g')) / greatest(length({s}), 1))"


def toy_sql(s: str) -> str:
    return f"(10 * {vowel_sql(s)} + 0.1 * length({s}))"
