"""The training-data operators as registered queries over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from coobs.llm import burst_trie, differencing, digest_array, equal_average, hidden_markov, multiprobe, partenum, raking, suffixes, surrogates, templates, toxicity, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op5_winnowing",
    f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS ws FROM benchmark),
bw AS (
    SELECT DISTINCT item, m, array_to_string(ws[p + 1 : p + m], ' ') AS win
    FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0)
),
dw AS (
    SELECT rid, p, m, array_to_string(ws[p + 1 : p + m], ' ') AS win
    FROM (SELECT rid, ws, m, unnest(range(greatest(len(ws) - m + 1, 0))) AS p FROM d, (SELECT DISTINCT m FROM bw))
),
hits AS (SELECT rid, p, m, item FROM dw JOIN bw USING (m, win)),
covered AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS pos FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows of ten words."""
    found = winnowing.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op2_differencing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts stay together."""
    placed = differencing.assignments(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def raking_sql(rounds: int = 30) -> str:
    """Proportional fitting as a chain of window sums, then the same probabilities and draws."""
    steps = [
        f"""rows AS (
    SELECT doc_id, coalesce('=' || source, '') AS s, coalesce('=' || lang, '') AS l, n AS n_tokens,
           CASE WHEN contains(t, 'License') THEN '=legal' WHEN contains(t, '@') THEN '=contact' WHEN n < 100 THEN '=short'
                WHEN n >= 1000 THEN '=long' ELSE '=prose' END AS p,
           CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(t))), 1, 13) AS BIGINT) / {float(1 << 52)!r} AS u
    FROM (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n FROM documents)
)""",
        "cells AS (SELECT s, l, p, sum(n_tokens) AS tokens FROM rows GROUP BY ALL)",
    ]
    for d in "slp":
        steps.append(f"t_{d} AS (SELECT {d}, target / sum(target) OVER () AS t_{d} FROM (SELECT {d}, sum(tokens) ^ {raking.TEMPER} AS target FROM cells GROUP BY {d} HAVING sum(tokens) > 0))")
    steps.append("w0 AS (SELECT s, l, p, tokens, CAST(tokens AS DOUBLE) AS w, t_s, t_l, t_p, (SELECT sum(tokens) FROM cells) AS total FROM cells JOIN t_s USING (s) JOIN t_l USING (l) JOIN t_p USING (p) WHERE tokens > 0)")
    n = 0
    for _ in range(rounds):
        for d in "slp":
            steps.append(f"w{n + 1} AS (SELECT * REPLACE (w * t_{d} * total / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{n})")
            n += 1
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, s AS source_level, l AS lang_level, p AS topic_level, n_tokens, round(coalesce(q, 1), 6) AS probability, u < coalesce(q, 1) AS kept
FROM rows LEFT JOIN (SELECT s, l, p, (w / tokens) / max(w / tokens) OVER () AS q FROM w{n}) USING (s, l, p)
"""
    )


@query("op6_raking", raking_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's calibrated probability and whether it is drawn."""
    rows = raking.calibrated(read(spark, sf_dir, "documents"))
    return rows.select(
        "row.doc_id",
        F.col("source").alias("source_level"),
        F.col("lang").alias("lang_level"),
        F.col("topic").alias("topic_level"),
        F.col("tokens").alias("n_tokens"),
        F.round("probability", 6).alias("probability"),
        (F.col("u") < F.col("probability")).alias("kept"),
    )


#: Host, path prefix, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_SQL = """
WITH u AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
j AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


@query("op7_digest_array", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest rule that fits."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return digest_array.filter_urls(read(spark, sf_dir, "pages"), rules)


@query("op10_partenum")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets are similar to 0.75 or more."""
    return partenum.near_duplicates(read(spark, sf_dir, "documents"))


@query("op4_recurrent_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; one id in five never taught."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` on the whole table of documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for the personal data in them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # a fixed key, so that results can be compared; a real one is a secret of the caller
    return surrogates.pseudonymise(docs, b"example key", count="n_replaced")


@query("op8_templates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = templates.extract_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op3_multiprobe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector."""
    return multiprobe.nearest(read(spark, sf_dir, "embeddings"))


@query("op9_deep_shallow")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats for 400 bytes or more, removed from every whole text."""
    summary, cuts = suffixes.deduplicate(read(spark, sf_dir, "documents"))
    cuts = cuts.select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    none = F.lit(0).cast("bigint")
    return summary.join(cuts, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def codes_sql(rounds: int = equal_average.ROUNDS) -> str:
    """Rounds of assignment and floored means as a chain of tables; a distance and an index in one number."""
    steps = [
        """kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, len(embedding) // 8 AS w,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "parts AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, (SELECT unnest(range(8)) AS p))",
        "c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 16)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT rid, p, min(CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - c.x[j]) * (q.x[j] - c.x[j]))) AS BIGINT) * 16 + e) AS m
    FROM parts q JOIN c{i} c USING (p) GROUP BY rid, p
)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
            SELECT p, m % 16 AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n
            FROM a{i} JOIN parts USING (rid, p), (SELECT unnest(range(1, (SELECT max(w) FROM kept) + 1)) AS j) GROUP BY ALL
        ) GROUP BY p, e
    ) n USING (p, e)
)"""
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN (SELECT rid, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY rid) USING (rid)
"""
    )


@query("op11_equal_average", codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the errors of equal labels."""
    vectors = read(spark, sf_dir, "embeddings")
    books = equal_average.fit(vectors)
    coded = equal_average.with_group_error(equal_average.encode(vectors, books, keep=["vec_id", "label"]), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


@query("op12_hidden_markov")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every whole text under a hidden Markov model of the texts that teach."""
    return hidden_markov.language_model(read(spark, sf_dir, "documents"))


#: CRC-32 of an ASCII string, bit by bit.
CRC_SQL = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),"
    " lambda acc, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(acc, b)),"
    " CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
)

TRIE_SQL = f"""
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r,
           md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT c, count(*) AS n, c - c % 100 AS b, {CRC_SQL.format("CAST(c AS VARCHAR)")} % 6 AS h FROM t GROUP BY c),
counted AS (SELECT o.*, least(o.h, coalesce(f.n, 0)) AS nb FROM own o LEFT JOIN own f ON f.c = o.b),
rebuilt AS (
    SELECT o.c, t.r AS k, t.id, t.chars FROM counted o JOIN t ON t.c = o.b AND t.r <= o.h
    UNION ALL SELECT o.c, o.nb + t.r - o.h, t.id, t.chars FROM counted o JOIN t ON t.c = o.c AND t.r > o.h
),
paths AS (
    SELECT own.c, list(id ORDER BY k) FILTER (id IS NOT NULL) AS ids, list(chars ORDER BY k) FILTER (id IS NOT NULL) AS ch
    FROM own LEFT JOIN rebuilt USING (c) GROUP BY own.c
),
prefixes AS (
    SELECT c, d, coalesce(array_to_string(ids[1:d], ''), '') AS pre, coalesce(ch[d], 0) AS chars, d = coalesce(len(ids), 0) AS ends
    FROM (SELECT *, unnest(range(coalesce(len(ids), 0) + 1)) AS d FROM paths)
),
nodes AS (
    SELECT d, pre, min(c) AS conv, count(*) AS n, max(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends
    FROM prefixes GROUP BY d, pre
),
kids AS (SELECT d - 1 AS d, left(pre, (d - 1) * 32) AS pre, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (d, pre)),
under AS (
    SELECT a AS d, left(pre, a * 32) AS pre, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * chars) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL
)
SELECT f.conv AS conv_id, CAST(f.d AS BIGINT) AS depth, up.conv AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN under u USING (d, pre) LEFT JOIN nodes up ON up.d = f.d - 1 AND up.pre = left(f.pre, (f.d - 1) * 32)
"""


@query("op13_burst_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    found = burst_trie.trie(read(spark, sf_dir, "conversations"), graft=True)
    return found.withColumn("depth", F.col("depth").cast("bigint"))
