"""Keys, sequences, variants, shingles, vocabulary and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY
from coobs.functions import sequences as S, text as T
from coobs.functions.binding import explode_once
from coobs.functions.numeric import ratio
from coobs.operators import corpus, folds, variants as V
from coobs.queries import fixtures as fx
from coobs.queries.registry import oracle, query, rounded, rs
from coobs.session import cut_lineage

SEED = 7
MAX_LEN = 64


@query(
    "sq_1_entity_key",
    r"""SELECT doc_id, md5(k1) AS key_md5, k1 = CASE WHEN length(k2) > 0 THEN k2 ELSE k1 END AS idempotent FROM
        (SELECT doc_id, k1, trim(regexp_replace(regexp_replace(lower(k1), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g')) AS k2 FROM
         (SELECT doc_id, CASE WHEN length(k) > 0 THEN k ELSE text END AS k1 FROM
          (SELECT doc_id, text, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g')) AS k FROM documents)))""",
)
def sq_1(spark, sf_dir):
    d = fx.raw_table(spark, sf_dir, "documents").select("doc_id", T.canonical_text(F.col("text")).alias("k"))
    return d.select(
        "doc_id", F.md5("k").alias("key_md5"), (T.canonical_text(F.col("k")) == F.col("k")).alias("idempotent")
    )


_LOOSE = """SELECT *, u AS unit, list_min(list_transform(range(1, len(u) + 1), lambda i: u[i:] || u[:i - 1])) AS key FROM
  (SELECT *, s[1:list_filter(range(1, len(s) + 1), lambda p: len(s) % p = 0 AND repeat(s[1:p], CAST(len(s) // p AS BIGINT)) = s)[1]] AS u FROM {t})"""


@query(
    "sq_2_loose_key",
    oracle(
        "SELECT source, id, length(unit) AS period, key FROM ("
        + _LOOSE.format(
            t="""(SELECT 'page' AS source, page_id AS id, url AS s FROM pages UNION ALL
                  SELECT 'part', entity, s FROM parts UNION ALL
                  SELECT 'part_rewritten', entity, repeat(s[4:] || s[:3], 3) FROM parts)"""
        )
        + ")",
        "parts",
    ),
)
def sq_2(spark, sf_dir):
    pages = fx.raw_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), T.char_tokens(F.col("url")).alias("seq")
    )
    p = fx.parts(spark, sf_dir).select(F.lit("part").alias("source"), F.col(ENTITY).alias("id"), "seq")
    again = p.select(
        F.lit("part_rewritten").alias("source"), "id", S.repeat_unit(S.rotate(F.col("seq"), 3), 3).alias("seq")
    )
    return pages.unionByName(p).unionByName(again).select(
        "source",
        "id",
        S.smallest_period(F.col("seq")).cast("long").alias("period"),
        S.spell(S.loose_key(F.col("seq"))).alias("key"),
    )


@query("sq_3_repeat_unit", oracle("SELECT entity, repeat(s, 3) AS trimer, 3 * length(s) AS n FROM parts", "parts"))
def sq_3(spark, sf_dir):
    p = fx.parts(spark, sf_dir).select(ENTITY, S.repeat_unit(F.col("seq"), 3).alias("t"))
    return p.select(ENTITY, S.spell(F.col("t")).alias("trimer"), F.size("t").cast("long").alias("n"))


@query(
    "sq_4_rotate",
    oracle(
        """SELECT entity, s[3:] || s[:2] AS by_two, s[(1 + length(s) // 2)::BIGINT:] || s[:(length(s) // 2)::BIGINT] AS by_half, s[:1] AS single
           FROM parts""",
        "parts",
    ),
)
def sq_4(spark, sf_dir):
    seq = F.col("seq")
    return fx.parts(spark, sf_dir).select(
        ENTITY,
        S.spell(S.rotate(seq, 2)).alias("by_two"),
        S.spell(S.rotate(seq, F.floor(F.size(seq) / 2).cast("int"))).alias("by_half"),
        S.spell(S.rotate(F.slice(seq, 1, 1), 5)).alias("single"),
    )


_ORDERED = """SELECT entity, v, min(ord) AS ord FROM (SELECT entity, s AS v, 0 AS ord FROM parts UNION ALL
  SELECT entity, v, CASE kind WHEN 'permutational' THEN 1 WHEN 'translational' THEN 3 ELSE 5 END + i FROM part_variants) GROUP BY entity, v"""


@query(
    "sq_5_variants",
    oracle(
        f"""SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY ord) - 1 AS INTEGER) AS n, v AS variant
            FROM ({_ORDERED}) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ord) <= 5""",
        "part_variants",
    ),
)
def sq_5(spark, sf_dir):
    out = V.distinct_variants(fx.parts(spark, sf_dir), ENTITY, "seq", limit=5)
    return out.select(ENTITY, "n", S.spell(F.col("variant")).alias("variant"))


@query(
    "sq_6_shingle_sets",
    oracle(
        """SELECT d.entity, d.ours, count(s.shingle) AS n, min(s.shingle) AS first, max(s.shingle) AS last
           FROM docs d LEFT JOIN doc_shingles s ON s.entity = d.entity GROUP BY d.entity, d.ours""",
        "docs",
        "doc_shingles",
    ),
)
def sq_6(spark, sf_dir):
    ours, others = fx.shingle_sets(spark, sf_dir)
    both = ours.withColumn("ours", F.lit(True)).unionByName(others.withColumn("ours", F.lit(False)))
    return both.select(
        ENTITY,
        "ours",
        F.size("shingles").cast("long").alias("n"),
        F.array_min("shingles").alias("first"),
        F.array_max("shingles").alias("last"),
    )


_BITS = 1024


@query(
    "sq_7_folded_bits",
    oracle(
        f"""SELECT entity, count(DISTINCT b) AS n_bits, min(b) AS lowest, max(b) AS highest FROM
            (SELECT entity, CAST(CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) % {_BITS} AS INTEGER) AS b
             FROM doc_shingles WHERE ours) GROUP BY entity""",
        "doc_shingles",
    ),
)
def sq_7(spark, sf_dir):
    ours, _ = fx.shingle_sets(spark, sf_dir)
    bits = ours.where(F.size("shingles") > 0).select(ENTITY, T.folded_bits(F.col("shingles"), _BITS).alias("bits"))
    return bits.select(
        ENTITY,
        F.size("bits").cast("long").alias("n_bits"),
        F.array_min("bits").alias("lowest"),
        F.array_max("bits").alias("highest"),
    )


@query(
    "sq_7_fold_saturation",
    oracle(
        f"""SELECT count(*) AS bits_used, {rs(f'count(*) / {_BITS}.0')} AS share_used, max(n) AS max_rows, min(n) AS min_rows FROM
            (SELECT b, count(DISTINCT entity) AS n FROM
             (SELECT entity, CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) % {_BITS} AS b FROM doc_shingles WHERE NOT ours) GROUP BY b)""",
        "doc_shingles",
    ),
)
def sq_7_saturation(spark, sf_dir):
    """A corpus fills every folded bit, which is why novelty uses unfolded shingles."""
    _, others = fx.shingle_sets(spark, sf_dir)
    bits = others.select(T.folded_bits(F.col("shingles"), _BITS).alias("bits"))
    return rounded(corpus.fold_saturation(bits, _BITS))


def _novelty(spark, sf_dir):
    ours, others = fx.shingle_sets(spark, sf_dir)
    return corpus.novelty(ours, corpus.document_frequency(others, ours))


_NOV = "mean_log_df min_log_df share_unseen share_rare".split()


@query(
    "sq_8_novelty",
    oracle("SELECT entity, n_shingles, " + ", ".join(f"{rs(c)} AS {c}" for c in _NOV) + " FROM novelty", "novelty"),
)
def sq_8(spark, sf_dir):
    return rounded(_novelty(spark, sf_dir))


@query(
    "sq_9_any_unseen",
    oracle("SELECT share_unseen > 0 AS out_of_domain, count(*) AS n FROM novelty GROUP BY 1", "novelty"),
)
def sq_9(spark, sf_dir):
    return corpus.flag_any_unseen(_novelty(spark, sf_dir)).groupBy("out_of_domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sq_9_above_median",
    oracle(
        "SELECT entity, share_unseen > (SELECT median(share_unseen) FROM novelty) AS out_of_domain FROM novelty",
        "novelty",
    ),
)
def sq_9_median(spark, sf_dir):
    return corpus.flag_above_median(_novelty(spark, sf_dir)).select(ENTITY, "out_of_domain")


@query(
    "sq_10_tokens",
    oracle(
        """SELECT entity, len(tokens) AS n_words, list_min(tokens) AS first, list_max(tokens) AS last, length(text) AS n_chars
           FROM doc_tokens JOIN docs USING (entity)""",
        "doc_tokens",
    ),
)
def sq_10(spark, sf_dir):
    ours, others = fx.documents(spark, sf_dir)
    return (
        ours.unionByName(others)
        .select(ENTITY, T.word_tokens(F.col("text")).alias("w"), F.size(T.char_tokens(F.col("text"))).alias("c"))
        .select(
            ENTITY,
            F.size("w").cast("long").alias("n_words"),
            F.array_min("w").alias("first"),
            F.array_max("w").alias("last"),
            F.col("c").cast("long").alias("n_chars"),
        )
    )


def _tokens(spark, sf_dir):
    ours, others = fx.documents(spark, sf_dir)
    words = T.word_tokens(F.col("text"))
    return explode_once(ours.unionByName(others), [], words, "token"), explode_once(ours, [], words, "token")


_VOCAB = {
    "counts": """SELECT token, count(*) AS n, bool_or(ours) AS need FROM
                 (SELECT ours, unnest(tokens) AS token FROM doc_tokens) GROUP BY token""",
    "vocab": """SELECT token, n, CAST(row_number() OVER (ORDER BY n < 5, n DESC, token) + 4 AS INTEGER) AS id
                FROM counts WHERE n >= 5 OR need""",
}


@query(
    "sq_11_vocabulary",
    oracle(
        """SELECT token, n, id FROM vocab UNION ALL
           SELECT * FROM (VALUES ('<pad>', 0, 0), ('<mask>', 0, 1), ('<unk>', 0, 2), ('<bos>', 0, 3), ('<eos>', 0, 4))""",
        "doc_tokens",
        extra=_VOCAB,
    ),
)
def sq_11(spark, sf_dir):
    return corpus.vocabulary(*_tokens(spark, sf_dir))


def _encoded(spark, sf_dir):
    ours, others = fx.documents(spark, sf_dir)
    every, required = _tokens(spark, sf_dir)
    vocab = cut_lineage(corpus.vocabulary(every, required), "vocabulary")
    rows = ours.unionByName(others).select(ENTITY, T.word_tokens(F.col("text")).alias("tokens"))
    return corpus.encode(rows, vocab, ENTITY, MAX_LEN), vocab


_ENC = {
    **_VOCAB,
    "ids": f"""SELECT entity, CAST(pos AS INTEGER) AS pos, coalesce(v.id, 2) AS id FROM
               (SELECT entity, unnest(tokens[1:{MAX_LEN - 2}]) AS token, unnest(range(1, least(len(tokens), {MAX_LEN - 2}) + 1)) AS pos FROM doc_tokens) t
               LEFT JOIN vocab v ON v.token = t.token""",
    "enc": f"""SELECT entity, list_concat(list_concat([3], b), list_concat([4], list_resize(CAST([] AS INTEGER[]), {MAX_LEN - 2} - len(b), 0))) AS ids FROM
               (SELECT d.entity, coalesce(list(i.id ORDER BY i.pos) FILTER (WHERE i.id IS NOT NULL), CAST([] AS INTEGER[])) AS b
                FROM doc_tokens d LEFT JOIN ids i ON i.entity = d.entity GROUP BY d.entity)""",
}


@query(
    "sq_12_encode",
    oracle("SELECT entity, array_to_string(ids, ' ') AS ids FROM enc", "doc_tokens", extra=_ENC),
)
def sq_12(spark, sf_dir):
    return _encoded(spark, sf_dir)[0].select(ENTITY, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "sq_13_truncation",
    f"""SELECT count(*) AS n, {rs('avg(n_chars)')} AS mean_len, {rs('avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END)')} AS share_truncated,
        {rs('sum(greatest(n_chars - 2000, 0)) / sum(n_chars)')} AS share_dropped, {rs('quantile_cont(n_chars, 0.99)')} AS p99 FROM
        (SELECT length(text) AS n_chars FROM documents)""",
)
def sq_13(spark, sf_dir):
    d = fx.raw_table(spark, sf_dir, "documents")
    return rounded(corpus.truncation_stats(d, F.length("text"), 2000))


def _u(what: str) -> str:
    return f"CAST('0x' || substr(md5(entity || '|' || (pos - 1) || '|{SEED}-{what}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "sq_14_masking",
    oracle(
        f"""SELECT entity, CAST(count(*) FILTER (WHERE chosen) AS BIGINT) AS n_chosen,
            CAST(count(*) FILTER (WHERE new = 1) AS BIGINT) AS n_masked,
            array_to_string(list(new ORDER BY pos), ' ') AS ids,
            array_to_string(list(CASE WHEN chosen THEN x ELSE -100 END ORDER BY pos), ' ') AS labels FROM
            (SELECT *, CASE WHEN NOT chosen THEN x WHEN {_u('kind')} < 0.8 THEN 1
                 WHEN {_u('kind')} < 0.9 THEN CAST(floor({_u('token')} * (SELECT count(*) FROM vocab)) + 5 AS INTEGER) ELSE x END AS new FROM
             (SELECT *, x NOT IN (0, 3, 4) AND {_u('pick')} < 0.15 AS chosen FROM
              (SELECT entity, unnest(ids) AS x, unnest(range(1, {MAX_LEN + 1})) AS pos FROM enc)))
            GROUP BY entity""",
        "doc_tokens",
        extra=_ENC,
    ),
)
def sq_14(spark, sf_dir):
    encoded, vocab = _encoded(spark, sf_dir)
    size = vocab.agg(F.count(F.lit(1))).scalar()
    out = corpus.mask_tokens(encoded, ENTITY, vocab_size=size, seed=SEED)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return out.select(
        ENTITY,
        F.size(F.filter("labels", lambda x: x != corpus.IGNORE)).cast("long").alias("n_chosen"),
        F.size(F.filter("ids", lambda x: x == corpus.MASK)).cast("long").alias("n_masked"),
        text("ids").alias("ids"),
        text("labels").alias("labels"),
    )


@query(
    "sq_15_assemble_corpus",
    oracle(
        f"""SELECT source, item, md5(text) AS text_md5, row_number() OVER (ORDER BY md5(source || '|' || item || '|' || text || '|{SEED}'), source, item, text) - 1 AS position FROM
            (SELECT 'core' AS source, CAST(entity AS VARCHAR) AS item, v AS text FROM ({_ORDERED}) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ord) <= 3
             UNION ALL SELECT * FROM (SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents ORDER BY md5(doc_id || '|{SEED}-documents'), doc_id LIMIT 120)
             UNION ALL SELECT * FROM (SELECT 'pages', CAST(page_id AS VARCHAR), url FROM pages ORDER BY md5(page_id || '|{SEED}-pages'), page_id LIMIT 30))""",
        "part_variants",
    ),
)
def sq_15(spark, sf_dir):
    core = V.distinct_variants(fx.parts(spark, sf_dir), ENTITY, "seq", limit=3)
    core = core.select(F.col(ENTITY).alias("k"), S.spell(F.col("variant")).alias("text"))
    docs = fx.raw_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    pages = fx.raw_table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.col("url").alias("text"))
    out = corpus.assemble_corpus(core, {"documents": (docs, 120), "pages": (pages, 30)}, "k", "text", SEED)
    return out.select("source", "item", F.md5("text").alias("text_md5"), "position")


_PART_FOLDS = {
    "pf": f"""SELECT *, CAST((row_number() OVER (PARTITION BY property ORDER BY md5(entity || '|42'), entity) - 1) % {fx.FOLDS} AS INTEGER) AS fold,
              count(*) OVER (PARTITION BY property) AS n FROM parts""",
    "aug": """SELECT entity, property, value, s, fold, false AS augmented FROM pf UNION ALL
              SELECT entity, property, value, s || s, fold, true FROM pf WHERE n < (SELECT avg(c) FROM (SELECT count(*) AS c FROM parts GROUP BY property))""",
}


@query(
    "sq_16_train_only_augmentation",
    oracle(
        """SELECT property, augmented, CAST(count(*) FILTER (WHERE fold <> 1) AS BIGINT) AS n_train,
           CAST(count(*) FILTER (WHERE fold = 1 AND NOT augmented) AS BIGINT) AS n_valid, CAST(sum(length(s)) AS BIGINT) AS n_units
           FROM aug GROUP BY property, augmented""",
        "parts",
        extra=_PART_FOLDS,
    ),
)
def sq_16(spark, sf_dir):
    rows = folds.property_folds(fx.parts(spark, sf_dir), k=fx.FOLDS, seed=42)
    # 400 in real use; the mean property size makes the rule bite at any scale
    n = rows.groupBy(PROPERTY).count().agg(F.avg("count")).scalar()
    aug = V.augment_small(rows, "seq", below=n, max_groups=1000)
    train = V.training_view(aug, 1).select(PROPERTY, "augmented", "seq", F.lit(1).alias("t"), F.lit(0).alias("v"))
    valid = V.validation_view(aug, 1).select(PROPERTY, "augmented", "seq", F.lit(0).alias("t"), F.lit(1).alias("v"))
    hidden = aug.where((F.col("fold") == 1) & F.col("augmented")).select(
        PROPERTY, "augmented", "seq", F.lit(0).alias("t"), F.lit(0).alias("v")
    )
    return (
        train.unionByName(valid)
        .unionByName(hidden)
        .groupBy(PROPERTY, "augmented")
        .agg(
            F.sum("t").alias("n_train"), F.sum("v").alias("n_valid"), F.sum(F.size("seq")).alias("n_units")
        )
    )


@query(
    "sq_17_composition",
    f"""SELECT doc_id, length(regexp_replace(text, '[^aeiou]', '', 'g')) AS n_vowels, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
        length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS n_marks,
        {rs("length(regexp_replace(text, '[^aeiou]', '', 'g')) / greatest(length(text), 1)")} AS share_vowels,
        {rs("length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)")} AS share_digits,
        {rs("length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / greatest(length(text), 1)")} AS share_marks FROM documents""",
)
def sq_17(spark, sf_dir):
    t = F.col("text")
    size = F.greatest(F.length(t), F.lit(1))
    counts = {"vowels": "[aeiou]", "digits": "[0-9]", "marks": "[.,;:!?]"}
    d = fx.raw_table(spark, sf_dir, "documents")
    d = d.select("doc_id", "text", *[T.count_matches(t, p).cast("long").alias(f"n_{c}") for c, p in counts.items()])
    return rounded(
        d.select("doc_id", *[f"n_{c}" for c in counts], *[ratio(F.col(f"n_{c}"), size).alias(f"share_{c}") for c in counts])
    )


@query(
    "sq_18_average_variants",
    oracle(
        f"""SELECT entity, {rs(f"avg({fx.toy_sql('v')})")} AS pred, count(*) AS n_variants FROM
            (SELECT entity, s AS v FROM parts UNION ALL SELECT entity, v FROM part_variants) GROUP BY entity""",
        "part_variants",
    ),
)
def sq_18(spark, sf_dir):
    v = V.with_variants(fx.parts(spark, sf_dir), "seq")
    return rounded(V.average_variants(v.withColumn("pred", fx.toy_predictor(F.col("variant"))), [ENTITY]))


@query(
    "evl_7_invariance_audit",
    oracle(
        f"""SELECT kind, count(*) AS n, CAST(count(*) FILTER (WHERE rw) AS BIGINT) AS n_rewritten,
            CAST(count(*) FILTER (WHERE rw AND moved) AS BIGINT) AS n_key_moved,
            {rs('avg(d) FILTER (WHERE rw)')} AS mean_delta, {rs('max(d) FILTER (WHERE rw)')} AS max_delta,
            {rs('median(d) FILTER (WHERE rw)')} AS median_delta, {rs('median(d / scale) FILTER (WHERE rw)')} AS median_rel,
            max(d) FILTER (WHERE rw) <= 1e-9 AS exact FROM
            (SELECT kind, v <> s AS rw, lower(v) <> lower(s) AS moved, abs({fx.toy_sql('v')} - {fx.toy_sql('s')}) AS d,
                    greatest(abs(value), 1e-9) AS scale FROM part_variants) GROUP BY kind""",
        "part_variants",
    ),
)
def evl_7(spark, sf_dir):
    key = lambda s: F.lower(S.spell(s))
    audit = V.invariance_rows(fx.parts(spark, sf_dir), "seq", key, fx.toy_predictor)
    return rounded(V.invariance_audit(audit))


@query(
    "evl_7_invariance_by_property",
    oracle(
        f"""SELECT kind, property, {rs('median(d)')} AS median_delta FROM
            (SELECT kind, property, abs({fx.toy_sql('v')} - {fx.toy_sql('s')}) AS d FROM part_variants WHERE v <> s) GROUP BY kind, property""",
        "part_variants",
    ),
)
def evl_7_property(spark, sf_dir):
    key = lambda s: F.lower(S.spell(s))
    audit = V.invariance_rows(fx.parts(spark, sf_dir), "seq", key, fx.toy_predictor)
    return rounded(V.invariance_by_property(audit))


_FEATS_SQL = [
    ("iv", fx.vowel_sql("{x}")),
    ("iv", "(length(regexp_replace({x}, '[^ ]', '', 'g')) / greatest(length({x}), 1))"),
    ("el", "length({x})"),
    ("el", "length(regexp_replace(lower({x}), '[^aeiou]', '', 'g'))"),
]


@query(
    "evl_8_feature_invariance",
    oracle(
        f"SELECT kind, family, count(*) AS n_values, {rs('avg(CAST(abs(b - a) / (abs(a) + 1e-6) < 0.02 AS INTEGER))')} AS share_unchanged FROM ("
        + " UNION ALL ".join(
            f"SELECT kind, '{f}' AS family, CAST({e.format(x='s')} AS DOUBLE) AS a, CAST({e.format(x='v')} AS DOUBLE) AS b FROM part_variants WHERE i = 0"
            for f, e in _FEATS_SQL
        )
        + ") GROUP BY kind, family",
        "part_variants",
    ),
)
def evl_8(spark, sf_dir):
    blank = lambda s: F.size(F.filter(s, lambda t: t == " "))
    size = lambda s: F.greatest(F.size(s), F.lit(1))
    feats = {
        "iv_vowels": fx.vowel_share,
        "iv_blanks": lambda s: blank(s) / size(s),
        "el_size": F.size,
        "el_vowels": lambda s: F.size(F.filter(s, lambda t: F.lower(t).isin("a", "e", "i", "o", "u"))),
    }
    return rounded(V.feature_invariance(fx.parts(spark, sf_dir), "seq", feats))


@query(
    "evl_8_key_selftest",
    oracle(
        f"""SELECT kind, count(*) AS n, {rs('avg(CAST(a.key = b.key AS INTEGER))')} AS rate, avg(CAST(a.key = b.key AS INTEGER)) >= 0.9 AS passed FROM
            ({_LOOSE.format(t='(SELECT entity, kind, i, lower(v) AS s FROM part_variants)')}) a JOIN
            ({_LOOSE.format(t='(SELECT entity, lower(s) AS s FROM parts)')}) b ON a.entity = b.entity GROUP BY kind""",
        "part_variants",
    ),
)
def evl_8_selftest(spark, sf_dir):
    key = lambda s: S.spell(S.loose_key(F.transform(s, F.lower)))
    return rounded(V.key_selftest(fx.parts(spark, sf_dir), "seq", key))


@query(
    "evl_10_spelling_spread",
    oracle(
        f"""SELECT property, count(*) AS n, {rs('avg(w / sd)')} AS spread_normalised, {rs('avg(r / sd)')} AS spread_raw,
            {rs('avg(r / sd) / greatest(avg(w / sd), 1e-9)', 3)} AS ratio FROM
            (SELECT v.entity, v.property, stddev_pop({fx.toy_sql('v.key')}) AS w, stddev_pop({fx.toy_sql('v.v')}) AS r FROM
             ({_LOOSE.format(t='(SELECT entity, property, v, v AS s FROM (SELECT entity, property, v FROM part_variants UNION ALL SELECT entity, property, s FROM parts))')}) v
             GROUP BY v.entity, v.property)
            JOIN (SELECT property, greatest(stddev_samp(value), 1e-9) AS sd FROM parts GROUP BY property) USING (property) GROUP BY property""",
        "part_variants",
    ).replace("v.key", "v.unit"),
)
def evl_10(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    out = V.spelling_spread(p, p, ENTITY, "seq", S.unit, fx.toy_predictor, max_groups=1000)
    return rounded(out, ratio=3)


