"""The pipeline's stages, each judged on its own input."""

import collections

import pytest
from test_llm_operators import components_of

import corpus_pipeline
from coobs.llm import toxicity
from coobs.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


def test_columns(stages):
    given = stages[0][1].columns
    assert all(after.columns == given for _, _, after in stages[:-1])
    assert stages[-1][2].columns == [*given, "shard"]


def test_toxic_go(spark, sf_dir, stages):
    _, docs, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, s in scored.items() if s < 0.5}


def test_one_of_each_group_stays(stages):
    _, docs, after = stages[1]
    rows = docs.collect()
    expect = sorted({c if n else rows[i]["doc_id"] for i, (n, c) in components_of(rows).items()})
    assert sorted(r["doc_id"] for r in after.collect()) == expect


def test_contaminated_go(spark, sf_dir, stages):
    _, docs, after = stages[2]
    found = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in after.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = set()
    for w in map(words, bench):
        m = min(10, len(w))
        windows |= {tuple(w[p : p + m]) for p in range(len(w) - m + 1 if m else 0)}
    sizes = {len(w) for w in windows}
    expect = set()
    for r in docs.collect():
        w = words(r["text"])
        if any(tuple(w[p : p + m]) in windows for m in sizes for p in range(len(w) - m + 1)):
            expect.add(r["doc_id"])
    assert found == expect


def test_mix_draws_from_its_input(stages):
    _, docs, after = stages[3]
    assert {r["doc_id"] for r in after.collect()} < {r["doc_id"] for r in docs.collect()}


def test_shards_balance(stages):
    _, docs, after = stages[4]
    rows = after.collect()
    assert len(rows) == docs.count()
    load = collections.Counter({s: 0 for s in range(16)})
    for r in rows:
        load[r["shard"]] += len((r["text"] or "").encode()) + 1
    largest = max(len((r["text"] or "").encode()) + 1 for r in rows)
    assert max(load.values()) - min(load.values()) <= largest


#: Names that helpers of the operators use, or used.
HELPERS = (
    "_id _digest _key _heavy _light _crate _text _score _tokens _source _lang _topic _u _n _c0 _c1 row own bad tokens topic u "
    "probability free ratio score comp least key crate bucket digest hits n_words n_hit items fp pos"
).split()


@pytest.mark.parametrize("n", range(5))
def test_clashing_columns(spark, sf_dir, n):
    """Every stage gives the same documents, and every column as it was, whatever else a table holds."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in HELPERS])
    _, stage = corpus_pipeline.STAGES[n]
    plain = {r["doc_id"]: r for r in stage(spark, docs, sf_dir).collect()}
    got = stage(spark, wide, sf_dir)
    assert got.columns == [*wide.columns, *(["shard"] if n == 4 else [])]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(plain)
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in HELPERS)
    assert all(r[c] == plain[r["doc_id"]][c] for r in rows for c in docs.columns)
