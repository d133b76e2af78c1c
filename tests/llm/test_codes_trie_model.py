"""Equal-average codes, burst tries and the hidden Markov model against plain computations."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coobs.llm import burst_trie, equal_average, hidden_markov
from coobs.llm.queries import CRC_SQL

# ---- codes --------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    """[(vec_id, code, error)] and entries by exhaustive search, in plain integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    whole = [[math.floor(scale * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in whole:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for r, v in zip(kept, whole):
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
    return out, books


def vectors(seed=3, n=90, dim=16):
    rng = random.Random(seed)
    rows = [(i * 3 % n, [round(rng.gauss(0, 0.2), 2) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [rows[5], (rows[7][0], rows[8][1], 1), (None, rows[9][1], 2)]  # repeated row, repeated id, null id
    rows += [(500, None, 1), (501, [None] * dim, 1), (502, [math.nan] + [0.0] * (dim - 1), 1), (503, [math.inf] * dim, None), (504, [0.0] * dim, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("entries", "parts"), [(16, 8), (5, 4)])
def test_codes(spark, entries, parts):
    rows = vectors()
    given = spark.createDataFrame(rows, SCHEMA).withColumn("_vector", F.lit("x")).withColumn("code", F.lit(1)).withColumn("_group", F.col("label"))
    books = equal_average.fit(given, entries=entries, parts=parts)
    expect, entry = plain_codes(rows, parts, entries, equal_average.ROUNDS, equal_average.SCALE)
    assert books.entries.tolist() == entry
    coded = equal_average.encode(given, books)
    assert collections.Counter((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == collections.Counter(expect)
    assert coded.columns == ["vec_id", "embedding", "label", "_vector", "_group", "code", "error"]
    sums = collections.Counter()
    for r in coded.collect():
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in equal_average.with_group_error(coded, "label").collect())


def test_codes_of_odd_tables(spark):
    assert equal_average.fit(spark.createDataFrame([], SCHEMA)) is None
    none = equal_average.encode(spark.createDataFrame([(1, None, 1)], SCHEMA), None)
    assert none.count() == 0
    rows = [(1, [0.5, 0.25, -0.1], 1), (2, [], 1), (3, [1.0] * 9, None), (4, [1e300, -1e300], 0)]  # lengths differ, components beyond the limit
    given = spark.createDataFrame(rows, SCHEMA)
    books = equal_average.fit(given, entries=3)
    assert books.shape == (8, 3, 2)
    got = {r["vec_id"]: r for r in equal_average.encode(given, books).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r["error"] >= 0 for r in got.values())
    top = equal_average.limit(2)
    same = equal_average.fit(spark.createDataFrame([*rows[:3], (4, [top / 4096.0, -top / 4096.0], 0)], SCHEMA), entries=3)
    assert same.entries.tolist() == books.entries.tolist()


def test_search_is_exact_and_spares_distances():
    rng = np.random.default_rng(5)
    entries = rng.integers(-300, 300, (64, 8)) + rng.integers(-300, 300, (64, 1))
    entries[9] = entries[4]  # ties between equal entries
    book, x = equal_average.Codebook(entries), rng.integers(-300, 300, (5000, 8)) + rng.integers(-300, 300, (5000, 1))
    looked: list[int] = []
    index, best = book.nearest(x, looked)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert sum(looked) < 0.8 * len(x) * len(entries)


def test_bound_is_strict():
    # the second entry has the lower index and its squared gap over width equals the best distance
    book = equal_average.Codebook(np.array([[2, 2], [0, 0]]))
    index, best = book.nearest(np.array([[1, 1]]))
    assert index.tolist() == [0] and best.tolist() == [2]


def test_decoded_vectors_are_near(spark):
    given = spark.createDataFrame(vectors(n=200), SCHEMA)
    books = equal_average.fit(given)
    far = 0.0
    for r in equal_average.encode(given, books).collect():
        d = sum((a - b) ** 2 for a, b in zip(books.decode(r["code"]), r["embedding"]))
        far = max(far, abs(d - r["error"] / books.scale**2))
    assert far < 0.02


# ---- tries --------------------------------------------------------------------------------------


def plain_trie(rows, graft):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        base = own.get(c - int(math.fmod(c, 100)), [])
        built[c] = tuple(base[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = {}
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out[(min(m), len(p))] = (parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def talks(seed, convs=300):
    rng = random.Random(seed)
    long = [("user" if i % 2 else "bot", f"long {i} é") for i in range(60)]
    rows = []
    for c in range(-40, convs):
        kind = rng.random()
        if kind < 0.35:  # copies
            turns = [("user", "hello"), ("bot", "how are you?"), ("user", "well")]
        elif kind < 0.6:  # beginnings of one long conversation
            turns = long[: rng.randint(1, 60)]
        else:
            turns = [(rng.choice(["user", "bot", None, ""]), rng.choice(["a", "bb", "", None, "ccc 👍"])) for _ in range(rng.randint(1, 9))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, None if rng.random() < 0.05 else i // (1 + (rng.random() < 0.1)), role, text))
    rows += [rows[3], rows[3], (None, 1, "user", "nobody"), (7 + 10**9, 1, "user", "x" * 50_000)]
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limits", [{}, {"rows": 8, "turns": 30}, {"rows": 1, "turns": 1}])
@pytest.mark.parametrize("graft", [True, False])
def test_trie(spark, graft, limits, monkeypatch):
    monkeypatch.setattr(burst_trie, "PACK", 7)
    rows = talks(4)
    given = spark.createDataFrame(rows, TALK).withColumn("head", F.lit(1)).withColumn("conv", F.lit(2))
    got = {}
    for r in burst_trie.trie(given, graft=graft, **limits).collect():
        assert (r["conv_id"], r["depth"]) not in got
        got[(r["conv_id"], r["depth"])] = tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    assert got == plain_trie(rows, graft)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TALK)
    assert burst_trie.trie(empty, graft=True).count() == 0
    # conversation 205 asks for turns of an absent one and has no turns of its own left
    c = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 1)
    (root,) = burst_trie.trie(spark.createDataFrame([(c, 0, "user", "gone")], TALK), graft=True).collect()
    assert (root["conv_id"], root["depth"], root["n_convs"], root["n_leaves"], root["parent_conv_id"]) == (c, 0, 1, 1, None)
    assert root["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_crc_in_sql():
    import duckdb

    for c in (0, -77, 123456, 10**12):
        assert duckdb.sql(f"SELECT {CRC_SQL.format(repr(str(c)))}").fetchall() == [(zlib.crc32(str(c).encode()),)]


# ---- language model -----------------------------------------------------------------------------


def plain_chain(chain, seq):
    """Log10 likelihood, state shares, expected transitions by the unscaled recursions."""
    states, n = len(chain.first), len(seq)
    a, b = np.zeros((n, states)), np.ones((n, states))
    a[0] = chain.first * chain.emit[seq[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ chain.after) * chain.emit[seq[t]]
    for t in range(n - 2, -1, -1):
        b[t] = chain.after @ (chain.emit[seq[t + 1]] * b[t + 1])
    p = a[-1].sum()
    pairs = sum((np.outer(a[t], chain.emit[seq[t + 1]] * b[t + 1]) * chain.after / p for t in range(n - 1)), np.zeros((states, states)))
    return np.log10(p), a * b / p, pairs


@pytest.mark.parametrize("most", [3, 17, 10_000])
def test_recursions(most):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 30, n).astype(np.uint16) for n in (1, 1, 2, 5, 9, 40, 3)]
    chain = hidden_markov.start_chain(np.full(30, 1 / 30), 3)
    sums, got = hidden_markov.Expected(30, 3), np.zeros(len(seqs))
    for rows, lot in hidden_markov.lots(pa.array([s.tobytes() for s in seqs], pa.binary()), most):
        sums.add(chain, lot, most)
        got[rows] = hidden_markov.log_likelihood(chain, lot, most)
    sums.finished(chain)
    plain = [plain_chain(chain, s) for s in seqs]
    emit = np.zeros((3, 30))
    for s, (_, g, _) in zip(seqs, plain):
        np.add.at(emit.T, s, g)
    assert np.allclose(got, [p for p, _, _ in plain]) and np.isclose(sums.log, got.sum())
    assert np.allclose(sums.emit, emit) and np.allclose(sums.after, sum(x for _, _, x in plain)) and np.allclose(sums.first, sum(g[0] for _, g, _ in plain))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["The", "the", "cat", "DOG", "é", "À", "a b", "z" * 80, "y" * 70, "...", "42"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 20 + i % 50]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (None, "the cat"), rows[3], rows[3], (203, "the " * 4000), (204, "never seen before")]
    return rows


def test_language_model(spark, texts):
    given = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_c0", F.lit(2))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in texts if not held(i) for w in words(t))
    total, distinct = sum(count.values()), len(count)

    teach = hidden_markov.taught()
    vocab = hidden_markov.vocabulary(given.where(teach), head=12)
    assert (vocab.total, vocab.distinct) == (total, distinct)
    coded = hidden_markov.encode(given, vocab, keep={"doc_id": F.col("doc_id"), "held_out": ~teach, "text": F.col("text")})
    chain, history = hidden_markov.fit(coded.where("NOT kept._c1"), vocab, states=3, rounds=5)
    assert history == sorted(history)
    assert np.allclose(chain.emit.sum(axis=0), 1) and np.allclose(chain.after.sum(axis=1), 1) and np.isclose(chain.first.sum(), 1)

    # class of each word, from its spelling
    def key(w):
        return w if len(w.encode()) <= 64 else " " + hashlib.sha256(w.encode()).hexdigest()

    head = {w: i + 1 for i, w in enumerate(vocab.words)}
    order = sorted((k for k in count if k is not None), key=lambda w: (-count[w], key(w)))
    assert vocab.words == [key(w) for w in order[:12]]
    tail_of = {r["word"]: r["tail"] for r in vocab.table.collect()}
    inside = collections.Counter()
    for w in order[12:]:
        inside[tail_of[key(w)]] += count[w] + 1
    rows = hidden_markov.score(coded, vocab, chain).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words(r["kept"]["_c2"])
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(count[x] > 0 for x in w))
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if all(x is None or key(x) in tail_of for x in w):
            seq = [0 if x is None else head.get(key(x), 13 + tail_of[key(x)]) for x in w]
            if len(seq) < 200:  # the unscaled recursion underflows beyond
                rest = sum(math.log10((count[x] + 1) / (inside[tail_of[key(x)]] + 1)) for x in w if x is not None and key(x) not in head)
                assert math.isclose(r["score"], plain_chain(chain, np.array(seq))[0] + rest, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_shares_inside_classes_sum_to_one(spark, texts):
    given = spark.createDataFrame(texts, "doc_id long, text string")
    vocab = hidden_markov.vocabulary(given, head=10)
    inside = np.ones(hidden_markov.TAIL, np.int64)  # one for what was never seen
    for r in vocab.table.collect():
        if r["word"] not in vocab.words:
            inside[r["tail"]] += r["c"] + 1
    assert (inside == vocab.inside).all()


def test_language_model_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert hidden_markov.language_model(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hidden_markov.language_model(spark.createDataFrame([(held, "a b")], schema), rounds=2).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(r["score"])


def test_language_model_beats_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = hidden_markov.language_model(docs, rounds=6).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]
