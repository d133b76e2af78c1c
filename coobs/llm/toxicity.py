"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector and the sum of its character 3- and 4-gram vectors, so
forms that were never seen still carry their stem.  Texts are cut into windows of ``WINDOW``
words that overlap in all but ``STRIDE`` words, the last one flush with the end; two gated recurrent
passes read a window, attention pools their states, and a text scores as its worst window.

Training needs labels of whole texts only: a toxic text teaches through its currently worst
window, a clean one through its currently worst and some random ones.  The first choice of windows
comes from the log-odds of character grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import release_memory, spare
from coobs.llm.words import Hasher, alnum_table, mix, text_blocks

WINDOW, STRIDE = 32, 4
#: Words between the windows that training chooses from.
TEACH_STRIDE = 24
HIDDEN = 8
DIM = 8
WORD_SLOTS, GRAM_SLOTS = 1 << 17, 1 << 17
#: Bounds of the training sample: rows per class, and bytes of a text that may teach.
TOXIC_ROWS, CLEAN_ROWS, TEACH_BYTES = 1000, 3000, 1 << 14
EPOCHS, STEPS = 8, 400
#: Windows per training text that epochs choose from: by prior, and at random.
BY_PRIOR, AT_RANDOM = 6, 6
CHUNK = 4096


def held_out(doc_id: str = "doc_id") -> Column:
    """One id in five, by CRC, never teaches; a null id does not either."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(5)), F.lit(0)) == 0


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+size."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def gram_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots of the 3-grams and the 4-grams of <word>>, with the number of each per word."""
    size = end - start
    at = np.cumsum(size + 3) - (size + 3)
    text = np.full(int((size + 3).sum()), ord(">"), np.uint64)
    text[at] = ord("<")
    text[ranges(at + 1, size)] = data[ranges(start, size)]
    out = []
    for n in (3, 4):
        h = np.full(max(len(text) - n + 1, 0), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + text[j : j + len(h)]
        out.append((mix(h[ranges(at, size + 4 - n)]) % np.uint64(GRAM_SLOTS)).astype(np.int64))
    return out, [size + 1, size]


def windows(first: np.ndarray, pad: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the words of every window of every row (``pad`` past its end), and each row's first window."""
    sizes = np.diff(first)
    count = np.maximum(1, -(-(sizes - WINDOW) // stride) + 1)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(nth * stride, np.maximum(sizes[row] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < sizes[row][:, None], at + first[row][:, None], pad), row, np.cumsum(count) - count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * DIM, HIDDEN
    p = {"word": rng.normal(0, 0.1, (WORD_SLOTS, DIM)), "gram": rng.normal(0, 0.1, (GRAM_SLOTS, DIM))}
    for way in "fb":
        p |= {f"W{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"c{way}": np.zeros(3 * h), f"U{way}": rng.normal(0, h**-0.5, (h, 3 * h))}
    p |= {"A": rng.normal(0, 0.25, (2 * h, h)), "v": rng.normal(0, 0.35, h), "u": rng.normal(0, 0.25, 2 * h), "o": np.full(1, -1.0)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def inputs(p: dict, slots: np.ndarray, grams: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Input vector of each distinct word, and a last one of zeros for padding."""
    x = np.zeros((len(slots) + 1, 2 * DIM), np.float32)
    x[:-1, :DIM] = p["word"][slots]
    for ids, n in zip(grams, counts):
        at = np.append(0, np.cumsum(n))
        for lo in range(0, len(slots), CHUNK):
            hi = min(lo + CHUNK, len(slots))
            x[lo:hi, DIM:] += np.add.reduceat(p["gram"][ids[at[lo] : at[hi]]], at[lo:hi] - at[lo], axis=0)
    x[:-1, DIM:] *= np.float32(0.4)
    return x


def forward(p: dict, x: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logit of each window; ``at`` indexes ``x`` and its last row is padding."""
    b, h = len(at), HIDDEN
    states = np.empty((WINDOW, b, 2 * h), np.float32)
    trace = {}
    for k, way in enumerate("fb"):
        given = x @ p[f"W{way}"] + p[f"c{way}"]
        s, steps = np.zeros((b, h), np.float32), []
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            g, q = given[at[:, t]], s @ p[f"U{way}"]
            zr = sigmoid(g[:, : 2 * h] + q[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * q[:, 2 * h :])
            before, s = s, n + z * (s - n)
            states[t, :, k * h : (k + 1) * h] = s
            if keep:
                steps.append((t, before, z, r, n, q[:, 2 * h :]))
        trace[way] = steps
    e = np.tanh(states @ p["A"])
    score = e @ p["v"]
    real = (at < len(x) - 1).T
    real[0] |= ~real.any(axis=0)  # a text without words attends to padding
    score = np.where(real, score, np.float32(-1e9))
    w = np.exp(score - score.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, states)
    logit = pooled @ p["u"] + p["o"]
    return (logit, (states, trace, e, w, pooled)) if keep else logit


def gate_tables(p: dict, x: np.ndarray) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Per direction and gate: what each distinct word gives to it, and the weights of the state before."""
    half, out = np.float32(0.5), {}
    for way in "fb":
        ws, us, cs = (np.split(p[f"{k}{way}"], 3, axis=-1) for k in "WUc")
        scales = (half, half, np.float32(1))  # a sigmoid is a tanh of half
        out[way] = [(k * (x @ w + c), np.ascontiguousarray(k * u)) for k, w, u, c in zip(scales, ws, us, cs)]
    return out


def logits_of(p: dict, tables: dict, at: np.ndarray) -> np.ndarray:
    """The same as ``forward``, quicker: every gate in an array of its own, and nothing allocated per step."""
    b, h, half = len(at), HIDDEN, np.float32(0.5)
    steps, states = np.ascontiguousarray(at.T), {}
    for way in "fb":
        *gates, (given, un) = tables[way]
        out = states[way] = np.empty((WINDOW, b, h), np.float32)
        s = np.zeros((b, h), np.float32)
        z, r, n, q = (np.empty((b, h), np.float32) for _ in range(4))
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            for (g, u), gate in zip(gates, (z, r)):
                np.take(g, steps[t], axis=0, out=gate, mode="clip")
                np.matmul(s, u, out=q)
                gate += q
                np.tanh(gate, out=gate)
                gate += 1
                gate *= half
            np.matmul(s, un, out=q)
            q *= r
            np.take(given, steps[t], axis=0, out=n, mode="clip")
            n += q
            np.tanh(n, out=n)
            after = np.subtract(s, n, out=out[t])
            after *= z
            after += n
            s = after
    score = np.tanh(states["f"] @ p["A"][:h] + states["b"] @ p["A"][h:]) @ p["v"]
    real = steps < len(tables["f"][0][0]) - 1
    real[0] |= ~real.any(axis=0)
    score = np.where(real, score, np.float32(-1e9))
    w = np.exp(score - score.max(axis=0))
    w /= w.sum(axis=0)
    return (w * (states["f"] @ p["u"][:h] + states["b"] @ p["u"][h:])).sum(axis=0) + p["o"]


def gradients(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted log loss, and that of the input vectors."""
    logit, (states, trace, e, w, pooled) = forward(p, x, at, keep=True)
    h = HIDDEN
    d = (weight * (sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"u": pooled.T @ d, "o": d.sum(keepdims=True)}
    dpool = d[:, None] * p["u"]
    dstates = w[:, :, None] * dpool
    dw = np.einsum("bh,tbh->tb", dpool, states)
    dscore = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tb,tba->a", dscore, e)
    de = dscore[:, :, None] * p["v"] * (1 - e * e)
    g["A"] = np.einsum("tbh,tba->ha", states, de)
    dstates += de @ p["A"].T
    dx = np.zeros_like(x)
    flat = at.T.ravel()
    order = np.argsort(flat, kind="stable")
    seen, start = np.unique(flat[order], return_index=True)
    for k, way in enumerate("fb"):
        carry, W, U = np.zeros((len(y), h), np.float32), p[f"W{way}"], p[f"U{way}"]
        dgiven, dU, dgs = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(U), np.empty((WINDOW, len(y), 3 * h), np.float32)
        for t, before, z, r, n, qn in reversed(trace[way]):
            ds = carry + dstates[t, :, k * h : (k + 1) * h]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (before - n) * z * (1 - z)
            dr = dn * qn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn], axis=1)
            dq = np.concatenate([dz, dr, dn * r], axis=1)
            dU += before.T @ dq
            dgs[t] = dg
            carry = ds * z + dq @ U.T
        dgiven[seen] = np.add.reduceat(dgs.reshape(-1, 3 * h)[order], start, axis=0)
        g[f"W{way}"], g[f"c{way}"], g[f"U{way}"] = x.T @ dgiven, dgiven.sum(axis=0), dU
        dx += dgiven @ W.T
    return g, dx


class Words:
    """Distinct words of some texts with their slots and grams."""

    def __init__(self, hasher: Hasher, lower: np.ndarray):
        self.hasher, self.lower = hasher, lower

    def of(self, data: np.ndarray, offsets: np.ndarray):
        words, start, end, first = self.hasher.words(data, offsets)
        distinct, at, inverse = np.unique(words, return_index=True, return_inverse=True)
        grams, counts = gram_ids(self.lower[data], start[at], end[at])
        return first, inverse, (distinct % np.uint64(WORD_SLOTS)).astype(np.int64), grams, counts


def tables() -> tuple[Hasher, np.ndarray]:
    table = alnum_table()
    return Hasher(table), np.where(table > 0, table - 1, 32).astype(np.uint8)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """A model from whole texts and 0/1 labels, by ``epochs`` or more, so that there are ``STEPS`` steps.

    With one class only, a constant.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array([(y.sum() + 1) / (len(y) + 2)])}
    column = pa.array(texts, pa.large_string())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.as_py().encode()) for t in column])])
    first, word, slots, grams, counts = Words(*tables()).of(data, offsets)
    pad = len(word)
    at, row, head = windows(first, pad, TEACH_STRIDE)
    at = np.append(word, len(slots)).astype(np.int32)[at]
    # all grams of a word, in one run per word
    owner = np.concatenate([np.repeat(np.arange(len(n), dtype=np.int32), n) for n in counts])
    gram, many = np.concatenate(grams).astype(np.int32)[np.argsort(owner, kind="stable")], counts[0] + counts[1]
    gram_at = np.cumsum(many) - many
    del owner, grams, counts

    # log-odds of grams by text: where to look first
    pos, neg = np.zeros(GRAM_SLOTS), np.zeros(GRAM_SLOTS)
    for lo in range(0, len(y), 64):  # few texts at a time: all their grams at once are many
        hi = min(lo + 64, len(y))
        here = word[first[lo] : first[hi]]
        doc = np.repeat(np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1])), many[here])
        pairs = np.unique(doc * GRAM_SLOTS + gram[ranges(gram_at[here], many[here])])
        toxic = y[lo + pairs // GRAM_SLOTS] > 0
        pos += np.bincount(pairs[toxic] % GRAM_SLOTS, minlength=GRAM_SLOTS)
        neg += np.bincount(pairs[~toxic] % GRAM_SLOTS, minlength=GRAM_SLOTS)
    odds = np.log((pos + 0.1) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    best = np.append(np.maximum.reduceat(odds[gram], gram_at), -99) if len(many) else np.array([-99.0])
    prior = best[at].max(axis=1)

    p, rng = new_model(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items() if k not in ("word", "gram")} for _ in (0, 1))
    squares, step, score = {k: np.full(len(p[k]), 1e-2, np.float32) for k in ("word", "gram")}, 0, prior
    share = np.diff(np.append(head, len(row)))
    lots = []
    for value in (-prior, rng.random(len(row))):
        order = np.lexsort((value, row))
        rank = np.empty(len(row), np.int64)
        rank[order] = np.arange(len(row)) - np.repeat(head, share)
        lots.append(rank)
    chosen = np.flatnonzero((lots[0] < BY_PRIOR) | (lots[1] < AT_RANDOM))
    at, row, score = at[chosen], row[chosen], prior[chosen]
    span = np.searchsorted(row, np.arange(len(y) + 1))

    def logits(at: np.ndarray) -> np.ndarray:
        ready = gate_tables(p, inputs(p, slots, [gram], [many]))
        return np.concatenate([logits_of(p, ready, at[i : i + CHUNK]) for i in range(0, len(at), CHUNK)])

    epoch = 0
    while epoch < epochs:
        if epoch > 2:
            score = logits(at)
        order = np.lexsort((score, row))
        worst = order[span[1:] - 1]
        clean = np.flatnonzero(y[row] == 0)
        extra = rng.choice(clean, min(len(clean), int((y == 0).sum())), replace=False)
        pick = np.concatenate([worst, extra])
        target = y[row[pick]]
        weight = np.where(target > 0, min(4.0, (target == 0).sum() / (target > 0).sum()), 1.0).astype(np.float32) ** 0.5
        shuffled = rng.permutation(len(pick))
        rate = 0.01 * (0.5 if epoch > epochs * 2 // 3 else 1.0)
        size = int(min(384, max(32, len(pick) // 16)))
        epochs = max(epochs, -(-STEPS * size // len(pick)))
        for i in range(0, len(pick), size):
            some = shuffled[i : i + size]
            here = at[pick[some]]
            used, local = np.unique(here, return_inverse=True)
            used = used[used < len(slots)]
            local = np.where(here < len(slots), local.reshape(here.shape), len(used))
            own = ranges(gram_at[used], many[used])
            xs = np.zeros((len(used) + 1, 2 * DIM), np.float32)
            xs[:-1, :DIM] = p["word"][slots[used]]
            if len(used):
                xs[:-1, DIM:] = 0.4 * np.add.reduceat(p["gram"][gram[own]], np.cumsum(many[used]) - many[used], axis=0)
            g, dx = gradients(p, xs, local, target[some], weight[some])
            step += 1
            for k in m:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for k, ids, d in (("word", slots[used], dx[:-1, :DIM]), ("gram", gram[own], np.repeat(0.4 * dx[:-1, DIM:], many[used], axis=0))):
                rows, inverse = np.unique(ids, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inverse, d)
                squares[k][rows] += (total**2).mean(axis=1)
                p[k][rows] -= 5 * rate * total / np.sqrt(squares[k][rows])[:, None]
        epoch += 1
    # the offset that puts 0.5 where whole training texts part best
    ready, padded, whole = gate_tables(p, inputs(p, slots, [gram], [many])), np.append(word, len(slots)), []
    for lo in range(0, len(y), 64):
        at, _, head = windows(first[lo : lo + 65], pad)
        whole.append(np.maximum.reduceat(np.concatenate([logits_of(p, ready, padded[at[i : i + CHUNK]]) for i in range(0, len(at), CHUNK)]), head))
    whole = np.concatenate(whole)
    order = np.argsort(whole)
    errors = np.cumsum(y[order]) + (1 - y).sum() - np.cumsum(1 - y[order])
    least = np.flatnonzero(errors[:-1] == errors[:-1].min())
    gap = whole[order][least + 1] - whole[order][least]
    i = least[np.argmax(gap)]
    p["o"] = p["o"] - np.float32((whole[order][i] + whole[order][i + 1]) / 2)
    return p


def score_texts(p: dict, words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each row of a block."""
    if "constant" in p:
        return np.full(len(offsets) - 1, p["constant"][0])
    first, word, slots, grams, counts = words.of(data, offsets)
    at, row, head = windows(first, len(word))
    at = np.append(word, len(slots))[at]
    x = inputs(p, slots, grams, counts)
    ready = gate_tables(p, x)
    logit = np.concatenate([logits_of(p, ready, at[i : i + CHUNK]) for i in range(0, len(at), CHUNK)])
    return 1 / (1 + np.exp(-np.maximum.reduceat(logit, head).astype(np.float64)))


def score_batches(batches: Iterator[pa.RecordBatch], p: dict, name: str) -> Iterator[pa.RecordBatch]:
    words = Words(*tables())
    for batch in batches:
        score = [score_texts(p, words, data, offsets) for _, _, data, offsets in text_blocks(batch.column("_text"))]
        columns = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*columns, name])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from a bounded sample: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows with the
    least hashes, without held-out ids, whose text has at most ``TEACH_BYTES`` bytes."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).select(F.col(f"`{doc_id}`").alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    order = F.xxhash64("_id")
    picked = known.where("_y = 1").orderBy(order, "_id").limit(TOXIC_ROWS).union(known.where("_y = 0").orderBy(order, "_id").limit(CLEAN_ROWS))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where(F.octet_length("_text") <= TEACH_BYTES)
    sample = rows.join(F.broadcast(picked), "_id").select("_id", "_y", "_text")
    # one task reads the bounded sample and trains; the driver sees the weights alone
    weights = sample.repartition(1).mapInArrow(learn, "name string, kind string, shape array<int>, data binary").toArrow()
    model = {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in weights.to_pylist()}
    return model or train([], [])


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a model trained on all rows, in an order that depends on the rows alone."""
    rows = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("_id", "_y", "_text"))))
    model = train([t for _, _, t in rows], [y for _, y, _ in rows])
    del rows
    release_memory()  # later stages use this worker again
    for name, x in model.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([x.dtype.str]), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.tobytes()], pa.binary())],
            names=["name", "kind", "shape", "data"],
        )


def score(docs: DataFrame, model: dict, *, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the score of the whole text in [0, 1].

    Null, empty and wordless texts get the score of a window without words; repeated rows score
    alike; an empty table stays empty; a column called like the score is replaced.
    """
    keep = [c for c in (keep or docs.columns) if c != name]
    names = [f"_c{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name != "_text")
    scored = given.mapInArrow(lambda it: score_batches(it, sent.value, "_score"), f"{shape}_score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("_score").alias(name))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **kw) -> DataFrame:
    """``docs`` that score below the threshold; columns as given."""
    model = fit(docs, labels, **kw)
    (name,) = spare(docs.columns, "score")
    scored = score(docs, model, text=kw.get("text", "text"), name=name)
    return scored.where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
