"""A hidden Markov language model, trained by Baum-Welch over all teaching texts.

A text is its words and one end sign.  Hidden states emit classes of words: the ``HEAD`` most frequent
words are classes of their own, every other word, known or not, belongs to one of ``TAIL`` classes by
its last three bytes.  Inside a tail class a word that was seen c times has the share
(c + 1) / (sum of c + 1 over the class, and 1 for whatever was never seen), so that a text's
probability is that of its classes under the hidden chain times the shares of its words.

Each round of Baum-Welch is one job: a task runs the scaled forward and backward recursions over its
texts and sends expected counts per class and state, which are summed per class; the sums have
a fixed bound and make the next model.  The probability of a text is the product of the scales of
its whole forward recursion.  Word counts grow with the corpus and are never gathered: the counts of
rare words meet the texts that hold them in a join.  A word beyond the head has at most a
``HEAD``-th of all tokens, so no key of that join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage
from coobs.llm.words import Hasher, list_array, mix, space_table, text_blocks

HEAD, TAIL = 8192, 2048
STATES, ROUNDS = 8, 8
#: Words of more bytes are named by their hash.
LONG = 64
#: Bytes of text, and tokens, that are worked on at once; a longer text is worked on in pieces.
BYTES, TOKENS = 1 << 22, 1 << 18
#: Weight of the overall class shares in a state's, and of an even spread in its transitions.
PRIOR, EVEN = 10.0, 0.1


def taught(doc_id: str = "doc_id") -> Column:
    """Does a text teach?  Not where the CRC of its id leaves 2 of 7; a null id teaches."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


# ---- words --------------------------------------------------------------------------------------


class Tokens:
    """Words of a block of texts: distinct keys with their hashes and tail classes, and where they stand."""

    def __init__(self):
        table = space_table()
        self.hasher, self.lower = Hasher(table), np.where(table > 0, table - 1, 32).astype(np.uint8)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(row of each word, its distinct word, hashes, keys, tail class and number of each distinct word)."""
        words, start, end, first = self.hasher.words(data, offsets)
        hashes, at, inverse, n = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        start, end = start[at], end[at]
        size = end - start
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
        spelled = self.lower[data[flat]]
        keys = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(spelled))
        if len(size) and size.max() > LONG:
            plain = keys.to_pylist()
            for i in np.flatnonzero(size > LONG):  # no word holds a blank
                plain[i] = " " + hashlib.sha256(plain[i].encode()).hexdigest()
            keys = pa.array(plain, pa.large_string())
        ending = np.zeros(len(size), np.uint64)
        for back in (1, 2, 3):
            ending = ending * np.uint64(257) + np.where(size >= back, self.lower[data[np.maximum(end - back, 0)]] if len(data) else 0, 0).astype(np.uint64)
        return np.repeat(np.arange(len(first) - 1), np.diff(first)), inverse, hashes, keys, (mix(ending) % np.uint64(TAIL)).astype(np.int64), n


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0), BYTES):
            _, _, _, keys, tail, n = tokens.of(data, offsets)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(tail, pa.int32()), pa.array(n, pa.int64())], names=["word", "tail", "n"])


@dataclass
class Vocabulary:
    """Counts of the teaching texts: ``table`` of (word, tail, c) in full, and what has a fixed bound."""

    table: DataFrame
    words: list[str]  # the head, most frequent first
    counts: np.ndarray  # of the end sign and the head's words
    inside: np.ndarray  # sum of c + 1, and 1, per tail class
    tail: np.ndarray  # tokens per tail class
    total: int  # N
    distinct: int  # V

    @property
    def classes(self) -> int:
        """The end sign is class 0, then the head's words, then the tail classes."""
        return len(self.counts) + TAIL

    def shares(self) -> np.ndarray:
        """Share of each class among all tokens, smoothed."""
        seen = np.concatenate([self.counts, self.tail]) + 1.0
        return seen / seen.sum()


def vocabulary(docs: DataFrame, *, text: str = "text", head: int = HEAD) -> Vocabulary:
    """The words of all of ``docs``, counted whole; an empty table gives an empty vocabulary."""
    if head + TAIL + 1 >= 1 << 16:
        raise ValueError("classes are 16-bit numbers")
    counted = docs.select(F.col(f"`{text}`")).mapInArrow(count_words, "word string, tail int, n bigint")
    table = cut_lineage(counted.groupBy("word", "tail").agg(F.sum("n").alias("c")), "lm_words")
    texts = docs.count()
    # at most ``head`` rows of at most LONG + 1 bytes, and at most TAIL rows
    top = table.orderBy(F.col("c").desc(), "word").limit(head).select("word", "tail", "c").toArrow().to_pandas()
    sums = table.groupBy("tail").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).toArrow().to_pandas()
    tokens, words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    tokens[sums["tail"]], words[sums["tail"]] = sums["tokens"], sums["words"]
    total, distinct = int(tokens.sum()) + texts, int(words.sum()) + (texts > 0)
    np.subtract.at(tokens, top["tail"].to_numpy(np.int64), top["c"].to_numpy(np.int64))
    np.subtract.at(words, top["tail"].to_numpy(np.int64), 1)
    return Vocabulary(table, top["word"].tolist(), np.concatenate([[texts], top["c"].to_numpy(np.int64)]), tokens + words + 1, tokens, total, distinct)


def encode_batches(batches: Iterator[pa.RecordBatch], head: list[str], counts: np.ndarray, inside: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    tokens, size = Tokens(), len(counts)
    # a long word's hash is that of the word, not of its key: such words are looked up by key
    known = pa.array(head, pa.large_string())
    plain = np.flatnonzero([not w.startswith(" ") for w in head])
    spelled = [head[i].encode() for i in plain]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in spelled])]).astype(np.int64)
    hashes = tokens.hasher.words(np.frombuffer(b"".join(spelled), np.uint8), bounds)[0]
    order = plain[np.argsort(hashes, kind="stable")].astype(np.int64)
    hashes = np.sort(hashes)
    lengthy = {w: i for i, w in enumerate(head) if w.startswith(" ")}
    log_count, log_inside = np.log10(counts + 1.0), np.log10(inside.astype(float))
    for batch in batches:
        parts: list[list] = [[] for _ in range(6)]
        for lo, hi, data, offsets in text_blocks(batch.column("_text"), BYTES):
            row, which, hashed, keys, tail, _ = tokens.of(data, offsets)
            rows = hi - lo
            cls = tail + size
            if len(hashes):
                spot = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
                same = pc.equal(keys, known.take(pa.array(order[spot]))).to_numpy(zero_copy_only=False)
                cls = np.where(same, order[spot] + 1, cls)
            if lengthy:
                for i in np.flatnonzero(pc.starts_with(keys, " ").to_numpy(zero_copy_only=False)):
                    if (k := lengthy.get(keys[i].as_py())) is not None:
                        cls[i] = k + 1
            per_row = np.bincount(row, minlength=rows)
            sequence = np.zeros(len(row) + rows, np.uint16)
            sequence[np.arange(len(row)) + row] = cls[which]
            ends = np.cumsum(per_row + 1)
            parts[0].append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate([[0], ends]) * 2), pa.py_buffer(sequence)]))
            of = cls[which]
            common = of < size
            parts[1].append(per_row + 1)
            parts[2].append(np.bincount(row[common], minlength=rows) + (counts[0] > 0))
            parts[3].append(np.bincount(row[common], log_count[of[common]], rows) + log_count[0])
            parts[4].append(np.bincount(row[~common], log_inside[of[~common] - size], rows))
            pairs, n = np.unique(row[~common] * np.int64(max(len(hashed), 1)) + which[~common], return_counts=True)
            rare = keys.take(pa.array(pairs % max(len(hashed), 1))).cast(pa.string())
            held = pa.StructArray.from_arrays([rare, pa.array(n, pa.int32())], names=["word", "n"])
            parts[5].append(list_array(held, np.bincount(pairs // max(len(hashed), 1), minlength=rows)))
        if not parts[0]:
            continue
        columns = [batch.column(n) for n in names] + [pa.concat_arrays(parts[0]).cast(pa.binary())]
        columns += [pa.array(np.concatenate(parts[i]), t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]
        columns.append(pa.concat_arrays(parts[5]))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "classes", "tokens", "common", "base", "inside", "rare"])


def encode(docs: DataFrame, vocab: Vocabulary, *, text: str = "text", keep: dict[str, Column]) -> DataFrame:
    """Texts as written sequences of classes, with ``keep`` (name to column) beside them.

    ``row`` numbers the written rows; ``rare`` holds the words beyond the head with their numbers.
    """
    names = [f"_c{i}" for i in range(len(keep))]
    given = docs.select(*[c.alias(n) for c, n in zip(keep.values(), names)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name in names)
    shape += "classes binary, tokens bigint, common bigint, base double, inside double, rare array<struct<word: string, n: int>>"
    head, counts, inside = vocab.words, vocab.counts, vocab.inside
    coded = given.mapInArrow(lambda it: encode_batches(it, head, counts, inside, names), shape)
    fixed = ["classes", "tokens", "common", "base", "inside", "rare"]
    return cut_lineage(coded.select(F.monotonically_increasing_id().alias("row"), *[F.struct(*names).alias("kept")] * bool(names), *fixed), "lm_texts")


# ---- the chain ----------------------------------------------------------------------------------


@dataclass
class Chain:
    """Shares of the first state, of the next state per state, and of classes per state (classes x states)."""

    first: np.ndarray
    after: np.ndarray
    emit: np.ndarray


def start_chain(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Chain:
    """States that stay with even odds and differ by chance in the classes they favour."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * np.exp(rng.normal(0, 1, (len(shares), states)))
    after = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Chain(np.full(states, 1 / states), after, emit / emit.sum(axis=0))


class Lot:
    """Texts sorted by length, longest first, read in step: at step t the first ``live[t]`` texts have a token."""

    def __init__(self, tokens: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.tokens, self.start, self.size = tokens, start, size
        self.live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")

    def __len__(self) -> int:
        return len(self.live)

    def classes(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the tokens of steps lo..hi, step by step, and where each step begins (one more at the end)."""
        live = self.live[lo:hi]
        ends = np.concatenate([[0], np.cumsum(live)])
        text = np.arange(ends[-1]) - np.repeat(ends[:-1], live)
        return self.tokens[self.start[text] + np.repeat(np.arange(lo, hi), live)], ends

    def pieces(self, most: int) -> list[tuple[int, int]]:
        """Runs of steps with at most ``most`` tokens each (one step at least)."""
        out, lo, ends = [], 0, np.cumsum(self.live)
        while lo < len(self):
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
            out.append((lo, max(hi, lo + 1)))
            lo = out[-1][1]
        return out


def lots(column: pa.Array, most: int = TOKENS) -> Iterator[tuple[np.ndarray, Lot]]:
    """(rows, texts) of a column of class sequences, in lots of about ``most`` tokens."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    tokens = np.frombuffer(column.buffers()[2], np.uint16, offsets[-1] // 2)
    start, size = offsets[:-1] // 2, np.diff(offsets) // 2
    order = np.argsort(-size, kind="stable")
    ends, lo = np.cumsum(size[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        rows = order[lo:hi]
        yield rows, Lot(tokens, start[rows], size[rows])
        lo = hi


def forward(chain: Chain, lot: Lot, lo: int, hi: int, before: np.ndarray | None):
    """Scaled forward recursion over steps lo..hi from the states before them.

    Returns the classes, where each step begins, their emissions, the scaled states and the scales (each in all columns).
    """
    seen, ends = lot.classes(lo, hi)
    emitted = np.take(chain.emit, seen, axis=0)
    states, scales = np.empty_like(emitted), np.empty_like(emitted)
    ones = np.ones((len(chain.first),) * 2)
    for t in range(hi - lo):
        i, j = ends[t], ends[t + 1]
        state = states[i:j]
        if lo + t == 0:
            state[:] = chain.first
        else:
            np.matmul(before[: j - i], chain.after, out=state)
        state *= emitted[i:j]
        np.matmul(state, ones, out=scales[i:j])
        state /= scales[i:j]
        before = state
    return seen, ends, emitted, states, scales


def log_likelihood(chain: Chain, lot: Lot, most: int = TOKENS) -> np.ndarray:
    """Base-10 logarithm of the probability of each text's classes."""
    out, before = np.zeros(len(lot.size)), None
    for lo, hi in lot.pieces(most):
        _, ends, _, states, scales = forward(chain, lot, lo, hi, before)
        before = states[ends[-2] :].copy()
        text = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        out += np.bincount(text, np.log10(scales[:, 0]), len(out))
    return out


class Expected:
    """Expected counts of emissions, transitions and first states, and the sum of log-likelihoods."""

    def __init__(self, classes: int, states: int):
        self.emit, self.after, self.first, self.log = np.zeros((states, classes)), np.zeros((states, states)), np.zeros(states), 0.0

    def add(self, chain: Chain, lot: Lot, most: int = TOKENS) -> None:
        """One lot: forward through all pieces, keeping the states between them, then back piece by piece."""
        pieces, borders = lot.pieces(most), [None]
        for lo, hi in pieces[:-1]:
            _, ends, _, states, _ = forward(chain, lot, lo, hi, borders[-1])
            borders.append(states[ends[-2] :].copy())
        after_t = np.ascontiguousarray(chain.after.T)
        ahead = np.zeros((0, len(chain.first)))  # emission and rest of the step after, scaled, for the texts that have it
        for (lo, hi), border in zip(reversed(pieces), reversed(borders)):
            seen, ends, emitted, states, scales = forward(chain, lot, lo, hi, border)
            self.log += np.log10(scales[:, 0]).sum()
            emitted /= scales
            rest = np.ones_like(states)
            for t in range(hi - lo - 1, -1, -1):
                i, j, k = ends[t], ends[t + 1], ends[t] + len(ahead)
                self.after += states[i:k].T @ ahead
                np.matmul(ahead, after_t, out=rest[i:k])
                ahead = emitted[i:j]
                ahead *= rest[i:j]
            states *= rest  # now the share of each state in each token
            ahead = ahead.copy()
            if lo == 0:
                self.first += states[: ends[1]].sum(axis=0)
            by_state = np.ascontiguousarray(states.T)
            for k in range(len(by_state)):
                self.emit[k] += np.bincount(seen, by_state[k], self.emit.shape[1])

    def finished(self, chain: Chain) -> Expected:
        self.after *= chain.after
        return self


def expected_batches(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    sums = Expected(*chain.emit.shape)
    for batch in batches:
        for _, lot in lots(batch.column(0)):
            sums.add(chain, lot)
    sums.finished(chain)
    classes = np.flatnonzero(sums.emit.sum(axis=0))
    states = len(chain.first)
    last = np.zeros((2, states))
    last[0], last[1, 0] = sums.first, sums.log
    kind = np.repeat([0, 1, 2, 3], [len(classes), states, 1, 1])
    item = np.concatenate([classes, np.arange(states), [0, 0]])
    values = np.concatenate([sums.emit.T[classes], sums.after, last])
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(item, pa.int32()), list_array(pa.array(values.ravel()), np.full(len(kind), states))], names=["kind", "item", "v"])


def improved(sums: Expected, shares: np.ndarray) -> Chain:
    """The chain that the expected counts make, smoothed so that nothing is impossible."""
    emit = sums.emit + PRIOR * shares
    after = sums.after + EVEN
    first = sums.first + EVEN
    return Chain(first / first.sum(), after / after.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))


def fit(coded: DataFrame, vocab: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> tuple[Chain, list[float]]:
    """Baum-Welch over all rows of ``coded``; the chain, and the log-likelihood before each round."""
    shares = vocab.shares()
    chain, history = start_chain(shares, states, seed), []
    for _ in range(rounds):
        counts = coded.select("classes").mapInArrow(lambda it, c=chain: expected_batches(it, c), "kind int, item int, v array<double>")
        # at most one row per class and state, whatever the number of texts
        rows = counts.groupBy("kind", "item").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(states)]).toArrow()
        values = np.column_stack([rows.column(f"v{k}").to_numpy() for k in range(states)]) if rows.num_rows else np.zeros((0, states))
        kind, item = rows.column("kind").to_numpy(), rows.column("item").to_numpy()
        sums = Expected(len(shares), states)
        sums.emit.T[item[kind == 0]] = values[kind == 0]
        sums.after[item[kind == 1]] = values[kind == 1]
        sums.first[:] = values[kind == 2].sum(axis=0)
        history.append(float(values[kind == 3][:, 0].sum()))
        chain = improved(sums, shares)
    return chain, history


def likelihoods(batches: Iterator[pa.RecordBatch], chain: Chain, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, out = batch.column("classes"), np.zeros(batch.num_rows)
        for rows, lot in lots(column):
            out[rows] = log_likelihood(chain, lot)
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out)], names=[*names, "chain"])


def score(coded: DataFrame, vocab: Vocabulary, chain: Chain) -> DataFrame:
    """``kept``, ``n_tokens``, ``n_known``, ``base_score`` (words by their counts alone) and ``score`` per text."""
    names = [c for c in coded.columns if c not in ("classes", "rare")]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema if f.name in names) + ", chain double"
    chained = coded.select("classes", *names).mapInArrow(lambda it: likelihoods(it, chain, names), shape)
    held = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(vocab.table.select("word", "c"), "word")
    rare = held.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare"), F.sum("n").alias("seen"))
    out = chained.join(rare, "row", "left")
    words = F.coalesce("rare", F.lit(0.0))
    return out.select(
        *[c for c in ("kept",) if c in names],
        F.col("tokens").alias("n_tokens"),
        (F.col("common") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + words - F.col("tokens") * float(np.log10(vocab.total + vocab.distinct + 1))).alias("base_score"),
        (F.col("chain") + words - F.col("inside")).alias("score"),
    )


def language_model(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", teach: Column | None = None, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all texts for which ``teach`` (``taught`` by default) holds and scores all whole texts.
    Null texts are empty: their only token is the end; repeated rows count and are scored
    each; without teaching texts every class is as likely as any other; an empty table stays empty;
    other columns are not read.
    """
    teach = taught(doc_id) if teach is None else teach
    vocab = vocabulary(docs.where(teach), text=text, head=head)
    coded = encode(docs, vocab, text=text, keep={"doc_id": F.col(f"`{doc_id}`"), "held_out": ~teach})
    chain, _ = fit(coded.where("NOT kept._c1"), vocab, states=states, rounds=rounds)
    return score(coded, vocab, chain).select(
        F.col("kept._c0").alias("doc_id"), F.col("kept._c1").alias("held_out"), "n_tokens", "n_known",
        F.lit(vocab.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
