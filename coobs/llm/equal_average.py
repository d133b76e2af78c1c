"""Compression of vectors to short codes, with an equal-average search for the nearest entry.

A vector is scaled to integers, cut into ``PARTS`` equal consecutive parts, and each part is
replaced by the index of the nearest entry of its position's codebook.  Codebooks start from the
vectors with the smallest ids and are refined over all rows: every round assigns all parts and
replaces each entry by the componentwise floored mean of its parts.

The nearest entry is found by component sums.  By the Cauchy-Schwarz inequality a squared distance
is at least (gap of the sums) ** 2 / width.  Entries are kept sorted by their sum; a part's search
starts where its own sum would stand and moves outward, the nearer side first, until the squared
gap exceeds ``width`` times the best distance.  It must exceed it strictly: an entry at the same
distance may still have the lower index.

All arithmetic is on integers, so results do not depend on how rows are dealt to tasks.  A task
sends at most ``PARTS * ENTRIES`` rows of sums to the shuffle in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage, spare

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts searched at once, so that temporary arrays stay small.
BLOCK = 1 << 14


def usable(embedding: str = "embedding") -> Column:
    """Is the vector there, without null, infinite or undefined components?"""
    v = F.col(f"`{embedding}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def limit(width: int) -> int:
    """Largest integer component for which squared gaps and summed distances stay below 2**62."""
    return (1 << 30) // max(width, 8)


def integers(vectors: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """Rows of ``parts * width`` integers; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    top = limit(width)
    flat = np.clip(np.floor(flat * scale), -top, top).astype(np.int64)
    if len(size) and size.min() == size.max() == parts * width:
        return flat.reshape(len(size), parts * width)
    out = np.zeros((len(size), parts * width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Codebook:
    """Entries of one part position, sorted by component sum for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, x: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row and the squared distance; ties to the lower index.

        ``counted`` receives the number of distances that each block needed.
        """
        index, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), BLOCK):
            index[lo : lo + BLOCK], best[lo : lo + BLOCK] = self._block(x[lo : lo + BLOCK], counted)
        return index, best

    def _block(self, x: np.ndarray, counted: list | None) -> tuple[np.ndarray, np.ndarray]:
        n, (m, width) = len(x), self.entries.shape
        far = np.iinfo(np.int64).max
        index, best = np.full(n, m, np.int64), np.full(n, far, np.int64)
        total = x.sum(axis=1)
        right = np.searchsorted(self.sums, total)
        left = right - 1
        open_ = np.arange(n)
        looked = 0
        while len(open_):
            t, lo, hi = total[open_], left[open_], right[open_]
            below = np.where(lo >= 0, t - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi < m, self.sums[np.minimum(hi, m - 1)] - t, far)
            gap, to_left = np.minimum(below, above), below <= above
            # gaps only grow from here on: a part is settled once the bound passes its best distance
            some, seen = gap < far, best[open_] < far
            go = some & (~seen | (np.where(some, gap, 0) ** 2 <= np.where(seen, best[open_], 0) * width))
            open_, to_left, lo, hi = open_[go], to_left[go], lo[go], hi[go]
            entry = self.order[np.where(to_left, lo, hi)]
            d = ((x[open_] - self.entries[entry]) ** 2).sum(axis=1)
            looked += len(open_)
            better = (d < best[open_]) | ((d == best[open_]) & (entry < index[open_]))
            best[open_[better]], index[open_[better]] = d[better], entry[better]
            left[open_] -= to_left
            right[open_] += ~to_left
        if counted is not None:
            counted.append(looked)
        return index, best


class Codebooks:
    """The entries of all part positions: an array (parts, entries, width)."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        self.entries, self.scale = entries, scale

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.entries.shape

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector a code stands for: the middle of each floored component."""
        picked = [self.entries[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return ((np.concatenate(picked) + 0.5) / self.scale).tolist()

    def searches(self) -> list[Codebook]:
        return [Codebook(e) for e in self.entries]


def sums_of(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Count and component sums of the parts each entry of each position is nearest to."""
    parts, entries, width = books.shape
    search = books.searches()
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for batch in batches:
        x = integers(batch.column(0), width, parts, books.scale).reshape(-1, parts, width)
        for p in range(parts):
            index, _ = search[p].nearest(x[:, p])
            count[p] += np.bincount(index, minlength=entries)
            for j in range(width):  # a batch's sums stay far below 2**53
                total[p, :, j] += np.bincount(index, x[:, p, j], entries).astype(np.int64)
    p, e = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))],
        names=["part", "entry", "n", "sums"],
    )


def assign(batches: Iterator[pa.RecordBatch], books: Codebooks, names: list[str]) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    search = books.searches()
    digits = np.array([f"{i:02x}" for i in range(256)])
    for batch in batches:
        x = integers(batch.column("_vector"), width, parts, books.scale).reshape(-1, parts, width)
        error, code = np.zeros(len(x), np.int64), np.full(len(x), "", f"<U{2 * parts}")
        for p in range(parts):
            index, best = search[p].nearest(x[:, p])
            error += best
            code = np.char.add(code, digits[index])
        columns = [*[batch.column(n) for n in names], pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "code", "error"])


def fit(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all usable vectors; None if there is none.

    The first entries are the vectors of the smallest ids (null ids last, repeated ids by their
    components); with fewer vectors than ``entries`` the codebooks are as small.  Vectors of other
    lengths are filled up with zeros to the longest, rounded up to a multiple of ``parts``.
    Components beyond ``limit`` are set to it.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    kept = vectors.where(usable(embedding)).select(F.col(f"`{vec_id}`").alias("_id"), F.col(f"`{embedding}`").alias("_vector"))
    longest = kept.agg(F.max(F.size("_vector"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    # at most ``entries`` rows
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").toArrow().column(0)
    x = integers(first, width, parts, scale).reshape(-1, parts, width)
    books = Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        sums = kept.select("_vector").mapInArrow(lambda it, b=books: sums_of(it, b), "part int, entry int, n bigint, sums array<bigint>")
        columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        # at most parts * entries rows
        got = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).toArrow().to_pandas()
        entry = books.entries.copy()
        total = got[[f"s{i}" for i in range(width)]].to_numpy(np.int64)
        entry[got["part"], got["entry"]] = total // got["n"].to_numpy(np.int64)[:, None]
        books = Codebooks(entry, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, *, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) of the usable vectors, with ``code`` and ``error``.

    Vectors that are null or hold null or non-finite components give no row; equal rows give
    equal codes; an empty table stays empty.  Columns named ``code`` or ``error`` are replaced.
    """
    keep = [c for c in (keep or vectors.columns) if c not in ("code", "error")]
    names = [f"_c{i}" for i in range(len(keep))]
    given = vectors.where(usable(embedding)).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{embedding}`").alias("_vector"))
    if books is None:
        return given.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name in names)
    out = given.mapInArrow(lambda it: assign(it, books, names), f"{shape}code string, error bigint")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "code", "error")


def with_group_error(coded: DataFrame, group: str, name: str = "label_error") -> DataFrame:
    """``coded`` with the errors summed over equal values of ``group``, nulls together.

    Sums combine before their shuffle.  ``coded`` is written once; the few sums come back by
    a join that the adaptive planner may broadcast or split.  A sum beyond a long is null.
    """
    coded = cut_lineage(coded, "codes")
    g, s = spare(coded.columns, "_group", "_sum")
    sums = coded.groupBy(F.col(f"`{group}`").alias(g)).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias(s))
    sums = cut_lineage(sums.select(g, F.expr(f"try_cast({s} AS bigint)").alias(s)), "code_errors")
    out = coded.join(sums, F.col(f"`{group}`").eqNullSafe(F.col(g)))
    return out.select(*[F.col(f"`{c}`") for c in coded.columns if c != name], F.col(s).alias(name))
