"""Similarity join of word-shingle sets by PartEnum signatures.

Sets with Jaccard similarity of at least 3/4 differ in at most a third of the smaller one's size
(``|A xor B| <= (|A| + |B|) / 7`` and ``|B| <= 4/3 |A|``).  Sizes fall into bands of a factor of
four; each band divides the domain of shingles into a fixed number of parts, and each non-empty
part of a set, with the shingles in it, is one signature.  Two similar sets of a band agree in all
parts but those that hold a differing shingle, so of A's signatures more than ``n - |A|/3`` are
shared, and the first ``|A|/3 + 1`` of each set in one common order must meet.  A set near the top of its
band takes part in the next one too, because a partner may lie there.

The common order puts signatures of frequent shingles last, by a count table of fixed size, so that
passages which many documents share seldom become signatures; the order changes the work,
never the result.  Sets that meet are compared with the first of their signature group; groups
that are still in more than one component are compared throughout.  Signatures travel as packed
blobs per hash bucket and are sorted in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.components import components
from coobs.llm.tables import BITS, cut_lineage, digest, filter_bits
from coobs.llm.words import Hasher, in_one_row, mix, ngrams, space_table, text_blocks

SHINGLE = 5
SLOTS = 1 << 20
SEGMENT = 1 << 12
BAND0 = 64
PER_TASK = 1_500_000


def shingle_sets(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a block, sorted and unique unless ``distinct`` is false.

    A row of fewer words than a shingle has one, of all its words; a row without words has none.
    """
    words, _, _, first = hasher.words(data, offsets)
    grams = ngrams(words, SHINGLE)
    at = np.flatnonzero(in_one_row(first, SHINGLE, len(grams)))
    grams, row = grams[at], np.searchsorted(first, at, "right") - 1
    sizes = np.diff(first)
    few = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(few):
        extra = [ngrams(words[first[r] : first[r + 1]], int(sizes[r]))[0] for r in few.tolist()]
        grams, row = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([row, few])
    if not distinct:
        return row, grams
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[new], row[new]
    return row, grams


def count_shingles(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    hasher, counts = Hasher(table), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            _, grams = shingle_sets(hasher, data, offsets, distinct=False)
            counts += np.bincount((grams & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    parts = counts.astype(np.int32).reshape(-1, SEGMENT)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "counts"])


def add_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SEGMENT, np.int64)
    for batch in batches:
        for blob in batch.column("counts"):
            total += np.frombuffer(blob.as_py(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "counts"])


def set_keys(row: np.ndarray, grams: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit identity of each row's set; 0 for the empty one."""
    sizes = np.bincount(row, minlength=n_rows)
    keys = np.zeros(n_rows, np.uint64)
    np.add.at(keys, row, mix(grams ^ np.uint64(0xA5A5A5A5DEADBEEF)))
    return sizes, np.where(sizes > 0, mix(keys + sizes.astype(np.uint64)) | np.uint64(1), 0).astype(np.uint64)


def band(sizes: np.ndarray) -> np.ndarray:
    """0 for sets below ``BAND0`` shingles, then one band per factor of four."""
    b = np.zeros(len(sizes), np.int64)
    edge = BAND0
    while (sizes >= edge).any():
        b[sizes >= edge] += 1
        edge *= 4
    return b


def signatures(row: np.ndarray, grams: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): for each row the first ``size / 3 + 1`` signatures of each of its bands."""
    own = band(sizes)
    next_edge = BAND0 * 4**own
    out_rows, out = [], []
    for up in (0, 1):
        b = own + up
        use = (sizes > 0) if up == 0 else (4 * sizes >= 3 * next_edge)
        pick = use[row]
        r, g = row[pick], grams[pick]
        if not len(r):
            continue
        # band 0 divides the domain into single shingles
        parts = np.where(b > 0, BAND0 * 4**b, 0).astype(np.uint64)[r]
        h = mix(g ^ np.uint64(0x1234567))
        part = np.where(parts > 0, h % np.maximum(parts, 1), h)
        level = levels[(g & np.uint64(SLOTS - 1)).astype(np.int64)]
        order = np.lexsort((part, r))
        r, part, value, level = r[order], part[order], mix(g[order] ^ np.uint64(0x7777777)), level[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        r, token = r[at], mix(np.add.reduceat(value, at) ^ mix(part[at] + b[r[at]].astype(np.uint64)))
        level = np.minimum.reduceat(level, at)
        need = sizes // 3 + 1
        have = np.bincount(r, minlength=len(sizes))
        if (have[use] < need[use]).any():
            raise ValueError("a set fills fewer parts than the guarantee needs")
        rank_key = (level.astype(np.uint64) << np.uint64(58)) | (token >> np.uint64(6))
        order = np.lexsort((rank_key, r))
        start = np.cumsum(have) - have
        rank = np.arange(len(r)) - start[r[order]]
        order = order[rank < need[r[order]]]
        out_rows.append(r[order])
        out.append(token[order])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def describe(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Id, set size, key and histogram of each row; no key for the empty set.

    The histogram counts shingles by leading hash bits in one to two bins a shingle, two bins to a
    byte; it is empty (no bound) if a count is over 15.
    """
    hasher = Hasher(table)
    for batch in batches:
        size, key, hist = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for lo, hi, data, offsets in text_blocks(batch.column("_text")):
            row, grams = shingle_sets(hasher, data, offsets)
            n, k = set_keys(row, grams, hi - lo)
            size.append(n)
            key.append(k)
            bits = np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 1)
            base = np.cumsum(1 << bits) - (1 << bits)
            lead = mix(grams ^ np.uint64(0x5151515151)) >> np.uint64(1)
            bins = np.bincount(base[row] + (lead >> (63 - bits[row]).astype(np.uint64)).astype(np.int64), minlength=int((1 << bits).sum()))
            hist += [b"" if h.max() > 15 else (h[::2] | h[1::2] << 4).astype(np.uint8).tobytes() for h in np.split(bins, base[1:])]
        size, key = np.concatenate(size), np.concatenate(key)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_digest"), pa.array(size, pa.int64()), pa.array(key.view(np.int64), pa.int64(), mask=size == 0), pa.array(hist, pa.binary())], names=["_id", "_digest", "n", "key", "hist"])


def unpacked(hist: bytes) -> np.ndarray:
    x = np.frombuffer(hist, np.uint8)
    return np.stack([x & 15, x >> 4], axis=1).ravel().astype(np.int32)


def room(x: bytes, y: bytes, n: int, m: int) -> int:
    """Upper bound of the shared shingles: they share a bin."""
    if not x or not y:
        return min(n, m)
    p, q = unpacked(x), unpacked(y)
    w = min(len(p), len(q))
    return int(np.minimum(p.reshape(w, -1).sum(axis=1), q.reshape(w, -1).sum(axis=1)).sum())


def may_reach(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose histograms leave room for the similarity."""
    for batch in batches:
        keep = []
        for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ha", "hb", "na", "nb")))):
            both = room(x, y, n, m)
            if den * both >= num * (n + m - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of a quarter of the bins, which bound the shared shingles too, less closely."""
    for batch in batches:
        out = []
        for hist in batch.column("hist").to_pylist():
            bins = unpacked(hist)
            bins = bins.reshape(max(len(bins) // 4, 2), -1).sum(axis=1) if hist else np.array([16])
            out.append(b"" if bins.max() > 15 else (bins[::2] | bins[1::2] << 4).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(out, pa.binary())], names=["key", "n", "hist"])


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (grp, key, comp, n, hist) that come sorted by group, one list a group, in the order of sizes."""
    grp, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "comp", "n", "hist"))):
            if row[0] != grp and rows:
                yield sorted(rows, key=lambda r: (r[3], r[1]))
                rows = []
            grp = row[0]
            rows.append(row)
    if rows:
        yield sorted(rows, key=lambda r: (r[3], r[1]))


def close(rows: list[tuple], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a group the later ones of other components whose sizes and histograms leave room for a link.

    A set is compared with the larger ones of its size band at once.
    """
    comp, size = (np.array([r[i] for r in rows]) for i in (2, 3))
    unbounded = np.array([not r[4] for r in rows])
    folded: dict[int, np.ndarray] = {}
    for i, (_, _, c, n, hist) in enumerate(rows):
        j = int(np.searchsorted(size, n * den // num, "right"))
        if j <= i + 1:
            continue
        other = comp[i + 1 : j] != c
        if not other.any():
            continue
        if hist:
            w = 2 * len(hist)
            if w not in folded:  # bins of larger sets merge in pairs
                folded[w] = np.stack([unpacked(r[4]).reshape(w, -1).sum(axis=1, dtype=np.int16) if 2 * len(r[4]) >= w else np.zeros(w, np.int16) for r in rows])
            both = np.minimum(folded[w][i + 1 : j], folded[w][i]).sum(axis=1)
            both = np.where(unbounded[i + 1 : j], n, both)
        else:
            both = np.full(j - i - 1, n)
        yield i, i + 1 + np.flatnonzero(other & (den * both >= num * (n + size[i + 1 : j] - both)))


def worth_comparing(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Members of a group that their histograms leave room for a link with another of it."""
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["grp", "key", "comp", "n"])

    for rows in groups_of(batches):
        some = np.zeros(len(rows), bool)
        for i, later in close(rows, num, den):
            some[i] |= len(later) > 0
            some[later] = True
        out += [rows[i] for i in np.flatnonzero(some).tolist()]
        if len(out) > 100_000:
            yield batch_of(out)
            out = []
    yield batch_of(out)


def cross_pairs(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a group from different components whose sizes and histograms leave room for a link."""
    out = set()
    for rows in groups_of(batches):
        for i, later in close(rows, num, den):
            for j in later.tolist():
                a, b = rows[i][1], rows[j][1]
                out.add((a, b) if a < b else (b, a))
        if len(out) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = set()
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def emit(batches: Iterator[pa.RecordBatch], table: np.ndarray, levels: np.ndarray, labels: list[int]) -> Iterator[pa.RecordBatch]:
    """Packed signatures of a batch per bucket: six bytes of each, grouped by set."""
    hasher, buckets = Hasher(table), len(labels)

    def pack(rows: list[np.ndarray], sigs: list[np.ndarray]) -> pa.RecordBatch:
        owner, sig = np.concatenate(rows), np.concatenate(sigs)
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        owner, sig = owner[order], sig[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        packed = {"bucket": [], "sigs": [], "owners": [], "counts": []}
        for i in range(buckets):
            a, z = cut[i], cut[i + 1]
            if a < z:
                who, many = np.unique(owner[a:z], return_counts=True)
                packed["bucket"].append(labels[i])
                packed["sigs"].append(six_bytes(sig[a:z] // np.uint64(buckets)))
                packed["owners"].append(who.tobytes())
                packed["counts"].append(many.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(packed["bucket"], pa.int32()), *[pa.array(packed[c], pa.binary()) for c in ("sigs", "owners", "counts")]], names=list(packed))

    for batch in batches:
        rows, sigs, held = [], [], 0
        seen: set[int] = set()
        for lo, hi, data, offsets in text_blocks(batch.column("_text")):
            row, grams = shingle_sets(hasher, data, offsets)
            n, k = set_keys(row, grams, hi - lo)
            fresh = np.zeros(hi - lo, bool)
            for i, key in enumerate(k.tolist()):  # equal sets of a batch sign once
                if key and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            pick = fresh[row]
            r, s = signatures(row[pick], grams[pick], np.where(fresh, n, 0), levels)
            rows.append(k[r])
            sigs.append(s)
            held += len(s)
            if held > 500_000:
                yield pack(rows, sigs)
                rows, sigs, held = [], [], 0
        if held:
            yield pack(rows, sigs)


def six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(blob) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a signature, once per group of sets; keys ascend.

    A chance agreement of six bytes in one bucket only adds a candidate.
    """
    sigs, owners = [], []
    for batch in batches:
        for s, o, c in zip(batch.column("sigs"), batch.column("owners"), batch.column("counts")):
            sigs.append(from_six(s.as_py()))
            owners.append(np.repeat(np.frombuffer(o.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)))
    if not sigs:
        return
    sig, owner = np.concatenate(sigs), np.concatenate(owners)
    del sigs, owners
    order = np.argsort(sig)
    sig = sig[order]
    twin = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    sig, owner = sig[twin], owner[order][twin]
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[new], owner[new]
    if not len(sig):
        return
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(at, len(sig)))
    group = np.add.reduceat(mix(owner.view(np.uint64) ^ np.uint64(0x3C3C3C3C)), at) + size.astype(np.uint64)
    _, one = np.unique(group, return_index=True)
    one = one[size[one] > 1]
    for i in range(0, len(one), 1000):
        some = one[i : i + 1000]
        members = [owner[at[j] : at[j] + size[j]] for j in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(group[some].view(np.int64), pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["grp", "members"])


def sets_of(batches: Iterator[pa.RecordBatch], table: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets, six bytes a shingle, of the rows whose key is in the filter."""
    hasher = Hasher(table)
    for batch in batches:
        out: dict[int, list[int]] = {}
        for lo, hi, data, offsets in text_blocks(batch.column(0)):
            row, grams = shingle_sets(hasher, data, offsets)
            _, keys = set_keys(row, grams, hi - lo)
            slot = keys.view(np.int64) % np.int64(len(bits) * 64)
            hit = (keys > 0) & ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0)
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in np.flatnonzero(hit).tolist():
                out.setdefault(int(keys[i : i + 1].view(np.int64)[0]), six_bytes(np.sort(grams[first[i] : first[i + 1]] & np.uint64((1 << 48) - 1))))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["key", "shingles"])


def compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets reach the similarity num / den."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            p, q = from_six(x.as_buffer()), from_six(y.as_buffer())
            joined = np.sort(np.concatenate([p, q]), kind="stable")
            both = int((joined[1:] == joined[:-1]).sum())
            if den * both >= num * (len(p) + len(q) - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def similar(pairs: DataFrame, texts: DataFrame, table: np.ndarray) -> DataFrame:
    """The pairs (``a``, ``b``) of set keys whose whole sets have similarity 3/4 or more."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    bits = texts.sparkSession.sparkContext.broadcast(filter_bits(keys, "key", BITS))
    sets = texts.mapInArrow(lambda it: sets_of(it, table, bits.value), "key bigint, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    # sets are dealt by key once; a pair then carries one set to the other
    y = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    x = pairs.select("a").distinct().join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    return cut_lineage(y.join(x, "a").mapInArrow(lambda it: compare(it, 75, 100), "a bigint, b bigint"), "partenum_links")


def candidates(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows, groups, table): id, set size and key per row; groups of keys that share a signature."""
    spark, table = docs.sparkSession, space_table()
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    parts = texts.mapInArrow(lambda it: count_shingles(it, table), "segment int, counts binary").groupBy("segment").applyInArrow(add_counts, "segment int, counts binary")
    counts = np.zeros((SLOTS // SEGMENT, SEGMENT), np.int64)
    for r in parts.collect():  # a table of fixed size
        counts[r["segment"]] = np.frombuffer(r["counts"], np.int64)
    counts, total = counts.reshape(-1), int(counts.sum())
    mean = total / SLOTS
    often = (counts - mean) / (4 * mean**0.5 + 4)  # how far beyond chance
    levels = spark.sparkContext.broadcast(np.clip(np.floor(np.log2(np.maximum(often, 1))), 0, 31).astype(np.uint8))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2 // PER_TASK)
    given = docs.select(F.col(f"`{doc_id}`").alias("_id"), digest(text).alias("_digest"), F.col(f"`{text}`").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()
    rows = cut_lineage(given.mapInArrow(lambda it: describe(it, table), f"_id {kind}, _digest binary, n bigint, key bigint, hist binary"), "partenum_rows")
    # one bucket per task: numbers that Spark's hash deals to different tasks
    dealt = spark.range(40 * tasks).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(tasks))).agg(F.min("label").alias("label"))
    labels = sorted(r["label"] for r in dealt.collect())
    packed = texts.mapInArrow(lambda it: emit(it, table, levels.value, labels), "bucket int, sigs binary, owners binary, counts binary").repartition(tasks, "bucket").drop("bucket")
    groups = packed.mapInArrow(meet, "grp bigint, members array<bigint>").groupBy("grp").agg(F.first("members").alias("members"))
    return rows, cut_lineage(groups, "partenum_groups"), table


def grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row its id, digest, set size and component (a set key; null for the empty set)."""
    rows, groups, table = candidates(docs, doc_id, text)
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    sizes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("hist").alias("hist"))
    sizes = cut_lineage(sizes.join(groups.select(F.explode("members").alias("key")).distinct(), "key", "left_semi"), "partenum_sizes")

    # a set meets many others and may link with few: short histograms tell which, and only there the whole ones go
    short = cut_lineage(sizes.mapInArrow(shortened, "key bigint, n bigint, hist binary"), "partenum_short")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and histograms leave room for a link."""
        for hists in (short, sizes):
            a, b = (hists.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("hist").alias(f"h{c}")) for c in "ab")
            near = pairs.join(a, "a").join(b, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
            pairs = near.mapInArrow(lambda it: may_reach(it, 75, 100), "a bigint, b bigint")
        return pairs

    # the centre of a group is its member that meets most others: an original more than its copies
    met = groups.select("grp", F.size("members").alias("m"), F.explode("members").alias("key"))
    met = met.join(met.groupBy("key").agg(F.sum("m").alias("meets")), "key")
    centre = met.groupBy("grp").agg(F.max(F.struct("meets", "key")).alias("c")).select("grp", F.col("c.key").alias("centre"))
    star = groups.join(centre, "grp").select(F.explode("members").alias("key"), "centre").where("key <> centre")
    star = cut_lineage(fitting(star.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()), "partenum_star")
    links = similar(star, texts, table)
    comp = cut_lineage(components(links), "partenum_comp")
    # groups that the stars did not join: members of different components, once
    member = groups.select("grp", F.explode("members").alias("key")).join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    split = member.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("grp", "key", "comp", "n", "hist").repartition(tasks, "grp").sortWithinPartitions("grp")

    apart = dealt(member.join(split, "grp").join(short, "key")).mapInArrow(lambda it: worth_comparing(it, 75, 100), "grp bigint, key bigint, comp bigint, n bigint")
    apart = dealt(apart.join(sizes.select("key", "hist"), "key"))
    rest = apart.mapInArrow(lambda it: cross_pairs(it, 75, 100), "a bigint, b bigint").distinct()
    rest = cut_lineage(rest.join(star, ["a", "b"], "left_anti"), "partenum_rest")
    if not rest.isEmpty():
        links = links.union(similar(rest, texts, table))
        comp = cut_lineage(components(links), "partenum_comp")
    joined = rows.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    return cut_lineage(joined.select("_id", "_digest", "n", "comp"), "partenum_components")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least id reachable over links) per row of ``docs``.

    Two rows link when the Jaccard similarity of their sets of five-word shingles is 0.75 or more.
    Null, empty and blank texts have no set and link with nothing; repeated rows and equal sets
    are one node; a null id is kept and never the least unless all of its component are null;
    other columns are not read.  All links between different sets are found, but links are only
    compared until their component is known.
    """
    rows = grouped(docs, doc_id, text)
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("_id").alias("least"))
    return rows.join(least, "comp", "left").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row with the least id stays.

    Rows without a set all stay.  Of several rows with the least id the one with the least digest
    of its text stays, and of repeated rows one.  A null id is greater than any other.
    """
    rows = grouped(docs, doc_id, text).where("comp IS NOT NULL")
    name = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_digest"))
    first = rows.groupBy("comp").agg(F.min(name).alias("first"))
    drop = rows.join(first, "comp").where(name != F.col("first")).select("_id", "_digest").distinct()
    twice = rows.groupBy("_id", "_digest").count().where("count > 1").select("_id", "_digest")
    drop, twice = cut_lineage(drop, "partenum_drop"), cut_lineage(twice, "partenum_twice")

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = right.select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"))
        return left.join(r, (F.col("_digest") == F.col("_rdigest")) & F.col("_id").eqNullSafe(F.col("_rid")), how)

    # only rows whose id may be asked for are shuffled; the joins that follow are exact
    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(drop.union(twice).select(slot("_id").alias("slot")), "slot", BITS))

    @F.arrow_udf("boolean")
    def listed(slot: pa.Array) -> pa.Array:
        at = slot.to_numpy(zero_copy_only=False)
        return pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    # the row travels as one column, so no column of it can be mistaken for a helper's
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    given = docs.select(row, F.col(f"`{doc_id}`").alias("_id"), digest(f"`{text}`").alias("_digest"))
    free = given.where(~listed(slot("_id")))
    kept = matched(given.where(listed(slot("_id"))), drop, "left_anti")
    if not twice.isEmpty():
        again = matched(kept, twice, "left_semi").dropDuplicates(["_id", "_digest"])
        kept = matched(kept, twice, "left_anti").union(again)
    return free.select("row.*").union(kept.select("row.*"))
