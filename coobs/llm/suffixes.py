"""Removal of long repeated substrings by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

Which suffixes need sorting is decided by content: of every window of ``LENGTH`` bytes the grams of
``GRAM`` bytes are hashed and the window belongs to its least one (its anchor).  Equal windows have
equal anchors at equal places, so only suffixes at anchors that occur more than once are sorted, in
groups of one anchor gram, each with the bytes of the windows it is responsible for.  A text that
repeats as a whole is settled by its digest and takes part once.

In a group the suffixes to the right are sorted by multikey quicksort down to ``SHALLOW`` bytes,
what still ties by blind tries; the reversed texts to the left are sorted alike.  Each node of the
left trie is a set of suffixes that agree for so many bytes to the left; the longest common
prefix of neighbours in right order within it tells how long the agreeing string is.

A gram that occurs more than ``HOT`` times would be too large a group: its windows are hashed one
by one and counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import BITS, cut_lineage, digest, filter_bits
from coobs.llm.words import BASE, BASE_INVERSE, mix, powers, text_blocks

LENGTH = 400
GRAM = 32
SHALLOW = 24
HOT = 100_000
PIECE = 1 << 19


# ---- anchors ------------------------------------------------------------------------------------


class Roller:
    """Hashes of all windows of a fixed width of a byte array."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1024), powers(BASE_INVERSE, 1024)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if len(data) > len(self.up):
            self.up, self.down = powers(BASE, 2 * len(data)), powers(BASE_INVERSE, 2 * len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return mix((total[width:] - total[:n]) * self.down[:n])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest value of each window, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, roll: Roller, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, first window, last window) of the anchors of one text."""
    width, pieces = length - gram + 1, []
    for lo in range(0, max(len(data) - length + 1, 0), PIECE):
        h = roll(data[lo : lo + PIECE + length - 1], gram)
        order = (h >> np.uint64(32)).astype(np.uint32)
        least = sliding(order, width, np.minimum)
        pad = np.zeros(width - 1, np.uint32)
        best = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
        at = np.flatnonzero(best == order)
        pieces.append((at + lo, h[at], order[at]))
    if not pieces:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    pos, key, order = (np.concatenate(x) for x in zip(*pieces))
    pos, one = np.unique(pos, return_index=True)
    key, order = key[one], order[one]
    lo = np.zeros(len(pos), np.int64)
    lo[1:] = np.where(order[1:] <= order[:-1], pos[1:] - width + 1, pos[:-1] + 1)
    lo = np.maximum.accumulate(np.maximum(lo, 0))
    hi = np.append(lo[1:] - 1, len(data) - length)
    real = lo <= hi
    return key[real], pos[real], lo[real], hi[real]


def scan(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    roll = Roller()
    for batch in batches:
        sizes, out, counts = [], {"key": [], "pos": [], "lo": [], "hi": []}, []
        for _, _, data, offsets in text_blocks(batch.column("_text")):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = anchors(data[a:b], roll, length, gram)
                sizes.append(b - a)
                counts.append(len(found[0]))
                for c, x in zip(out, found):
                    out[c].append(x)
        cat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
        cut = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(cat[c].view(np.int64) if c == "key" else cat[c].astype(np.int32))) for c in out]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("digest"), pa.array(sizes, pa.int64()), *lists], names=["_id", "digest", "n", "key", "pos", "lo", "hi"])


# ---- deep-shallow sorting -----------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    return lo


def blind_trie(strings: list[bytes], items: list[int], known: int) -> list[tuple[int, int]]:
    """(item, common prefix with the one before) in order, for strings that agree in ``known`` bytes.

    Inner nodes keep a depth and the byte each branch has there; an insertion goes down blindly,
    compares once with the leaf it ends at, and branches where the two part.
    """
    # node: [depth, {byte: node}] or a list of equal items as a leaf
    root: list | None = None
    for item in items:
        s = strings[item]
        if root is None:
            root = ["leaf", [item]]
            continue
        node = root
        while node[0] != "leaf":
            c = s[node[0]] if len(s) > node[0] else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = common(s, other, known)
        if depth == len(s) == len(other):
            node[1].append(item)
            continue
        parent, branch, node = None, None, root
        while node[0] != "leaf" and node[0] < depth:
            c = s[node[0]] if len(s) > node[0] else -1
            parent, branch, node = node, c, node[1][c]
        mine = s[depth] if len(s) > depth else -1
        if node[0] == depth:
            node[1][mine] = ["leaf", [item]]
            continue
        theirs = other[depth] if len(other) > depth else -1
        split = [depth, {mine: ["leaf", [item]], theirs: node}]
        if parent is None:
            root = split
        else:
            parent[1][branch] = split
    out: list[tuple[int, int]] = []
    stack = [(root, known)]
    while stack:
        node, before = stack.pop()
        if node[0] == "leaf":
            for i, item in enumerate(node[1]):
                out.append((item, before if i == 0 else len(strings[item])))
        else:
            kids = [node[1][c] for c in sorted(node[1])]
            stack.extend((kid, node[0] if i else before) for i, kid in reversed(list(enumerate(kids))))
    return out


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common prefix of each with the one before (0 for the first)."""
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), known, 0)]
    while stack:
        items, depth, before = stack.pop()
        if len(items) == 1:
            out.append((items[0], before))
        elif depth >= known + shallow or len(items) == 2:
            done = blind_trie(strings, items, depth)
            out.append((done[0][0], before))
            out.extend(done[1:])
        else:
            byte = [strings[i][depth] if len(strings[i]) > depth else -1 for i in items]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            parts = [[], [], []]
            for i, c in zip(items, byte):
                parts[(c > pivot) - (c < pivot) + 1].append(i)
            todo, first = [], before
            for part, next_depth in zip(parts, (depth, depth + 1, depth)):
                if part:
                    if pivot == -1 and next_depth > depth:  # these strings have ended
                        todo.append((part, None, first))
                    else:
                        todo.append((part, next_depth, first))
                    first = depth
            for part, next_depth, b in reversed(todo):
                if next_depth is None:
                    stack.append((part, known + shallow, b))
                else:
                    stack.append((part, next_depth, b))
    return np.array([i for i, _ in out], np.int64), np.array([p for _, p in out], np.int64)


def repeats(left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(member, least, greatest offset before the anchor) of windows that another member shares.

    ``left`` are the reversed bytes before the anchor, ``right`` those from the anchor on; a member
    answers for offsets ``lo`` to ``hi``.
    """
    n = len(left)
    if n == 2:
        reach, back = common(*right), common(*left)
        for m in (0, 1):
            a, b = max(int(lo[m]), length - reach), min(int(hi[m]), back)
            if a <= b:
                yield m, a, b
        return
    order, prefix = deep_shallow(right, gram)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    table = [prefix]
    while 2 ** len(table) < n:
        x, half = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(x[:-half], x[half:]))

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes of ranks a < b."""
        k = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for j in np.unique(k).tolist():
            some = k == j
            out[some] = np.minimum(table[j][a[some] + 1], table[j][b[some] - 2**j + 1])
        return out

    by_left, agree = deep_shallow(left)
    # nodes of the left trie as (depth, first, end) with the depth of the parent
    stack: list[list[int]] = []
    nodes: list[tuple[int, int, int, int]] = []
    for i in range(1, n + 1):
        depth, start = (int(agree[i]) if i < n else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            nodes.append((max(depth, stack[-1][0] if stack else -1), d, start, i))
        if i < n and (not stack or stack[-1][0] < depth):
            stack.append([depth, start])
    for above, depth, a, b in nodes:
        members = by_left[a:b]
        ranks = np.sort(rank[members])
        near = between(ranks[:-1], ranks[1:])
        best = np.zeros(len(ranks), np.int64)
        best[:-1] = near
        best[1:] = np.maximum(best[1:], near)
        who = order[ranks]
        first = np.maximum(np.maximum(above + 1, length - best), lo[who])
        last = np.minimum(depth, hi[who])
        for i in np.flatnonzero(first <= last).tolist():
            yield int(who[i]), int(first[i]), int(last[i])


# ---- dataflow -----------------------------------------------------------------------------------


def pass_filter(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose digest may be asked for; the join that follows is exact."""
    for batch in batches:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
        yield batch.filter(pa.array(hit))


def contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the windows of each asked anchor."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "digest", "pos", "lo", "hi", "hot", "bytes")}
        held = 0
        for d, text, asked in zip(batch.column("digest").to_pylist(), batch.column("_text").to_pylist(), batch.column("asked").to_pylist()):
            data = text.encode()
            for x in asked:
                piece = data[x["lo"] : x["hi"] + length]
                for c, v in zip(out, (x["key"], d, x["pos"], x["lo"], x["hi"], x["hot"], piece)):
                    out[c].append(v)
                held += len(piece)
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays(packed(out), names=list(out))
                out, held = {c: [] for c in out}, 0
        yield pa.RecordBatch.from_arrays(packed(out), names=list(out))


def packed(out: dict[str, list]) -> list[pa.Array]:
    types = {"key": pa.int64(), "digest": pa.binary(), "pos": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "hot": pa.bool_(), "bytes": pa.binary()}
    return [pa.array(v, types[c]) for c, v in out.items()]


def solve(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Covered byte intervals per text from rows that come grouped by anchor key."""

    def group(rows: list[tuple]) -> Iterator[tuple[bytes, int, int]]:
        rows = list({(r[1], r[2]): r for r in rows}.values())  # one row per place
        if len(rows) < 2:
            return
        cut = [(r[2] - r[3], r) for r in rows]
        right = [r[5][c:] for c, r in cut]
        left = [r[5][:c][::-1] for c, r in cut]
        lo = np.array([r[2] - r[4] for r in rows])
        hi = np.array([r[2] - r[3] for r in rows])
        for m, a, b in repeats(left, right, lo, hi, length, gram):
            yield rows[m][1], rows[m][2] - b, rows[m][2] - a + length

    def flush(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], names=["digest", "a", "b"])

    key, rows, found = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "pos", "lo", "hi", "bytes"))):
            if row[0] != key:
                found.extend(group(rows))
                key, rows = row[0], []
                if len(found) > 50_000:
                    yield flush(found)
                    found = []
            rows.append(row)
    found.extend(group(rows))
    yield flush(found)


def window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """128-bit hash of each window of a hot anchor."""
    for batch in batches:
        for d, lo, data in zip(*(batch.column(c).to_pylist() for c in ("digest", "lo", "bytes"))):
            n = len(data) - length + 1
            hashes = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([d] * n, pa.binary()), pa.array(range(lo, lo + n), pa.int32())], names=["w", "digest", "s"])


def cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes without the covered intervals."""
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, cover in zip(batch.column("_text").to_pylist(), batch.column("cover").to_pylist()):
            data, parts, at, gone, n = text.encode(), [], 0, 0, 0
            end = -1
            for x in sorted(cover, key=lambda x: (x["a"], x["b"])):
                if x["a"] > end:
                    n += 1
                    parts.append(data[at : x["a"]])
                    gone += x["b"] - x["a"]
                    end = x["b"]
                elif x["b"] > end:
                    gone += x["b"] - end
                    end = x["b"]
                at = end
            removed.append(gone)
            spans.append(n)
            kept.append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "digest", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(summary, cuts).  ``summary``: per row of ``docs`` its id, ``n_bytes``, ``whole`` (every byte goes) and
    ``digest``; ``cuts``: per text that loses a part its digest, ``n_removed``, ``n_spans``, ``kept`` bytes.

    Null and empty texts, and texts shorter than ``length``, keep all bytes; rows with equal texts of
    ``length`` bytes or more lose all, as does a repeated row; other columns are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{doc_id}`").alias("_id"), digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()
    rows = given.mapInArrow(lambda it: scan(it, length, gram), f"_id {kind}, digest binary, n bigint, key array<bigint>, pos array<int>, lo array<int>, hi array<int>")
    rows = cut_lineage(rows, "suffix_rows")
    name = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))
    lists = F.arrays_zip("key", "pos", "lo", "hi")
    copies = rows.where(F.col("n") >= length).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("one"), F.first(lists).alias("anchors"))
    copies = cut_lineage(copies, "suffix_texts")
    places = copies.select("digest", F.col("one")["id"].alias("one"), F.explode("anchors").alias("x")).select("digest", "one", "x.*")
    often = copies.select(F.explode("anchors.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    again = places.join(often, "key").groupBy("digest", "one").agg(F.collect_list(F.struct("key", "pos", "lo", "hi", (F.col("c") > hot).alias("hot"))).alias("asked"))
    again = cut_lineage(again, "suffix_asked")

    def slot_of(c: str):
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    def texts_for(keys: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(filter_bits(keys.select(slot_of("digest").alias("slot")), "slot", BITS))
        return given.withColumn("slot", slot_of("digest")).mapInArrow(lambda it: pass_filter(it, bits.value), f"_id {kind}, digest binary, _text string, slot bigint").drop("slot")

    asked = again.withColumnRenamed("digest", "_digest")
    chosen = texts_for(again).join(asked, (F.col("digest") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("one"))).select("digest", "_text", "asked")
    pieces = chosen.mapInArrow(lambda it: contexts(it, length), "key bigint, digest binary, pos int, lo int, hi int, hot boolean, bytes binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("NOT hot").drop("hot").repartition(2 * tasks, "key").sortWithinPartitions("key")
    covered = dealt.mapInArrow(lambda it: solve(it, length, gram), "digest binary, a int, b int")
    if not often.where(F.col("c") > hot).isEmpty():
        w = cut_lineage(pieces.where("hot").mapInArrow(lambda it: window_hashes(it, length), "w binary, digest binary, s int"), "suffix_windows")
        twice = w.distinct().groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
        covered = covered.union(w.join(twice, "w").select("digest", F.col("s").alias("a"), (F.col("s") + length).alias("b")))
    single = copies.where("copies = 1").select("digest")
    cover = covered.join(single, "digest", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    cover = cut_lineage(cover, "suffix_cover")
    cuts = texts_for(cover).join(cover, "digest").mapInArrow(cut_text, f"_id {kind}, digest binary, n_removed bigint, n_spans bigint, kept binary")
    whole = copies.where("copies > 1").select("digest", F.lit(True).alias("whole"))
    summary = rows.select("_id", "digest", "n").join(whole, "digest", "left").select(F.col("_id").alias("doc_id"), "digest", F.col("n").alias("n_bytes"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return summary, cuts.drop("_id")
