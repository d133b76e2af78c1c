"""Benchmark decontamination by winnowing.

Of every window of ``window - k + 1`` consecutive k-word hashes the least (the last of equal
ones) is kept as a fingerprint.  Two texts that share ``window`` words share a whole such
window of hashes, so they share the fingerprint it keeps: no span of ``window`` words is
missed.  Documents are joined with benchmark items on fingerprints, and each shared k-gram is
extended word by word to both sides; an extension over ``window`` words or more is a hit.
Items shorter than ``window`` words count as one window of their own length and are looked
up at every position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coobs.llm.tables import BITS, cut_lineage, digest, filter_bits
from coobs.llm.words import Hasher, alnum_table, in_one_row, list_array, ngrams, text_blocks

WINDOW = 10
GRAM = 5

HIT = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("left", pa.string()), ("gram", pa.string()), ("right", pa.string())])
HIT_SQL = "array<struct<fp:bigint,pos:int,size:int,left:string,gram:string,right:string>>"


def fingerprints(grams: np.ndarray, inside: np.ndarray, first: np.ndarray, k: int, width: int) -> np.ndarray:
    """Positions winnowing keeps; a row with fewer k-grams than a window keeps none."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, np.int64)
    whole = in_one_row(first, k + width - 1, n)
    for j in range(1, width):
        here = grams[j : j + n]
        lower = here <= least
        least = np.where(lower, here, least)
        where[lower] = j
    return np.unique((np.arange(n) + where)[whole])


def scan(batches: Iterator[pa.RecordBatch], table: np.ndarray, window: int, k: int, short: list[int] | None, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Fingerprints with their neighbouring words, per row: all of them, or those in ``bits``.

    ``short`` lists lengths under ``window`` to look up at every position; None (for the items)
    gives a row of fewer words its one window.
    """
    hasher, side = Hasher(table), window - k
    lower = np.where(table > 0, table - 1, 32).astype(np.uint8)
    for batch in batches:
        out, counts, n_words = [], [], []
        for _, _, data, offsets in text_blocks(batch.column("_text")):
            words, start, end, first = hasher.words(data, offsets)
            sizes = np.diff(first)
            n_words.append(sizes)
            found = []  # (position, size, hash)
            grams = ngrams(words, k)
            inside = in_one_row(first, k, len(grams))
            at = fingerprints(grams, inside, first, k, side + 1)
            found.append((at, np.full(len(at), k), grams[at]))
            for m in range(1, window) if short is None else short:
                grams = ngrams(words, m)
                at = np.flatnonzero(in_one_row(first, m, len(grams)))
                if short is None:
                    row = np.searchsorted(first, at, "right") - 1
                    at = at[sizes[row] == m]
                found.append((at, np.full(len(at), -m), grams[at] ^ np.uint64(0x5BD1E995 * m)))
            pos, size, fp = (np.concatenate(x) for x in zip(*found))
            if bits is not None and len(fp):
                slot = fp.view(np.int64) % np.int64(len(bits) * 64)
                hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                pos, size, fp = pos[hit], size[hit], fp[hit]
            order = np.lexsort((size, pos))
            pos, size, fp = pos[order], size[order], fp[order]
            row = np.searchsorted(first, pos, "right") - 1
            counts.append(np.bincount(row, minlength=len(sizes)))
            texts = lower[data].tobytes() if len(pos) else b""
            for p, s, h, r in zip(pos.tolist(), size.tolist(), fp.view(np.int64).tolist(), row.tolist()):
                m, reach = abs(s), side if s > 0 else 0
                lo, hi = max(int(first[r]), p - reach), min(int(first[r + 1]), p + m + reach)
                parts = [[texts[start[i] : end[i]].decode("utf-8", "replace") for i in range(a, b)] for a, b in ((lo, p), (p, p + m), (p + m, hi))]
                out.append({"fp": h, "pos": p - int(first[r]), "size": s, "left": " ".join(parts[0]), "gram": " ".join(parts[1]), "right": " ".join(parts[2])})
        hits = list_array(pa.array(out, HIT), np.concatenate(counts) if counts else np.zeros(0, np.int64))
        columns = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in columns] + [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), hits],
            names=[*columns, "n_words", "hits"],
        )


def split(words: str) -> list[str]:
    """Words that ``scan`` joined by a blank; white space beyond ASCII belongs to words."""
    return words.split(" ") if words else []


def extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Joined fingerprints -> word interval of the document that the item shares, if long enough."""
    for batch in batches:
        rows = {n: batch.column(n).to_pylist() for n in ("pos", "size", "gram", "left", "right", "i_gram", "i_left", "i_right")}
        keep, lo, hi = [], [], []
        for i, (pos, size) in enumerate(zip(rows["pos"], rows["size"])):
            if rows["gram"][i] != rows["i_gram"][i]:
                continue
            l = r = 0
            if size > 0:
                for a, b in zip(reversed(split(rows["left"][i])), reversed(split(rows["i_left"][i]))):
                    if a != b:
                        break
                    l += 1
                for a, b in zip(split(rows["right"][i]), split(rows["i_right"][i])):
                    if a != b:
                        break
                    r += 1
                if l + size + r < window:
                    continue
            keep.append(i)
            lo.append(pos - l)
            hi.append(pos + abs(size) + r)
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest").take(pa.array(keep, pa.int64())), batch.column("item").take(pa.array(keep, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            names=["digest", "item", "lo", "hi"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: its id, the digest of its text, ``n_words``, ``n_hit`` (words
    inside any occurrence of an item window), ``n_items``, ``items`` (their ids as sorted strings).

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII.  A null text
    has no words and no hits; an empty table gives an empty result or no hits; repeated rows each
    get the result of their text; a null item id counts under the empty string; other columns of
    either table are not read.  Texts are scanned once, whatever their length.
    """
    spark, table = docs.sparkSession, alnum_table()
    given = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("_text"))
    prints = (
        given.mapInArrow(lambda it: scan(it, table, window, k, None, None), f"item string, n_words bigint, hits {HIT_SQL}")
        .select("item", F.explode("hits").alias("h"))
        .select("item", F.col("h.fp").alias("fp"), F.col("h.size").alias("size"), F.col("h.left").alias("i_left"), F.col("h.gram").alias("i_gram"), F.col("h.right").alias("i_right"))
        .distinct()
    )
    prints = cut_lineage(prints, "winnow_items")
    bits = spark.sparkContext.broadcast(filter_bits(prints, "fp", BITS))
    short = sorted(-r[0] for r in prints.where("size < 0").select("size").distinct().collect())  # lengths under the window

    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    scanned = cut_lineage(rows.mapInArrow(lambda it: scan(it, table, window, k, short, bits.value), f"_id {kind}, digest binary, n_words bigint, hits {HIT_SQL}"), "winnow_docs")
    # equal texts have equal hits: work on one of each
    hits = (
        scanned.where(F.size("hits") > 0)
        .groupBy("digest")
        .agg(F.first("hits").alias("hits"))
        .select("digest", F.explode("hits").alias("h"))
        .select("digest", "h.*")
    )
    spans = hits.join(prints, ["fp", "size"]).select("digest", "item", "pos", "size", "left", "gram", "right", "i_left", "i_gram", "i_right")
    spans = cut_lineage(spans.mapInArrow(lambda it: extend(it, window), "digest binary, item string, lo int, hi int").distinct(), "winnow_spans")
    ordered = Window.partitionBy("digest").orderBy("lo", "hi")
    reach = F.coalesce(F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (
        spans.select("digest", "lo", "hi").distinct().withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reach)))
        .groupBy("digest").agg(F.sum("new").cast("bigint").alias("n_hit"))
    )
    named = spans.select("digest", "item").distinct().groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.join(named, "digest")
    return scanned.join(found, "digest", "left").select(
        F.col("_id").alias(doc_id),
        "digest",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows that hold any window of an item; null texts stay."""
    text = kw.get("text", "text")
    bad = decontaminate(docs, items, **kw).where("n_hit > 0").select(F.col("digest").alias("bad")).distinct()
    # the row travels as one column, so no column of it can be mistaken for a helper's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(f"`{text}`").alias("own"))
    return whole.join(bad, F.col("own") == F.col("bad"), "left_anti").select("row.*")
