"""Sharding by Karmarkar-Karp differencing: tight byte balance for groups that must stay whole.

A partial partition holds one part per shard.  The two with the largest spread are combined,
the largest part of one with the smallest of the other, until one partition is left.

Differencing is a sequence over one heap, so it runs on a number of items that does not
grow with the data: a group that weighs at least ``1 / (shards * per_shard)`` of all bytes is an
item of its own (there are at most ``shards * per_shard`` of these), every other group goes by a
hash of its key into one of ``shards * per_shard`` crates, and a crate is an item.  Crates are
small beside a shard and all differ, so differencing evens them out to a few bytes, as long as
no single group outweighs a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage, digest

PER_SHARD = 256
SLOT_ROWS = 50_000
RUN = 10_000


def difference(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item -> shard by repeated differencing of (size, item); equal inputs give equal results."""
    heap = []
    for n, (size, key) in enumerate(sorted(items, key=lambda x: (-x[0], x[1]))):
        heap.append((-size if shards > 1 else 0, n, [(0, ())] * (shards - 1) + [(size, (key,))]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # parts ascend in a and descend in b; members stay nested pairs until the end
        parts = sorted(((x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda part: part[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], n, parts))
        n += 1
    where = {}
    for shard, (_, members) in enumerate(heap[0][2] if heap else []):
        stack = [members]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                where[node] = shard
            else:
                stack.extend(node)
    return where


def group_key(text: str) -> Column:
    """Equal texts form a group; null texts form one."""
    return F.coalesce(digest(text), F.lit(b""))


def byte_size(text: str) -> Column:
    """UTF-8 bytes and 1; a null text counts 1."""
    return (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 1).cast("bigint")


def balance(groups: DataFrame, shards: int, per_shard: int = PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """Shards of the heavy groups and of the crates, from (``_key``, ``_size``) with unique keys.

    Both results have at most ``shards * per_shard`` rows.
    """
    crates = shards * per_shard
    total = groups.agg(F.sum("_size").alias("t"))
    heavy = F.col("_size") * F.lit(crates) >= total.scalar()
    items = groups.select(F.when(heavy, F.concat(F.lit("g"), F.hex("_key"))).otherwise(F.concat(F.lit("c"), crate(crates))).alias("item"), "_size")
    items = items.groupBy("item").agg(F.sum("_size").alias("size"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(s), k) for b in batches for k, s in zip(b["item"], b["size"])]
        where = difference(rows, shards)
        yield pd.DataFrame({"item": list(where), "shard": list(where.values())})

    # at most 2 * crates items, whatever the data
    solved = cut_lineage(items.repartition(1).mapInPandas(solve, "item string, shard int"), "kk_items")
    return (
        solved.where(F.col("item").startswith("g")).select(F.unhex(F.substring("item", 2, 1 << 20)).alias("_key"), F.col("shard").alias("_heavy")),
        solved.where(F.col("item").startswith("c")).select(F.substring("item", 2, 20).cast("int").alias("_crate"), F.col("shard").alias("_light")),
    )


def crate(crates: int) -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(crates)).cast("int")


def shard_groups(docs: DataFrame, *, text: str = "text", shards: int = 16, per_shard: int = PER_SHARD) -> DataFrame:
    """``docs`` with a column ``shard``: equal texts stay together, bytes are balanced.

    Null texts form one group, empty texts another; repeated rows stay with their text; an empty
    table stays empty.  A column named ``shard`` is replaced; other columns pass through.  Documents
    are read twice and not shuffled: the two lookup tables have a fixed bound and are broadcast.
    """
    keep = [c for c in docs.columns if c != "shard"]
    groups = docs.select(group_key(text).alias("_key"), byte_size(text).alias("_size")).groupBy("_key").agg(F.sum("_size").alias("_size"))
    heavy, light = balance(cut_lineage(groups, "kk_groups"), shards, per_shard)
    # the row travels as one column, so no column of it can be mistaken for a helper's
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    keyed = docs.select(row, group_key(f"`{text}`").alias("_key")).withColumn("_crate", crate(shards * per_shard))
    placed = keyed.join(F.broadcast(heavy), "_key", "left").join(F.broadcast(light), "_crate", "left")
    return placed.select("row.*", F.coalesce("_heavy", "_light").alias("shard"))


def with_slots(rows: DataFrame, *, part: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each part from 0 without gaps, in no task more than a bucket of a part.

    Equal rows are counted before the shuffle and spread out again at the end, so a row that
    repeats without bound is no burden.
    """
    others = [c for c in rows.columns if c != part]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = cut_lineage(counted, "kk_rows")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    bucketed = counted.withColumn("_bucket", F.pmod(F.xxhash64(*others), F.lit(total // SLOT_ROWS + 1)))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(part, "_bucket").agg(F.sum("_n").alias("_m")).select(part, "_bucket", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(part, "_bucket").orderBy(*others).rowsBetween(Window.unboundedPreceding, -1)
    first = bucketed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [part, "_bucket"])
    start = F.col("_offset") + F.col("_before")
    runs = first.select(*rows.columns, (start + F.col("_n")).alias("_end"), F.explode(F.sequence(start, start + F.col("_n") - 1, F.lit(RUN).cast("bigint"))).alias("_run"))
    return runs.select(*rows.columns, F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col("_end")) - 1)).alias(slot))


def assignments(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, size, CRC of the text (0 for null), shard, slot in the shard."""
    placed = shard_groups(docs, text=text, shards=shards).select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_crc32"),
        "shard",
    )
    return with_slots(placed)
