"""A prefix trie of conversations, built as burst tries.

A conversation is a path of turn ids; a node is a distinct prefix of paths.  Equal paths are one
suffix with the number of its members.  Suffixes lie in containers; a container holds the suffixes that share
their first turns, and stands under the trie head of that prefix.  A container with more than
``ROWS`` suffixes or ``TURNS`` turns bursts: what all its suffixes share becomes a chain of trie
heads, and the next turn id deals them to new containers.  Its rows, its least and greatest path (whose
common prefix is the common prefix of all) and its members are partial aggregates, so a container
that holds all paths is no burden to any task.  Containers that remain are small; they are dealt to shards,
sorted, and swept once from the first suffix to the last: a stack holds the open nodes, and a node closes
when the next suffix leaves its prefix.  Totals below the heads are one more sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage

#: Suffixes and turns that a container may hold; one suffix alone never bursts.
ROWS, TURNS = 2048, 1 << 16
#: Ids of equal paths that travel as one string.
PACK = 10_000
#: Characters of a turn id.
ID = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()


def graft_length(conv: Column) -> Column:
    """Number of turns a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)).cast("int")


def paths(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv``, ``path``, ``chars``): turn ids in one string and code points per turn, as given.

    Turns are ordered by ``turn``, nulls first, then by role and turn id; null roles and texts are
    empty; repeated rows are turns of their own; rows without a conversation id take no part.  A
    conversation's ids (not its texts) are assembled in one task.
    """
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    # the length of the role keeps ("a", "bc") and ("ab", "c") apart
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        r.alias("role"),
        F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)).alias("id"),
        F.char_length(t).alias("chars"),
    )
    nth = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "id"))
    one = F.array_sort(F.collect_list(F.struct("nth", "id", "chars")))
    return turns.select("conv", nth.alias("nth"), "id", "chars").groupBy("conv").agg(one.alias("turns")).select("conv", "turns")


def grafted(given: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its hundred.

    ``given`` and the result hold (``conv``, ``turns``).  All turns of the other are taken if it has
    fewer, none if it is absent; the conversation's own turns follow after as many as were asked for.
    """
    given = cut_lineage(given, "trie_turns")
    first = given.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.slice("turns", 1, 5).alias("lent"))
    h = graft_length(F.col("conv"))
    joined = given.withColumn("base", F.expr("conv - conv % 100")).join(first, "base", "left")
    nothing = F.slice("turns", 1, 0)
    lent = F.coalesce(F.slice("lent", F.lit(1), h), nothing)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv", F.concat(lent, own).alias("turns"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, conv): runs of equal paths, with up to ``PACK`` ids as one string."""
    path, chars, ids, rows = None, None, [], []

    def shipped():
        columns = list(zip(*rows))
        rows.clear()
        types = [pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "chars", "first", "n", "ids"])

    for batch in batches:
        for p, n, conv in zip(batch.column("path").to_pylist(), batch.column("chars").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (p != path or len(ids) >= PACK):
                rows.append((path, chars, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            path, chars = p, n
            ids.append(conv)
        if rows:
            yield shipped()
    if ids:
        rows.append((path, chars, ids[0], len(ids), ",".join(map(str, ids))))
        yield shipped()


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by (path, first): one row per path, its ids hashed as they pass."""
    types = [("path", pa.string()), ("chars", pa.list_(pa.int32())), ("size", pa.int32()), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]
    path, rows, state = None, [], None

    def closed():
        return (path, state[0], len(path) // ID, state[1], state[2], state[3].hexdigest())

    for batch in batches:
        for p, chars, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "first", "n", "ids"))):
            if p == path:
                state[2] += n
                state[3].update(b"," + ids.encode())
                continue
            if state:
                rows.append(closed())
            path, state = p, [chars, first, n, hashlib.sha256(ids.encode())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), types)], names=[k for k, _ in types])
            rows = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, (_, t) in zip(closed(), types)], names=[k for k, _ in types])


def suffixes(given: DataFrame) -> DataFrame:
    """Distinct paths: (``path``, ``chars``, ``size``, ``conv`` least member, ``n`` members, ``ends`` hash of members).

    A path that very many conversations share is dealt by ranges of ids first, so that one task
    sees only packs of them; their hash is a sequence by its nature and is computed as they pass.
    """
    flat = given.select("conv", F.array_join(F.transform("turns", lambda t: t["id"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    flat = cut_lineage(flat, "trie_paths")
    packs = flat.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv").mapInArrow(pack, "path string, chars array<int>, first bigint, n bigint, ids string")
    key = F.md5("path")
    out = packs.repartition(key).sortWithinPartitions("path", "first").mapInArrow(unite, "path string, chars array<int>, size int, conv bigint, n bigint, ends string")
    return cut_lineage(out, "trie_suffixes")


def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``deep``, the number of turns that the least and the greatest path share."""
    for batch in batches:
        deep = []
        for a, b in zip(batch.column("least").to_pylist(), batch.column("greatest").to_pylist()):
            lo, hi = 0, min(len(a), len(b)) // ID
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if a[: mid * ID] == b[: mid * ID] else (lo, mid - 1)
            deep.append(lo)
        keep = [n for n in batch.schema.names if n not in ("least", "greatest")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(deep, pa.int32())], names=[*keep, "deep"])


ABOVE = "array<struct<conv: bigint, depth: int>>"


def burst(seen: DataFrame, rows: int = ROWS, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(containers, heads) of the distinct paths.

    ``containers`` are the paths with ``head`` (key of their container), ``at`` (turns consumed),
    ``parent`` (least member of the node above) and ``above`` (the bursts on the way).  ``heads`` has one row
    per burst.  The number of rounds is the number of bursts on the longest way down.
    """
    live = seen.select("*", F.lit("").alias("head"), F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast(ABOVE).alias("above"))
    resting, heads = [], []
    while True:
        stats = live.groupBy("head", "at", "parent", "above").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("size") - F.col("at")).alias("turns"),
            F.sum("n").alias("n"),
            F.min("conv").alias("conv"),
            F.min(F.struct("path", "chars")).alias("low"),
            F.max("path").alias("greatest"),
        )
        full = stats.where((F.col("rows") > 1) & ((F.col("rows") > rows) | (F.col("turns") > turns)))
        full = full.select("head", "at", "parent", "above", "n", "conv", "low.chars", F.col("low.path").alias("least"), "greatest")
        found = full.mapInArrow(common, f"head string, at int, parent bigint, above {ABOVE}, n bigint, conv bigint, chars array<int>, deep int")
        found = cut_lineage(found, "trie_bursts")
        if found.isEmpty():
            resting.append(live)
            break
        # few rows beside the suffixes: Spark broadcasts them while they are small, and splits a hot container otherwise
        flags = found.select("head", "deep", F.col("conv").alias("top"))
        dealt = cut_lineage(live.join(flags, "head", "left"), "trie_dealt")
        resting.append(dealt.where("deep IS NULL").drop("deep", "top"))
        ends = dealt.where("size = deep").select("head", F.col("ends").alias("ends"))
        heads.append(found.join(ends, "head", "left"))
        on = dealt.where("size > deep")
        key = F.md5(F.concat("head", F.expr(f"substring(path, {ID} * at + 1, {ID} * (deep - at + 1))")))
        here = F.array(F.struct(F.col("top").alias("conv"), F.col("deep").alias("depth")))
        live = on.select(
            *seen.columns, key.alias("head"), (F.col("deep") + 1).alias("at"), F.col("top").alias("parent"),
            F.concat(F.coalesce("above", F.expr(f"CAST(array() AS {ABOVE})")), here).cast(ABOVE).alias("above"),
        )
    whole = resting[0]
    for part in resting[1:]:
        whole = whole.unionByName(part)
    if not heads:
        return whole, found.withColumn("ends", F.lit(None).cast("string"))
    every = heads[0]
    for part in heads[1:]:
        every = every.unionByName(part)
    return whole, cut_lineage(every, "trie_heads")


NODE = f"conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, above {ABOVE}"
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("conv", pa.int64()), ("depth", pa.int32())]))]
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above"]


class Node:
    __slots__ = ("depth", "chars", "conv", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars, self.conv, self.ends, self.below = depth, chars, None, NO_ENDS, []
        self.n = self.children = self.leaves = self.saved = 0


def sweep(batches: Iterator[pa.RecordBatch], ship: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose suffixes arrive sorted by (head, path).

    A node's row waits in its parent until the parent's least member is known, so no more rows
    wait than a container has turns.
    """
    stack: list[Node] = []
    rows: list[tuple] = []
    head = path = parent = above = None

    def close(depth: int) -> None:
        while stack and stack[-1].depth >= depth:
            node = stack.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.chars
            for child in node.below:
                rows.append((child.conv, child.depth, node.conv, child.n, child.children, child.leaves, child.saved, child.ends, None))
            node.below = []
            if not stack:  # the container's top
                rows.append((node.conv, node.depth, parent, node.n, node.children, node.leaves, node.saved, node.ends, above or []))
                return
            up = stack[-1]
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.below.append(node)

    def shipped() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
        rows.clear()
        return out

    names = ("head", "at", "parent", "above", "path", "chars", "conv", "n", "ends")
    for batch in batches:
        for h, at, up, over, p, chars, conv, n, ends in zip(*(batch.column(c).to_pylist() for c in names)):
            size = len(p) // ID
            if h != head:
                close(-1)
                head, path, parent, above = h, None, up, over
            shared = at - 1
            if path is not None:
                shared, most = at, min(size, len(path) // ID)
                while shared < most and path[shared * ID : shared * ID + ID] == p[shared * ID : shared * ID + ID]:
                    shared += 1
                close(shared + 1)
            for depth in range(shared + 1, size + 1):
                stack.append(Node(depth, chars[depth - 1] if depth else 0))
            last = stack[-1]
            last.n += n
            last.conv = conv if last.conv is None else min(last.conv, conv)
            last.ends = ends
            path = p
            if len(rows) >= ship:
                yield shipped()
    close(-1)
    if rows:
        yield shipped()


def nodes(given: DataFrame, *, rows: int = ROWS, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie over (``conv``, ``turns``), see ``trie``."""
    containers, heads = burst(suffixes(given), rows, turns)
    swept = containers.repartition("head").sortWithinPartitions("head", "path").mapInArrow(sweep, NODE)
    swept = cut_lineage(swept, "trie_nodes")

    own = F.col("n") - 1
    shares = F.transform(F.sequence("at", "deep"), lambda d: F.when(d == 0, F.lit(0)).otherwise(F.get("chars", d - 1)).cast("bigint") * own)
    heads = heads.select("*", shares.alias("shares"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = swept.where("above IS NOT NULL").select("above", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    parts = parts.unionByName(heads.where("above IS NOT NULL").select("above", F.lit(0).cast("bigint").alias("leaves"), total(F.col("shares")).alias("saved")))
    spread = parts.select("leaves", "saved", F.size("above").alias("ways"), F.posexplode("above").alias("way", "over"))
    below = spread.groupBy("over.conv", "over.depth").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("way") == F.col("ways") - 1).alias("children")
    )
    chain = heads.join(below.withColumnRenamed("depth", "deep"), ["conv", "deep"]).select("*", F.posexplode(F.sequence("at", "deep")).alias("i", "depth"))
    last = F.col("depth") == F.col("deep")
    one = F.lit(1).cast("bigint")
    upper = chain.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(one).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + total(F.slice("shares", F.col("i") + 1, F.size("shares") - F.col("i")))).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return swept.select(*NAMES[:-1]).unionByName(upper)


def trie(conversations: DataFrame, *, graft: bool = False, rows: int = ROWS, turns: int = TURNS, **columns) -> DataFrame:
    """One row per node of the prefix trie of all conversations.

    ``conv_id`` (least member) and ``depth`` name a node.  ``n_convs`` members, ``n_children``, ``n_leaves``
    and ``saved_tokens`` (what each node's members but one need not repeat of its last text, in
    code points) over its subtree, ``ends_sha256`` of the members that end there.  With ``graft`` conversations take
    their first turns from the first of their hundred.  An empty table has no nodes; a conversation
    without turns left ends at the root; null roles and texts are empty, rows without a
    conversation id take no part, ties and repeated rows are turns in the order ``paths`` states;
    other columns are not read.
    """
    given = paths(conversations, **columns)
    return nodes(grafted(given) if graft else given, rows=rows, turns=turns)
