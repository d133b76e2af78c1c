"""URL filters on a sorted digest array.

A rule is a host with a path prefix.  The array holds the 64-bit xxhash of every rule in order,
followed by the rules' full strings; tasks map the file into memory, so only the pages that
searches touch are read, and all workers of a machine share them.  A URL asks for each suffix of
its host with each prefix of its path whose length some rule has; all questions of a batch go
through one vectorised binary search, and every digest that is found is confirmed against the
stored string, so that a collision never decides.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: marker between host and path in the stored string; a host never holds it
CUT = "/"


def host_of(url: str) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty without one."""
    c = F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), "://([^/?#]*)", 1)
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def write_index(rules: DataFrame, path: str) -> None:
    """Write (host, path, verdict) as a digest array; of equal rules ``block`` wins.

    Rules stream to the file in key order; only digests and offsets are held.
    """
    unique = rules.select(F.lower(F.trim("host")).alias("host"), "path", "verdict").where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keys, offsets, paths = [], [0], set()
    blob = bytearray()
    for row in sorted(((xxhash.xxh64_intdigest(r["host"] + CUT + r["path"]), r["host"], r["path"], r["verdict"]) for r in unique.toLocalIterator())):
        keys.append(row[0])
        blob += f"{row[3]} {row[1]}{CUT}{row[2]}".encode()
        offsets.append(len(blob))
        paths.add(len(row[2]))
    with open(path, "wb") as f:
        np.array([len(keys), len(paths)], np.int64).tofile(f)
        np.array(sorted(paths), np.int64).tofile(f)
        np.array(keys, np.uint64).tofile(f)
        np.array(offsets, np.int64).tofile(f)
        f.write(blob)


class Index:
    """A mapped digest array."""

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, 2)
        n, m = int(head[0]), int(head[1])
        raw = np.memmap(path, np.uint8, "r")
        at = 16
        self.lengths = raw[at : at + 8 * m].view(np.int64)
        at += 8 * m
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view(np.int64)
        self.blob = raw[at + 8 * (n + 1) :]

    def find(self, asked: list[str]) -> list[str | None]:
        """Verdict of each string that is stored, else None."""
        out: list[str | None] = [None] * len(asked)
        if not asked or not len(self.keys):
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in asked), np.uint64, len(asked))
        at = np.searchsorted(self.keys, digests)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == digests[open_]]
            for i in open_.tolist():
                stored = self.blob[self.offsets[at[i]] : self.offsets[at[i] + 1]].tobytes().decode()
                verdict, _, full = stored.partition(" ")
                if full == asked[i]:
                    out[i] = verdict
            # equal digests of other strings stand next to each other
            at[open_] += 1
            open_ = open_[[out[i] is None and at[i] < len(self.keys) for i in open_.tolist()]] if len(open_) else open_
        return out


def judge(batches: Iterator[pa.RecordBatch], name: str, default: str) -> Iterator[pa.RecordBatch]:
    index = Index(SparkFiles.get(name))
    lengths = [int(n) for n in index.lengths]
    for batch in batches:
        asked, owner, cuts = [], [], []
        for row, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
            labels = host.split(".") if host else []
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for n in lengths:
                    if n <= len(path):
                        asked.append(suffix + CUT + path[:n])
                        owner.append(row)
                        cuts.append((len(suffix) + n, len(suffix)))
        best: dict[int, tuple] = {}
        for q, row, size, verdict in zip(asked, owner, cuts, index.find(asked)):
            if verdict is not None and (row not in best or size > best[row][0]):
                host, path = q[: size[1]], q[size[1] + 1 :]
                best[row] = (size, host + path, verdict)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in batch.schema.names]
            + [pa.array([best[i][1] if i in best else None for i in range(n)], pa.string()), pa.array([best[i][2] if i in best else default for i in range(n)], pa.string())],
            names=[*batch.schema.names, "rule", "verdict"],
        )


def filter_urls(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the longest rule that fits (null if none) and its verdict.

    A rule fits its host and all subdomains, on paths that start with the rule's path.  A null URL
    or one without :// has an empty host and path and fits no rule, so it gets ``default``, as does
    every URL no rule fits; repeated rows are judged alike; other columns are not read.
    """
    spark = pages.sparkSession
    name = f"digests-{uuid.uuid4().hex}.bin"
    # the driver's file server hands this file to each executor, which keeps its own copy
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), name)
    write_index(rules, path)
    spark.sparkContext.addFile(path)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: judge(it, name, default), f"page_id {kind}, host string, path string, rule string, verdict string")
