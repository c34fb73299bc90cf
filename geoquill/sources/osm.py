"""Reader of the map's block-compressed binary exchange format, block by block in parallel.

A file is a row of blobs, each behind a small header that tells its size. One pass per file reads headers only and lists
where blobs lie; blobs are then dealt out and decoded by many tasks, so a planet file is neither read by one task nor held
whole. Only storage that pyarrow's file systems open is supported.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = (
    "kind string, id long, lat double, lng double, tags map<string,string>, refs array<long>, "
    "members array<struct<kind:string,ref:long,role:string>>"
)
KINDS = ("node", "way", "relation")


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return fs.open_input_file(p)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[at]
        at += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a message: number, and an integer or bytes."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 0:
            v, at = _varint(b, at)
        elif tag & 7 == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        elif tag & 7 == 1:
            v, at = b[at : at + 8], at + 8
        else:
            v, at = b[at : at + 4], at + 4
        yield tag >> 3, v


def packed(b: bytes, signed: bool = False) -> np.ndarray:
    """Packed integers; ``signed`` undoes the zigzag."""
    raw = np.frombuffer(b, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    part = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    v = np.bitwise_or.reduceat(part, first)
    if signed:
        return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
    return v.view(np.int64)


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def entities(block: bytes) -> list[tuple]:
    """Rows of a data block, as :data:`ENTITY`."""
    strings, groups, grain, lat0, lng0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [x.decode("utf-8", "replace") for _, x in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = _signed(v)
        elif n == 20:
            lng0 = _signed(v)
    degrees = lambda base, v: 1e-9 * (base + grain * v)
    rows = []
    for g in groups:
        for n, v in fields(g):
            m: dict[int, list] = {}
            for k, x in fields(v):
                m.setdefault(k, []).append(x)
            one = lambda k, m=m: m.get(k, [b""])[-1]
            if n == 2:
                ids, la, lo = (np.cumsum(packed(one(k), True)) for k in (1, 8, 9))
                tags, kv = [{} for _ in ids], packed(one(10)).tolist()
                at = k = 0
                while k < len(kv):
                    if kv[k] == 0:
                        at, k = at + 1, k + 1
                    else:
                        tags[at][strings[kv[k]]] = strings[kv[k + 1]]
                        k += 2
                rows += [("node", int(i), degrees(lat0, int(y)), degrees(lng0, int(x)), t, None, None) for i, y, x, t in zip(ids, la, lo, tags, strict=True)]
                continue
            if n not in (1, 3, 4):
                continue
            tags = {strings[a]: strings[b] for a, b in zip(packed(one(2)), packed(one(3)), strict=True)}
            if n == 1:
                rows.append(("node", _zigzag(one(1)), degrees(lat0, _zigzag(one(8))), degrees(lng0, _zigzag(one(9))), tags, None, None))
            elif n == 3:
                rows.append(("way", _signed(one(1)), None, None, tags, np.cumsum(packed(one(8), True)).tolist(), None))
            else:
                who = zip(packed(one(10)), np.cumsum(packed(one(9), True)), packed(one(8)), strict=True)
                rows.append(("relation", _signed(one(1)), None, None, tags, None, [{"kind": KINDS[t], "ref": int(r), "role": strings[s]} for t, r, s in who]))
    return rows


def blobs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, size) of every data blob; several files are one table."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                out, at = [], 0
                with _open(path) as f:
                    end = f.size()
                    while at < end:
                        f.seek(at)
                        (n,) = struct.unpack(">I", f.read(4))
                        head = dict(fields(f.read(n)))
                        at += 4 + n
                        if head[1] == b"OSMData":
                            out.append((path, at, head[3]))
                        at += head[3]
                yield pd.DataFrame(out, columns=["path", "at", "size"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(heads, "path string, at long, size long")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All nodes, ways and relations of the files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, at, size in zip(b["path"], b["at"], b["size"], strict=True):
                with _open(path) as f:
                    f.seek(at)
                    blob = dict(fields(f.read(size)))
                rows = entities(blob[1] if 1 in blob else zlib.decompress(blob[3]))
                out = pd.DataFrame(rows, columns=["kind", "id", "lat", "lng", "tags", "refs", "members"], dtype=object)
                yield out.assign(id=out["id"].astype("int64"), lat=out["lat"].astype(float), lng=out["lng"].astype(float))

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blobs(spark, paths).repartition(width, "path", "at").mapInPandas(decode, ENTITY)


def ways_with_nodes(entities_: DataFrame) -> DataFrame:
    """(id, tags, nodes) of ways whose nodes are all there, in order: one shuffle of references to their nodes."""
    ways = entities_.where("kind = 'way'").select("id", "tags", F.posexplode("refs").alias("pos", "ref"), F.size("refs").alias("want"))
    nodes = entities_.where("kind = 'node'").select(F.col("id").alias("ref"), "lat", "lng")
    found = ways.join(nodes, "ref").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))).alias("n"), F.max("want").alias("want"))
    found = found.where("size(n) = want").select("id", F.transform("n", lambda v: F.struct(v["lat"].alias("lat"), v["lng"].alias("lng"))).alias("nodes"))
    return found.join(entities_.where("kind = 'way'").select("id", "tags"), "id").select("id", "tags", "nodes")
