"""Reader of the binary format of network address databases: a search tree over address bits, and a section of records.

The tree is cut at its first eight bits, and each of the 256 parts is walked by a task of its own, so ranges are listed
without one task seeing them all. Addresses of four bytes are read, also where the tree is for sixteen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What opens the metadata, and the bytes between tree and records.
MARK, GAP = b"\xab\xcd\xefMaxMind.com", 16
RANGE = "lo long, hi long, country string, city string, lat double, lng double"


def decode(data: bytes, at: int, base: int):
    """(value, next place) of a record's field; pointers are places after ``base``."""
    kind, size = data[at] >> 5, data[at] & 31
    at += 1
    if kind == 1:
        width, low = size >> 3, size & 7
        raw = int.from_bytes(data[at : at + width + 1], "big")
        to = raw if width == 3 else (low << 8 * (width + 1)) + raw + (0, 2048, 526336)[width]
        return decode(data, base + to, base)[0], at + width + 1
    if kind == 0:
        kind, at = data[at] + 7, at + 1
    if size > 28:
        extra = size - 28
        size = (29, 285, 65821)[extra - 1] + int.from_bytes(data[at : at + extra], "big")
        at += extra
    if kind == 7:
        out = {}
        for _ in range(size):
            key, at = decode(data, at, base)
            out[key], at = decode(data, at, base)
        return out, at
    if kind == 11:
        items = []
        for _ in range(size):
            item, at = decode(data, at, base)
            items.append(item)
        return items, at
    if kind == 14:
        return bool(size), at
    raw, at = data[at : at + size], at + size
    if kind == 2:
        return raw.decode("utf-8"), at
    if kind == 3:
        return struct.unpack(">d", raw)[0], at
    if kind == 15:
        return struct.unpack(">f", raw)[0], at
    if kind == 8:
        return int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True), at
    return raw if kind == 4 else int.from_bytes(raw, "big"), at


class Tree:
    """A database in memory; its size is bounded by the address space that it describes."""

    def __init__(self, data: bytes):
        start = data.rfind(MARK)
        if start < 0:
            raise ValueError("no metadata: not an address database")
        self.data = data
        meta, _ = decode(data, start + len(MARK), start + len(MARK))
        self.nodes, self.bits = meta["node_count"], meta["record_size"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits")
        self.base = self.nodes * self.bits // 4 + GAP
        self.root, self.depth = 0, 0
        for _ in range(96 if meta["ip_version"] == 6 else 0):  # addresses of four bytes lie behind zeros
            if self.root < self.nodes:
                self.root = self.child(self.root, 0)

    def child(self, node: int, bit: int) -> int:
        at, w = node * self.bits // 4, self.bits // 8
        if self.bits == 28:
            middle = self.data[at + 3]
            raw = self.data[at : at + 3] if not bit else self.data[at + 4 : at + 7]
            return ((middle >> 4 if not bit else middle & 15) << 24) + int.from_bytes(raw, "big")
        return int.from_bytes(self.data[at + bit * w : at + (bit + 1) * w], "big")

    def record(self, value: int):
        return decode(self.data, self.base + value - self.nodes - GAP, self.base)[0]

    def walk(self, first: int) -> Iterator[tuple[int, int, dict]]:
        """(lo, hi, record) of all ranges whose addresses begin with the byte ``first``."""
        node, width = self.root, 32
        for k in range(7, -1, -1):
            if node >= self.nodes:
                break
            node, width = self.child(node, first >> k & 1), width - 1
        lo = first << 24
        if node > self.nodes and width > 24:  # a range wider than a byte is told by the first of its bytes
            if first & ((1 << (width - 24)) - 1):
                return
        todo = [(node, lo, width)]
        while todo:
            node, lo, width = todo.pop()
            if node > self.nodes:
                yield lo, lo + (1 << width) - 1, self.record(node)
            elif node < self.nodes and width:
                todo += [(self.child(node, 1), lo + (1 << (width - 1)), width - 1), (self.child(node, 0), lo, width - 1)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi, country, city, lat, lng) of all ranges of a database file."""
    shipped = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(shipped.value)
        for b in batches:
            rows = []
            for first in b["first"]:
                for lo, hi, r in tree.walk(int(first)):
                    spot = r.get("location", {})
                    rows.append((lo, hi, r.get("country", {}).get("iso_code"), r.get("city", {}).get("names", {}).get("en"), spot.get("latitude"), spot.get("longitude")))
            out = pd.DataFrame(rows, columns=["lo", "hi", "country", "city", "lat", "lng"])
            yield out.astype({"lo": "int64", "hi": "int64", "lat": float, "lng": float})

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(256).select(F.col("id").alias("first")).repartition(width).mapInPandas(walk, RANGE)
