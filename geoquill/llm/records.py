"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record is framed as: length (8 bytes, little-endian), masked CRC-32C of those 8 bytes, payload, masked CRC-32C of the
payload. The payload is doc_id (8 bytes), the width of an id (1 byte: 2 or 4), the number of ids (4 bytes), the ids.
Records lie in shards in ascending doc_id order; the index is a Parquet table beside them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ByteBpe
from .common import NO_ID, file_bytes, shared_dir, small_batches

#: Characters of text that a shard takes, about; a shard is read and written by one task.
SHARD_CHARS = 16_000_000
#: The CRC-32C polynomial (reflected) and the mask's addend.
POLY, MASK_ADD = 0x82F63B78, 0xA282EAD8
LANE = 64
HEADER = struct.Struct("<qBI")


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


def _times(op: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Apply a linear map on 32 bits, held as four tables of 256, to every value."""
    return op[0][v & 255] ^ op[1][(v >> 8) & 255] ^ op[2][(v >> 16) & 255] ^ op[3][v >> 24]


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """The map that feeding 2**power zero bytes makes of a CRC register."""
    every = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if power == 0:
        return _byte_table()[every & 255] ^ (every >> 8)
    half = _zeros(power - 1)
    return _times(half, _times(half, every))


def _after_zeros(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The registers ``v`` after ``n`` zero bytes each."""
    v, n = v.astype(np.uint32), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        on = ((n >> k) & 1).astype(bool)
        v[on] = _times(_zeros(k), v[on])
    return v


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload. Bytes run in lanes of 64 side by side; lanes are shifted and summed, as CRC is linear."""
    if not payloads:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in payloads], np.int64)
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    buf = np.zeros(int(ends[-1]) * LANE, np.uint8)
    for p, e, n in zip(payloads, (ends * LANE).tolist(), sizes.tolist(), strict=True):
        buf[e - n : e] = np.frombuffer(p, np.uint8)  # zeros in front change nothing from a zero register
    block, table = np.ascontiguousarray(buf.reshape(-1, LANE).T), _byte_table()
    reg = np.zeros(block.shape[1], np.uint32)
    for row in block:
        reg = table[(reg ^ row) & 255] ^ (reg >> 8)
    owner = np.repeat(np.arange(len(payloads)), lanes)
    reg = _after_zeros(reg, (ends[owner] - 1 - np.arange(len(reg))) * LANE)
    out = np.zeros(len(payloads), np.uint32)
    full = lanes > 0
    if full.any():
        out[full] = np.bitwise_xor.reduceat(reg, (ends - lanes)[full])
    ones = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    return out ^ _after_zeros(ones, sizes) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF).astype(np.uint32)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c_many(heads)), masked(crc32c_many(payloads))
    return [b"".join((h, x.tobytes(), p, y.tobytes())) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(data: bytes, most: int = 256) -> Iterator[list[bytes]]:
    """Payloads of a shard in runs of at most ``most``; raises on a wrong checksum or a cut record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        heads, said, found, checks = [], [], [], []
        while at < len(data) and len(heads) < most:
            if at + 12 > len(data):
                raise ValueError(f"cut record at byte {at}")
            (n,) = struct.unpack_from("<Q", data, at)
            if at + 16 + n > len(data):
                raise ValueError(f"cut record at byte {at}")
            heads.append(bytes(view[at : at + 8]))
            said.append(int.from_bytes(view[at + 8 : at + 12], "little"))
            found.append(bytes(view[at + 12 : at + 12 + n]))
            checks.append(int.from_bytes(view[at + 12 + n : at + 16 + n], "little"))
            at += 16 + n
        if not (np.array_equal(masked(crc32c_many(heads)), said) and np.array_equal(masked(crc32c_many(found)), checks)):
            raise ValueError("a record's checksum is wrong")
        yield found


def pack(doc_id: int, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and int(np.max(ids)) > 0xFFFF else 2
    return HEADER.pack(doc_id, wide, len(ids)) + np.asarray(ids, f"<u{wide}").tobytes()


def unpack(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, wide, n = HEADER.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{wide}", n, HEADER.size).astype("<u4")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder; a plain path is a mounted one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0) -> tuple[str, DataFrame]:
    """Encode every text, append ``end_id``, write shards under ``folder``; returns the folder and the offset index.

    The index has a row per record: doc_id, shard, offset, length, n_tokens. A null text is empty, so its record is the
    end id alone. A null id is written as the least number, so it comes first, and is null again when read; repeated rows
    are written as often as they occur, equal ids in the order of their texts. A task that runs again writes the same bytes under a new name and renames: a lost executor
    leaves nothing half-written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "records")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    (chars,) = rows.agg(F.sum(F.length("text"))).first()
    parts = max(1, -(-(chars or 0) // SHARD_CHARS))

    shipped = spark.sparkContext.broadcast(file_bytes(vocabulary))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard = ByteBpe(shipped.value), TaskContext.get().partitionId()
        fs, root = open_store(folder)
        fs.create_dir(f"{root}/shards", recursive=True)
        name = f"{root}/shards/part-{shard:06d}.rec"
        made, at = f"{name}.{uuid.uuid4().hex}.tmp", 0
        with fs.open_output_stream(made) as out:
            for b in batches:
                ids = [np.append(enc.ids(x), end_id) for x in b["text"]]
                recs = frame([pack(d, x) for d, x in zip(b["doc_id"].tolist(), ids, strict=True)])
                lengths = np.array([len(r) for r in recs], np.int64)
                offsets = at + np.cumsum(lengths) - lengths
                out.write(b"".join(recs))
                at += int(lengths.sum())
                yield pd.DataFrame({"doc_id": b["doc_id"], "shard": shard, "offset": offsets, "length": lengths, "n_tokens": [len(x) for x in ids]})
        fs.move(made, name)

    schema = "doc_id long, shard int, offset long, length long, n_tokens long"
    rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(write, schema).write.parquet(f"{folder}/index")
    return folder, _null_again(spark.read.schema(schema).parquet(f"{folder}/index"))


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start, n_tokens, ids_crc32 in file order, checksums verified.

    ``start`` is the number of ids in all records before. Only a row per shard passes through one task.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        fs, root = open_store(folder)
        for b in batches:
            for shard, base, records in zip(b["shard"], b["base"], b["records"], strict=True):
                with fs.open_input_stream(f"{root}/shards/part-{shard:06d}.rec") as f:
                    data = f.read()
                seen, at = 0, int(base)
                for run in unframe(data):
                    rows = []
                    for p in run:
                        d, ids = unpack(p)
                        rows.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    seen += len(rows)
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                if seen != records:
                    raise ValueError(f"shard {shard} has {seen} records, its index {records}")

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _null_again(
        shards.select("shard", "base", "records").repartition(width, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _null_again(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def read_at(folder: str, rows: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Ids of single records by (shard, offset, length) of the index: what a shuffled reader calls."""
    fs, root = open_store(folder)
    out = []
    for shard, offset, length in rows:
        with fs.open_input_file(f"{root}/shards/part-{shard:06d}.rec") as f:
            f.seek(offset)
            (payloads,) = unframe(f.read(length))
        out.append(unpack(payloads[0])[1])
    return out
