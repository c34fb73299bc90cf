"""Helpers that every training-data operator shares: shared scratch tables, Arrow batch sizes, splits."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id is called inside; it is null again in results.
NO_ID = -(2**63)
#: Rows and bytes of an Arrow batch, whichever is reached first: texts may be long.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20

#: Paths of scratch tables written inside open :class:`scratch` blocks, one list a block.
_blocks: list[list[str]] = []


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only on one machine (a local master, as in tests) is a folder made up where the session sets none; on a cluster a
    missing setting is an error, as no local folder is shared there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "geoquill-checkpoints")
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if _blocks:
        _blocks[-1].append(path)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing lazy reads any more: what was made from them is stored itself."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            delete(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end every scratch table written inside: whoever opens it has stored or read its result by then.

    Lazy results of the operators read scratch tables, so only the caller knows when those may go.
    """
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def same_row(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(id, hash of the text): what tells rows apart that repeat an id. Null ids and null texts are values like others."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learnt from; a null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % 5) == 0, F.lit(True))


def file_bytes(path: str) -> bytes:
    """A model file as the driver reads it; operators broadcast its bytes, so executors need no such path."""
    with open(path, "rb") as f:
        return f.read()


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most about ``most`` labelled rows outside the held-out fifth.

    ``most`` is the documented bound of what a model is fitted on. Rows are chosen by a hash of the id, so the
    choice depends neither on order nor on partitions. Null labels and ids are left out; of repeated labels for
    one id the larger holds.
    """
    lab = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    n = lab.count()
    if n > most:
        lab = lab.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # at most `most` rows of two numbers, so the broadcast has a fixed bound
    return docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("doc_id", "text", "y")
