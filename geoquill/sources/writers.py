"""Writers: versioned index folders with a manifest published last, partitioned tables, dumps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_index(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None, cluster: dict[str, str] | None = None) -> str:
    """Write every table under ``root/version``, then the manifest, then the pointer that readers follow.

    A reader sees the old version until the pointer has moved, which is one rename; a failed build leaves it alone.
    """
    made = {}
    for name, df in tables.items():
        if cluster and name in cluster:
            df = df.repartition(F.col(cluster[name])).sortWithinPartitions(cluster[name])
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.partitionBy(*partition[name])
        w.parquet(f"{root}/{version}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}")
        made[name] = {"rows": back.count(), "schema": json.loads(df.schema.json())}
    _put(spark, f"{root}/{version}/manifest.json", json.dumps({"version": version, "tables": made}))
    _put(spark, f"{root}/current", version)
    return f"{root}/{version}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # one rename that replaces the target: a reader sees the old text or the new one
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, options)


def _get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def open_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current version; row counts and schemas must be those of the manifest."""
    version = _get(spark, f"{root}/current").strip()
    manifest = json.loads(_get(spark, f"{root}/{version}/manifest.json"))
    out = {}
    from pyspark.sql.types import StructType

    for name, said in manifest["tables"].items():
        df = spark.read.schema(StructType.fromJson(said["schema"])).parquet(f"{root}/{version}/{name}")
        if df.count() != said["rows"]:
            raise ValueError(f"{name}: {said['rows']} rows expected")
        out[name] = df
    return out


def forward_index(docs: DataFrame, root: str, per_country: bool = True) -> None:
    """Documents by country, a folder each, or as one table; sorted by name, so that a look-up skips row groups."""
    df = docs.withColumn("country_code", F.coalesce(F.lower("country"), F.lit("unknown")))
    # a large country takes several tasks: rows are dealt by country and a hash of their id
    df = df.repartition("country_code", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("country_code", "name")
    w = df.write.mode("overwrite")
    (w.partitionBy("country_code") if per_country else w).parquet(root)


def autocomplete_index(entries: DataFrame, root: str, per_country: bool = True) -> None:
    """Completion entries (country, key, id, name, rank) in key order, by country or unified: ranges of keys in each file."""
    by = ["country", "key"] if per_country else ["key", "country"]
    w = entries.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
    (w.partitionBy("country") if per_country else w).parquet(root)


def address_shards(points: DataFrame, root: str, deg: float = 0.05) -> None:
    """Address points by source and country, near ones together; the schema is published after the last row."""
    from geoquill.functions import geo

    df = points.withColumn("cell", geo.cell(F.col("lat"), F.col("lng"), deg).cast("long"))
    df = df.repartition("source", "country_code", F.floor(F.col("cell") / (1 << 24))).sortWithinPartitions("source", "country_code", "cell")
    df.write.mode("overwrite").partitionBy("source", "country_code").parquet(f"{root}/rows")
    _put(points.sparkSession, f"{root}/schema.json", df.schema.json())


def open_address_shards(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(_get(spark, f"{root}/schema.json")))).parquet(f"{root}/rows")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """A dump with a header as Parquet, for inspection by SQL."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(source)
    df.write.mode("overwrite").parquet(target)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, rows, fields) of the tables that the current version's manifest promises."""
    version = _get(spark, f"{root}/current").strip()
    said = json.loads(_get(spark, f"{root}/{version}/manifest.json"))["tables"]
    return spark.createDataFrame([(k, v["rows"], len(v["schema"]["fields"])) for k, v in said.items()], "name string, rows long, fields int")


def coordinate(c: Column) -> Column:
    return F.format_string("%.6f", c)


def dump_csv(df: DataFrame, path: str, coordinates: tuple[str, ...] = ("lat", "lng")) -> None:
    """Header, quoted where needful, coordinates at six places."""
    cols = [coordinate(F.col(c)).alias(c) if c in coordinates else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_tsv(df: DataFrame, path: str, version: str) -> None:
    """Tab-separated rows behind a version line in the first file."""
    body = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"), F.lit(1).alias("o"))
    head = df.sparkSession.range(1).select(F.lit(f"#{version}").alias("value"), F.lit(0).alias("o"))
    head.unionByName(body).select("value").write.mode("overwrite").text(path)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def response(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per row; nulls are left out."""
    return df.select(F.to_json(F.struct(*columns)).alias("body"))
