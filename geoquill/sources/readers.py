"""Readers of the source formats, each with an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def psv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-separated national address files: a header line, strings throughout, empty as null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("sep", "|").option("header", True).option("enforceSchema", True).csv(path)


#: Columns of the open address files.
OPEN_COLUMNS = "LON LAT NUMBER STREET UNIT CITY DISTRICT REGION POSTCODE ID HASH".split()


def _headers(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, header) of every file under a root: only first lines are read, by many tasks."""
    import pandas as pd
    import pyarrow.fs as pafs

    def first(batches):
        for b in batches:
            heads = []
            for path in b["path"]:
                fs, p = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with fs.open_input_stream(p) as f:
                    data = b""
                    while b"\n" not in data and (more := f.read(4096)):
                        data += more
                heads.append(data.split(b"\n", 1)[0].decode("utf-8-sig").strip())
            yield pd.DataFrame({"path": b["path"], "header": heads})

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    return listed.mapInPandas(first, "path string, header string")


def open_addresses(spark: SparkSession, root: str, include: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """All CSV files under a root, the country from the first folder; quotes and line ends inside fields are kept.

    Headers may have the columns in any case and order, and lack some. Files with one header are read together, and there
    are few different headers.
    """
    where = root.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    country = lambda c: F.lower(F.split_part(F.split_part(F.replace(c, F.lit(where), F.lit("\u0001")), F.lit("\u0001"), F.lit(2)), F.lit("/"), F.lit(1)))
    found = _headers(spark, root, ".csv").withColumn("country_code", country(F.col("path")))
    if include:
        found = found.where(F.col("country_code").isin(include))
    if skip:
        found = found.where(~F.col("country_code").isin(skip))
    kinds = found.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    fields = [c.lower() for c in OPEN_COLUMNS]
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*fields, "country_code"]))
    for k in kinds:
        names = [c.strip().strip('"').lower() for c in k["header"].split(",")]
        schema = ", ".join(f"`{c}` string" for c in names)
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(sorted(k["paths"]))
        df = df.select(*[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in fields], country(F.col("_metadata.file_path")).alias("country_code"))
        out = out.unionByName(df)
    return out


def usable_addresses(rows: DataFrame) -> DataFrame:
    """Finite numeric coordinates and a number; numbers of 0 and points at the origin are none."""
    lat, lng = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    ok = lat.between(-90, 90) & lng.between(-180, 180) & (F.trim("number") != "") & (F.trim("number") != "0") & ~((lat == 0) & (lng == 0))
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn("lat", lat).withColumn("lng", lng).drop("lon")


def tsv(spark: SparkSession, path: str, schema: str | StructType, version: str) -> DataFrame:
    """Tab-separated export whose first line is ``# version``; another version is refused."""
    head = spark.read.text(path).where(F.startswith("value", F.lit("#"))).select(F.trim(F.substr("value", F.lit(2)))).distinct().limit(2).collect()
    if [r[0] for r in head] != [version]:
        raise ValueError(f"{path}: version {[r[0] for r in head]}, not {version}")
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


#: Schema of a feature with a geometry of any kind.
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def rings(body: Column) -> Column:
    """Outer rings of a Polygon or MultiPolygon body as arrays of (lat, lng)."""
    kind = F.get_json_object(body, "$.geometry.type")
    text = F.get_json_object(body, "$.geometry.coordinates")
    one, many = F.from_json(text, "array<array<array<double>>>"), F.from_json(text, "array<array<array<array<double>>>>")
    outer = F.when(kind == "Polygon", F.array(F.get(one, F.lit(0)))).when(kind == "MultiPolygon", F.transform(many, lambda p: F.get(p, F.lit(0))))
    return F.transform(outer, lambda r: F.transform(r, lambda v: F.struct(F.get(v, F.lit(1)).alias("lat"), F.get(v, F.lit(0)).alias("lng"))))


def point_features(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line, gzip or plain: number, street, unit, city, postcode, lat, lng of valid points."""
    raw = spark.read.text(path)
    p = lambda k: F.get_json_object("value", f"$.properties.{k}").alias(k)
    at = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<double>")
    rows = raw.where(F.get_json_object("value", "$.geometry.type") == "Point").select(*[p(k) for k in ("number", "street", "unit", "city", "postcode")], F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"))
    return rows.where("not (lat = 0 and lng = 0) and coalesce(number, '') not in ('', '0')")


def admin_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(country_code, level, field, max_area) of a mapping file; a bare entry is a field, an object may add a cap."""
    raw = spark.read.text(path, wholetext=True)
    entry = "map<string,string>"
    base = F.from_json(F.get_json_object("value", "$.defaults.admin"), entry)
    own = F.from_json(F.get_json_object("value", "$.countries"), "map<string,struct<admin:map<string,string>>>")
    rows = raw.select(F.lit(None).cast("string").alias("country_code"), F.explode(base).alias("level", "e"))
    rows = rows.unionByName(raw.select(F.explode(own).alias("country_code", "c")).select("country_code", F.explode("c.admin").alias("level", "e")))
    field = F.coalesce(F.get_json_object("e", "$.field"), F.col("e"))
    return rows.select("country_code", F.col("level").cast("int").alias("level"), field.alias("field"), F.get_json_object("e", "$.max_area").cast("double").alias("max_area"))


def ip_number(c: Column) -> Column:
    """A dotted address as a number; null where it is none."""
    parts = F.transform(F.split(c, r"\."), lambda x: x.try_cast("long"))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x))


def replication_state(c: Column) -> Column:
    """(sequence, timestamp) of a state file whose colons are escaped."""
    stamp = F.replace(F.regexp_extract(c, r"timestamp=(\S+)", 1), F.lit("\\:"), F.lit(":"))
    return F.struct(F.regexp_extract(c, r"sequenceNumber=(\d+)", 1).try_cast("long").alias("sequence"), F.to_timestamp(F.nullif(stamp, F.lit(""))).alias("timestamp"))


def geocode_snapshot(body: Column) -> Column:
    """(status, lat, lng, country) of an external answer's first result."""
    r = F.from_json(body, "struct<status:string,results:array<struct<geometry:struct<location:struct<lat:double,lng:double>>,address_components:array<struct<short_name:string,types:array<string>>>>>>")
    first = F.get(r["results"], F.lit(0))
    land = F.filter(first["address_components"], lambda c: F.array_contains(c["types"], "country"))
    return F.struct(r["status"].alias("status"), first["geometry"]["location"]["lat"].alias("lat"), first["geometry"]["location"]["lng"].alias("lng"), F.get(land, F.lit(0))["short_name"].alias("country"))


def regression_cases(spark: SparkSession, path: str) -> DataFrame:
    """(suite, id, tags, request, status, checks) of corpus files; a request without a method is a GET."""
    from geoquill.functions.checks import CORPUS

    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CORPUS).alias("c"))
    rows = raw.select(F.col("c.name").alias("suite"), F.explode("c.cases").alias("case"))
    request = F.struct(F.coalesce("case.request.method", F.lit("GET")).alias("method"), F.col("case.request.path").alias("path"), F.col("case.request.query").alias("query"))
    return rows.select("suite", "case.id", F.coalesce("case.tags", F.array().cast("array<string>")).alias("tags"), request.alias("request"), F.col("case.expect.status").alias("status"), F.col("case.expect.checks").alias("checks"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may be absent: then an empty one of the same type."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
