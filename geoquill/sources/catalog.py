"""What an index folder holds: files, shards, loaded parts; and which source files may lie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, name) of all files under ``root`` that end in ``suffix``, by path. Only the listing is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("path")


def shards(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(shard) of a table partitioned by ``key``: the values whose folders hold data; a table without folders has one, null."""
    part = F.regexp_extract("path", f"/{key}=([^/]+)/", 1)
    return files(spark, root, ".parquet").select(F.nullif(F.lower(F.url_decode(part)), F.lit("")).alias("shard")).distinct()


def shard(spark: SparkSession, root: str, schema: str, key: str, values: list[str] | None = None) -> DataFrame:
    """The table with only the wanted shards: a filter on the partition column, so other folders are not opened."""
    df = spark.read.schema(schema).parquet(root)
    return df.where(F.lower(key).isin([v.lower() for v in values])) if values is not None else df


def parts(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """(part, loaded, rows, countries): every expected part, how many rows it has and of which countries."""
    out = None
    for name in expected:
        df = tables.get(name)
        if df is None:
            one = next(iter(tables.values())).sparkSession.range(1).select(F.lit(name).alias("part"), F.lit(False).alias("loaded"), F.lit(0).cast("long").alias("rows"), F.array().cast("array<string>").alias("countries"))
        else:
            code = F.sort_array(F.collect_set("country_code")) if "country_code" in df.columns else F.array().cast("array<string>")
            one = df.agg(F.count("*").alias("rows"), code.alias("countries")).select(F.lit(name).alias("part"), F.lit(True).alias("loaded"), "rows", "countries")
        out = one if out is None else out.unionByName(one)
    return out


#: Region presets by the path of their extract at the public mirror.
REGIONS = {
    "africa": "africa", "antarctica": "antarctica", "asia": "asia", "australia-oceania": "australia-oceania", "central-america": "central-america", "europe": "europe",
    "north-america": "north-america", "russia": "russia", "south-america": "south-america", "australia": "australia-oceania/australia",
    "new-zealand": "australia-oceania/new-zealand", "niue": "australia-oceania/niue", "united-kingdom": "europe/united-kingdom", "canada": "north-america/canada", "usa": "north-america/us",
}
CONTINENTS = "africa antarctica asia australia-oceania central-america europe north-america russia south-america".split()
SUFFIX, PLANET = "-latest.osm.pbf", "planet"
#: Presets that do not clash with a planet file, as their extracts are not continents.
BESIDE_PLANET = ["united-kingdom", "canada"]


def region_files(spark: SparkSession) -> DataFrame:
    """(region, path): the extracts of every preset; all continents are nine, the planet is one."""
    rows = [(r, p + SUFFIX) for r, p in REGIONS.items()] + [("all-continents", REGIONS[c] + SUFFIX) for c in CONTINENTS] + [(PLANET, PLANET + SUFFIX)]
    return spark.createDataFrame(rows, "region string, path string")


def source_clashes(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(region, clash, files): why a wanted region must not be built from a folder (``names``: name), or null.

    A planet file beside wanted continents, or continents beside a wanted planet, would be counted twice.
    """
    extracts = names.where(F.endswith("name", F.lit(SUFFIX)))
    seen = extracts.agg(F.max(F.col("name") == PLANET + SUFFIX).alias("planet"), F.sort_array(F.collect_set(F.when(F.col("name") != PLANET + SUFFIX, F.col("name")))).alias("others"))
    both = wanted.join(seen, F.lit(True))  # one row
    continent = (F.col("region") != PLANET) & ~F.col("region").isin(BESIDE_PLANET)
    clash = F.when(F.coalesce("planet", F.lit(False)) & continent, "planet beside continents").when((F.col("region") == PLANET) & (F.size("others") > 0), "continents beside planet")
    return both.select("region", clash.alias("clash"), F.when(clash == "continents beside planet", F.array_join("others", ",")).alias("files"))
