"""Reading directories, registers, rules and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirwise import schemas
from dirwise.functions.names import join_address, region_of, register_type
from dirwise.functions.values import filled, lenient_float, or_null, round_half_up, text, trim_all
from dirwise.operators.records import hydrate
from dirwise.session import saved
from dirwise.sources.json_entries import json_entries


def directory(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """All entities, typed for reading."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return hydrate(reader.format(fmt).load(path))


def csv_by_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Named columns of a quoted CSV file as texts; ``columns`` maps header names to new ones."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    return raw.select(*[trim_all(F.col(f"`{h}`")).alias(n) for h, n in columns.items()])


def coordinates_csv(spark: SparkSession, path: str) -> DataFrame:
    """(postcode, outcode, easting, northing, admin_district) from an establishment file with a header row."""
    raw = csv_by_header(spark, path, {"Postcode": "postcode", "Easting": "e", "Northing": "n", "LA (name)": "la"})
    code = F.regexp_replace(F.upper(text("postcode")), r"\s+", " ")
    e, n = lenient_float("e"), lenient_float("n")
    rows = raw.filter(filled("postcode") & F.coalesce((e != 0) & (n != 0), F.lit(False)))
    return rows.select(code.alias("postcode"), F.split_part(code, F.lit(" "), F.lit(1)).alias("outcode"), round_half_up(e).alias("easting"),
                       round_half_up(n).alias("northing"), F.coalesce(or_null("la"), F.lit("England")).alias("admin_district"))


def register_by_position(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Register rows by column position; quoted commas stay inside their column."""
    last = max(schemas.REGISTER_POSITIONS.values())
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(last + 1)])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path, header=header, quote='"', escape='"', enforceSchema=True)
    return raw.select(*[trim_all(text(f"c{i}")).alias(n) for n, i in schemas.REGISTER_POSITIONS.items()])


def register_records(rows: DataFrame) -> DataFrame:
    """Positional register rows as entity-like records."""
    closed = (F.lower(text("SCHSTATUS")) == "closed") | filled("CLOSEDATE")
    return rows.select(
        F.col("URN").alias("urn"), F.col("SCHNAME").alias("name"), F.col("LANAME").alias("la"), region_of("LANAME").alias("region"),
        F.col("POSTCODE").alias("postcode"), join_address("STREET", "LOCALITY", "TOWN", "POSTCODE").alias("address"),
        register_type("SCHOOLTYPE", "SCHNAME", "ADMPOL").alias("schoolType"), F.col("SCHOOLTYPE").alias("rawSchoolType"),
        F.coalesce(or_null("GENDER"), F.lit("Mixed")).alias("gender"),
        F.when(filled("AGELOW") & filled("AGEHIGH"), F.concat_ws("-", "AGELOW", "AGEHIGH")).otherwise("").alias("ageRange"),
        F.coalesce(or_null("ADMPOL"), F.lit("Non-selective")).alias("admissionsPolicy"), (~closed).alias("active"))


def _present(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rules(spark: SparkSession, path: str) -> tuple[list[dict], list[dict]]:
    """(state rules, independent rules) of a rule file edited by hand, as lists; a missing file has no rules. Large files: ``rule_table``."""
    if not _present(spark, path):
        return [], []
    one = lambda part: [r.asDict(recursive=True) for r in rule_table(spark, path, part).orderBy("ordinal").drop("file", "ordinal").collect()]
    return one("state_consortia"), one("independent_consortia")


def rule_table(spark: SparkSession, path: str, part: str = "state_consortia") -> DataFrame:
    """(file, ordinal, rule columns) of the entries of one part of rule files, of any size and number."""
    every = json_entries(spark, path)
    begins = saved(every.select("file", "ordinal", F.regexp_extract("before", r'"([^"]*)"\s*:\s*\[\s*$', 1).alias("part")).where("part <> ''"))
    ours = begins.where(F.col("part") == part).select("file", F.col("ordinal").alias("first"))
    after = begins.select("file", F.col("ordinal").alias("next")).join(ours, "file").where("next > first").groupBy("file").agg(F.min("next").alias("stop"))
    spans = ours.join(after, "file", "left")
    inside = every.join(spans, "file").where((F.col("ordinal") >= F.col("first")) & (F.col("stop").isNull() | (F.col("ordinal") < F.col("stop"))))
    return inside.select("file", (F.col("ordinal") - F.col("first")).alias("ordinal"), F.from_json("value", schemas.RULE).alias("r")).select("file", "ordinal", "r.*")


def outcode_map(spark: SparkSession, path: str) -> DataFrame:
    """District coordinates from JSON objects keyed by district, of any size."""
    key = F.regexp_extract("before", r'"((?:[^"\\]++|\\.)*+)"\s*:\s*$', 1)
    rows = json_entries(spark, path).select(key.alias("key"), F.from_json("value", schemas.COORDS).alias("v"))
    return rows.select(F.coalesce("v.outcode", "key").alias("outcode"), "v.lat", "v.lon", "v.easting", "v.northing", "v.district")
