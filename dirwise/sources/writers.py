"""Exports and saved results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirwise.functions.values import text

# The columns of the flat export, in order.
FLAT_COLUMNS = (
    ("ID", "id"), ("URN", "urn"), ("School Name", "name"), ("Local Authority", "la"), ("Region", "region"), ("Postcode", "postcode"),
    ("Address", "address"), ("School Type", "schoolType"), ("Gender", "gender"), ("Age Range", "ageRange"), ("Pupil Count", "pupilCount"),
    ("Ofsted Rating", "ofstedRating"), ("Progress 8", "gcseProgress8"), ("Attainment 8", "gcseAttainment8"),
    ("EBacc Score", "ebaccAveragePointScore"), ("Entrance Exam Type", "entranceExamType"), ("Exam Registration Open", "registrationOpen"),
    ("Exam Registration Deadline", "registrationDeadline"), ("Exam Date", "examDate"), ("Results Release Date", "resultsDate"),
    ("GCSE Subjects Offered", "gcseSubjects"), ("Admissions Policy", "admissionsPolicy"), ("Website", "website"), ("Phone", "phone"),
    ("Email", "email"),
)
MILESTONES = ("registrationOpen", "registrationDeadline", "examDate", "resultsDate")


def _cell(df: DataFrame, c: str, sep: str = "; ") -> Column:
    types = dict(df.dtypes)
    if c in MILESTONES and "entranceExamDates" in types:
        return text(F.try_element_at("entranceExamDates", F.lit(c)))
    if c not in types:
        return F.lit("")
    if types[c].startswith("array"):
        return F.coalesce(F.array_join(c, sep), F.lit(""))
    return text(F.col(c).cast("string"))


def flat_rows(df: DataFrame) -> DataFrame:
    """The export columns as texts; lists joined by '; '."""
    return df.select(*[_cell(df, c).alias(h) for h, c in FLAT_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    """Cells are quoted only where they hold a comma, a quote or a line break; quotes are doubled."""
    flat_rows(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def tab_rows(df: DataFrame) -> DataFrame:
    """Export rows without tabs and line breaks, one text per line."""
    flat = flat_rows(df)
    return flat.select(*[F.regexp_replace(F.col(f"`{c}`"), "[\t\n]", " ").alias(c) for c in flat.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, never quoted."""
    rows = tab_rows(df)
    rows.write.mode("overwrite").csv(path, header=True, sep="\t", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


XML_COLUMNS = (
    ("id", "id"), ("urn", "urn"), ("name", "name"), ("localAuthority", "la"), ("region", "region"), ("postcode", "postcode"), ("schoolType", "schoolType"),
    ("gender", "gender"), ("pupilCount", "pupilCount"), ("ofstedRating", "ofstedRating"), ("gcseAttainment8", "gcseAttainment8"),
    ("entranceExamType", "entranceExamType"),
)


def xml_rows(df: DataFrame) -> DataFrame:
    """Rows as they are nested in the XML export."""
    dates = F.struct(*[_cell(df, m).alias(m) for m in MILESTONES]).alias("entranceExamDates")
    return df.select(*[_cell(df, c, ", ").alias(n) for n, c in XML_COLUMNS], dates, _cell(df, "website").alias("website"))


def write_xml(df: DataFrame, path: str) -> None:
    xml_rows(df).write.mode("overwrite").format("xml").option("rootTag", "schools").option("rowTag", "school").save(path)


def write_domains(tables: dict[str, tuple[str, DataFrame]], root: str) -> dict[str, int]:
    """Each table into its domain's folder; fails if a copy has another number of rows.

    tables: name -> (domain, rows). Returns the row counts.
    """
    counts = {}
    for name, (domain, df) in tables.items():
        path = f"{root.rstrip('/')}/{domain}/{name}"
        before = df.count()
        df.write.mode("overwrite").parquet(path)
        after = df.sparkSession.read.parquet(path).count()
        if before != after:
            raise ValueError(f"{name}: {before} rows before, {after} after the copy")
        counts[name] = after
    return counts


def save_scan(results: DataFrame, root: str, scan_type: str, scanned_at: str, total: int) -> None:
    """The last result of one kind of scan; other kinds stay as they are."""
    stamped = results.withColumns({"scanned_at": F.lit(scanned_at), "total_rows": F.lit(total)})
    stamped.write.mode("overwrite").parquet(f"{root.rstrip('/')}/scan_type={scan_type}")


def read_scan(spark: SparkSession, root: str, scan_type: str) -> DataFrame | None:
    """The last result of a kind of scan; None if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{root.rstrip('/')}/scan_type={scan_type}")
    except AnalysisException:
        return None


def write_lookup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_document(rows: DataFrame, path: str, key: str | None = None, part: str | None = None) -> None:
    """One JSON document per task: an object of the rows by ``key``, or an object with their array under ``part``."""
    value = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    if key:
        framed_key = F.to_json(F.struct(F.col(key).cast("string").alias("k")))  # {"k":"..."}
        value = F.concat(F.substring(framed_key, F.lit(6), F.length(framed_key) - 6), F.lit(": "), value)
    lines = rows.select(value.alias("value"))
    first, last = ("{", "}") if part is None else (f'{{"{part}": [', "]}")

    def framed(batches):
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = [f",{t}" if begun or i else f"{first}{t}" for i, t in enumerate(texts)]
            begun = begun or bool(texts)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last])], ["value"])

    lines.mapInArrow(framed, "value string").write.text(path)
