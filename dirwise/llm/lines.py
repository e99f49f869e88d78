r"""Line deduplication over a whole corpus.

Lines are exploded with their position; a line's key (white space stripped at both
ends, A-Z lower-cased) is hashed to 128 bits; per hash the first and last document
are found with partial minima and maxima, which tells whether at least two hold it;
lines of such hashes go from every document but the first, and what is left of a
document is put together again by position. Only hashes and positions are shuffled
for the counts; texts travel once, to meet the positions they lose.

Defined results: null and empty texts are one empty line; documents without an id
take part like one document that comes after all others; rows with the same id are
one document whose lines are judged alike; keys shorter than ``MIN_CHARS`` code
points always stay; other columns are kept; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.llm.common import text_or_empty
from dirwise.session import saved

MIN_CHARS = 10
# The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: id, row (tells rows of one id apart), pos, h1, h2."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "row", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, row and the positions ``gone`` of the lines that each row loses."""
    keys = saved(line_keys(docs, id_col, text_col, min_chars))
    spans = keys.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("named"), F.count("*").alias("all"))
    # written, so that the join below has exchanges of its own, whose hot partitions adaptive execution can split
    shared = saved(spans.where("first <> last or (named > 0 and named < all)").select("h1", "h2", "first"))
    lost = keys.join(shared, ["h1", "h2"]).where(F.col("id").isNull() | (F.col("id") != F.col("first")))
    return lost.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines in its text column, and the columns n_lines and n_dropped (incoming ones of these names are replaced)."""
    lost = drops(docs, id_col, text_col, min_chars).select(F.col("id").alias("__line_id"), F.col("row").alias("__line_row"), F.col("gone").alias("__line_gone"))
    rows = docs.drop("n_lines", "n_dropped")
    text = text_or_empty(text_col)
    joined = rows.join(lost, rows[id_col].eqNullSafe(lost["__line_id"]) & (F.xxhash64(text) == lost["__line_row"]), "left")
    lines = F.split(text, "\n", -1)
    gone = F.coalesce(F.size("__line_gone"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    rest = F.get(F.transform(F.array(lines), lambda a: F.array_join(F.transform(kept, lambda i: F.get(a, i)), "\n")), F.lit(0))
    whole = F.when(F.col("__line_gone").isNull(), text).otherwise(rest)
    return joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": gone.cast("long"), text_col: whole}).select(*rows.columns, "n_lines", "n_dropped")
