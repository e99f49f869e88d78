r"""Document fingerprints by a threshold-scaled sketch, in built-in functions only.

A text's words (white space apart, lower-cased) give shingles of five; of their
64-bit hashes all below a fixed fraction of the hash range are retained. A sketch
so grows with its text, two sketches merge by union, and the share of the smaller
one found in the other estimates containment even between a line and a book.

The order of documents is taken from ids alone: they are ranged over tasks, each
task looks one row ahead, and a table with one row per task closes the gaps. Texts
are shuffled once by id, and the opening of the next text travels once.

Defined results: null text counts as empty; a text without words has an empty
sketch, like only to another empty one (1, else 0); a text none of whose hashes is
below the fraction keeps its smallest one; rows that repeat id and text count once;
rows of one id stand in the order of their texts' hashes; a null id comes first;
other columns are ignored; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.llm.common import bind, text_or_empty
from dirwise.session import saved

WORDS = 5
#: Hashes below 2**(64 - FRACTION_BITS) are retained: one in eight.
FRACTION_BITS = 3
BLANKS = " \t\n\x0b\x0c\r"
SMALLEST = -(1 << 63)


def _retained(hashes: Column, bits: int) -> Column:
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - bits) == 0)


def _least(hashes: Column) -> Column:
    """The smallest hash alone; unsigned order is signed order with the first bit turned."""
    return F.array(F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(SMALLEST)))).bitwiseXOR(F.lit(SMALLEST)))


def sketch(text: Column, words: int = WORDS, bits: int = FRACTION_BITS) -> Column:
    """Sorted array of the retained shingle hashes of a text."""
    found = F.filter(F.split(F.btrim(F.lower(text), F.lit(BLANKS)), "[ \t-\r]+"), lambda w: w != "")
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    shingles = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
    chosen = lambda s: bind(_retained(s, bits), lambda r: F.when(F.size(r) > 0, F.array_sort(F.array_distinct(r))).otherwise(_least(s)))
    return bind(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(bind(shingles(h), chosen)))


def merged(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    """Sketch of both texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    kept = _retained(both, bits)
    return F.when(F.size(kept) > 0, kept).when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(_least(both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other holds too."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of all shingles of both that both hold."""
    return F.when(F.size(a) + F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(1.0))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def following(ids: DataFrame, order: list[str]) -> DataFrame:
    """``ids`` (one row each) with ``next``, a struct of the ``order`` columns of the row that follows; the first follows the last."""
    ranged = saved(ids.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("task", F.spark_partition_id()))
    place = F.struct(*order)
    inside = ranged.withColumn("ahead", F.lead(place).over(Window.partitionBy("task").orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    firsts = ranged.groupBy("task").agg(F.min(place).alias("head"))
    by_task = Window.orderBy("task")  # one row per task
    heads = firsts.select("task", F.coalesce(F.lead("head").over(by_task), F.first("head").over(by_task.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    return inside.join(F.broadcast(heads), "task").select(*ids.columns, F.coalesce("ahead", "beyond").alias("next"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = FRACTION_BITS) -> DataFrame:
    """Per document: n_chars, the text ``edited`` (its second half replaced by the next one's opening), the sketches of the text, of ``edited`` and of the next text."""
    text = text_or_empty(text_col)
    # the id is told by has and k alone: both joins below then read the same columns, and their exchange of texts is one
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("k"), F.isnotnull(id_col).alias("has"), F.xxhash64(text).alias("h"), text.alias("text"))
    key = ["has", "k", "h"]
    # repeats go without an aggregate over texts: the sort that this needs is the joins' own
    once = rows.withColumn("earlier", F.lag(F.lit(1)).over(Window.partitionBy(*key).orderBy("k"))).where("earlier is null").drop("earlier")
    ids = rows.select(*key, F.floor(F.length("text") / 2).cast("int").alias("half")).distinct()
    links = following(ids, key).select(*[F.col(c).alias(f"own_{c}") for c in key], "half", *[F.col(f"next.{c}").alias(c) for c in key])
    opening = once.join(links, key).select(*[F.col(f"own_{c}").alias(c) for c in key], "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("opening"), sketch(F.col("text"), words, bits).alias("next_sketch"))
    pairs = once.join(opening, key)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("half")), F.col("opening"))
    texts = pairs.select(F.when(F.col("has"), F.col("k")).alias("id"), F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_sketch")
    return texts.select(F.col("id").alias(id_col), "n_chars", "edited", sketch(F.col("text"), words, bits).alias("sketch"), sketch(F.col("edited"), words, bits).alias("edited_sketch"), "next_sketch")
