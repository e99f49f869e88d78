"""Entries of JSON documents of any size, read in many tasks.

A document is an object or array whose entries are objects (``{"k": {..}, ..}``,
``{"part": [{..}, ..], ..}`` or ``[{..}, ..]``). Spark's text reader cuts the files
after closing braces and splits large ones; whether a split begins inside a string, and
how deep, follows from what the splits before it hold, of which each tells a few
numbers for both cases. Every entry is put together from its own pieces only.

Defined results: an empty file has no entries; a document that ends inside a string or
with braces left open, or that holds text after its end, raises an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dirwise.session import saved

#: All up to the first brace outside strings.
BEFORE = r'^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
ESCAPED = re.compile(r"\\.", re.S)


def braces(text: str, inside: int) -> tuple[int, int]:
    """Braces opened by a piece that begins ``inside`` a string (1) or not (0), and whether it ends inside one."""
    parts = (ESCAPED.sub("", text) if "\\" in text else text).split('"')
    return sum(x.count("{") for x in parts[inside::2]), (inside + len(parts) - 1) % 2


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str, int]]:
    """file, block, whether the block begins here, and text of every piece, and the file's size."""
    now = None
    for batch in batches:
        for value, file, block, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield file, block, (file, block) != now, value, whole
            now = (file, block)


def _summaries(spark: SparkSession, path: str) -> dict[str, list]:
    """Per file its blocks in order: block, for a start outside and inside a string the change in depth and how it ends, and the last piece."""
    def run(batches):
        out: list[list] = []
        for file, block, first, value, whole in _blocks(batches):
            if first:
                out.append([file, block, 0, 0, 0, 1, "", value.lstrip()[:1], 0, whole])
            row = out[-1]
            row[8] += len(value.encode()) + 1
            for case in (0, 1):
                opened, row[3 + 2 * case] = braces(value, row[3 + 2 * case])
                row[2 + 2 * case] += opened - (not row[3 + 2 * case])
            row[6] = value[-200:]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i in (0, 6, 7) else pa.int64()) for i in range(10)], ["file", "block", "depth0", "ends0", "depth1", "ends1", "last", "first", "size", "whole"])

    files: dict[str, list] = {}
    # one row per split of a file
    for r in _pieces(spark, path).mapInArrow(run, "file string, block long, depth0 long, ends0 long, depth1 long, ends1 long, last string, first string, size long, whole long").collect():
        files.setdefault(r["file"], []).append(r)
    return {f: sorted(rows, key=lambda r: r["block"]) for f, rows in files.items()}


def _starts(files: dict[str, list]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """Depth, string state and the depth that entries lie at, at the start of each block; complains about documents that don't end."""
    out = {}
    for file, rows in files.items():
        depth, inside, level = 0, 0, int(rows[0]["first"] == "{")
        for r in rows:
            out[file, r["block"]] = depth, inside, level
            depth, inside = depth + r[f"depth{inside}"], r[f"ends{inside}"]
        # what follows the last brace counts as a piece that ends with one
        tail, open_end = _tail(rows[-1]["last"]), sum(r["size"] for r in rows) - rows[0]["whole"]
        bare = open_end == 1 if open_end in (0, 1) else tail and depth < 0  # a compressed file's size tells nothing
        if inside or depth + bare or bare and not tail or not level and rows[-1]["last"].strip()[-1:] != "]":
            raise ValueError(f"{file}: the document does not end")
    return out


def _tail(text: str) -> bool:
    return not text.strip("[] \t\r\n")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal from 0, before, value): each entry's object as text, and the text between it and the entry before, which holds its key."""
    starts = _starts(_summaries(spark, path))

    def run(batches):
        out: list[tuple] = []
        depth = inside = entry = n = level = 0
        for file, block, first, value, _ in _blocks(batches):
            if first:
                (depth, inside, level), entry, n = starts[file, block], 0, 0
                if level and not depth and not inside:
                    depth, value = 1, value.lstrip()[1:]  # the brace of the document itself
            closed = not inside and (depth < level or not level and not depth and value.lstrip()[:1] == "]")
            if closed and not _tail(value):
                raise ValueError(f"{file}: text after the end")
            opened, inside = braces(value, inside)
            depth += opened - (not inside)
            if depth < level and not inside:
                continue
            ends = not inside and depth == level
            out.append((file, block, entry, n, value + "}", ends))
            n, entry = n + 1, entry + ends
            if len(out) >= 5000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(held):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], ["file", "block", "entry", "n", "piece", "ends"])

    pieces = saved(_pieces(spark, path).mapInArrow(run, "file string, block long, entry long, n long, piece string, ends boolean"))
    # entries of the blocks before; a file has few blocks
    ended = pieces.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("ended"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ended.select("file", "block", F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["file", "block"]).withColumn("ordinal", F.col("before") + F.col("entry"))
    whole = numbered.groupBy("file", "ordinal").agg(F.array_sort(F.collect_list(F.struct("block", "n", "piece"))).alias("p"), F.bool_or("ends").alias("ends")).where("ends")
    whole = whole.select("file", "ordinal", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
    before = F.regexp_extract("text", BEFORE, 0)
    return whole.select("file", "ordinal", before.alias("before"), F.substring(F.col("text"), F.length(before) + 1, F.length("text")).alias("value"))
