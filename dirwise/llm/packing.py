"""Packing token sequences into windows of fixed size.

A document's ids (and its end mark) are cut into full windows first; the rest of
each document is placed best-fit decreasing: from the longest piece down, a
segment tree over remaining capacities finds the tightest open window that still
holds the piece. Pieces are dealt evenly into groups of about ``GROUP_PIECES``
by a hash of their place, and every group is packed by itself, so that a task's
memory is bounded at any size; only lengths travel, never ids or texts.

Defined results: null text counts as empty and gives the end mark alone; rows
without an id and repeated rows are packed like any other; other columns are
ignored; no documents, no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirwise.llm import bpe
from dirwise.llm.common import slices, text_or_empty
from dirwise.session import saved

WINDOW = 4096
END_ID = 2
#: Pieces packed together in one task.
GROUP_PIECES = 50_000


class Capacities:
    """Open windows by remaining capacity; a tree of counts tells the smallest capacity of at least n that has one."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        at = self.half + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        at = self.half + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # climb until a right-hand neighbour has one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.half:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.half
        name = self.open[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, name


def best_fit_decreasing(lengths: Sequence[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece. ``lengths`` come longest first, each from 1 to ``window``."""
    capacities, windows, offsets, made = Capacities(window), [], [], 0
    for n in lengths:
        found = capacities.take(n)
        if not found:
            found, made = (window, made), made + 1
        left, name = found
        windows.append(name)
        offsets.append(window - left)
        if left > n:
            capacities.put(left - n, name)
    return windows, offsets


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words = bpe.load(path)
        for batch in slices(batches):
            place, out = [], []
            for row, ids in enumerate(words.encode_batch(batch.column(1).to_pylist())):
                raw = np.append(ids, end_id).astype("<u4")
                for start in range(0, raw.size, window):
                    piece = raw[start : start + window]
                    place.append(row)
                    out.append((start, piece.size, zlib.crc32(piece), raw.size))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(x) for x in columns)], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return rows.withColumnRenamed("id", id_col)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id, offset (gapless from 0) and sequence_tokens.

    A sequence is padded to ``window`` unless its length is a power of two.
    """
    cut = saved(pieces(docs, path, window, end_id, id_col, text_col))
    groups = 1 + cut.count() // group_pieces
    kind = docs.schema[id_col].dataType.simpleString()

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        windows, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = (np.int64(key[0]) << 32) + np.array(windows, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        pdf["sequence_tokens"] = pdf.groupby("sequence_id")["length"].transform("sum")
        return pdf.drop(columns="grp")

    spread = cut.withColumn("grp", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(groups)))
    return spread.groupBy("grp").applyInPandas(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
