"""Nearest neighbours by shifted space-filling curves.

Unit vectors are turned by several random rotations, shifted and cut to a few
dimensions; the cells of a grid there are put in the order of a Hilbert curve. Spark
ranges the rows of all curves over tasks by key and numbers them; a query looks at
the rows within a window of numbers on either side, curve by curve, block by block.
Cells are refined to ``KEY_BITS`` a side, so a dense group is ordered by what tells
its members apart; rows of one cell are ordered anew on each curve.
Blocks are compared in 16-bit copies of the vectors; whatever may be among the
nearest there, by the copies' own rounding errors, is compared anew in double precision.

Every row is in the index. The window is a share of the rows, because vectors
without structure have no smaller neighbourhood; with ``CURVES`` curves and
``SHARE`` of the rows on either side, recall on such vectors is above 0.9.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows without an id; of rows with
one id the smallest vector counts; multiples of a vector are one direction; equal scores go to the smaller id; fewer
candidates than asked for are all returned; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.llm.common import slices
from dirwise.session import saved

CURVES, DIMS, CELL_BITS, KEY_BITS, SEED = 16, 12, 3, 30, 7
SHARE, LEAST_WINDOW = 0.035, 256
#: Rows compared at once.
BLOCK, MOST_BLOCK = 1024, 32768
#: Largest number of a 16-bit copy, and what float arithmetic may add to its rounding error.
STEPS, SLACK = 32767, 1e-5


def hilbert_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row's cell along the Hilbert curve through a grid of ``2**bits`` cells a side, as bits from the first."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # from the coarsest cells down: mirror or swap with the first axis
        low = (1 << level) - 1
        for axis in range(len(x)):
            odd = (x[axis] >> level & 1).astype(bool)
            swap = np.where(odd, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(odd, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    return np.stack([(axis >> level & 1).astype(np.uint8) for level in range(bits - 1, -1, -1) for axis in x], axis=1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The same place as a number."""
    key = np.zeros(len(cells), np.int64)
    for bit in hilbert_bits(cells, bits).T:
        key = key << 1 | bit
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int = DIMS, bits: int = KEY_BITS, seed: int = SEED) -> list[bytes]:
    """Keys of unit vectors along one curve: rotate, keep a few dimensions, shift by up to half a coarse cell, cut into cells over three deviations."""
    rng = np.random.default_rng([seed, curve])
    n = unit.shape[1]
    turned = unit @ np.linalg.qr(rng.standard_normal((n, n)))[0][:, : min(dims, n)] * math.sqrt(n)
    side = 1 << bits
    cells = np.floor(((turned + 3) / 6 + rng.uniform(-0.5, 0.5, turned.shape[1]) / (1 << CELL_BITS)) * side)
    return [x.tobytes() for x in np.packbits(hilbert_bits(np.clip(cells, 0, side - 1), bits), axis=1)]


def sound(vector: Column) -> Column:
    """The vector can take part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def ordered(vectors: DataFrame, curves: int) -> DataFrame:
    """``vectors`` (id, v, asks) along all curves: curve, rank, id, asks, small (16-bit copy), scale, off (length of its rounding error)."""
    def keyed(batches):
        for batch in slices(batches, 4096):
            v = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(v):
                continue
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            top = np.abs(unit).max(axis=1, keepdims=True)
            whole, scale = np.round(unit / top * STEPS).astype(np.int16), (top / STEPS).astype(np.float32)
            off = pa.array(np.linalg.norm(unit - whole * scale.astype(np.float64), axis=1).astype(np.float32))
            small, scale = pa.array([x.tobytes() for x in whole], pa.binary()), pa.array(scale[:, 0])
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(unit, c), pa.binary()), batch.column(0), batch.column(2), small, scale, off], ["curve", "key", "id", "asks", "small", "scale", "off"])

    def numbered(batches):
        task, curve, n = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            of = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
            start = np.repeat(first, np.diff(np.r_[first, len(of)]))
            at = np.arange(len(of)) - start
            if len(of):
                at[of == of[0]] += n if of[0] == curve else 0
                curve, n = of[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), task, np.int32)), pa.array(at.astype(np.int64)), *(batch.column(i) for i in (0, 2, 3, 4, 5, 6))], ["task", "at", "curve", "id", "asks", "small", "scale", "off"])

    rest = "id long, asks boolean, small binary, scale float, off float"
    keys = vectors.select("id", "v", "asks").mapInArrow(keyed, f"curve int, key binary, {rest}").withColumn("mixed", F.xxhash64("curve", "id"))
    lined = keys.repartitionByRange("curve", "key", "mixed").sortWithinPartitions("curve", "key", "mixed", "id").drop("mixed")
    rows = saved(lined.mapInArrow(numbered, f"task int, at long, curve int, {rest}"))
    counts = rows.groupBy("curve", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), ["curve", "task"]).select("curve", (F.col("before") + F.col("at")).alias("rank"), "id", "asks", "small", "scale", "off")  # a row per task and curve


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """query_id, rank, ``id_col``, score of the ``k`` nearest found for every row where ``asks`` holds."""
    sized = vectors.where(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    common = sized.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    length = common["n"] if common else 1
    chosen = sized.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    longest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    single = saved(chosen.withColumn("longest", longest).withColumn("v", F.transform("v", lambda x: x.cast("double") / F.col("longest"))).drop("longest"))
    # vectors of one direction are one place on every curve, named by their smallest id; of their ids the first k + 1 can be among the nearest
    rows = saved(single.groupBy("v").agg(F.min("id").alias("id"), F.max("asks").alias("asks")))
    place = Window.partitionBy("v").orderBy("id")
    copies = single.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).select("v", F.col("id").alias("copy")).join(rows.select("v", "id"), "v").select("id", "copy")
    queries = single.where("asks").select("v", F.col("id").alias("query_id")).join(rows.select("v", F.col("id").alias("name")), "v").select("query_id", "name")
    total = rows.count()
    window = max(LEAST_WINDOW, math.ceil(share * total))
    block = min(max(BLOCK, window), MOST_BLOCK)
    line = saved(ordered(rows, curves))
    blocks = line.withColumn("block", F.floor(F.col("rank") / block))
    looks = line.where("asks").select("curve", "rank", "id", "small", "scale", "off", F.explode(F.sequence(F.floor((F.greatest(F.col("rank") - window, F.lit(0))) / block), F.floor(F.least(F.col("rank") + window, F.lit(max(total - 1, 0))) / block))).alias("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "near": [], "off": []})
        unpack = lambda pdf: np.frombuffer(b"".join(pdf["small"]), np.int16).reshape(len(pdf), -1).astype(np.float32) * pdf["scale"].to_numpy()[:, None]
        have, rank, ids, off = unpack(right), right["rank"].to_numpy(), right["id"].to_numpy(), right["off"].to_numpy()
        out = []
        for start in range(0, len(left), 256):
            some = left.iloc[start : start + 256]
            near = unpack(some) @ have.T
            near[(np.abs(rank - some["rank"].to_numpy()[:, None]) > window) | (ids == some["id"].to_numpy()[:, None])] = -9
            own = some["off"].to_numpy()[:, None]
            bound = off + own * (1 + off) + SLACK
            least = np.partition(near - bound, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -5.0
            q, x = np.nonzero((near > -5) & (near + bound >= least))
            out.append(pd.DataFrame({"query_id": some["id"].to_numpy()[q], "id": ids[x], "near": near[q, x], "off": bound[q, x]}))
        return pd.concat(out)

    found = looks.groupBy("curve", "block").cogroup(blocks.groupBy("curve", "block")).applyInPandas(compare, "query_id long, id long, near float, off float")
    own = rows.where("asks").select(F.col("id").alias("query_id"), "id", F.lit(9.0).cast("float").alias("near"), F.lit(0.0).cast("float").alias("off"))
    once = saved(found.union(own).groupBy("query_id", "id").agg(F.max("near").alias("near"), F.max("off").alias("off")))
    least = Window.partitionBy("query_id").orderBy(F.desc("low"), "id")
    sure = once.select("query_id", "id", (F.col("near") - F.col("off")).alias("low")).withColumn("n", F.row_number().over(least)).where(F.col("n") == k + 1)  # the query's own place is the first
    short = once.join(sure.select("query_id", "low"), "query_id", "left").where("low is null or near + off >= low")
    pairs = short.join(rows.select("id", F.col("v").alias("b")), "id").join(rows.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    scored = pairs.select(F.col("query_id").alias("name"), "id", (dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))).alias("score"))
    nearest_first = [F.desc("score"), "copy"]
    top = saved(scored.join(copies, "id").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(*nearest_first))).where(F.col("n") <= k + 1).select("name", "copy", "score"))
    others = queries.join(top, "name").where("copy <> query_id")
    best = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("copy").alias(id_col), "score")
