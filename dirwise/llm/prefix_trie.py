"""The trie of conversation prefixes, as node tables in flat arrays.

A turn is known by the MD5 of its role and text; the texts themselves are never
exchanged. A prefix's digest is the exclusive-or of its turns' hashes, each taken
together with its position, so that the digests of a conversation of any length come
from a running value over ranges of rows: no conversation has to fit in one task.
Distinct digests are the trie's nodes. All members of a digest must agree on depth,
last turn and parent, else an error tells of the collision.

Sums over subtrees are made in shards. A shard holds stretches of at most ``STRETCH``
levels of conversations' paths. It lists the distinct digests in them, gives each a slot
by a minimal perfect hash whose every answer is compared with the digest kept in the
slot, scatters counts into flat arrays, and adds them up through the array of parent
slots from the deepest level to the highest. A count lies with one conversation (the
node's smallest) and what lies below a stretch is added at its end, so the shards'
sums add up to the whole: a first turn that a third of all conversations share, or one
conversation with a third of all turns, is spread over all shards.

Defined results: rows without a conversation's id take no part; turns are ordered by
number, null first, equal numbers by their MD5; null role and text are empty; extra
columns are not read; a conversation without turns is a member of the root; no
conversations, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.session import saved

#: Levels of a path that lie in one shard.
STRETCH = 512
#: Rows of a shard, about.
SHARD_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"
#: Places of the hash's bit arrays per key.
ROOM = 1.6
KEY = ["hi", "lo"]
ABOVE = ["up_hi", "up_lo"]


# running values over ranges of rows


def _running(rows: DataFrame, order: list[Column], key: str, step: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], made: str) -> DataFrame:
    """Rows in ranges of ``order`` with ``pid``, the range, and what ``step`` makes of each batch from its columns and the places where ``key`` changes.

    The columns that ``step`` makes run on within a key and begin anew in every range.
    """
    names = rows.columns
    new = [x.split()[0] for x in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        pid, carry, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            change = np.r_[True, cols[key][1:] != cols[key][:-1]]
            goes_on = last is not None and cols[key][0] == last
            out = step(cols, change, carry if goes_on else None)
            carry, last = {n: out[n][-1] for n in new}, cols[key][-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n]) for n in new), pa.array(np.full(batch.num_rows, pid, np.int32))], [*names, *new, "pid"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), made, "pid int"])
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))


def _before(rows: DataFrame, key: str, totals: list[Column], sums: Callable[[str], Column]) -> DataFrame:
    """For keys that lie in several ranges: key, pid and what the ranges before hold. A range shares at most its first and last key."""
    edges = rows.groupBy("pid").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.array("a", "b")).alias(key)).distinct()
    held = rows.join(F.broadcast(edges), key).groupBy(key, "pid").agg(*totals)
    earlier = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in held.columns if c not in (key, "pid")]
    return held.select(key, "pid", *[sums(n).over(earlier).alias(f"{n}_before") for n in names]).where(f"{names[0]}_before is not null")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), mark_hi, mark_lo (MD5 of role and text), words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))

    def step(cols, change, carry):
        at = np.arange(change.size)
        pos = at - np.maximum.accumulate(np.where(change, at, 0)) + 1
        if carry is not None:
            first = np.flatnonzero(change)[1] if change.sum() > 1 else change.size
            pos[:first] += carry["pos"]
        mark = np.frombuffer(b"".join(cols["mark"]), ">i8").reshape(-1, 2).astype(np.int64)
        return {"pos": pos.astype(np.int64), "mark_hi": mark[:, 0].copy(), "mark_lo": mark[:, 1].copy()}

    rows = rows.select("conv_id", "turn", "mark", "words")
    numbered = _running(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark")], "conv_id", step, "pos long, mark_hi long, mark_lo long")
    before = _before(numbered, "conv_id", [F.max("pos").alias("n")], F.sum)
    whole = numbered.join(F.broadcast(before), ["conv_id", "pid"], "left")
    return whole.select("conv_id", (F.col("pos") + F.coalesce("n_before", F.lit(0))).alias("pos"), "mark_hi", "mark_lo", "words")


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c that take their first crc32(c) mod ``heads`` turns from conversation c - c mod ``group``: their turns, and one row (conv_id, size) for each."""
    rows = saved(rows)
    c = F.col("conv_id")
    first = rows.where((c % group == 0) & (F.col("pos") < heads)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "mark_hi", "mark_lo", "words"))).alias("first"))
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("h", F.crc32(c.cast("string")) % heads).withColumn("base", c - c % group).join(first, "base", "left")
    given = F.coalesce(F.filter("first", lambda x: x["pos"] <= F.col("h")), F.array().cast(first.schema["first"].dataType))
    convs = saved(convs.select("conv_id", "h", given.alias("given"), (F.size(given) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("size")))
    own = rows.join(convs.select("conv_id", "h", F.size("given").alias("n"), "size"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "mark_hi", "mark_lo", "words", "size")
    taken = convs.select("conv_id", "size", F.explode("given").alias("x")).select("conv_id", "x.pos", "x.mark_hi", "x.mark_lo", "x.words", "size")
    return own.union(taken), convs.select("conv_id", "size")


# nodes


def _paths(rows: DataFrame) -> DataFrame:
    """Rows of the conversations with the digest (hi, lo) of the prefix that ends there, and of the one before (up_hi, up_lo)."""
    mixed = lambda lane: F.xxhash64(F.lit(lane), "mark_hi", "mark_lo", "pos")
    rows = rows.select("conv_id", "pos", "mark_hi", "mark_lo", "words", "size", mixed(1).alias("t_hi"), mixed(2).alias("t_lo"))

    def step(cols, change, carry):
        out = {}
        starts = np.flatnonzero(change)
        for name, t in (("hi", cols["t_hi"]), ("lo", cols["t_lo"])):
            run = np.bitwise_xor.accumulate(t)
            base = np.r_[0, run[starts[1:] - 1]] if starts.size else np.zeros(1, np.int64)
            if carry is not None:
                base[0] ^= carry[name]
            out[name] = run ^ np.repeat(base, np.diff(np.r_[starts, t.size]))
        return out

    local = _running(rows, [F.col("conv_id"), F.col("pos")], "conv_id", step, "hi long, lo long")
    before = _before(local, "conv_id", [F.bit_xor("t_hi").alias("x_hi"), F.bit_xor("t_lo").alias("x_lo")], F.bit_xor)
    whole = local.join(F.broadcast(before), ["conv_id", "pid"], "left")
    at = lambda c: F.col(c).bitwiseXOR(F.coalesce(f"x_{c}_before", F.lit(0).cast("long")))
    whole = whole.select("conv_id", "pos", "mark_hi", "mark_lo", "words", "size", "t_hi", "t_lo", at("hi").alias("hi"), at("lo").alias("lo"))
    return whole.select("conv_id", "pos", "mark_hi", "mark_lo", "words", "size", "hi", "lo", F.col("hi").bitwiseXOR(F.col("t_hi")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("t_lo")).alias("up_lo"))


def _nodes(paths: DataFrame) -> DataFrame:
    """One row per digest; its members must agree on all that the digest stands for."""
    same = ["pos", "mark_hi", "mark_lo", "words", *ABOVE]
    grouped = paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_max") for c in same])
    agree = F.lit(True)
    for c in same:
        agree &= F.col(c) == F.col(f"{c}_max")
    checked = F.when(agree, F.col("conv_id")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return grouped.select(*KEY, *ABOVE, checked.alias("conv_id"), F.col("pos").alias("depth"), "n_convs", "words")


class NodeTable:
    """Slots 0 to n - 1 for n distinct digests.

    Level by level, keys are hashed to the places of a bit array; a key alone in its place
    has it, the others go on to the next level. A slot is the number of set bits before.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = np.arange(hi.size), 0
        while left.size:
            size = max(64, int(left.size * ROOM))
            at = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("equal digests")
        slots = self._slots(hi, lo)
        self.hi, self.lo = np.zeros(hi.size, np.int64), np.zeros(hi.size, np.int64)
        self.hi[slots], self.lo[slots] = hi, lo

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hi.astype(np.uint64) ^ (lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1B54A32D192ED03 & (2**64 - 1)))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(hi.size, -1), np.arange(hi.size)
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(hi[left], lo[left], level, size)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for a key that isn't the one kept in the slot it is sent to."""
        slots = self._slots(hi, lo)
        if self.hi.size:
            slots[(self.hi[slots] != hi) | (self.lo[slots] != lo)] = -1
        return slots


def subtree_sums(hi: np.ndarray, lo: np.ndarray, up_hi: np.ndarray, up_lo: np.ndarray, level: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Digests of the distinct nodes by slot and, for each of ``values``, its sum over a node and all below it. Level 0 has no parents here; rows may repeat a node."""
    order = np.lexsort((lo, hi))
    new = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])] if hi.size else np.zeros(0, bool)
    one = order[new]
    table = NodeTable(hi[one], lo[one])
    slots = table.find(hi, lo)
    parent, depth = np.full(one.size, -1), np.zeros(one.size, np.int64)
    depth[slots] = level
    inner = np.flatnonzero(level > 0)
    parent[slots[inner]] = table.find(up_hi[inner], up_lo[inner])
    if (parent[depth > 0] < 0).any():
        raise ValueError("a node without its parent")
    sums = []
    for value in values:
        total = np.zeros(one.size, np.int64)
        np.add.at(total, slots, value)
        sums.append(total)
    by_depth = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
    for d in range(depth.max(initial=0), 0, -1):
        at = by_depth[cut[d - 1] : cut[d]]
        for total in sums:
            np.add.at(total, parent[at], total[at])
    return table.hi, table.lo, sums


def _shard(table: pa.Table) -> pa.Table:
    cols = [table.column(n).to_numpy() for n in ("hi", "lo", "up_hi", "up_lo", "level", "gain", "leaves")]
    hi, lo, (gain, leaves) = subtree_sums(*cols[:5], cols[5:])
    return pa.table({"hi": hi, "lo": lo, "gain": gain, "leaves": leaves})


def _subtrees(paths: DataFrame, info: DataFrame) -> DataFrame:
    """hi, lo, gain, leaves: sums over the subtrees of nodes that several conversations share, and over the whole for the root (0, 0)."""
    gain = (F.col("n_convs") - 1) * F.col("words")
    shared = info.where("n_convs > 1 and depth > 0").select(*KEY, F.col("conv_id").alias("owner"), gain.alias("gain"))
    rows = paths.select("conv_id", "pos", *KEY, *ABOVE).join(shared, KEY)
    rows = saved(rows.select("conv_id", F.expr(f"(pos - 1) div {STRETCH}").alias("stretch"), ((F.col("pos") - 1) % STRETCH).alias("level"), *KEY, *ABOVE, F.when(F.col("conv_id") == F.col("owner"), F.col("gain")).otherwise(0).alias("gain")))
    # what lies below a stretch counts at its last row: the conversation's later stretches, and its leaf if it has one of its own
    units = rows.groupBy("conv_id", "stretch").agg(F.sum("gain").alias("gain"), F.max_by(F.struct("level", *KEY, *ABOVE), "level").alias("last"))
    below = F.sum("gain").over(Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    leaves = info.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    ends = units.withColumn("below", F.coalesce(below, F.lit(0))).join(leaves, "conv_id", "left")
    ends = ends.select("conv_id", "stretch", "last.*", F.col("below").alias("gain"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaves"))
    weights = rows.withColumn("leaves", F.lit(0).cast("long")).unionByName(ends)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    weights = weights.withColumn("shard", F.pmod(F.xxhash64("conv_id", "stretch"), F.lit(shards))).drop("conv_id", "stretch")
    parts = weights.groupBy("shard").applyInArrow(_shard, "hi long, lo long, gain long, leaves long")
    sums = parts.groupBy(*KEY).agg(F.sum("gain").alias("gain"), F.sum("leaves").alias("leaves"))
    whole = info.agg(F.sum(F.when(F.col("depth") > 0, gain).otherwise(0)).alias("gain"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    root = F.lit(0).cast("long")
    return sums.unionByName(whole.where("leaves is not null").select(root.alias("hi"), root.alias("lo"), F.coalesce("gain", root).alias("gain"), "leaves"))


def _end_lists(ends: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the ids that end at a node, ascending and joined by commas. Ids are joined to texts in ranges; a node's texts then pass through one running hash."""
    def texts(batches):
        for batch in batches:
            hi, lo, ids = (c.to_numpy() for c in batch.columns)
            if not ids.size:
                continue
            cut = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            names = list(map(str, ids.tolist()))
            joined = [",".join(names[a:b]) for a, b in zip(cut, [*cut[1:], len(names)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hi[cut]), pa.array(lo[cut]), pa.array(ids[cut]), pa.array(joined)], [*KEY, "first", "ids"])

    def hashes(batches):
        node = sha = None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if node == (hi, lo):
                    sha.update(f",{ids}".encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (hi, lo), hashlib.sha256(ids.encode())
            yield rows(out)
        if node:
            yield rows([(*node, sha.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(texts, "hi long, lo long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashes, "hi long, lo long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (conv_id, pos from 1 without gaps, mark_hi, mark_lo, words, size) over all of ``convs`` (conv_id, size).

    conv_id (a node's smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; and node, the digest (zero: the root).
    """
    paths = saved(_paths(rows))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(zero.alias("hi"), zero.alias("lo"), zero.cast("long").alias("up_hi"), zero.alias("up_lo"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"))
    nodes = saved(_nodes(paths).unionByName(top))
    kids = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    info = saved(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    ends = paths.where("pos = size").select(*KEY, "conv_id").unionByName(convs.where("size = 0").select(zero.alias("hi"), zero.alias("lo"), "conv_id"))
    above = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    full = info.join(saved(_subtrees(paths, info)), KEY, "left").join(saved(_end_lists(ends)), KEY, "left").join(above, ABOVE)
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("gain", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))).alias("node"),
    )
