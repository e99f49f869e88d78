"""Near-duplicates by SimHash: fingerprints, a self-join of their binary trie, and the groups that links form.

The trie is walked breadth-first as tables. A row of the frontier is a pair of trie
nodes of one depth with the number of bits in which their paths differ; a step joins
both nodes with their children some levels deeper and drops every pair that exceeds
the error budget. Of three parts of a fingerprint, at least one agrees when no more
than two bits differ, so three tries (of the fingerprint rotated by a part each) are
walked together, each with no error allowed in its first part.

Why no key gets hot: the trie holds each distinct fingerprint once, however many
documents share it; a node has at most ``2**step`` children in a step and at most
1 + d + d(d-1)/2 partners at depth d, at any number of rows.

Defined results: null text counts as empty, and texts without words have fingerprint
zero and are linked like any other; equal rows share a group; a group is named by the
smallest id it holds, a null id never names one unless there is no other; other
columns are ignored; no documents, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirwise.llm.common import slices, text_or_empty
from dirwise.llm.components import components
from dirwise.session import saved

BITS = 64
WORDS = 3
BUDGET = 2
SEED = 42
#: Levels walked at once below the first part.
STEPS = (8, 8, 9, 9, 9)
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the shingles of a text, repeats included, as a signed long."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) > words else iter([b" ".join(parts)])
    total, counts = 0, np.zeros(BITS, np.int64)
    hashed = (xxhash.xxh64_intdigest(x, SEED) for x in shingles)
    while (block := np.fromiter((h for h, _ in zip(hashed, range(BLOCK))), np.uint64)).size:  # noqa: B905
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += block.size
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *further: str) -> DataFrame:
    """id, fp (the 64 bits as a long) of every row, and its columns ``further``."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *further)]
    names = ["id", *further, "fp"]

    def run(batches):
        for batch in slices(batches):
            *held, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*held, pa.array(map(fingerprint, texts.to_pylist()), pa.int64())], names)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "long"], strict=True))
    return docs.select(F.col(id_col).alias("id"), *further, text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _rotated(code, by: int):
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, BITS - by)) if by else code


def trie_links(codes: DataFrame, budget: int = BUDGET, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct longs in column ``fp`` that differ in at most ``budget`` bits; each pair once."""
    if budget != 2:
        raise ValueError("three parts hold one that agrees for a budget of two")
    part = BITS - sum(steps)
    turns = (0, part, 2 * part)
    fp = F.col("fp")
    tries = codes.where("fp is not null").select(F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), _rotated(fp, by).alias("code")) for i, by in enumerate(turns)])).alias("x")).select("x.*")
    tries = tries.withColumn("node", F.shiftrightunsigned("code", BITS - part))
    shared = tries.groupBy("trie", "node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tries = saved(tries.join(shared, ["trie", "node"]))
    front = saved(shared.select("trie", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("bits")))
    depth = part
    for step in steps:
        below = BITS - depth - step
        paths = tries.select("trie", F.shiftrightunsigned("code", BITS - depth).alias("node"), F.shiftrightunsigned("code", below).bitwiseAND(F.lit((1 << step) - 1)).alias("sub"))
        kids = paths.groupBy("trie", "node", "sub").agg(F.count("*").alias("n")).groupBy("trie", "node").agg(F.collect_list(F.struct("sub", "n")).alias("kids"))
        left = front.join(kids.select("trie", F.col("node").alias("a"), F.col("kids").alias("kids_a")), ["trie", "a"])
        both = left.join(kids.select("trie", F.col("node").alias("b"), F.col("kids").alias("kids_b")), ["trie", "b"])
        one = both.select("trie", "a", "b", "bits", "kids_b", F.explode("kids_a").alias("x"))
        near = F.filter("kids_b", lambda y: (F.bit_count(y["sub"].bitwiseXOR(F.col("x.sub"))) + F.col("bits") <= budget) & ((F.col("a") != F.col("b")) | (y["sub"] > F.col("x.sub")) | ((y["sub"] == F.col("x.sub")) & (y["n"] > 1))))
        two = one.select("trie", "a", "b", "bits", "x", F.explode(near).alias("y"))
        deeper = lambda node, kid: F.shiftleft(F.col(node), step).bitwiseOR(F.col(kid))
        front = two.select("trie", deeper("a", "x.sub").alias("a"), deeper("b", "y.sub").alias("b"), (F.col("bits") + F.bit_count(F.col("x.sub").bitwiseXOR(F.col("y.sub")))).cast("int").alias("bits"))
        depth += step
    back = lambda c: F.when(F.col("trie") == 0, F.col(c)).when(F.col("trie") == 1, _rotated(F.col(c), BITS - turns[1])).otherwise(_rotated(F.col(c), BITS - turns[2]))
    return front.where("a <> b").select(back("a").alias("x"), back("b").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(marks: DataFrame, budget: int) -> DataFrame:
    """fp, component: the fingerprint that names the group of each distinct fingerprint."""
    codes = marks.select("fp").distinct()
    joined = saved(components(trie_links(saved(codes), budget)))
    return codes.join(joined, codes["fp"] == joined["vertex"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most ``budget`` bits)."""
    marks = saved(fingerprints(docs, id_col, text_col))
    named = marks.groupBy("fp").agg(F.min("id").alias("first")).join(_grouped(marks, budget), "fp")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    return marks.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` per group: the smallest by id (a null id last), then by its text's hash; of rows equal in both any one.

    Rows, not ids, are kept or dropped: an id may stand on several texts.
    """
    mark = F.xxhash64(text_or_empty(text_col))
    marks = saved(fingerprints(docs.select(F.col(id_col), F.col(text_col), mark.alias("mark__")), id_col, text_col, "mark__"))
    row = F.struct(F.col("id").isNull().alias("blank"), "id", "mark__")
    named = marks.groupBy("fp").agg(F.min(row).alias("own")).join(_grouped(marks, budget), "fp")
    best = saved(named.groupBy("component").agg(F.min("own").alias("first")))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark__") == F.col("first.mark__"))
    going = marks.join(named.join(best, "component").select("fp", "first"), "fp").where(~stays)
    # rows that stay but once
    many = marks.groupBy("id", "mark__").agg(F.count("*").alias("n")).where("n > 1")
    kept = best.select(F.col("first.id").alias("k"), F.col("first.mark__").alias("m"))
    many = many.join(kept, F.col("id").eqNullSafe(F.col("k")) & (F.col("mark__") == F.col("m")), "left_semi")
    named_as = lambda rows, flag: rows.select(F.col("id").alias("id__"), "mark__", F.lit(flag).alias("stays__"))
    odd = saved(named_as(going, False).unionByName(named_as(many, True)))
    same = lambda rows: docs[id_col].eqNullSafe(rows["id__"]) & (mark == rows["mark__"])
    again = odd.where("stays__")
    more = docs.join(again, same(again)).dropDuplicates(["id__", "mark__"]).select(*docs.columns)
    return docs.join(odd, same(odd), "left_anti").unionByName(more)
