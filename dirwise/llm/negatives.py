"""Hard negatives by bounds along spanning trees of anchors.

Anchors of a label that lie close by form groups of at most ``GROUP``; each group has a
minimal spanning tree. A candidate's score at a parent anchor, plus or minus the edge's
length times the candidate's norm, bounds its score at the child. Only candidates whose
bounds meet what the child still needs (for positives the best few so far, for
negatives the windows below its positives) are scored anew, exactly; the others hand
their bounds on, widened edge by edge.

Anchors and candidates are dealt out over a grid: a cell holds a bounded number of anchors
(in memory, with their trees and best rows so far) and streams its share of the
candidates past them. Each candidate travels once per column of anchors, each anchor once
per row of candidates, and only a cell's best rows leave it. Which cell a row falls in
depends on its id alone, so no label, vector or group of copies fills a cell.

Defined results: rows without an id, label or vector, and vectors with null or non-finite
components, take no part; of rows that repeat an id the first by label and vector
counts; scores are exact integers, and one beyond a long raises an error; empty vectors
take no part, and vectors of different lengths never meet; ties go to the smaller id;
extra columns are not read; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.session import saved

#: Anchors of a tree, of a cell, and candidates of a cell, at most (cells: about).
GROUP = 256
CELL_ANCHORS = 4096
CELL_ROWS = 50_000
#: Candidates scored at once.
BLOCK = 4096
#: Above this share of scores that are needed after all, the rest of a group is scored in one product.
DENSE = 0.5
#: Integers up to here are exact as doubles.
EXACT = 2**53


def taking_part(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (array<double> of whole numbers) of the rows that take part; one row per id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # doubles beyond 2^53 are whole numbers
    whole = F.transform(v, lambda x: F.when(F.abs(x * F.lit(float(scale))) < F.lit(float(EXACT)), F.floor(x * F.lit(float(scale))).cast("double")).otherwise(x * F.lit(float(scale))))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(F.coalesce(v, F.array().cast("array<double>"))) > 0)).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    many = saved(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    first = rows.join(many, "id").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    return rows.join(many, "id", "left_anti").unionByName(first)


class Tree:
    """Minimal spanning tree of a group of anchors, parents before children."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        square = (vectors * vectors).sum(axis=1)
        apart = np.maximum(square[:, None] + square[None, :] - 2 * (vectors @ vectors.T), 0)
        self.order, self.parent, self.edge = [0], np.full(n, -1), np.zeros(n)
        near, via = apart[0].copy(), np.zeros(n, np.int64)
        open_ = np.ones(n, bool)
        open_[0] = False
        for _ in range(n - 1):
            i = int(np.argmin(np.where(open_, near, np.inf)))
            self.order.append(i)
            # the edge's length is taken from the difference itself and rounded up, so that it never falls short
            self.parent[i], self.edge[i] = via[i], np.sqrt(((vectors[i] - vectors[via[i]]) ** 2).sum()) * (1 + 1e-9) + 1e-9
            open_[i] = False
            closer = open_ & (apart[i] < near)
            near[closer], via[closer] = apart[i][closer], i


def exact_scores(rows: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as whole numbers; ``small`` says that doubles hold them exactly."""
    if small:
        return rows @ anchor
    own = [int(x) for x in anchor]
    out = [sum(int(a) * b for a, b in zip(r, own, strict=True)) for r in rows]
    if any(abs(x) > 2**63 - 1 for x in out):
        raise ValueError("a score is beyond a long")
    return np.array(out, object)


class Cell:
    """Anchors of one cell in trees, and for each anchor what the kind of search keeps."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, search):
        order = np.lexsort((ids, _closeness(vectors), labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.search, self.order = search, order
        cut = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1]])
        self.groups = []
        for a, b in zip(cut, [*cut[1:], ids.size], strict=True):
            for start in range(a, b, GROUP):
                stop = min(start + GROUP, b)
                self.groups.append((start, stop, int(self.labels[start]), Tree(self.vectors[start:stop])))
        self.top = np.abs(self.vectors).max(initial=0)
        self.scored = 0  # candidates scored one by one or in products, for tests and reports

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, ids.size, BLOCK):
            stop = start + BLOCK
            self._block(ids[start:stop], labels[start:stop], vectors[start:stop])

    def _block(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        norm = np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9)
        small = self.top * np.abs(vectors).max(initial=0) * vectors.shape[1] < EXACT
        for start, stop, label, tree in self.groups:
            mine = np.flatnonzero((labels == label) == self.search.same_label)
            if not mine.size:
                continue
            own, size = vectors[mine], norm[mine]
            low, high = np.empty((stop - start, mine.size)), np.empty((stop - start, mine.size))
            dense, seen, needed = None, 0, 0
            for i in tree.order:
                at = start + i
                if tree.parent[i] < 0:
                    need = np.arange(mine.size)
                else:
                    reach = tree.edge[i] * size
                    slack = reach * 1e-9 + 1e-6 if small else reach * 1e-9 + np.abs(low[tree.parent[i]]) * 1e-12
                    np.subtract(low[tree.parent[i]], reach + slack, out=low[i])
                    np.add(high[tree.parent[i]], reach + slack, out=high[i])
                    need = np.flatnonzero(self.search.wanted(at, low[i], high[i]))
                if not need.size:
                    continue
                seen, needed = seen + 1, needed + need.size
                if dense is None and small and seen > 8 and needed > DENSE * seen * mine.size:  # the bounds tell little here
                    dense = own @ self.vectors[start:stop].T
                    self.scored += dense.size
                if dense is None:
                    score = exact_scores(own[need], self.vectors[at], small)
                    self.scored += need.size
                else:
                    score = dense[need, i]
                low[i, need] = high[i, need] = score.astype(np.float64)
                self.search.offer(at, int(self.ids[at]), score, ids[mine[need]])


def _closeness(vectors: np.ndarray) -> np.ndarray:
    """A number by which close vectors tend to follow each other: the signs along fixed directions, read as a Gray code."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    directions = np.random.default_rng(7).normal(size=(vectors.shape[1], 24))
    bits = (vectors @ directions > 0).astype(np.int64)
    plain = np.bitwise_xor.accumulate(bits, axis=1)
    return plain @ (1 << np.arange(23, -1, -1))


def _merged(scores: np.ndarray, ids: np.ndarray, kept: tuple, k: int) -> tuple:
    """The k best of both, higher scores first, ties by smaller id."""
    scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], ids])
    if scores.size > 4 * k and scores.dtype != object:
        edge = np.partition(scores, scores.size - k)[scores.size - k]
        some = scores >= edge
        scores, ids = scores[some], ids[some]
    order = sorted(range(scores.size), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _largest(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return float(np.partition(values, values.size - k)[values.size - k]) if values.size >= k else -np.inf


NOTHING = (np.zeros(0), np.zeros(0, np.int64))


class Positives:
    """The best ``k`` rows of the anchor's label."""

    same_label = True

    def __init__(self, anchors: int, k: int):
        self.k, self.best = k, [NOTHING] * anchors

    def wanted(self, at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Candidates that may be among the best, of those kept and of these; one of these may be the anchor itself."""
        scores = self.best[at][0]
        least = float(scores[-1]) if scores.size == self.k else -np.inf
        return high >= max(least, _largest(low, self.k + 1))

    def offer(self, at: int, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = ids != anchor
        if self.best[at][0].size == self.k:
            keep &= scores >= self.best[at][0][-1]
        if keep.any():
            self.best[at] = _merged(scores[keep], ids[keep], self.best[at], self.k)

    def rows(self, at: int) -> Iterator[tuple[int, int, int]]:
        for score, i in zip(*self.best[at], strict=True):
            yield -1, int(i), int(score)


class Negatives:
    """For each positive the best ``k`` rows of other labels with floor * positive <= 100 * negative <= ceiling * positive."""

    same_label = False

    def __init__(self, positives: list[list[tuple[int, int]]], k: int, floor: int, ceiling: int):
        self.k = k
        self.windows = [[(i, -((-floor * s) // 100), (ceiling * s) // 100) for i, s in held if -((-floor * s) // 100) <= (ceiling * s) // 100] for held in positives]
        self.best = [[NOTHING] * len(x) for x in self.windows]

    def _reach(self, at: int) -> Iterator[tuple[int, int | float, int]]:
        for n, (_, low, high) in enumerate(self.windows[at]):
            scores = self.best[at][n][0]
            yield n, (max(low, scores[-1]) if scores.size == self.k else low), high

    def wanted(self, at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(low.size, bool)
        for _, least, most in self._reach(at):
            some = (high >= float(least)) & (low <= float(most))
            sure = low[some & (low >= float(least)) & (high <= float(most))]
            out |= some & (high >= _largest(sure, self.k))
        return out

    def offer(self, at: int, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for n, least, most in list(self._reach(at)):
            keep = (scores >= least) & (scores <= most) & (ids != anchor)
            keep = keep.astype(bool)
            if keep.any():
                self.best[at][n] = _merged(scores[keep], ids[keep], self.best[at][n], self.k)

    def rows(self, at: int) -> Iterator[tuple[int, int, int]]:
        for (positive, _, _), best in zip(self.windows[at], self.best[at], strict=True):
            for score, i in zip(*best, strict=True):
                yield positive, int(i), int(score)


FOUND = "anchor_id long, positive_id long, found_id long, score long"


def _grid(anchors: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """Anchors and candidates dealt over the cells: cell, kind (0: anchor, 1: candidate), id, label, v, positives."""
    n_anchors, n_rows = anchors.count(), rows.count()
    across = max(1, -(-n_anchors // CELL_ANCHORS))
    down = max(1, -(-n_rows // CELL_ROWS), -(-rows.sparkSession.sparkContext.defaultParallelism // across))
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    cells = lambda first, step, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * step)).alias("cell")
    held = anchors.select(cells(spot(across, 1) * down, 1, down), F.lit(0).alias("kind"), "id", "label", "v", "positives")
    none = F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives")
    passing = rows.select(cells(spot(down, 2), down, across), F.lit(1).alias("kind"), "id", "label", "v", none)
    return held.unionByName(passing), across * down


def _search(anchors: DataFrame, rows: DataFrame, make) -> DataFrame:
    """What the searches of all cells keep. ``make`` makes a search from the anchors' positives."""
    dealt, cells = _grid(anchors, rows)

    def run(batches: Iterator[pa.RecordBatch]):
        now, open_ = None, {}
        waiting: dict[int, list[tuple]] = {}

        def opened(held: list[tuple]) -> Cell:
            ids, labels, vectors, positives = (list(x) for x in zip(*held, strict=True))
            made = Cell(np.array(ids), np.array(labels), np.array(vectors), None)
            made.search = make([positives[i] for i in made.order])
            return made

        def results(done: Cell):
            out = [(int(done.ids[at]), *row) for at in range(done.ids.size) for row in done.search.rows(at)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["anchor_id", "positive_id", "found_id", "score"])

        for batch in batches:
            cells_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, (cells_[1:] != cells_[:-1]) | (kinds[1:] != kinds[:-1])]) if batch.num_rows else []
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if cells_[a] != now:
                    yield from map(results, open_.values())
                    now, open_, waiting = cells_[a], {}, {}
                ids, labels, lists = (batch.column(i).slice(a, b - a) for i in (2, 3, 4))
                if kinds[a] == 0:
                    for i, label, v, held in zip(ids.to_pylist(), labels.to_pylist(), lists.to_pylist(), batch.column(5).slice(a, b - a).to_pylist(), strict=True):
                        waiting.setdefault(len(v), []).append((i, label, v, [(x["i"], x["s"]) for x in held or []]))
                    continue
                if waiting:
                    open_, waiting = {width: opened(held) for width, held in waiting.items()}, {}
                ids, labels, flat, widths = ids.to_numpy(), labels.to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                for width in set(widths.tolist()) & set(open_):
                    some = widths == width
                    open_[width].see(ids[some], labels[some], flat[np.repeat(some, widths)].reshape(-1, width))
        yield from map(results, open_.values())

    together = dealt.repartition(max(1, cells), "cell").sortWithinPartitions("cell", "kind")
    return together.mapInArrow(run, FOUND)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """rank and the first k of each group, higher scores first, ties by smaller id. A group has at most k rows from each cell."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, floor: int = 30, ceiling: int = 90, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``. Components are ``scale`` times the vector's, rounded down.
    """
    kept = saved(taking_part(rows, id_col, vector_col, label_col, scale))
    no_positives = F.array().cast("array<struct<i: bigint, s: bigint>>")
    anchors = kept.where(is_anchor)
    best = _best(_search(anchors.withColumn("positives", no_positives), kept, lambda held: Positives(len(held), positives)), ["anchor_id"], positives)
    best = saved(best.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("i"), F.col("positive_score").alias("s")))).alias("positives"))
    found = _search(anchors.join(lists, "id"), kept, lambda held: Negatives(held, negatives, floor, ceiling))
    ranked = _best(found, ["anchor_id", "positive_id"], negatives)
    return ranked.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
