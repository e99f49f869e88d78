"""Hard negatives against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from dirwise.llm import negatives, queries


def plain(rows, step=100, n_pos=5, n_neg=10):
    """All scores of all pairs in Python integers."""
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            fine[i] = min(fine.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in fine.items():
        if a % step:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, w) in fine.items() if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2])[:n_pos]:
            windowed = sorted(x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n_neg]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(windowed, 1)]
    return sorted(out)


def own(spark, rows, step=100):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, score double, v string")
    return sorted(map(tuple, negatives.mined(table, F.col("id") % step == 0).collect()))


def test_negatives_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], int(rng.integers(0, 4))) for i in range(1500)]
    rows += [(2000 + i, [0.5] * 16, i % 3) for i in range(700)]  # a third are one vector
    rows += [(5000 + i, rows[0][1], 2) for i in range(0, 300, 50)]
    odd = [(None, [1.0] * 16, 1), (9001, None, 1), (9002, [1.0] * 16, None), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, [], 1), (9100, [1.0, 2.0], 1), (9101, [1.0, 2.5], 1), (9102, [1.0, 1.0], 2), (9200, [0.0] * 16, 1), (9006, [float("inf")] * 16, 2)]
    odd += [(9300, [1e-9] * 16, 3), (9300, [-0.1] * 16, 2)]
    assert own(spark, rows + odd) == plain(rows + odd)


def test_close_anchors_are_bounded_by_their_parents():
    """In tight clusters most candidates never get a score of their own, and results are those of all pairs."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 200
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 32)))
    labels = np.repeat(np.arange(40) % 4, 100)
    ids, anchors = np.arange(4000), np.arange(0, 4000, 5)
    cell = negatives.Cell(ids[anchors], labels[anchors], vectors[anchors], negatives.Positives(anchors.size, 5))
    cell.see(ids, labels, vectors)
    scores = vectors @ vectors.T
    for at, a in enumerate(cell.ids):
        same = np.flatnonzero((labels == labels[a]) & (ids != a))
        want = same[np.lexsort((same, -scores[a, same]))[:5]]
        assert cell.search.best[at][1].tolist() == want.tolist()
    assert cell.scored < 0.5 * anchors.size * 1000


def test_large_whole_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.randint(2**18, 2**20) + rng.random() for _ in range(4)], i % 2) for i in range(0, 400, 4)]
    assert own(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="beyond a long"):
        own(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_empty_tables_and_few_rows(spark):
    assert own(spark, [(None, None, None)]) == []
    assert own(spark, [(0, [1.0], 1)]) == []
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.9], 2)]
    assert own(spark, few) == plain(few) != []


def test_trees_reach_all_anchors_by_short_edges():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(60, 5)) * 50)
    tree = negatives.Tree(v)
    assert sorted(tree.order) == list(range(60)) and tree.order[0] == 0
    seen = {0}
    for i in tree.order[1:]:
        assert tree.parent[i] in seen and tree.edge[i] >= np.linalg.norm(v[i] - v[tree.parent[i]])
        seen.add(i)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(queries.ORACLES["op13_hard_negatives"])
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = queries.QUERIES["op13_hard_negatives"](spark, sf)
    assert want and want == sorted(tuple(r[c] for c in cols) for r in got.collect())
