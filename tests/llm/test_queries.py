"""The registered queries themselves, on the smallest tables: against their SQL, the libraries, or plain Python."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from dirwise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got.collect())


def test_sketches(spark, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in rows(spark, "op1_scaled_sketches")}
    assert set(got) == set(ids)
    marks = {}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n, r = texts[i], len(texts[i]) // 2, got[i]
        edited = t[: len(t) - n] + texts[after][:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and marks.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_neighbours(spark):
    table = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    ids, m = np.array([x[0] for x in table]), np.array([x[1] for x in table], np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in rows(spark, "op3_curve_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        near = unit @ unit[at]
        order = [i for i in np.lexsort((ids, -near)) if i != at][:5]
        assert [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(near[np.flatnonzero(ids == v)[0]] - s) < 1e-9 for _, v, s in found)
        hits += len({int(ids[i]) for i in order} & {x[1] for x in found})
    assert hits >= 0.9 * 5 * len(got)


def test_simhash_groups(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marks = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        marks[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in marks}
    while True:
        new = {i: min(group[j] for j in marks if (marks[i] ^ marks[j]).bit_count() <= 2) for i in marks}
        if new == group:
            break
        group = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op4_simhash_groups")}
    assert got == {i: (f"{marks[i]:016x}", group[i]) for i in marks}


def test_quality(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op6_line_field_quality")}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_pieces_and_tokens(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in rows(spark, "op9_bpe_round_trip"):
        own = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    held, windows = {}, {}
    for r in rows(spark, "op7_packed_sequences"):
        piece = [*ids[r["doc_id"]], 2][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) + 1
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans, end in [(sorted(held[i]), len(ids[i]) + 1) for i in ids] + [(sorted(w), None) for w in windows.values()]:
        stops = [a + n for a, n in spans]
        assert [a for a, _ in spans] == [0, *stops[:-1]] and (stops[-1] == end if end else stops[-1] <= 4096)


def test_license_base(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows(spark, "op10_license_rules"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(lower))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        labels = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) if labels else True
        assert 0 <= r["score"] <= 1


def test_surrogates(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op8_surrogates")}
    assert set(got) == set(texts) and all((r["n_entities"] == 0) == ((r["text"] or "") == texts[i]) for i, r in got.items())
