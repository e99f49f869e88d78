"""Line deduplication, SimHash groups, tokens, packing and fingerprints against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dirwise.llm import bpe, components, fingerprints, lines, packing, simhash

PATH = public_tokenizers.path("word_bpe_49k.json")
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# lines


def plain_lines(docs):
    keys = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = x.strip(BLANK).translate(LOWER)
            if len(k) >= 10:
                keys.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        kept, n = [], 0
        for x in (t or "").split("\n"):
            ids = keys.get(x.strip(BLANK).translate(LOWER), set())
            named = [j for j in ids if j is not None]
            gone = len(ids) > 1 and (i is None or i != min(named))
            kept, n = (kept, n + 1) if gone else ([*kept, x], n)
        out.append((i, "\n".join(kept), len((t or "").split("\n")), n))
    return sorted(out, key=repr)


def test_lines_match_plain_python(spark):
    rng = random.Random(1)
    pool = [f"  Shared LINE number {i}  " for i in range(30)] + ["short", "", "ÄÖÜ äöü ÄÖÜ äöü", "\x0b tab line here \t", "shared line NUMBER 3"]
    docs = [(i, "\n".join(rng.choices([*pool, f"own line of {i} {rng.random()}"], k=rng.randint(1, 9)))) for i in range(200)]
    docs += [(i, "the very common line") for i in range(200, 300)] + [(300, None), (301, ""), (302, "\n\n"), (None, "The Very Common Line\nalone here"), (299, "the very common line")]
    got = lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lines(docs)


def test_lines_keep_other_columns(odd, none):
    got = lines.deduplicated(odd)
    assert got.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_dropped"] and got.count() == odd.count()
    assert lines.deduplicated(none).count() == 0


# SimHash


def plain_mark(text):
    words = [w.decode("utf-8", "replace") for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_of_texts(spark):
    texts = [None, "", "One", "one TWO", "one two three", "one two three four", "É é É é", "a b a b a b a b c", "x " * 70_000 + "y"]
    got = {r["id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain_mark(t) for i, t in enumerate(texts)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_trie_links_match_all_pairs(spark):
    rng = random.Random(2)
    codes = {0, (1 << 64) - 1}
    for _ in range(40):  # dense clouds: every member one to four bits off
        base = rng.getrandbits(64)
        codes |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    base = rng.getrandbits(64)
    codes |= {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    codes = sorted(codes)
    got = {(r["a"], r["b"]) for r in simhash.trie_links(spark.createDataFrame([(signed(c),) for c in codes], "fp long")).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 400)
    edges = list(zip(names[:150], names[1:150], strict=False)) + [(names[200], x) for x in names[201:300]] + [(names[350], names[350]), (names[1], names[0]), (None, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    expected = {x: min(names[:150]) for x in names[:150]} | {x: min(names[200:300]) for x in names[200:300]}
    assert got == expected


def test_groups_of_odd_texts(odd, none):
    got = sorted((r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(odd).collect() if r["doc_id"] is not None)
    assert [x[:2] for x in got if x[0] in (1, 2, 3, 4, 5)] == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4)] and got[0][2] == "0" * 16
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id < 6").collect()) == [1, 4]
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def test_a_near_copy_links_to_its_text(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(2000)) for _ in range(20)]
    docs = [*enumerate(texts), *((100 + i, t.replace(t.split()[7], "other", 1)) for i, t in enumerate(texts))]
    marks = {i: plain_mark(t) for i, t in docs}
    parent = {i: i for i in marks}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in marks:
        for b in marks:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in marks} and sum(got[100 + i] == i for i in range(20)) >= 10


def test_one_row_of_each_group_stays(spark):
    """Rows are kept or dropped, not ids: an id may stand on several texts, rows may repeat, ids may be missing."""
    other = "quite another text that nobody else holds at all"
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, other, "z"), (5, "twice the same row here", "u"), (5, "twice the same row here", "u"), (None, "no id but shared", "v"), (None, "no id but shared", "v"), (7, "no id but shared", "w"), (None, "alone without an id", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark__ string").withColumnRenamed("mark__", "fp")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2], rows[3], rows[7], rows[8]], key=repr)


# tokens

SPECIAL = ["<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "a\x85b\xa0c　d\x1ce", "DON'T we'll I'D 's", "####aaaaaaaa!!!?", "ΑΣ ΣΑΣ ǅ ẞ ﬁ İ", "é é ́x", "1234 ½ Ⅷ ²", "日本語のテキスト", "😀😀 👨‍👩‍👧"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_match_the_library(spark, odd, library):
    texts = [(i, t) for i, t in enumerate(SPECIAL)] + [(100 + i, r["text"]) for i, r in enumerate(odd.select("text").collect())]
    for r in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect():
        ids = library.encode(dict(texts)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids, skip_special_tokens=False))


def test_random_strings_match_the_library(library):
    rng, words = random.Random(5), bpe.WordBpe(PATH)
    texts = ["".join(rng.choices("abcdeABC éßñ'.,!#  \n\t0123日Σ", k=rng.randint(0, 80))) for _ in range(3000)]
    assert [x.tolist() for x in words.encode_batch(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x6000)))], ids=["latin", "han"])
def test_a_million_letters_without_a_space(library, alphabet):
    text = "".join(random.Random(3).choices(alphabet, k=1_000_000))
    assert bpe.load(PATH).encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_memo_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 50)
    words, rng = bpe.WordBpe(PATH), random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(30)) for _ in range(60)]
    for i in range(0, 60, 7):
        assert [x.tolist() for x in words.encode_batch(texts[i : i + 7])] == [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 7]]


# packing


def plain_fit(lengths, window):
    open_, out = [], []
    for n in lengths:
        fits = [(left, i) for i, left in enumerate(open_) if left >= n]
        if fits:
            left, i = min(fits)
        else:
            open_.append(window)
            left, i = window, len(open_) - 1
        open_[i] -= n
        out.append(left)
    return out


def test_tightest_window_is_found():
    rng = random.Random(7)
    for window in (1, 7, 64, 100, 4096):
        lengths = sorted((rng.randint(1, window) for _ in range(300)), reverse=True)
        windows, offsets = packing.best_fit_decreasing(lengths, window)
        assert [window - o for o in offsets] == plain_fit(lengths, window)
        ends = {}
        for w, o, n in zip(windows, offsets, lengths, strict=True):
            assert o == ends.get(w, 0)
            ends[w] = o + n
        assert max(ends.values()) <= window
    assert packing.best_fit_decreasing([], 8) == ([], [])


def test_packed_pieces_hold_every_id_once(spark, odd, none, library):
    docs = odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(100, 400)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack(docs, PATH, window=256, group_pieces=200).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 256 and all(r["sequence_tokens"] == ends[r["sequence_id"]] for r in rows)
    for i, t in texts.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(odd, PATH).select("doc_id").where("doc_id is null").count() == 2 and packing.pack(none, PATH).count() == 0


# fingerprints


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_of_edited_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    docs = [(i * 3, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 6, 400, 3000])))) for i in range(80)] + [(None, "a first text without an id"), (1, None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.compared(df).withColumn("c", fingerprints.containment(F.col("sketch"), F.col("edited_sketch"))).withColumn("f", fingerprints.as_text(F.col("sketch"))).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert len(got) == len(docs)
    wrong = []
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(t) and got[i]["f"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in got[i]["sketch"])
        a, b = shingles(t), shingles(edited)
        if min(len(a), len(b)) > 300:
            wrong.append(abs(got[i]["c"] - len(a & b) / min(len(a), len(b))))
            assert all(0 <= h < 1 << 61 for h in got[i]["sketch"])
    assert np.mean(wrong) < 0.08


def test_sketches_of_odd_texts(odd, none):
    assert fingerprints.compared(odd).count() == odd.select("doc_id", "text").distinct().count() and fingerprints.compared(none).count() == 0


def test_merged_sketch_is_that_of_both(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choices("abcdefghijklmnop", k=500)) for _ in range(2))
    s = lambda x: fingerprints.sketch(F.lit(x))
    r = spark.range(1).select(s(a).alias("a"), s(b).alias("b"), fingerprints.merged(s(a), s(b)).alias("m"), fingerprints.containment(s(a), fingerprints.merged(s(a), s(b))).alias("c"), fingerprints.resemblance(s(a), s(a)).alias("r"), s("").alias("e"), fingerprints.merged(s("x y"), s("z")).alias("t"), s("x y").alias("x"), s("z").alias("z")).first()
    assert r["m"] == sorted({*r["a"], *r["b"]}) and r["c"] == r["r"] == 1 and r["e"] == []
    top = lambda h: h & (1 << 64) - 1
    both = [*r["x"], *r["z"]]
    small = [h for h in both if top(h) < 1 << 61]
    assert r["t"] == (sorted(small) if small else [min(both, key=top)])


