"""SentencePiece ids, spans and texts against the library, merges against a plain merger."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from dirwise.llm import merges, queries, sentences

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "a  b\n\nc ▁x", "<0x41>\x00日本😀", "  ", " \n", "</s><s><unk>", "▁", "▁▁▁▁▁", " " * 17, " " * 5 + "x" + " " * 9, "�", "é ﬁ ① ＡＢＣ ｶﾞ"]


def texts(n, alphabet="ab ▁\n1é日😀\x00thein ﬁ①Ａ　​́", longest=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def field(number, value):
    size, head = len(value), bytearray([number << 3 | 2])
    while True:
        head.append(size & 127 | (128 if size > 127 else 0))
        size >>= 7
        if not size:
            return bytes(head) + value


def with_normaliser(rule, prefix, trim):
    """The model's file with another normaliser: the library's own compiled map of a rule."""
    spec = next(v for f, v in sentences.message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if f == 3)
    new = field(1, b"other") + field(2, dict(sentences.message(spec))[2]) + bytes([3 << 3, prefix, 4 << 3, trim])
    with open(PATH, "rb") as f:
        parts = list(sentences.message(f.read()))
    return b"".join(field(k, v) for k, v in parts if k != 3) + field(3, new)


def library_spans(library, text):
    """Byte spans as the library's own message holds them."""
    out = []
    for f, piece in sentences.message(library.encode(text, out_type="serialized_proto")):
        if f == 2:
            x = dict(sentences.message(piece))
            out.append((x[2], x.get(4, 0), x.get(5, 0)))
    return out


@pytest.mark.parametrize("model", [("plain",), *(("rule", rule, prefix, trim) for rule in ("nmt_nfkc", "nfkc_cf") for prefix, trim in itertools.product((0, 1), (0, 1)))], ids=str)
def test_ids_spans_and_texts_match_the_library(model):
    if model[0] == "plain":
        with open(PATH, "rb") as f:
            raw = f.read()
    else:
        raw = with_normaliser(*model[1:])
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), sentences.Sentences(raw)
    for text, (ids, begins, ends) in zip(all_texts := ODD + texts(1500), own.encode(all_texts), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == library_spans(library, text), repr(text)


def test_any_ids_decode_as_the_library_does():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), sentences.load(PATH), random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x6000)))], ids=["latin", "han"])
def test_a_million_letters_without_a_space(alphabet):
    text = "".join(random.Random(3).choices(alphabet, k=1_000_000))
    ids, begins, ends = sentences.load(PATH).encode([text])[0]
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    assert ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()


def test_spans_tile_the_text_and_hold_the_pieces():
    own = sentences.load(PATH)
    for text, (ids, begins, ends) in zip(all_texts := texts(300, "abc déé日"), own.encode(all_texts), strict=True):
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(begins, ends, strict=True)) == raw
        for i, b, e in zip(ids.tolist(), begins, ends, strict=True):
            assert b == e or raw[b:e].decode() in own.raw[i].decode(errors="replace") or len(own.raw[i]) == 1


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentences, "MEMO_PARTS", 3)
    with open(PATH, "rb") as f:
        own = sentences.Sentences(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ODD + texts(50):
        assert own.encode([text])[0][0].tolist() == library.encode(text)


def plain_merge(table, symbols):
    """Lowest rank first, of equal ranks the leftmost, one at a time."""
    pairs = {int(k): (int(r), int(p)) for k, r, p in zip(table.keys, table.rank, table.product, strict=True)}
    sym = list(symbols)
    while True:
        known = [(pairs[k], i) for i in range(len(sym) - 1) if (k := sym[i] * table.base + sym[i + 1]) in pairs]
        if not known:
            return sym
        (_, product), i = min(known, key=lambda x: (x[0][0], x[1]))
        sym[i : i + 2] = [product]


@pytest.mark.parametrize("ranks", [3, 40, 1000])
def test_merges_match_a_plain_merger(ranks):
    """Tables drawn at random: pairs with equal ranks, and merges that make pairs of lower rank."""
    rng = np.random.default_rng(ranks)
    for _ in range(60):
        n = 12
        pairs = np.unique(rng.integers(0, n, (60, 2)), axis=0)
        table = merges.MergeTable(pairs[:, 0], pairs[:, 1], rng.integers(0, ranks, len(pairs)), rng.integers(0, n, len(pairs)), n)
        words = [rng.integers(0, n, rng.integers(1, 40)) for _ in range(20)]
        want = [plain_merge(table, w.tolist()) for w in words]
        sizes = np.array([len(w) for w in words])
        sym, counts = table.merge_short(np.concatenate(words), sizes)
        assert [x.tolist() for x in np.split(sym, counts.cumsum()[:-1])] == want
        assert [table.merge_long(w).tolist() for w in words] == want and [table.merge_one(w).tolist() for w in words] == want


def test_query_rows(spark, odd, none):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sentences.encode(odd, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, library.encode(t or "")) for i, t in odd.select("doc_id", "text").collect())
    assert sentences.encode(none, PATH).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op11_sentence_pieces"](spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, r = library.encode(t or ""), rows.pop(i)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["spanned_bytes"] == len((t or "").encode()) and re.fullmatch("[0-9a-f]{64}", r["ids_sha256"])
    assert not rows
