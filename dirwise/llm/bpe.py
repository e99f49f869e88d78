"""Byte-pair encoding and decoding with a public word-level vocabulary.

Text is cut at white space; each piece is encoded once per worker and remembered
in a bounded memo. New words are encoded together: the symbols of all of them lie
in one flat array, and every round looks up all neighbouring pairs by binary
search in the sorted keys of the merge table, takes each word's pair of lowest
rank and merges its places from left to right, until no word has a known pair. A long
word has its places kept by rank, so that a round costs what it merges (``merges``).

Defined results: null text counts as empty; an empty text has no ids and decodes
to an empty text; repeated rows are encoded alike; other columns are not touched.
The strings of the vocabulary's own special tokens become their single ids, as the
public tokenizers library does it.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirwise.llm.common import slices, text_or_empty
from dirwise.llm.merges import MergeTable, merge_words

#: Pieces remembered per worker; beyond it the memo starts anew, which changes no result.
MEMO_PIECES = 500_000
# White space as the vocabulary's own splitting rule knows it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Separators that Python's split() takes for white space and the vocabulary doesn't.
ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else free))
        free += byte not in plain
    return letters


class WordBpe:
    """Vocabulary file of the ``tokenizers`` library: lower case, split by a pattern, byte letters, merges with a word-end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.gaps = re.compile(f"[{SPACE}]+")
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        left, right, product = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).T
        self.table = MergeTable(left, right, np.arange(len(pairs)), product, len(self.tokens))
        self.reset()

    def reset(self) -> None:
        """Forget all pieces. Row r of the memo holds ``pool[start[r] : start[r] + count[r]]``."""
        self.memo: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.start = self.count = np.empty(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.inner[raw], sizes.cumsum() - 1
        sym[last] = self.final[raw[last]]
        return merge_words(self.table, sym, sizes)

    def split_words(self, piece: str) -> list[str]:
        """Words of a piece; a run of letters needs no pattern."""
        piece = piece.replace("Σ", "σ").lower()
        return [piece] if piece.isalpha() else self.words.findall(piece)

    def add(self, names: Iterable[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.memo.update(zip(names, range(self.count.size, self.count.size + counts.size), strict=True))
        self.start = np.concatenate([self.start, self.pool.size + counts.cumsum() - counts])
        self.count = np.concatenate([self.count, counts])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the memo's rows, one after the other, and each row's number of ids."""
        counts = self.count[rows]
        shift = self.start[rows] - (counts.cumsum() - counts)
        return self.pool[np.repeat(shift, counts) + np.arange(counts.sum())], counts

    def learn(self, pieces: set[str]) -> None:
        """Add the pieces to the memo: first their words, then the pieces that aren't words themselves."""
        cut = {x: self.split_words(x) for x in pieces}
        fresh = list(set(chain.from_iterable(cut.values())).difference(self.memo))
        if fresh:
            self.add(fresh, *self.merge([w.encode("utf-8", "replace") for w in fresh]))
        rest = [x for x in cut if x not in self.memo]
        if rest:
            sizes = np.fromiter((len(cut[x]) for x in rest), np.int64, len(rest))
            ids, counts = self.flat(np.fromiter(map(self.memo.__getitem__, chain.from_iterable(map(cut.__getitem__, rest))), np.int64))
            ends = np.r_[0, counts.cumsum()][np.r_[0, sizes.cumsum()]]
            self.add(rest, ids, np.diff(ends))

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [x for x in self.gaps.split(text) if x] if ODD.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces: list[str] = []
        ends, marks = [], []
        for text in texts:
            for i, part in enumerate(self.marks.split(text) if any(x in text for x in self.special) else (text,)):
                if i % 2:
                    marks.append((len(pieces), self.special[part]))
                    pieces.append("")
                else:
                    pieces += self.pieces(part)
            ends.append(len(pieces))
        if self.count.size > MEMO_PIECES:
            self.reset()
        if "" not in self.memo:
            self.add([""], np.zeros(1), np.ones(1, np.int64))  # room for the id of a special token
        new = set(pieces).difference(self.memo)
        if new:
            gc.disable()  # many small lists and no cycles: the collector would walk the memo again and again
            try:
                self.learn(new)
            finally:
                gc.enable()
        ids, counts = self.flat(np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces)))
        before = np.r_[0, counts.cumsum()]
        for at, special in marks:
            ids[before[at]] = special
        return np.split(ids, before[ends[:-1]])

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: tokens as they are, joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` array<int> and ``decoded`` string."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in slices(batches):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return rows.withColumnRenamed("id", id_col)
