"""SentencePiece encoding and decoding that keeps, for every piece, its bytes of the original text.

A text is normalised from left to right: at each place the longest entry of the model's
compiled character map (a double-array trie) that begins there is replaced, and every
character that comes out records the byte of the original at which it began. Spaces
become the model's space letter. The normalised text is cut where no piece of the
vocabulary reaches across; each part is merged once per worker (best score first, of
equal scores the leftmost) and remembered in a bounded memo. Characters that the
vocabulary lacks become their bytes. A piece's span is the origin of its first
character up to that of the character after its last; of a character's bytes the last
carries the span, the others are empty.

Defined results: null text counts as empty; an empty text has no ids and decodes to an
empty text; repeated rows are encoded alike; extra columns are not read; very long
texts are encoded whole; an empty table gives no rows. Models other than byte-pair
ones, and models with pieces set by users or marked unused, are refused.
"""

from __future__ import annotations

import functools
import gc
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirwise.llm.common import slices, text_or_empty
from dirwise.llm.merges import MergeTable, merge_words

#: Parts of texts remembered per worker; beyond it the memo starts anew, which changes no result.
MEMO_PARTS = 500_000
# Fixed values of the model's format: the letter for a space, kinds of pieces, the text of unknown pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT = " ⁇ "
BPE = 2


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _number(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(raw, at)
        else:
            size, at = _number(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double-array trie of byte strings and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.values = blob[4 + size :]
        self.memo: dict[int, str] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """Length and value of the longest entry that begins at ``at``; length 0 if there is none."""
        units = self.units
        pos = (units[0] >> 10) << ((units[0] & 512) >> 6)
        length, value = 0, -1
        for n in range(at, len(raw)):
            if not raw[n]:
                break
            pos ^= raw[n]
            unit = units[pos]
            if unit & 0x800000FF != raw[n]:
                break
            pos ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                length, value = n + 1 - at, units[pos] & 0x7FFFFFFF
        return length, value

    def text(self, value: int) -> str:
        if value not in self.memo:
            self.memo[value] = self.values[value : self.values.index(b"\0", value)].decode()
        return self.memo[value]


class Sentences:
    """A byte-pair model file of the ``sentencepiece`` library."""

    def __init__(self, model: bytes):
        pieces, norm, train = [], {}, {}
        for field, value in message(model):
            if field == 1:
                x = dict(message(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                train = dict(message(value))
            elif field == 3:
                norm = dict(message(value))
        if train.get(3, 1) != BPE or train.get(24, 0) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("only byte-pair models without user-set or unused pieces, with the space before a word")
        self.charmap = CharMap(norm[2]) if norm.get(2) else None
        self.prefix, self.trim, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE if self.escape else " "
        self.size = len(pieces)
        self.bytes = np.zeros(256, np.int64)
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.has_bytes = any(k == BYTE for _, _, k in pieces)
        self.raw: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append({CONTROL: b"", UNKNOWN: UNKNOWN_TEXT.encode()}.get(kind, piece.replace(SPACE, " ").encode()))
        self.control = frozenset(i for i, x in enumerate(pieces) if x[2] == CONTROL)
        self.vocab = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.length = np.array([len(p) for p, _, _ in pieces], np.int64)
        # a symbol is a piece's id, or beyond those the code of a character that is no piece
        symbol = lambda x: self.vocab[x] if x in self.vocab else self.size + ord(x) if len(x) == 1 else None
        scores = sorted({-s for _, s, k in pieces if k == NORMAL})
        order = {s: i for i, s in enumerate(scores)}
        pairs = []
        for piece, i in self.vocab.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, order[-pieces[i][1]], i))
        self.table = MergeTable(*np.array(pairs or [(0, 0, 0, 0)], np.int64).T, self.size + 0x110000)
        long = [p for p in self.vocab if len(p) > 1]
        held = set("".join(long))
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in held and chr(c) != self.space))
        if any(a != self.space and b == self.space for p in long for a, b in zip(p, p[1:], strict=False)):
            self.parts = re.compile(r"[\s\S]+")
        else:
            self.parts = re.compile(f"[{alone}]|{self.space}+[^{self.space}{alone}]*|[^{self.space}{alone}]+" if alone else f"{self.space}+[^{self.space}]*|[^{self.space}]+")
        self.reset()

    def reset(self) -> None:
        """Forget all parts. Row r of the memo holds ``ids[start[r] : start[r] + count[r]]`` and the characters each id stands for."""
        self.memo: dict[str, int] = {}
        self.ids, self.chars = np.empty(0, np.int32), np.empty(0, np.int32)
        self.start = self.count = np.empty(0, np.int64)

    # normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of the original it comes from."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.charmap is None and not self.trim:
            starts = np.arange(len(raw) + 1) if len(raw) == len(text) else np.r_[np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)]
            body = raw.decode().replace(" ", self.space)
            return (self.space + body, np.r_[0, starts]) if self.prefix else (body, starts)
        return self._mapped(raw)

    def _steps(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """What each stretch of the original becomes, its first byte, and its length."""
        at = 0
        while at < len(raw):
            length, value = self.charmap.longest(raw, at) if self.charmap else (0, -1)
            if length:
                yield self.charmap.text(value), at, length
            else:
                first = raw[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                yield raw[at : at + length].decode(), at, length
            at += length

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        out: list[str] = []
        origin: list[int] = []
        blank, begun, end = self.trim, False, 0
        for new, at, length in self._steps(raw):
            if not begun:
                if self.trim and new == " ":
                    end = at + length
                    continue
                begun = True
                if self.prefix:
                    out.append(self.space)
                    origin.append(at)
            if blank:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", self.space))
                origin += [at] * len(new)
                blank = self.trim and new.endswith(" ")
            elif not self.trim:
                blank = False
            end = at + length
        text = "".join(out)
        if not begun:
            return "", np.array([end])
        if self.trim:
            while text.endswith(self.space):
                text = text[: -len(self.space)]
                end = origin[len(text)]
        return text, np.array([*origin[: len(text)], end])

    # encoding

    def learn(self, parts: list[str]) -> None:
        """Add the parts to the memo."""
        symbols: dict[str, int] = {}
        for c in set("".join(parts)):
            symbols[c] = self.vocab.get(c, self.size + ord(c))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = np.fromiter(map(symbols.__getitem__, "".join(parts)), np.int64, int(sizes.sum()))
        sym, counts = merge_words(self.table, sym, sizes)
        foreign = sym >= self.size
        chars = np.ones(sym.size, np.int64)
        chars[~foreign] = self.length[sym[~foreign]]
        if foreign.any():
            sym, chars, counts = self._as_bytes(sym, chars, counts, foreign)
        self.memo.update(zip(parts, range(self.count.size, self.count.size + counts.size), strict=True))
        self.start = np.concatenate([self.start, self.ids.size + counts.cumsum() - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids, self.chars = np.concatenate([self.ids, sym.astype(np.int32)]), np.concatenate([self.chars, chars.astype(np.int32)])

    def _as_bytes(self, sym: np.ndarray, chars: np.ndarray, counts: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes, the last of which stands for the character."""
        if not self.has_bytes:
            return np.where(foreign, self.unknown, sym), chars, counts
        code = sym - self.size
        width = np.where(foreign, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        word = np.repeat(np.arange(counts.size), counts)
        new = np.repeat(sym, width)
        new_chars = np.repeat(chars, width)
        rest = np.repeat(width.cumsum(), width) - 1 - np.arange(new.size)  # bytes that follow within the character
        multi, codes = np.repeat(foreign, width), np.repeat(code, width)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[np.repeat(width, width)]
        is_head = np.r_[True, rest[:-1] == 0]
        byte = np.where(is_head, head | (codes >> (6 * rest)), 0x80 | ((codes >> (6 * rest)) & 0x3F))
        new[multi] = self.bytes[byte[multi]]
        new_chars[multi] = (rest[multi] == 0).astype(np.int64)
        return new, new_chars, np.bincount(word, weights=width, minlength=counts.size).astype(np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the first byte and the byte after the last of each id's span in the original."""
        if self.count.size > MEMO_PARTS:
            self.reset()
        parts: list[str] = []
        ends, origins = [0], []
        for text in texts:
            norm, origin = self.normalised(text)
            parts += self.parts.findall(norm)
            ends.append(len(parts))
            origins.append(origin)
        new = list(set(parts).difference(self.memo))
        if new:
            gc.disable()  # no cycles here: the collector would walk the memo again and again
            try:
                self.learn(new)
            finally:
                gc.enable()
        rows = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))
        counts = self.count[rows]
        take = np.repeat(self.start[rows] - (counts.cumsum() - counts), counts) + np.arange(counts.sum())
        cut = np.r_[0, counts.cumsum()][ends]
        ids, chars = self.ids[take], self.chars[take]
        out = []
        for i, origin in enumerate(origins):
            last = chars[cut[i] : cut[i + 1]].cumsum()
            stop = origin[last]
            out.append((ids[cut[i] : cut[i + 1]], np.r_[origin[:1], stop[:-1]][: stop.size], stop))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: the first word's space goes, bytes that are no character become U+FFFD one by one."""
        ids = list(ids)
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix or self.trim:
            for i in ids:
                word = self.raw[i].startswith(b" ") and i not in self._plain
                if word:
                    raw = raw[1:]
                # where spaces are trimmed, words of nothing but the space all lose it
                if i not in self.control and not (word and self.trim and self.raw[i] == b" "):
                    break
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(chr(x) if x < 0x80 else "�" if 0xDC80 <= x <= 0xDCFF else chr(x) for x in map(ord, raw.decode("utf-8", "surrogateescape")))

    @functools.cached_property
    def _plain(self) -> frozenset[int]:
        """Ids whose text may begin with a space that is none of the model's own."""
        return frozenset([self.unknown, *(self.bytes.tolist() if self.has_bytes else [])])


@functools.lru_cache(2)
def load(path: str) -> Sentences:
    with open(path, "rb") as f:
        return Sentences(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids``, ``begins`` and ``ends`` (bytes of the UTF-8 original) array<int>, and ``decoded`` string."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for batch in slices(batches):
            coded = model.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in coded)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in coded]).astype(np.int32))) for k in range(3)]
            decoded = pa.array([model.decode(x[0].tolist()) for x in coded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, decoded], ["id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)
