"""Byte-level BPE encoding and decoding over whole texts.

Encoding: within a pre-token the symbols form a doubly linked list, and the mergeable
pairs wait in a priority queue by merge rank, then position. An entry whose symbols have
meanwhile merged is stale and skipped. Decoding concatenates vocabulary strings.

Texts go through Arrow batches on the executors; the vocabulary is read once per Python
worker. Natural text repeats its words, so each worker keeps the ids of what it has seen
between two spaces in a memo of two generations, each of bounded size.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of one generation of a memo.
MEMO_ENTRIES = 500_000
#: Marks that make one token of their own after letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pair keys and queue entries are packed into one integer each.
_SHIFT, _LOW = 32, (1 << 32) - 1


def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Unsafe(Exception):
    """A piece between two spaces whose tokens may depend on its neighbours."""


class _Memo(dict):
    """Text between two spaces -> its ids as little-endian unsigned 32-bit bytes.

    When full, it becomes the old generation; what is asked for again moves back.
    """

    def __init__(self, codec: Bpe, lead: str):
        super().__init__()
        self.codec, self.lead, self.old = codec, lead, {}

    def __missing__(self, piece: str) -> bytes:
        head = piece.rstrip(MARKS)
        if len(head) < len(piece) and head.isalpha():  # letters, then a run of marks: no entry of its own
            return self[head] + self.codec.marks(piece[len(head) :])
        if (out := self.old.get(piece)) is None:
            if not piece or piece[0].isspace() or piece[-1].isspace() or self.codec.has_special(piece):
                raise _Unsafe
            head, line, tail = piece.partition("\n")
            if line and not head[-1].isspace() and not tail[0].isspace():
                return self[head] + self.codec.marks(line) + self.codec.first[tail]
            out = self.codec.encode_plain(self.lead + piece, piece.isalpha())
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(of[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in of for c in s)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        for s in self.special:
            vocab.pop(s.encode(), None)
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        #: A pair of ids -> its rank; a rank -> the id made.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for m in spec["model"]["merges"]:
            x, y = (raw(s) for s in (m.split(" ") if isinstance(m, str) else m))
            self.ranks.setdefault(vocab[x] << _SHIFT | vocab[y], len(self.made))
            self.made.append(vocab[x + y])
        self.strings = {i: s for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.marks = lru_cache(maxsize=10_000)(self.encode_plain)
        self.first, self.rest = _Memo(self, ""), _Memo(self, " ")

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        sym = [self.byte_ids[b] for b in token]
        n, rank, made = len(sym), self.ranks.get, self.made
        queue = [r << _SHIFT | i for i in range(n - 1) if (r := rank(sym[i] << _SHIFT | sym[i + 1])) is not None]
        if not queue:
            return sym
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & _LOW, entry >> _SHIFT
            x, j = sym[i], after[i]
            if x < 0 or j >= n or rank(x << _SHIFT | sym[j]) != r:
                continue  # stale: a neighbour has merged meanwhile
            new = sym[i] = made[r]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << _SHIFT | sym[k])) is not None:
                    heapq.heappush(queue, r << _SHIFT | i)
            h = before[i]
            if h >= 0 and (r := rank(sym[h] << _SHIFT | new)) is not None:
                heapq.heappush(queue, r << _SHIFT | h)
        return [s for s in sym if s >= 0]

    def encode_plain(self, text: str, one: bool = False) -> bytes:
        """Text without special tokens, pre-token by pre-token; one: it is known to be a single one."""
        ids: list[int] = []
        for token in (text,) if one else self.pattern.findall(text):
            ids += self.merge(token.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit bytes.

        Where every space stands between two non-spaces, a token never reaches over
        the start of a space, so the text may be cut there. Any other text takes the
        pattern over its whole length.
        """
        if not text:
            return b""
        try:
            head, *tail = text.split(" ")
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _Unsafe:
            pass
        if not self.special_pattern:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Bpe:
    return Bpe(path)


def _batches(column: pa.Array, rows: int):
    for start in range(0, len(column), rows):
        yield column.slice(start, rows)


def encode(df: DataFrame, vocab: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of `df` with the token ids of `text` as array<int> in a new column `ids`.

    `vocab` is the path of a byte-level BPE tokenizer file that executors can read. Null
    and empty texts have no ids. A special token's string in a text becomes its id. Rows,
    order and other columns stay; ties do not arise. A column named `ids` is replaced.
    """

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        bpe, offsets, parts = codec(vocab), [0], []
        for piece in _batches(texts, 256):
            for t in piece.to_pylist():
                parts.append(bpe.encode(t or ""))
                offsets.append(offsets[-1] + len(parts[-1]) // 4)
        flat = np.frombuffer(b"".join(parts), "<u4").astype("i4", copy=False)
        return pa.ListArray.from_arrays(pa.array(np.array(offsets, "i4")), pa.array(flat))

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, vocab: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row of `df` with the text of `ids` in a new column; null ids give an empty text, and a column of that name is replaced."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        bpe = codec(vocab)
        return pa.array([bpe.decode(x.values.to_numpy()) if x.is_valid and len(x.values) else "" for x in lists], pa.string())

    return df.withColumn(text, run(F.col(ids)))


def little_endian(ids: str = "ids"):
    """array<int> -> its bytes as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b"" for x in lists], pa.binary())

    return run(F.col(ids))
