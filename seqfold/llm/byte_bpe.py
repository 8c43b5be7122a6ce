"""Byte-level BPE: exact encoding in linear time, and decoding.

Bytes map to Latin-1 characters, so that one automaton bounds the
longest vocabulary entry at every place of a piece. A sequence of tokens is the BPE encoding exactly if each adjacent pair is the encoding of its own
bytes; the encoder takes the longest entry that is compatible with the token before it and steps back
where none is. As a prefix has one encoding only, a place that failed once is never entered again.
The compatibility of pairs and the encoding of whole pieces are memoised, in bounded dictionaries.

Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows give equal
results; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.llm.storage import unused

MEMO = 200_000  # units that a worker keeps at most; pairs of tokens, which are smaller, eight times as many
_UNITS = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall


class Memo:
    """A dictionary of two generations, bounded by entries: when the young one is full it becomes the old one, which is dropped.

    What is asked for again moves to the young one, so frequent keys stay."""

    def __init__(self, entries: int = MEMO):
        self.half, self.young, self.old = max(1, entries // 2), {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.ids = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.width = max(map(len, self.ids))
        self.entries = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.entries.add_word(b, i)
        self.entries.make_automaton()
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.shorter: dict[int, int] = {}  # the longest entry that begins a token, -1 for none
        self.heads: dict[str, int] = {}  # the longest entry that begins a path of the automaton: as many keys as it has places
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs = Memo(8 * MEMO)
        self.units = Memo()

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            raw = self.bytes[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, put together, are encoded as a, b.

        Goes back in time: undoes the later of the merges beside the boundary, and fails if the two tokens
        that then meet there would have merged before what was undone."""
        x, y, before = a, b, 1 << 60
        while True:
            across = self.ranks.get(self.bytes[x] + self.bytes[y])
            if across is not None and across < before:
                return False
            hx, hy = self.last_merge(x), self.last_merge(y)
            if hx and (x > y or not hy):
                before, x = x, hx[1]
            elif hy:
                before, y = y + 1, hy[0]  # at equal rank the left one, across the boundary, comes first
            else:
                return True

    def head(self, text: str) -> int:
        """The longest entry that begins text, -1 for none."""
        ids = self.ids
        for n in range(len(text), 0, -1):
            token = ids.get(text[:n])
            if token is not None:
                return token
        return -1

    def next_shorter(self, token: int) -> int:
        """The longest other entry that begins token, -1 for none."""
        less = self.shorter.get(token)
        if less is None:
            less = self.shorter[token] = self.head(self.bytes[token][:-1].decode("latin-1"))
        return less

    def follower(self, last: int, token: int) -> int:
        """The longest of token and the entries that begin it that is compatible behind last, -1 for none; memoised."""
        key = last << 24 | token
        found = self.pairs.get(key)
        if found is None:
            found = token
            while found >= 0 and not self.compatible(last, found):
                found = self.next_shorter(found)
            self.pairs.put(key, found)
        return found

    def piece(self, raw: bytes) -> bytes:
        """The tokens of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, sys.byteorder)
        text, heads, known, sizes, width, longest = raw.decode("latin-1"), self.heads, self.pairs.young, self.size, self.width, self.entries.longest_prefix
        n, at, last, out, failed = len(text), 0, -1, [], None
        while True:
            rest = text[at : at + width]
            path = rest[: longest(rest)]
            token = heads.get(path)
            if token is None:
                token = heads[path] = self.head(path)
            while True:  # the longest entry that fits between last and a place that has not failed
                if last >= 0 and token >= 0:
                    found = known.get(last << 24 | token)
                    token = self.follower(last, token) if found is None else found
                if token >= 0:
                    if failed is None or at + sizes[token] not in failed:
                        break
                    token = self.next_shorter(token)
                    continue
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                if failed is None:
                    failed = set()
                failed.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = self.next_shorter(token)
            out.append(token)
            at += sizes[token]
            if at == n:
                return array("I", out).tobytes()
            last = token

    def part(self, text: str) -> bytes:
        """piece, kept for the next time if it is short."""
        got = self.units.get(text)
        if got is None:
            got = self.piece(text.encode("utf-8"))
            if len(text) <= 64:
                self.units.put(text, got)
        return got

    def unit(self, text: str) -> bytes:
        """The ids of a white space run or of a visible one, kept for the next time if it is short."""
        got = self.units.get(text)
        if got is None:
            parts = self.find(text)
            got = b"".join([self.part(p) for p in parts]) if len(parts) > 1 else self.piece(text.encode("utf-8"))
            if len(text) <= 64:
                self.units.put(text, got)
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order.

        No match of the pattern goes over from visible characters to white space or has more than one space before
        them, so the text is cut there, and the encodings of the short units, most of them words, are memoised."""
        if not text:
            return b""
        known, unit = self.units.young, self.unit
        return b"".join([known.get(u) or unit(u) for u in _UNITS(text)])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    """A tokenizer from a file of lines "base64(bytes) rank"; each Python worker keeps its own."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids, an array<long> of token ids."""

    @F.arrow_udf("array<bigint>")
    def ids(text: pa.Array) -> pa.Array:
        bpe = load(path, pattern)
        coded = [bpe.encode(t.as_py()) for t in text]
        sizes = np.cumsum([0, *(len(c) // 4 for c in coded)])
        return pa.ListArray.from_arrays(sizes.astype(np.int32), np.frombuffer(b"".join(coded), np.uint32).astype(np.int64))

    return docs.withColumn("ids", ids(F.col(text_col)))


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """coded with decoded, the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        bpe = load(path, pattern)
        return pa.array([bpe.decode(x or ()) for x in ids.to_pylist()], pa.binary())

    return coded.withColumn("decoded", raw(F.col(ids_col)))


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256, without ids leaving the task."""

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def summary(text: pa.Array) -> pa.Array:
        bpe, n, coded, raw = load(path, pattern), [], [], []
        for t in text:
            ids = np.frombuffer(bpe.encode(t.as_py()), np.uint32)
            n.append(len(ids))
            coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            raw.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(raw, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    (digest,) = unused(docs, "digest")
    done = docs.withColumn(digest, summary(F.col(text_col)))
    return done.withColumns({c: F.col(digest)[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(digest)
