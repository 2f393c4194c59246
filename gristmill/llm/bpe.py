"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For each prefix of a piece's bytes there is exactly one token that ends the prefix's encoding (its last token): the
one whose left neighbour is the last token of the prefix before it and which merging could not have joined otherwise.
Storing that token per prefix gives any prefix's encoding by walking back; an append only adds entries, and an edit
keeps all entries before it (`PrefixEncoding`). Whole texts are split into pieces in numpy by the character classes
of the usual pattern, pieces are dictionary-encoded by Arrow, and each different piece is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at once, and the pieces and pairs that a worker remembers.
SLICE, PIECES, PAIRS = 1 << 20, 400_000, 2_000_000
_NONE = 1 << 62
#: Longest piece (bytes) that is encoded together with others.
WIDE = 48
_BASE, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WIDE, _BASE)]), dtype=np.uint64)


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class _Table:
    """64-bit keys (not 0) to numbers, looked up many at once: open addressing, linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, _NONE)
        for k, v, at in zip(keys, values, self._slot(keys).tolist(), strict=True):
            while self.keys[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, _NONE where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], _NONE)
        on = np.flatnonzero((there != keys) & (there != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (there != 0)]
        return out


class Vocabulary:
    """Ranks of a byte-level BPE (a tiktoken file). Rank order is merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.dead: set[int] = set()
        for i in sorted(self.tokens):
            self._learn(i)
        self.live = {b: i for b, i in ranks.items() if i not in self.dead}
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.left, self.right = (np.array([self.split.get(i, (i, i))[k] for i in range(size)], np.int64) for k in (0, 1))
        self.by_hash = _Table(np.array([_hash(b) for b in self.live], np.uint64), np.array(list(self.live.values()), np.int64))
        pairs = np.array([*self.joined] or [(0, 0)], np.uint64)
        self.by_pair = _Table(pairs[:, 0] << np.uint64(32) | pairs[:, 1] | _MARK, np.array([*self.joined.values()] or [_NONE], np.int64))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _learn(self, i: int) -> None:
        """Finds the two tokens whose merge makes token i; a token that no merge makes can only stand for a whole piece."""
        token = self.tokens[i]
        if len(token) > 1:
            parts = merge(token, self.ranks, i)
            if len(parts) == 2:
                self.split[i] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = i
                return
            self.dead.add(i)
        self.split[i] = (i, i)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a, b as they are where a ends and b begins."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        limit, x, y, joined, split = _NONE, a, b, self.joined, self.split
        while True:
            if joined.get((x, y), _NONE) < limit:
                ok = False
                break
            if x > y:
                limit, x = x, split[x][1]
                if x == limit:
                    limit, y = y + 1, split[y][0]
                    if y + 1 == limit:
                        ok = True
                        break
            else:
                limit, y = y + 1, split[y][0]
                if y + 1 == limit:
                    limit, x = x, split[x][1]
                    if x == limit:
                        ok = True
                        break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i] is the token that ends the encoding of data[:i + 1]; entries that are given are kept and added to."""
        last = [] if last is None else last
        live, compatible, longest = self.live, self.compatible, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = live.get(data[start:end])
                if token is not None and (start == 0 or compatible(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        out.reverse()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        get = self.pieces.get
        out = [get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.pieces) + len(new) > PIECES:
            self.pieces.clear()
        new.sort(key=lambda i: len(pieces[i]))
        for begin in range(0, len(new), 4096):
            part = new[begin : begin + 4096]
            while part and len(pieces[part[-1]]) > WIDE:
                i = part.pop()
                whole = self.ranks.get(pieces[i])
                out[i] = np.array([whole] if whole is not None else self.walk(self.last_tokens(pieces[i])), "<u4").tobytes()
            for i, ids in zip(part, self._together([pieces[i] for i in part]), strict=True):
                out[i] = self.pieces[pieces[i]] = ids
        return out

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """last_tokens() and walk() of many short pieces at once: a row each, one prefix length after another."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        wide = int(sizes.max())
        data = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        sums = np.zeros((len(pieces), wide + 1), np.uint64)
        for i in range(wide):
            sums[:, i + 1] = sums[:, i] * _BASE + data[:, i] + np.uint64(1)
        last = np.full((len(pieces), wide + 1), -1, np.int64)
        for end in range(1, wide + 1):
            low = int(np.searchsorted(sizes, end))  # pieces are in order of length
            from_ = max(0, end - self.longest)
            hashes = sums[low:, end : end + 1] - sums[low:, from_:end] * _POWERS[end - from_ : 0 : -1]
            rows, starts = np.divmod(np.arange(hashes.size), end - from_)
            tokens = self.by_hash.find(hashes.ravel())
            found = np.flatnonzero(tokens < _NONE)
            rows, starts, tokens = rows[found] + low, starts[found] + from_, tokens[found]
            fits = starts == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self._compatible(last[rows[inner], starts[inner]], tokens[inner])
            last[rows[fits], end] = tokens[fits]
        at, tokens, left = sizes.copy(), np.zeros((len(pieces), wide), "<u4"), np.full(len(pieces), wide)
        rows = np.arange(len(pieces))
        # a piece that is a token is that token, merged or not
        whole = np.array([self.ranks.get(p, -1) for p in pieces])
        last[rows[whole >= 0], sizes[whole >= 0]] = whole[whole >= 0]
        while len(rows):
            token = last[rows, at[rows]]
            if (token < 0).any():
                raise ValueError("no token ends at a byte of " + repr(pieces[int(rows[token < 0][0])]))
            left[rows] -= 1
            tokens[rows, left[rows]] = token
            at[rows] -= self.lengths[token]
            rows = rows[at[rows] > 0]
        return [tokens[i, left[i] :].tobytes() for i in range(len(pieces))]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs. No pair with -1 fits."""
        ok = a >= 0
        at = np.flatnonzero(ok)
        x, y, limit = a[at], b[at], np.full(len(at), _NONE)
        while len(at):
            joined = self.by_pair.find(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64) | _MARK) < limit
            ok[at[joined]] = False
            nx, ny = self.right[x], self.left[y]
            go_x = (nx != x) & ((x > y) | (ny == y))
            go_y = ~go_x & (ny != y)
            limit = np.where(go_x, x, y + 1)
            x, y = np.where(go_x, nx, x), np.where(go_y, ny, y)
            on = (go_x | go_y) & ~joined
            at, x, y, limit = at[on], x[on], y[on], limit[on]
        return ok

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by one gather over the vocabulary's bytes."""
        return ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def merge(data: bytes, ranks: dict[bytes, int], below: int = _NONE) -> list[int]:
    """Plain BPE: joins the adjacent pair of lowest rank until none is left. Slow; for tables and tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PrefixEncoding:
    """The encoding of one growing or changing piece. append() and replace() work from the first changed byte on."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = vocabulary.last_tokens(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Replaces data[start:end]; what merging made of the bytes before start stays as stored."""
        self.data = self.data[:start] + by + self.data[end:]
        del self.last[start:]
        self.vocabulary.last_tokens(self.data, self.last)

    def ids(self, length: int | None = None) -> list[int]:
        """Of the whole, or of the prefix of that many bytes."""
        return self.vocabulary.walk(self.last if length is None else self.last[:length])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0]:starts[0] + lengths[0]], then those of the next, and so on, as one array."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


_L, _N, _S, _O = 1, 2, 3, 4
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.array([{"L": _L, "N": _N}.get(unicodedata.category(chr(c))[0], _O) for c in range(sys.maxunicode + 1)], np.uint8)
    table[_SPACES] = _S
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where a match of the pattern begins:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    points: code points of texts one after another; first: True where a text begins.
    """
    n = len(points)
    kind = _classes()[points]
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= first  # a run of one class begins
    start = turn.copy()
    space = kind == _S
    # a single space right before a run of another class belongs to that run
    plain = points == 32
    joins = np.zeros(n, bool)
    joins[1:] = turn[1:] & ~first[1:] & plain[:-1] & ~space[1:]
    start[joins] = False
    # the last of several white-space characters before a run stands apart
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= before
    # contractions: an apostrophe at which a match begins
    for at in np.flatnonzero((points == 39) & start & turn).tolist():
        for suffix in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            end = at + 1 + len(suffix)
            if end <= n and points[at + 1 : end].tolist() == list(suffix) and not first[at + 1 : end].any():
                start[at + 1] = False
                if end < n and kind[end] == _L and not first[end]:
                    start[end] = True
                break
    return start


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each text."""
    whole = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not whole:
        return [np.zeros(0, "<u4") for _ in texts]
    data = whole.encode()
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(len(points), bool)
    first[begins[sizes > 0]] = True
    at = np.flatnonzero(piece_starts(points, first))
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    offsets = np.append(place[at], len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    encoded = vocabulary.encode_pieces(pieces.dictionary.to_pylist())
    which = pieces.indices.to_numpy()
    ids, count = np.frombuffer(b"".join(encoded), "<u4"), np.array([len(e) // 4 for e in encoded], np.int64)
    lengths = count[which]
    out = ragged(ids, (np.cumsum(count) - count)[which], lengths)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    bounds = ends[np.searchsorted(at, np.append(begins, len(points)))]
    return [out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Whole texts in order (null: empty), about SLICE characters at once. A longer text comes alone."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """The id column with the outputs asked for, of ids (array<long>), n_tokens, ids_sha256 and decoded_sha256.

    Pieces are encoded separately and without special tokens. A null text counts as empty: no ids. Repeated rows give
    repeated results; further columns are left. path must be readable on the executors.
    """
    kinds = {"ids": ("array<bigint>", pa.list_(pa.int64())), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in outputs}
            for part in _slices(batch.column(1).to_pylist()):
                for ids in encode_texts(part, v):
                    for k in outputs:
                        if k == "ids":
                            out[k].append(ids.astype(np.int64))
                        elif k == "n_tokens":
                            out[k].append(len(ids))
                        elif k == "ids_sha256":
                            out[k].append(hashlib.sha256(ids.tobytes()).hexdigest())
                        else:
                            out[k].append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], kinds[k][1]) for k in outputs)], [id_col, *outputs])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_kind}, " + ", ".join(f"{k} {kinds[k][0]}" for k in outputs))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and `decoded`, the bytes (binary) of its ids. Null ids: no bytes."""
    id_kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            data = [v.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_kind}, decoded binary")
