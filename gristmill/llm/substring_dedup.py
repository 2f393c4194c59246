"""Substring deduplication over windows of words, with a count-min prefilter.

1. Documents are spread by id and text over chunks of bounded size. Each chunk makes a sparse count-min sketch of its
   windows: per row, the sorted cells that it touches, and those it touches twice (counters that stop at 2).
2. The sketches of all chunks are merged by range of cells; each chunk gets back those of its own cells whose merged
   count is 2 or more. A count-min estimate is never too low, so no repeated window is lost.
3. A second pass groups only the windows whose estimate says repeated in every row, by 128 bits of BLAKE2b over their
   words: a chunk sends the first of its equal windows, and learns which of them begin earlier elsewhere.
4. Words under a window that also begins earlier are removed.

The sketch has CELLS cells for each window, whatever the size of the input, so the share of wrongly kept candidates
stays; its parts are never gathered in one place. A window that a third of all documents hold costs one entry a chunk.
The texts are shuffled once: the passes over the chunks share one exchange.

Both merges go up a ladder: a chunk cuts what it sends into at most 2^FANOUT_BITS ranges, as many chunks again are
merged within a range, the result is cut further, and so on until a range holds the chunks of the whole input; the
answers come down the same steps. So rows and bytes exchanged grow in proportion to the chunks (times the steps, one
up to some 190 chunks, four at 10^7), not with chunks x ranges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import LONG_MAX, WHOLE, others
from gristmill.llm._words import buffers, window_hashes, word_bounds, word_hashes

CHUNK_BYTES = 6 << 20
#: Sketch: rows, and cells of a row for each word of the input.
ROWS, CELLS = 2, 16
#: A sender cuts what it sends into at most 2^FANOUT_BITS ranges.
FANOUT_BITS = 6
#: Digests that are worked out at once.
SLAB = 1 << 14


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed; small if the high bytes seldom change."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each value is in found (sorted): first by a table of low bits, then by search."""
    out = np.zeros(len(values), bool)
    if not len(found) or not len(values):
        return out
    table = np.zeros(1 << 22, bool)
    table[(found & found.dtype.type(len(table) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values & values.dtype.type(len(table) - 1)).astype(np.int64)])
    at = np.searchsorted(found, values[maybe])
    at[at == len(found)] = 0
    out[maybe] = found[at] == values[maybe]
    return out


def ladder(chunks: int, bits: int | None = None) -> list[int]:
    """Bits of the range that each step takes, about a range for every three chunks in the end."""
    bits = FANOUT_BITS if bits is None else bits
    total = max(0, math.ceil(math.log2(max(1, chunks / 3))))
    steps = max(1, -(-total // bits))
    return [total // steps + (i < total % steps) for i in range(steps)]


def cut_sorted(values: np.ndarray, low: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted values by the `bits` bits above the lowest `low`; empty ones are left out."""
    digits = (values >> np.uint64(low)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    ends = np.searchsorted(digits, np.arange(1 << bits), side="right").tolist()
    begin = 0
    for digit, end in enumerate(ends):
        if end > begin:
            yield digit, slice(begin, end)
        begin = end


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Chunk:
    """The documents of a chunk in a fixed order (id, null last; then digests of the text), and their windows."""

    def __init__(self, table: pa.Table, size: int, ordered: bool = True):
        self.size = size
        ids = table["__own"].to_numpy()
        data, at = buffers(table["__text"])
        texts = [data[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]
        if not ordered:
            self.words = [t.split() for t in texts]
            self.first = np.cumsum([0, *map(len, self.words)])
            return
        digests = [hashlib.sha256(t).digest() for t in texts]
        tie = np.frombuffer(b"".join(d[:4] for d in digests), ">u4").astype(np.uint32)
        order = np.lexsort((tie, ids))
        if (~runs([ids[order], tie[order]])).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], digests[i])), np.int64)
        self.order, self.ids, self.tie = order, ids[order], tie[order]
        self.words = [texts[i].split() for i in order]
        self.first = np.cumsum([0, *map(len, self.words)])

    def windows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The words at which a window within a document begins, and ROWS hashes of each."""
        self.whole = b"\n".join(b" ".join(w) for w in self.words)
        data = np.frombuffer(self.whole, np.uint8)
        self.begins, self.ends = word_bounds(data)
        hashes = word_hashes(data)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(len(last)) + self.size <= last)
        return at, [window_hashes(hashes, self.size, r)[at] if len(at) else np.zeros(0, np.uint64) for r in range(ROWS)]

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a BLAKE2b digest of the words of the windows that begin there (after windows())."""
        whole, blake, out = self.whole, hashlib.blake2b, []
        for i in range(0, len(at), SLAB):
            part = at[i : i + SLAB]
            ends = self.ends[part + self.size - 1].tolist()
            out.append(b"".join([blake(whole[s:e], digest_size=16).digest() for s, e in zip(self.begins[part].tolist(), ends, strict=True)]))
        halves = np.frombuffer(b"".join(out), "<u8").reshape(-1, 2) if out else np.zeros((0, 2), np.uint64)
        return halves[:, 0], halves[:, 1]


SKETCH = pa.schema([("row", pa.int32()), ("grp", pa.int64()), ("prefix", pa.int64()), ("sender", pa.int64()), ("cells", pa.binary()), ("more", pa.binary())])
HOT = pa.schema([("row", pa.int32()), ("grp", pa.int64()), ("prefix", pa.int64()), ("digit", pa.int32()), ("cells", pa.binary())])
ENTRY = pa.schema([("grp", pa.int64()), ("prefix", pa.int64()), ("sender", pa.int64()), *((c, pa.binary()) for c in ("key", "key2", "id", "tie", "at"))])
LATE = pa.schema([("grp", pa.int64()), ("prefix", pa.int64()), ("digit", pa.int32()), ("at", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


class Steps:
    """The ladder of both merges: for step s (from 0), the bits it takes and all that were taken before."""

    def __init__(self, chunks: int, cell_bits: int):
        self.bits, self.cell_bits = ladder(chunks), cell_bits

    @property
    def top(self) -> int:
        return len(self.bits) - 1

    def taken(self, step: int) -> int:
        return sum(self.bits[: step + 1])

    def group(self, step: int, sender: int) -> int:
        """Where a sender's pieces of this step are merged; on the top step all senders meet."""
        return 0 if step == self.top else sender >> self.bits[step]

    def kind(self, step: int) -> type:
        return np.uint32 if self.cell_bits - self.taken(step) <= 32 else np.uint64

    # the sketch

    def sketch_pieces(self, step: int, row: int, sender: int, prefix: int, cells: np.ndarray, more: np.ndarray) -> list[tuple]:
        """Sorted cells (without the bits of the prefix) cut for this step."""
        low, bits, kind = self.cell_bits - self.taken(step), self.bits[step], self.kind(step)
        mask = np.uint64((1 << low) - 1)
        twice = dict(cut_sorted(more, low, bits))
        out = []
        for digit, at in cut_sorted(cells, low, bits):
            again = more[twice[digit]] if digit in twice else more[:0]
            packed = (pack_sorted((x & mask).astype(kind)) for x in (cells[at], again))
            out.append((row, self.group(step, sender), (prefix << bits) | digit, sender, *packed))
        return out

    def merge_cells(self, step: int, table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The cells of each piece; all different ones, sorted; and those counted twice or more."""
        kind = self.kind(step)
        cells = [unpack_sorted(x, kind) for x in table["cells"].to_pylist()]
        more = [unpack_sorted(x, kind) for x in table["more"].to_pylist()]
        every = np.sort(np.concatenate(cells), kind="stable")
        new = runs([every])
        twice = np.unique(np.concatenate([every[~new], *more]))
        return cells, every[new], twice

    def sketch_up(self, step: int, table: pa.Table) -> pa.Table:
        """Pieces of a group merged and cut for the next step."""
        _, every, twice = self.merge_cells(step, table)
        row, group, prefix = (table[c][0].as_py() for c in ("row", "grp", "prefix"))
        return rows_table(self.sketch_pieces(step + 1, row, group, prefix, every.astype(np.uint64), twice.astype(np.uint64)), SKETCH)

    def hot_of(self, step: int, table: pa.Table, hot: np.ndarray) -> pa.Table:
        """For each sender, those of its cells that are hot (sorted)."""
        kind, bits = self.kind(step), self.bits[step]
        cells = [unpack_sorted(x, kind) for x in table["cells"].to_pylist()]
        sizes = np.cumsum([0, *map(len, cells)])
        kept = member(np.concatenate(cells), hot) if cells else np.zeros(0, bool)
        row, prefix = table["row"][0].as_py(), table["prefix"][0].as_py()
        out = []
        for sender, c, begin, end in zip(table["sender"].to_pylist(), cells, sizes[:-1].tolist(), sizes[1:].tolist(), strict=True):
            mine = c[kept[begin:end]]
            if len(mine):
                out.append((row, sender, prefix >> bits, prefix & ((1 << bits) - 1), pack_sorted(mine)))
        return rows_table(out, HOT)

    def hot_top(self, step: int, table: pa.Table) -> pa.Table:
        return self.hot_of(step, table, self.merge_cells(step, table)[2])

    def joined(self, step: int, hot: pa.Table) -> np.ndarray:
        """The hot cells that came back for a group, without the bits of its prefix, sorted."""
        low, kind = self.cell_bits - self.taken(step), self.kind(step)
        parts = sorted((d, unpack_sorted(x, kind)) for d, x in zip(hot["digit"].to_pylist(), hot["cells"].to_pylist(), strict=True))
        return np.concatenate([(np.uint64(d) << np.uint64(low)) | x.astype(np.uint64) for d, x in parts]) if parts else np.zeros(0, np.uint64)

    def hot_down(self, step: int, table: pa.Table, hot: pa.Table) -> pa.Table:
        if not table.num_rows or not hot.num_rows:
            return HOT.empty_table()
        return self.hot_of(step, table, self.joined(step + 1, hot).astype(self.kind(step)))

    # the exact groups

    def entry_pieces(self, step: int, sender: int, prefix: int, key: np.ndarray, rest: list[np.ndarray | None]) -> list[tuple]:
        """Entries in order of their key, cut for this step."""
        bits, before = self.bits[step], self.taken(step) - self.bits[step]
        own = key & np.uint64((1 << (64 - before)) - 1) if before else key
        return [(self.group(step, sender), (prefix << bits) | digit, sender, pack_sorted(key[at]), *(None if x is None else pack(x[at]) for x in rest)) for digit, at in cut_sorted(own, 64 - self.taken(step), bits)]

    @staticmethod
    def merge_entries(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Columns of all pieces; the order by key, id, tie and sender; which are first of their key; the piece, and the place in it, of each."""
        table = table.take(pc.sort_indices(table["sender"]))
        kinds = (("key", np.uint64), ("key2", np.uint64), ("id", np.int64), ("tie", np.uint32))
        parts = [[unpack(x, k) for x in table[n].to_pylist()] for n, k in kinds]
        parts[0] = [np.cumsum(k, dtype=np.uint64) for k in parts[0]]
        sizes = [len(k) for k in parts[0]]
        columns = [np.concatenate(p) for p in parts]
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        again = np.zeros(len(key), bool)  # only runs of equal keys need the further columns
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        at = np.flatnonzero(again)
        tied = order[at]
        order[at] = tied[np.lexsort((of[tied], columns[3][tied], columns[2][tied], columns[1][tied], columns[0][tied]))]
        return columns, order, runs([columns[0][order], columns[1][order]]), of, place

    def entries_up(self, step: int, table: pa.Table) -> pa.Table:
        """The first of each key in a group goes on to the next step."""
        table = table.filter(pc.is_valid(table["key"]))
        if not table.num_rows:
            return ENTRY.empty_table()
        columns, order, first, _, _ = self.merge_entries(table)
        kept = order[first]
        group, prefix = table["grp"][0].as_py(), table["prefix"][0].as_py()
        return rows_table(self.entry_pieces(step + 1, group, prefix, columns[0][kept], [*(c[kept] for c in columns[1:]), None]), ENTRY)

    def late_of(self, step: int, table: pa.Table, back: pa.Table | None) -> pa.Table:
        """For each sender its entries that begin earlier elsewhere: their places in the document chunk (step 0) or in the piece sent."""
        bits = self.bits[step]
        passed = table.filter(pc.is_null(table["key"]))
        out = [(s, 0, 0, x) for s, x in zip(passed["sender"].to_pylist(), passed["at"].to_pylist(), strict=True)]
        table = table.filter(pc.is_valid(table["key"]))
        if table.num_rows:
            table = table.take(pc.sort_indices(table["sender"]))
            columns, order, first, of, place = self.merge_entries(table)
            late = ~first
            if back is not None and back.num_rows:
                # what was sent on, in its order; the next step cut it into ranges
                sent = np.flatnonzero(first)
                own = columns[0][order[sent]]
                digits = ((own >> np.uint64(64 - self.taken(step + 1))) & np.uint64((1 << self.bits[step + 1]) - 1)).astype(np.int64) if self.bits[step + 1] else np.zeros(len(own), np.int64)
                for digit, x in zip(back["digit"].to_pylist(), back["at"].to_pylist(), strict=True):
                    late[sent[np.searchsorted(digits, digit) + unpack_sorted(x, np.uint32).astype(np.int64)]] = True
            gone = order[late]
            gone = gone[np.argsort(of[gone], kind="stable")]
            prefix, senders, ats = table["prefix"][0].as_py(), table["sender"].to_pylist(), table["at"].to_pylist()
            edges = np.searchsorted(of[gone], np.arange(len(senders) + 1))
            for i, sender in enumerate(senders):
                mine = place[gone[edges[i] : edges[i + 1]]]
                if len(mine):
                    where = unpack(ats[i], np.uint32)[mine] if step == 0 else mine.astype(np.uint32)
                    out.append((sender, prefix >> bits, prefix & ((1 << bits) - 1), pack_sorted(np.sort(where))))
        return rows_table(out, LATE)

    def late_top(self, step: int, table: pa.Table) -> pa.Table:
        return self.late_of(step, table, None)

    def late_down(self, step: int, table: pa.Table, back: pa.Table) -> pa.Table:
        return self.late_of(step, table, back) if table.num_rows else LATE.empty_table()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with its text less the repeated words, kept words joined by one space, and n_words, n_removed (long).

    A word goes if a window of `window` words over it also begins earlier: at a smaller id, or earlier in the same
    document. Windows are judged on the input. Null or empty text: no words, an empty text. A null id comes last;
    rows that share an id come in the order of a digest of their texts, and may lie in different chunks (only rows that
    are equal in id and text never part). Ids are whole numbers, any other kind is an error. Further columns stay; an
    empty table gives an empty one. A document is never cut, so a chunk is as large as its longest one.
    """
    if docs.schema[id_col].dataType.simpleString() not in WHOLE:
        raise TypeError(f"{id_col} must be a whole number")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    cell_bits = min(62, max(sum(ladder(chunks)) + 8, math.ceil(math.log2(max(2, total / 6 * CELLS)))))
    steps = Steps(chunks, cell_bits)
    names = others(docs, "n_words", "n_removed")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MAX))
    chunked = docs.select(*names, own.alias("__own"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).drop(text_col)
    chunked = chunked.withColumn("__chunk", F.pmod(F.xxhash64("__own", "__text"), F.lit(chunks)).cast("long"))
    by_chunk = lambda: chunked.groupBy("__chunk")

    def sketch(table: pa.Table) -> pa.Table:
        chunk, out = table["__chunk"][0].as_py(), []
        for r, h in enumerate(Chunk(table, window, ordered=False).windows()[1]):
            cells = np.sort(h >> np.uint64(64 - cell_bits))
            new = runs([cells])
            out += steps.sketch_pieces(0, r, chunk, 0, cells[new], np.unique(cells[~new]))
        return rows_table(out, SKETCH)

    def exact(table: pa.Table, counted: pa.Table) -> pa.Table:
        """The first of the chunk's equal windows among those estimated repeated; with key null, places that come later in the chunk."""
        out = []
        if table.num_rows and counted.num_rows:
            chunk = table["__chunk"][0].as_py()
            c = Chunk(table, window)
            at, hashes = c.windows()
            keep = np.arange(len(at))
            for r, h in enumerate(hashes):
                found = steps.joined(0, counted.filter(pc.equal(counted["row"], r)))
                keep = keep[member(h[keep] >> np.uint64(64 - cell_bits), found)]
            at = at[keep]
            key, key2 = c.digests(at)
            order = np.lexsort((at, key2, key))
            key, key2, at = key[order], key2[order], at[order]
            new = runs([key, key2])
            later = np.sort(at[~new]).astype(np.uint32)
            if len(later):
                out.append((steps.group(0, chunk), chunk & ((1 << steps.bits[0]) - 1), chunk, None, None, None, None, pack_sorted(later)))
            key, key2, at = key[new], key2[new], at[new]
            doc = np.searchsorted(c.first, at, side="right") - 1
            out += steps.entry_pieces(0, chunk, 0, key, [key2, c.ids[doc], c.tie[doc], at.astype(np.uint32)])
        return rows_table(out, ENTRY)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out_schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "n_words bigint", "n_removed bigint"])

    def cut(table: pa.Table, late: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([*(table["__text" if n == text_col else n] for n in names), pa.array([], pa.int64()), pa.array([], pa.int64())], [*names, "n_words", "n_removed"])
        c = Chunk(table, window)
        gone = np.zeros(c.first[-1] + 1, np.int32)
        for x in late["at"].to_pylist():
            at = unpack_sorted(x, np.uint32).astype(np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        kept = np.cumsum(gone)[:-1] == 0
        texts, removed = [], []
        for i, words in enumerate(c.words):
            mask = kept[c.first[i] : c.first[i + 1]]
            removed.append(len(mask) - int(mask.sum()))
            texts.append(b" ".join(compress(words, mask.tolist()) if removed[-1] else words).decode())
        table = table.take(pa.array(c.order))
        columns = [pa.array(texts, pa.string()) if n == text_col else table[n] for n in names]
        return pa.Table.from_arrays([*columns, pa.array(np.diff(c.first), pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    late = _late_places(by_chunk, _hot_cells(by_chunk, sketch, steps), exact, steps)
    return by_chunk().cogroup(late.groupBy("grp")).applyInArrow(cut, out_schema)


def _at(step: int, f: Callable) -> Callable:
    """f at a step, as a function of one table (Spark counts a function's parameters)."""
    return lambda table: f(step, table)


def _at2(step: int, f: Callable) -> Callable:
    return lambda table, back: f(step, table, back)


def _hot_cells(by_chunk, sketch, steps: Steps) -> DataFrame:
    """Up the ladder with the sketches and down with the cells counted twice; grp is the chunk."""
    keys = ("row", "grp", "prefix")
    pieces = [by_chunk().applyInArrow(sketch, ddl(SKETCH))]
    for step in range(steps.top):
        pieces.append(pieces[-1].groupBy(*keys).applyInArrow(_at(step, steps.sketch_up), ddl(SKETCH)))
    hot = pieces[-1].groupBy(*keys).applyInArrow(_at(steps.top, steps.hot_top), ddl(HOT))
    for step in reversed(range(steps.top)):
        both = pieces[step].groupBy(*keys).cogroup(hot.groupBy(*keys))
        hot = both.applyInArrow(_at2(step, steps.hot_down), ddl(HOT))
    return hot


def _late_places(by_chunk, hot: DataFrame, exact, steps: Steps) -> DataFrame:
    """Up the ladder with the first windows of each key and down with those that begin earlier elsewhere; grp is the chunk."""
    keys = ("grp", "prefix")
    pieces = [by_chunk().cogroup(hot.groupBy("grp")).applyInArrow(exact, ddl(ENTRY))]
    for step in range(steps.top):
        pieces.append(pieces[-1].groupBy(*keys).applyInArrow(_at(step, steps.entries_up), ddl(ENTRY)))
    late = pieces[-1].groupBy(*keys).applyInArrow(_at(steps.top, steps.late_top), ddl(LATE))
    for step in reversed(range(steps.top)):
        both = pieces[step].groupBy(*keys).cogroup(late.groupBy(*keys))
        late = both.applyInArrow(_at2(step, steps.late_down), ddl(LATE))
    return late
