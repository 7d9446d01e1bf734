"""Sum-of-squares online packing of documents into fixed windows.

Each input partition is packed on its own, in the order in which it is read, so
nothing is shuffled and a lost executor only costs its partition. For a piece
of s ids, every fill level h that some open window has is a choice, and so is a
new window; the choice that makes the sum of the squared counts N(h)**2 of
partially filled windows smallest is taken (ties: the fullest window). The
counts are one array indexed by level.

A document longer than a window is cut into whole windows and a rest; the rest
is placed. When a partition ends, the fullest windows that are open are filled
with what the emptiest hold, cut to fit, so most pieces stay where they were
placed; what the last window holds goes into windows whose sizes are the powers
of two of its length, which need no padding. Open windows keep HELD ids at most
(a partition of long rests only may never close one): beyond that, half of what
they hold is settled in the same way, and placing goes on among the others.

Ids: the tokenizer drops white space and never joins across it, so a text's ids
are those of its white-space-separated words in turn, cut further where the
tokenizer cuts; each distinct unit is encoded once per worker (`WordEncoder`). Then `END_ID` closes each document.

Defined results: a null text is empty and yields one piece with the end id; a
null doc_id passes through; repeated rows are packed once each; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._bytes import Block, Rolling, blocks, units

CAPACITY = 4096
END_ID = 2
HELD = 16_000_000
PIECE = 64
REMEMBER = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LINE = 256
_encoders: dict = {}


class WordEncoder:
    """Ids of whole texts by way of their distinct units; keeps at most REMEMBER units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _encoded(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has. plain: words of ASCII letters only, encoded by the line."""
        some, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = [" ".join(words[i] for i in some[k : k + LINE]) for k in range(0, len(some), LINE)]
        flat = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) != len(some) or len(ends) and ends[-1] + 1 != len(flat):
            some, other, flat, ends = some[:0], np.arange(len(words)), flat[:0], ends[:0]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        flat = np.concatenate([flat, np.array([i for ids in rest for i in ids], np.uint32)])
        lengths = np.concatenate([np.diff(ends, prepend=-1), np.array([len(ids) for ids in rest], np.int64)])
        order = np.argsort(np.concatenate([some, other]), kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        return flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))], lengths

    def _learn(self, keys: list[int], words: list[str], plain: np.ndarray) -> None:
        flat, lengths = self._encoded(words, plain)
        first, n = len(self.index), len(self.index) + len(keys)
        while len(self.starts) < n:
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.pool) < self.used + len(flat):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[first:n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:n] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(keys, range(first, n)))

    def encode(self, block: Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows, each row closed by end_id, and the offsets of the rows."""
        start, end, plain, data, offsets = units(block)
        inverse, keys = pd.factorize(Rolling(data).of(start, end))
        if len(self.index) + len(keys) > REMEMBER:
            self.forget()
        known, find = keys.tolist(), self.index.get
        place = np.array([find(k, -1) for k in known], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[inverse[::-1]] = np.arange(len(inverse))[::-1]
            raw, at = data.tobytes(), first[new]
            place[new] = len(self.index) + np.arange(len(new))
            self._learn([known[k] for k in new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[at].tolist(), end[at].tolist())], plain[at])
        starts, lengths = np.append(self.starts[place], self.used), np.append(self.lengths[place], 1)
        if self.used == len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used] = end_id
        token = np.insert(inverse, offsets[1:], len(known))
        size = lengths[token]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(starts[token] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.concatenate([[0], total[np.cumsum(np.diff(offsets) + 1) - 1]])


class Packer:
    """Open windows by fill level, with the number at each level in one array; they hold `most` ids at most, a piece counting as PIECE more."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0, most: int = HELD):
        self.capacity, self.next, self.most, self.held = capacity, first_sequence, most, 0
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.at: list[list] = [[] for _ in range(capacity)]
        self.rows: list[tuple] = []
        self.cut = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.close([(doc_id, start, ids[start : start + self.capacity], n)])
        if n > whole:
            self.place((doc_id, whole, ids[whole:].copy(), n))

    def place(self, piece: tuple) -> None:
        size, top = len(piece[2]), self.capacity
        level, best = 0, 2 * self.count[size] + 1
        if size < top:
            here = self.count[1 : top - size + 1]
            change = 2 * (self.count[size + 1 : top + 1] - here) + 2
            change[-1] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = k + 1
        window = self.at[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        self.held += size + PIECE
        if level + size == top:
            self.shut(window)
        else:
            self.count[level + size] += 1
            self.at[level + size].append(window)
            if self.held > self.most:
                self.settle(self.most // 2)

    def shut(self, window: list[tuple]) -> None:
        """Close a window that was open."""
        self.held -= sum(len(p[2]) + PIECE for p in window)
        self.close(window)

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def settle(self, most: int) -> None:
        """Fill the fullest open windows with what the emptiest hold, cut to fit, until no more than `most` is held or one window is left."""
        windows = [[w, level] for level in range(self.capacity - 1, 0, -1) for w in self.at[level]]
        full, spare = 0, len(windows) - 1
        while full < spare and self.held > most:
            (into, level), (out, left) = windows[full], windows[spare]
            doc_id, start, ids, n = out.pop()
            size = min(len(ids), self.capacity - level)
            into.append((doc_id, start, ids[:size], n))
            windows[full][1], windows[spare][1] = level + size, left - size
            self.cut += size
            if size < len(ids):
                out.append((doc_id, start + size, ids[size:].copy(), n))
                self.held += PIECE
            if level + size == self.capacity:
                self.shut(into)
                full += 1
            spare -= left == size
        self.count[:] = 0
        self.at = [[] for _ in range(self.capacity)]
        for window, level in windows[full : spare + 1]:
            self.count[level] += 1
            self.at[level].append(window)

    def flush(self) -> None:
        """Settle all open windows, and cut the contents of the last one into powers of two."""
        self.settle(0)
        pieces = [p for windows in self.at for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.count[:] = 0
        self.at, self.held = [[] for _ in range(self.capacity)], 0
        window, room = [], 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                room = room or 1 << (left.bit_length() - 1)
                part = ids[:room]
                window.append((doc_id, start, part, n))
                ids, start, room, left = ids[len(part) :], start + len(part), room - len(part), left - len(part)
                if not room:
                    self.close(window)
                    window = []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a tokenizer file that every executor has. A window that isn't full has a power of two as its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                ids, offsets = encoder.encode(block, end_id)
                for k in range(len(block)):
                    packer.add(doc_ids[block.first + k], ids[offsets[k] : offsets[k + 1]])
                if len(packer.rows) > 10_000:
                    yield packer.taken()
        packer.flush()
        yield packer.taken()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
