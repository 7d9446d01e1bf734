"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every byte that a string of LENGTH (200) bytes covers goes, where that string
also starts anywhere else, in another text or in the same. Only suffixes at
anchors are sorted: of any string of LENGTH bytes, the anchor is the GRAM-byte
window in it whose hash is smallest (leftmost on ties). Equal strings have
their anchors at equal offsets, so nothing is lost by looking at anchors only,
and there is about one for every LENGTH - GRAM bytes.

Buckets are refined by the identifiers (64-bit hashes) of what lies at earlier
and later offsets of their suffixes:

1. The initial bucket of an anchor is its GRAM-byte gram. The starts whose
   anchor it is form a range; the bytes that their strings cover together give
   the next identifier. Anchors that agree in both are repeated as a whole
   range. In a bucket of one there is no repeat. Else one suffix of each
   identifier goes on.
2. Ranges are split into PART starts each; their buckets are refined by the
   gram that all strings of the part share, and the next identifier is again
   that of all the bytes they cover. The same three outcomes follow.
3. What is left is refined by single strings.

Ranges that repeat within one batch of a partition are told at once, and one of
them goes on, so a passage that a third of all texts hold, or a line that one
text repeats, is thinned before any shuffle.

Each refinement is one shuffle by bucket, a sort by identifiers, and a pass in
that order with one row of state, so a bucket of any size needs no memory.
Texts that are equal are one (grouped by two 64-bit hashes, pre-aggregated
before the shuffle, and written once), so copies cost nothing after the first step.
Anchors of a long text are found by segments of SEGMENT starts; hashing the parts of a text
takes about 50 bytes of a Python worker for each of its bytes.

Two strings count as equal when the 64-bit hashes of the string, and of the
parts of it that the refinement passed, agree.

Defined results: null texts are empty; texts shorter than LENGTH keep all their
bytes; equal texts of at least LENGTH bytes lose all, the first as well; rows
with a null id and rows that repeat an id are documents like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder, written
from ._bytes import U64, Block, Rolling, blocks, mix, sliding
from ._joins import met

LENGTH, GRAM, PART = 200, 100, 13
ROWS = "bucket long, next long, h1 long, h2 long, place long"
REFINED = "kind int, bucket long, next long, h1 long, h2 long, place long"
MOST = (1 << 24) - 1
SEGMENT = 1 << 22
_PLACE = U64((1 << 28) - 1)
_ORDER = U64(((1 << 64) - 1) ^ ((1 << 28) - 1))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """h1, h2, text, copies of each different text."""
    return docs.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.lit(11)).alias("h2"))


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


def anchors(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, gram hash, hash of all that the range's strings cover, first start, number of starts and place of each anchor."""
    data, offsets = block.data, block.offsets
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    rolling = Rolling(data)
    grams = rolling.fixed(gram)
    ranked = grams & _ORDER | np.arange(len(grams), dtype=U64) & _PLACE
    at = (sliding(np.minimum, ranked, length - gram + 1) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][row])
    at = at[start]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last, place = start[cut], start[np.append(cut[1:], len(start)) - 1], at[cut]
    return row[first], grams[place], rolling.of(first, last + length), first, last - first + 1, place


def _packed(start: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A range: its first start (31 bits), number of starts (24 bits, so at most MOST), and how far behind the first start the anchor is (8 bits)."""
    return start << 32 | n << 8 | back


def _segments(block: Block, length: int, size: int) -> Iterator[tuple[Block, int]]:
    """The block, or, if it is one long text, parts of it with size starts each, and where each part begins."""
    n = len(block.data)
    if len(block) > 1 or n < size + length:
        yield block, 0
        return
    for at in range(0, n - length + 1, size):
        data = block.data[at : at + size + length - 1]
        yield Block(block.first, data, np.array([0, len(data)])), at


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors' ranges: done 0. Ranges that a batch already shows to be repeated: done 1, neighbours joined, dealt evenly; one of each such goes on as done 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["done", "bucket", "next", "h1", "h2", "place"]
        for batch in batches:
            ids = [np.asarray(batch.column(k)) for k in (0, 1)]
            parts = []
            for block, at in (x for b in blocks(batch.column(2)) for x in _segments(b, length, SEGMENT)):
                row, bucket, after, first, n, place = anchors(block, length, gram)
                parts.append((block.first + row, bucket.view(np.int64), after.view(np.int64), first - block.offsets[row] + at, n, place - first))
            if not parts:
                continue
            of, bucket, after, start, n, back = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((after, bucket))
            fresh = np.ones(len(of), bool)
            fresh[1:] = (bucket[order][1:] != bucket[order][:-1]) | (after[order][1:] != after[order][:-1])
            group = np.cumsum(fresh) - 1
            known = np.zeros(len(of), bool)
            known[order] = (np.bincount(group, minlength=1) > 1)[group] if len(of) else False
            goes_on = np.sort(order[fresh])
            yield pa.record_batch([pa.array(np.zeros(len(goes_on), np.int32)), *_longs(bucket[goes_on], after[goes_on], ids[0][of[goes_on]], ids[1][of[goes_on]], _packed(start, n, back)[goes_on])], names=names)
            some = np.flatnonzero(known)
            if len(some):
                cut = np.flatnonzero(np.concatenate([[True], (of[some][1:] != of[some][:-1]) | (start[some][1:] != start[some][:-1] + n[some][:-1])]))
                total = np.add.reduceat(n[some], cut)
                pieces = -(-total // MOST)
                first, step = np.repeat(some[cut], pieces), (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST
                total = np.minimum(np.repeat(total, pieces) - step, MOST)
                spread = mix((first + step).astype(U64) + ids[0][of[first]].view(U64)).view(np.int64)
                yield pa.record_batch([pa.array(np.ones(len(first), np.int32)), *_longs(spread, spread, ids[0][of[first]], ids[1][of[first]], _packed(start[first] + step, total, np.zeros(len(first), np.int64)))], names=names)

    return texts.select("h1", "h2", "text").mapInArrow(run, f"done int, {ROWS}")


def _refine(rows: DataFrame, schema: str, keep_nodes: bool = True) -> DataFrame:
    """kind 1: rows that share bucket and next with another. kind 0: one row of each next, in buckets that have several."""
    names = [x.split()[0] for x in schema.split(", ") if not x.startswith(("bucket", "done"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, count, alone = None, 0, True  # the open run's first row, its rows so far, whether no other run of its bucket came before

        def found(table: pa.Table, kind: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(at):
                part = table.take(pa.array(at))
                part = part.add_column(0, "kind", pa.array(np.full(len(at), kind, np.int32)))
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if "done" in table.column_names:
                done = table.column("done").to_numpy() == 1
                table = table.drop_columns(["done"])
                yield from found(table, 1, np.flatnonzero(done))
                table = table.take(pa.array(np.flatnonzero(~done)))
                if not table.num_rows:
                    continue
            weight = np.ones(table.num_rows, np.int64)
            if carry is not None:
                table = pa.concat_tables([carry, table])
                weight = np.concatenate([[count], weight])
            bucket, after = table.column("bucket").to_numpy(), table.column("next").to_numpy()
            new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            new_run = new_bucket | np.concatenate([[True], after[1:] != after[:-1]])
            run_at, of_run, of_bucket = np.flatnonzero(new_run), np.cumsum(new_run) - 1, np.cumsum(new_bucket) - 1
            size = np.bincount(of_run, weights=weight).astype(np.int64)
            several = np.bincount(of_bucket[run_at]) > 1
            if carry is not None and not alone:
                several[0] = True
            full = size[of_run] > 1
            if carry is not None and count > 1:
                full[0] = False
            yield from found(table, 1, np.flatnonzero(full))
            if keep_nodes:
                yield from found(table, 0, run_at[:-1][several[of_bucket[run_at[:-1]]]])
            last = run_at[-1]
            alone = not several[-1]
            carry, count = table.slice(last, 1), int(size[-1])
        if carry is not None and not alone and keep_nodes:
            yield from found(carry, 0, np.zeros(1, np.int64))

    return rows.repartition("bucket").sortWithinPartitions("bucket", "next").mapInArrow(run, "kind int, " + ", ".join(f"{n} {'binary' if n == 'strings' else 'long'}" for n in ["bucket", *names]))


def _parts(texts: DataFrame, nodes: DataFrame, length: int, gram: int) -> DataFrame:
    """The nodes' ranges in parts: bucket, next, text, place, and the hashes of the part's strings."""
    mine = nodes.groupBy("h1", "h2").agg(F.collect_list("place").alias("places"))
    joined = texts.select("h1", "h2", "text").join(mine, ["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(batch.column(k)) for k in (0, 1)]
            places = batch.column(3)
            all_places, ends = np.asarray(places.flatten()), np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths()))])
            for block in blocks(batch.column(2)):
                lo, hi = block.first, block.first + len(block)
                some = all_places[ends[lo] : ends[hi]]
                row = np.repeat(np.arange(len(block)), np.diff(ends[lo : hi + 1]))
                start, n, back = (some >> 32) + block.offsets[row], some >> 8 & 0xFFFFFF, some & 255
                anchor = start + back
                least, most = anchor - (start + n - 1), back  # distances from start to anchor
                parts = most // PART - least // PART + 1
                total = np.cumsum(parts)
                j = np.arange(total[-1] if len(total) else 0) - np.repeat(total - parts, parts) + np.repeat(least // PART, parts)
                anchor, least, most, row = (np.repeat(x, parts) for x in (anchor, least, most, row))
                low, high = np.maximum(least, j * PART), np.minimum(most, j * PART + PART - 1)
                first, n = anchor - high, high - low + 1
                rolling = Rolling(block.data)
                grams = rolling.of(anchor, anchor + gram)
                common = rolling.of(anchor - j * PART, anchor - j * PART + length - PART + 1)
                bucket = mix(mix(grams + j.astype(U64)) ^ common)
                after = mix(rolling.of(first, first + n - 1 + length) ^ low.astype(U64))
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                hashes = rolling.of(each, each + length)
                cuts = np.concatenate([[0], np.cumsum(n)])
                strings = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(hashes.tobytes())])
                of = lo + row
                longs = _longs(bucket, after, ids[0][of], ids[1][of], _packed(first - block.offsets[row], n, high))
                yield pa.record_batch([*longs, strings], names=["bucket", "next", "h1", "h2", "place", "strings"])

    return joined.mapInArrow(run, f"{ROWS}, strings binary")


def _singles(nodes: DataFrame) -> DataFrame:
    """One row for each string of the parts that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, h1, h2, place = (np.asarray(batch.column(k)) for k in range(4))
            start, n, back = place >> 32, place >> 8 & 0xFFFFFF, place & 255
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(np.arange(len(n)), n)
            distance = back[of] - step
            hashes = np.frombuffer(b"".join(batch.column(4).to_pylist()), U64)
            key = mix(np.ascontiguousarray(bucket).view(U64)[of] + distance.astype(U64) * U64(0x9E3779B97F4A7C15))
            one = np.ones(len(of), np.int64)
            yield pa.record_batch(_longs(key ^ hashes, hashes, h1[of], h2[of], _packed(start[of] + step, one, distance)), names=["bucket", "next", "h1", "h2", "place"])

    return nodes.select("bucket", "h1", "h2", "place", "strings").mapInArrow(run, ROWS)


def _covered(block: Block, row: np.ndarray, start: np.ndarray, n: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Which bytes go."""
    step = np.zeros(len(block.data) + 1, np.int32)
    at = start + block.offsets[row]
    np.add.at(step, at, 1)
    np.add.at(step, at + n - 1 + length, -1)
    return (np.cumsum(step[:-1]) > 0) | np.repeat(whole, np.diff(block.offsets))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_kept: its remaining bytes as well.

    length up to 255 above gram; the strings' own length is a parameter of the method only through the hashes.
    """
    if not 0 < gram <= length - PART or length - gram > 250:
        raise ValueError("gram must be shorter than length by at least 13 and at most 250")
    spark, base = docs.sparkSession, folder(docs.sparkSession)
    docs = hashed(docs)
    texts = written(distinct_texts(docs), f"{base}/texts")
    one = written(_refine(_anchored(texts, length, gram), ROWS), f"{base}/one")
    two = written(_refine(_parts(texts, one.where("kind = 0"), length, gram), f"{ROWS}, strings binary"), f"{base}/two")
    three = written(_refine(_singles(two.where("kind = 0")), ROWS, keep_nodes=False), f"{base}/three")
    ranges = [x.where("kind = 1").select("h1", "h2", "place") for x in (one, two, three)]
    found = ranges[0].unionByName(ranges[1]).unionByName(ranges[2]).groupBy("h1", "h2").agg(F.collect_list("place").alias("places"))
    joined = texts.join(found, ["h1", "h2"], "left").select("h1", "h2", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"), "copies")
    schema = "h1 long, h2 long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            places, copies = batch.column(3), np.asarray(batch.column(4))
            all_places, ends = np.asarray(places.flatten()), np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths()))])
            for block in blocks(batch.column(2)):
                lo, hi = block.first, block.first + len(block)
                some = all_places[ends[lo] : ends[hi]]
                size = np.diff(block.offsets)
                row = np.repeat(np.arange(len(block)), np.diff(ends[lo : hi + 1]))
                gone = _covered(block, row, some >> 32, some >> 8 & 0xFFFFFF, (copies[lo:hi] > 1) & (size >= length), length)
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                inside = np.ones(len(gone), bool)
                inside[block.offsets[:-1][size > 0]] = False
                begins[1:] &= ~(gone[:-1] & inside[1:])
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = block.data[~gone].tobytes()
                cuts = (block.offsets - total[block.offsets]).tolist()
                pieces = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                columns = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, 4)]
                columns += [pa.array(x) for x in (size, np.diff(total[block.offsets]), np.diff(spans[block.offsets]))]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()))
                if with_kept:
                    columns.append(pa.array(pieces, pa.binary()))
                yield pa.record_batch(columns, names=names)

    results, slim = joined.mapInArrow(run, schema), docs.select("doc_id", "h1", "h2")
    if with_kept:  # the bytes that stay aren't broadcast
        return slim.join(results.drop("copies"), ["h1", "h2"]).drop("h1", "h2")
    return met(slim, written(results, f"{base}/results"), ["h1", "h2"], "copies").drop("h1", "h2", "copies")
