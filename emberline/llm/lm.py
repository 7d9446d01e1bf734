"""LM scoring with a probabilistic suffix tree over words.

Tokens are lower-cased words, then one end per text. The tree's root is the
base model: (c + 0.1) / (N + 0.1 * (V + 1)). A deeper state is a context: the last
d words of the same text. Its next-symbol distribution gives each
symbol that followed LEAST times or more (count - DISCOUNT) / count of the context,
and spreads what is left by the distribution of its suffix, the context of the last d - 1
words; so every distribution sums to one. A context that occurs LEAST times becomes a state
if its suffix is one and a divergence test retains it: the Kullback-Leibler divergence of its
distribution from its suffix's, times its count, reaches GAIN nats. So the tree is as deep
as the test makes it, and grows with the corpus. A token is scored at the
longest suffix of what precedes it that is a state.

No part of the tree is broadcast or sent to the driver. Texts are cut into chunks of about
CHUNK tokens, written as indices into the chunk's words. A chunk asks for what it
needs to know of its distinct words, n-grams and contexts; the questions are dealt
by hash, totalled over all chunks, and answered in the order asked. For each depth d there
are two: the counts of the (context, next) n-grams of d + 1 words, asked only if the n-grams of d words in it
occur LEAST times and the context's suffix is a state; and what the contexts' states leave. The first chunk
that has an n-gram gives the row from which its context's state is computed. No key
is hot: a chunk asks once for each. Depths follow until the test retains no context. From
depth DEEP on, only the tokens go on whose context may still be a state there (a few in a hundred); what is
needed of them is written for each depth, and the others' scores are summed.

Words and contexts are 64-bit hashes. A chunk holds whole texts, so a text takes about
200 bytes of a Python worker for each of its tokens.

Defined results: a null text is empty and consists of its end; rows with a null
id take no part; rows that repeat an id are texts of their own; an empty
table gives no rows; other columns are ignored. Training
texts are those whose crc32(id as text) % 10 isn't 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder, remove, written
from ._bytes import U64, Block, blocks, mix

CHUNK = 600_000
BUCKET_KEYS = 1_000_000
LEAST = 4
DISCOUNT = 0.5
GAIN = 12.0
ALPHA = 0.1
DEEP = 4
END = U64(0x3C6EF372FE94F82B)
OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"
CHUNKS = "chunk long, n long, n_train long, ids binary, size binary, words binary, at binary"
ASKED = "kind int, bucket long, chunk long, keys binary, counts binary, context long, p double, parent double, of long"
FRONT = "texts long, row binary, pos binary, token binary, train binary, p binary, gram binary, of binary, own binary"
FRONT_KINDS = {"row": np.uint32, "pos": np.uint32, "token": np.uint64, "train": np.uint8, "p": np.float64, "gram": np.uint64, "of": np.int64, "own": np.int64}
DONE = "chunk long, ids binary, size binary, known binary, base binary, score binary"
ANSWERS = "chunk long, question int, bucket long, kind string, answer binary"


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block's rows, ends included, and the offsets of the rows."""
    words = block.words()
    h = np.insert(words.hashes(), words.offsets[1:], END)
    return h, words.offsets + np.arange(len(words.offsets))


def longer(gram: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one more token."""
    return mix(gram * U64(0x9E3779B97F4A7C15) + token)


def trains(ids) -> np.ndarray:
    """Which ids' texts the model learns from."""
    return np.fromiter((zlib.crc32(str(i).encode()) % 10 != 0 for i in ids), bool, len(ids))


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(blob: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size // width).T).view(kind).reshape(-1)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes comes first."""
    first = np.zeros(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, and their buckets in it."""
    bucket = (keys % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order].astype(np.int64)


def _chunks(docs: DataFrame) -> DataFrame:
    """Texts in chunks: their ids and sizes, the chunk's distinct words, and each token as an index into those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, n = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def chunk() -> pa.RecordBatch:
            nonlocal held, made, n
            h, size, ids = (np.concatenate(x) for x in zip(*held))
            at, words = pd.factorize(h)
            order = np.argsort(-np.bincount(at), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            blobs = [packed(ids), packed(size), words[order].tobytes(), packed(rank[at])]
            held, made, n = [], made + 1, 0
            longs = [pa.array([x], pa.int64()) for x in (part + made, len(h), int(size[trains(ids.tolist())].sum()))]
            return pa.record_batch([*longs, *[pa.array([x], pa.binary()) for x in blobs]], names=_names(CHUNKS))

        for batch in batches:
            for block in blocks(batch.column(1)):
                h, offsets = tokens(block)
                held.append((h, np.diff(offsets), np.asarray(batch.column(0).slice(block.first, len(block)), dtype=np.int64)))
                n += len(h)
                if n >= CHUNK:
                    yield chunk()
        if held:
            yield chunk()

    return docs.mapInArrow(run, CHUNKS)


class _Asker:
    """One who asks buckets for keys, and has the answers so far."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, buckets: int):
        self.table, self.id, self.buckets = table, table.column("chunk")[0].as_py(), buckets
        self.answers: dict[int, list] = {}
        for question, bucket, kind, values in zip(*(answers.column(c).to_pylist() for c in ("question", "bucket", "kind", "answer"))) if answers else ():
            self.answers.setdefault(question, []).append((bucket, kind, values))

    def blob(self, name: str, kind) -> np.ndarray:
        return unpacked(self.table.column(name)[0].as_py(), kind)

    def told(self, question: int, keys: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(len(keys), kind)
        if len(keys):
            parts = sorted(self.answers.pop(question), key=lambda x: x[0])
            out[_dealt(keys, self.buckets)[0]] = np.concatenate([unpacked(values, k) for _, k, values in parts])
        return out


class _Chunk(_Asker):
    """A chunk's tokens, and what the answers so far tell of them.

    Question 0 asks for counts of words, 2 d - 1 for counts of n-grams of d + 1 words, 2 d for what states of d words leave;
    question -1 comes after the last answer, or at depth until.
    """

    def __init__(self, table: pa.Table, answers: pa.Table | None, buckets: int, size: float, until: int = 0):
        super().__init__(table, answers, buckets)
        self.total, self.until = size, until
        self.ids, self.size = self.blob("ids", np.int64), self.blob("size", np.int64)
        self.words, self.at = np.frombuffer(table.column("words")[0].as_py(), U64), self.blob("at", np.uint32).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.training = np.repeat(trains(self.ids.tolist()), self.size).astype(np.float64)

    def to(self, question: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a question, and their training counts here. Before it, all that earlier answers tell."""
        at, n, h = self.at, len(self.at), self.words[self.at]
        if question == 0:
            return self.words, np.bincount(at, weights=self.training, minlength=len(self.words)).astype(np.int64)
        count = (self.told(0, self.words, np.int64) >> 1)[at]  # of the n-gram of d words that each token ends
        self.known = count > 0
        self.root = (count + ALPHA) / self.total if self.total else None
        self.p, gram, depth = self.root, h, 1
        place = np.arange(n) - np.repeat(self.offsets[:-1], self.size)
        follows = place >= 1  # tokens whose context of depth words can be a state
        while True:
            follows[1:] &= count[:-1] >= LEAST
            if depth == self.until:
                i = np.flatnonzero(follows)
                row = np.repeat(np.arange(len(self.size)), self.size)[i]
                self.front = {"row": row, "pos": i, "token": h[i], "train": self.training[i], "p": self.p[i], "gram": gram[i - 1], "of": count[i - 1], "own": count[i]}
                return self.words[:0], count[:0]
            some = np.flatnonzero(follows & (count >= LEAST))
            codes, grams = pd.factorize(longer(gram[some - 1], h[some]))
            if question == 2 * depth - 1:
                return grams, np.bincount(codes, weights=self.training[some], minlength=len(grams)).astype(np.int64)
            told = self.told(2 * depth - 1, grams, np.int64)
            then, next_gram = np.zeros(n, np.int64), np.zeros(n, U64)
            then[some], next_gram[some] = (told >> 1)[codes], grams[codes]
            after = np.flatnonzero(follows)
            of, contexts = pd.factorize(gram[after - 1])
            if question == 2 * depth:
                rows = some[_first(codes, len(grams))[(told & 1 == 1) & (told >> 1 >= LEAST)]]
                self.rows = gram[rows - 1], (then[rows] - DISCOUNT) / count[rows - 1], self.p[rows], count[rows - 1]
                return contexts, np.zeros(0, np.int64)
            left = self.told(2 * depth, contexts, np.int64)[of]
            after, left = after[left > 0], left[left > 0]
            rest = left / (2 * count[after - 1])
            if self.root is not None:
                shown = np.where(then[after] >= LEAST, (then[after] - DISCOUNT) / count[after - 1], 0.0)
                self.p = self.p.copy()
                self.p[after] = shown + rest * self.p[after]
            depth += 1
            follows = np.zeros(n, bool)
            follows[after] = True
            follows &= place >= depth
            gram, count = next_gram, then


def _blobs(front: dict) -> list[bytes]:
    return [packed(front[k].astype(kind)) for k, kind in FRONT_KINDS.items()]


class _Front(_Asker):
    """A chunk's tokens whose context of so many words may be a state: what _Chunk knows of them."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, buckets: int):
        super().__init__(table, answers, buckets)
        self.texts, self.at = table.column("texts")[0].as_py(), {k: self.blob(k, kind) for k, kind in FRONT_KINDS.items()}

    def to(self, question: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.at
        some = np.flatnonzero(a["own"] >= LEAST)
        codes, grams = pd.factorize(longer(a["gram"][some], a["token"][some]))
        if question % 2:
            return grams, np.bincount(codes, weights=a["train"][some], minlength=len(grams)).astype(np.int64)
        told = self.told(question - 1, grams, np.int64)
        self.then, self.gram = np.zeros(len(a["own"]), np.int64), np.zeros(len(a["own"]), U64)
        self.then[some], self.gram[some] = (told >> 1)[codes], grams[codes]
        at = some[_first(codes, len(grams))[(told & 1 == 1) & (told >> 1 >= LEAST)]]
        self.rows = a["gram"][at], (self.then[at] - DISCOUNT) / a["of"][at], a["p"][at], a["of"][at]
        self.which, contexts = pd.factorize(a["gram"])
        return contexts, np.zeros(0, np.int64)

    def summed(self, some: np.ndarray) -> np.ndarray:
        """The log10 probabilities of these tokens by text."""
        return np.bincount(self.at["row"][some], weights=np.log10(self.at["p"][some]), minlength=self.texts)

    def step(self, question: int) -> tuple[dict, np.ndarray]:
        """The next depth's tokens, and the sums of those that end here."""
        contexts, _ = self.to(question)
        a, left = self.at, self.told(question, contexts, np.int64)[self.which]
        state, rest = left > 0, left / (2 * self.at["of"])
        shown = np.where(self.then >= LEAST, (self.then - DISCOUNT) / a["of"], 0.0)
        a["p"] = np.where(state, shown + rest * a["p"], a["p"])
        before = np.maximum(np.searchsorted(a["pos"], a["pos"]) - 1, 0)
        near = a["pos"][before].astype(np.int64) == a["pos"].astype(np.int64) - 1
        of = np.where(near, self.then[before], 0)
        on = np.flatnonzero(state & (of >= LEAST))
        front = {k: a[k][on] for k in ("row", "pos", "token", "train", "p")} | {"gram": self.gram[before][on], "of": of[on], "own": self.then[on]}
        return front, self.summed(np.setdiff1d(np.arange(len(of)), on))


def _with(chunks: DataFrame, answers: DataFrame | None, run, schema: str) -> DataFrame:
    """run(chunk's row, its answers or None) for each chunk."""
    if answers is not None:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: run(a, b), schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from run(pa.Table.from_batches([batch.slice(k, 1)]), None).combine_chunks().to_batches()

    return chunks.mapInArrow(each, schema)


def _asked(chunks: DataFrame, answers: DataFrame | None, question: int, asker) -> DataFrame:
    """kind 0: the keys that a chunk asks a bucket for. kind 1: with an even question, the rows of which states are made."""

    def ask(table: pa.Table, known: pa.Table | None) -> pa.Table:
        c = asker(table, known)
        keys, counts = c.to(question)
        order, bucket = _dealt(keys, c.buckets)
        keys, counts = keys[order], counts[order].astype(np.uint32) if len(counts) else counts
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        cuts = [*first.tolist(), len(bucket)]
        blobs = [(keys[a:b].tobytes(), packed(counts[a:b]) if len(counts) else b"") for a, b in zip(cuts[:-1], cuts[1:])]
        rows = c.rows if question and question % 2 == 0 else (np.zeros(0, U64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
        m, r = len(first), len(rows[0])
        nothing = lambda n, kind: pa.nulls(n, kind)
        asks = [pa.array(np.zeros(m, np.int32)), pa.array(bucket[first]), pa.array(np.full(m, c.id)), pa.array([x[0] for x in blobs], pa.binary()), pa.array([x[1] for x in blobs], pa.binary())]
        asks += [nothing(m, pa.int64()), nothing(m, pa.float64()), nothing(m, pa.float64()), nothing(m, pa.int64())]
        told = [pa.array(np.ones(r, np.int32)), nothing(r, pa.int64()), nothing(r, pa.int64()), nothing(r, pa.binary()), nothing(r, pa.binary())]
        told += [pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3])]
        return pa.concat_tables([pa.table(x, names=_names(ASKED)) for x in (asks, told)])

    return _with(chunks, answers, ask, ASKED)


def _reply(table: pa.Table, question: int, values: list[np.ndarray], kind: str, more: int) -> pa.Table:
    of, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    if more >= 0:  # the number of keys with a count, under no chunk
        of, bucket, values = [*of, -1], [*bucket, 0], [*values, np.array([more])]
    kinds = ["<u4" if kind == "<i8" and (not len(v) or v.max() < 1 << 32) else kind for v in values]
    blobs = [packed(v.astype(k)) for v, k in zip(values, kinds)]
    return pa.table([pa.array(of, pa.int64()), pa.array(np.full(len(of), question, np.int32)), pa.array(bucket, pa.int64()), pa.array(kinds, pa.string()), pa.array(blobs, pa.binary())], names=_names(ANSWERS))


def _totals(asked: DataFrame, question: int) -> DataFrame:
    """The answers to a question about counts: total count << 1 | whether the asking chunk is the first with the key."""

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        keys = [np.frombuffer(x.as_buffer(), U64) for x in table.column("keys")]
        counts = np.concatenate([unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
        at, found = pd.factorize(np.concatenate(keys))
        sums = np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)
        owns = np.zeros(len(at), np.int64)
        owns[_first(at, len(found))] = 1
        values = np.split(sums[at] << 1 | owns, np.cumsum([len(k) for k in keys])[:-1])
        return _reply(table, question, values, "<i8", int((sums > 0).sum()) if question == 0 else -1)

    return asked.select("bucket", "chunk", "keys", "counts").groupBy("bucket").applyInArrow(total, ANSWERS)


def _leavings(asked: DataFrame, states: DataFrame, question: int) -> DataFrame:
    """The answers to a question about states: twice the count that the state leaves to its suffix, 0 where the context isn't one."""

    def left(table: pa.Table, known: pa.Table) -> pa.Table:
        context, rest = known.column("context").to_numpy().view(U64), known.column("left").to_numpy()
        order = np.argsort(context)
        context, rest = context[order], rest[order]
        values = []
        for x in table.column("keys"):
            keys = np.frombuffer(x.as_buffer(), U64)
            at = np.minimum(np.searchsorted(context, keys), max(len(context) - 1, 0))
            values.append(np.where(context[at] == keys, rest[at], 0) if len(context) else np.zeros(len(keys), np.int64))
        return _reply(table, question, values, "<i8", -1)

    return asked.select("bucket", "chunk", "keys").groupBy("bucket").cogroup(states.groupBy("bucket")).applyInArrow(left, ANSWERS)


def _states(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, context and what it leaves (a whole number: twice its count, less 2 count - 1 of each shown n-gram) of the contexts that the divergence test retains, of rows (context, p, parent, of)."""
    sums = rows.groupBy("context").agg(F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("rest"), F.sum("parent").alias("shown"), F.max("of").alias("of"))
    here = F.col("p") + F.col("rest") * F.col("parent")
    gains = rows.select("context", "p", "parent").join(sums, "context").groupBy("context", "rest", "shown", "of").agg(F.sum(here * F.log(here / F.col("parent"))).alias("gain"))
    kept = gains.where(F.col("of") * (F.col("gain") + F.col("rest") * F.log("rest") * F.greatest(1 - F.col("shown"), F.lit(0.0))) >= GAIN)
    # the bucket of the unsigned hash: 2**64 more where the signed one is negative
    bucket = F.pmod(F.pmod("context", F.lit(buckets)) + F.when(F.col("context") < 0, F.lit(2**64 % buckets)).otherwise(0), F.lit(buckets)).cast("long")
    return kept.select(bucket.alias("bucket"), "context", F.round(2 * F.col("of") * F.col("rest")).cast("long").alias("left"))


def _row(c: _Asker, schema: str, values: list) -> pa.Table:
    """One row of a chunk's values, null for those not given."""
    types = {"long": pa.int64(), "binary": pa.binary()}
    values = [c.id, *values]
    return pa.table([pa.array([v], types[x.split()[1]]) for x, v in zip(schema.split(", "), values)], names=_names(schema))


def _deep(front: DataFrame, done: list[DataFrame], question: int, buckets: int, base: str) -> tuple[list[DataFrame], int]:
    """done with the scores of all tokens that front has, and the tree's depth."""
    ask = lambda table, known: _Front(table, known, buckets)
    both = f"kind int, chunk long, {FRONT}, sums binary"

    def step(question: int):
        def run(table: pa.Table, known: pa.Table) -> pa.Table:
            c = ask(table, known)
            new, sums = c.step(question)
            return _row(c, "chunk long, " + both.split(", ", 2)[2] + ", kind long", [c.texts, *_blobs(new), packed(sums), len(new["row"])]).select(_names(both)).set_column(0, "kind", pa.array([int(len(new["row"]) > 0)], pa.int32()))

        return run

    def end(table: pa.Table, known: None) -> pa.Table:
        c = ask(table, known)
        return _row(c, DONE, [None, None, None, None, packed(c.summed(np.arange(len(c.at["row"]))))])

    while True:
        counts = written(_totals(_asked(front, None, question, ask), question), f"{base}/answers{question}")
        if not counts.limit(1).count():
            break
        asked = written(_asked(front, counts, question + 1, ask), f"{base}/asked{question}")
        states = written(_states(asked.where("kind = 1").select("context", "p", "parent", "of"), buckets), f"{base}/states{question}")
        if not states.limit(1).count():
            break
        left = written(_leavings(asked.where("kind = 0"), states, question + 1), f"{base}/answers{question + 1}")
        new = written(_with(front, counts.unionByName(left), step(question + 1), both), f"{base}/front{question}")
        done = [*done, new.selectExpr("chunk", *(f"CAST(NULL AS BINARY) AS {c}" for c in _names(DONE)[1:5]), "sums AS score")]
        remove(front.sparkSession, f"{base}/asked{question}")
        front, question = new.where("kind = 1").drop("kind", "sums"), question + 2
    return [*done, _with(front, None, end, DONE)], (question - 1) // 2


def score(docs: DataFrame, deep: int = DEEP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and depth of the tree, for every document."""
    base = folder(docs.sparkSession)
    chunks = written(_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())), f"{base}/chunks")
    n_all, n_train = (int(x or 0) for x in chunks.agg(F.sum("n"), F.sum("n_train")).first())
    buckets = max(64, n_all // BUCKET_KEYS)

    first = written(_totals(_asked(chunks, None, 0, lambda table, known: _Chunk(table, known, buckets, 0.0)), 0), f"{base}/answers0")
    v = sum(int(unpacked(r["answer"], r["kind"])[0]) for r in first.where("chunk = -1").select("kind", "answer").toLocalIterator())
    size, answers, depth, more = n_train + ALPHA * (v + 1), first.where("chunk >= 0"), 0, True
    ask = lambda table, known: _Chunk(table, known, buckets, size)
    while more and depth + 1 < deep:
        question = 2 * depth + 1
        counts = written(_totals(_asked(chunks, answers, question, ask), question), f"{base}/answers{question}")
        if more := bool(counts.limit(1).count()):
            asked = written(_asked(chunks, answers.unionByName(counts), question + 1, ask), f"{base}/asked{question}")
            states = written(_states(asked.where("kind = 1").select("context", "p", "parent", "of"), buckets), f"{base}/states{question}")
            if more := bool(states.limit(1).count()):
                left = written(_leavings(asked.where("kind = 0"), states, question + 1), f"{base}/answers{question + 1}")
                answers, depth = answers.unionByName(counts).unionByName(left), depth + 1
            remove(docs.sparkSession, f"{base}/asked{question}")

    def reached(table: pa.Table, known: pa.Table) -> pa.Table:
        c = _Chunk(table, known, buckets, size, depth + 1)
        c.to(-1)
        rest = np.ones(len(c.p), bool)
        rest[c.front["pos"]] = not more
        by_text = [np.add.reduceat(x, c.offsets[:-1]) for x in (c.known.astype(np.int64), np.log10(c.root), np.where(rest, np.log10(c.p), 0.0))]
        if not more:
            c.front = {k: x[:0] for k, x in c.front.items()}
        both = [packed(c.ids), packed(c.size), *map(packed, by_text), len(c.size), *_blobs(c.front)]
        return _row(c, f"{DONE}, {FRONT}", both)

    at = written(_with(chunks, answers, reached, f"{DONE}, {FRONT}"), f"{base}/reached")
    for name in ("chunks", *(f"answers{k}" for k in range(2 * depth + 2))):
        remove(docs.sparkSession, f"{base}/{name}")
    done = [at.select(*_names(DONE))]
    if more:
        done, depth = _deep(at.select("chunk", *_names(FRONT)), done, 2 * depth + 1, buckets, base)
    all_done = done[0]
    for x in done[1:]:
        all_done = all_done.unionByName(x)

    def final(table: pa.Table) -> pa.Table:
        whole = table.filter(table.column("ids").is_valid())
        ids, sizes, known, root = (unpacked(whole.column(k)[0].as_py(), kind) for k, kind in zip(("ids", "size", "known", "base"), (np.int64, np.int64, np.int64, np.float64)))
        parts = sum(unpacked(x, np.float64) for x in table.column("score").to_pylist())
        return pa.table([pa.array(x) for x in (ids, sizes, known, root, parts)], names=_names(OUT))

    held_out = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0).alias("held_out")
    return all_done.groupBy("chunk").applyInArrow(final, OUT).select("doc_id", held_out, "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", F.lit(depth).alias("depth"))
