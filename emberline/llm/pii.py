"""Personal data: base patterns, and terms that reveal them by co-occurrence.

Base spans, per kind and leftmost without overlap: e-mail addresses, IPv4
addresses, card numbers (13 to 19 digits that pass Luhn) and phone numbers (9 to
15 digits). The patterns never look at a character twice for long runs
(possessive quantifiers); a run that fails is passed as a whole, since no later
start in it could match.

Sanitisation: a protected entity is a base match, normalised. The corpus tells
how much of an entity e a term t reveals. With c of the df(t) documents that hold
t holding e as well, anywhere in them, and N documents, PMI(e; t) =
log2(N * c / (df(e) * df(t))) of the IC(e) = log2(N / df(e)) bits of e are told,
and IC - PMI = -log2 P(e | t) bits are left open. P(e | t) is c / df(t), taken at
its lower confidence bound (Wilson's, Z standard errors), which shrinks what few
documents say: one document says nothing, two that agree leave at most
-log2(GENERALISE) bits open, eight at most -log2(REMOVE). A term goes where P(e | t)
exceeds REMOVE, and is generalised to a placeholder where it exceeds GENERALISE;
of an entity that many documents hold, at least half (a term to be generalised) or three
quarters (to be removed) of its bits must be told as well. A disclosing term is
found wherever it stands in a document that holds the entity; documents without
personal data are never touched.

How pairs are found without looking at all of them: equal texts are one, with a
weight. Entities with the same texts are one class, and so are terms with the
same texts and frequency, so that a long list of addresses that was copied is one class
of each. Only pairs that can pass are counted: c > least(df(t)) says
how many of a term's documents may lack the entity, so a term meets the entities of
its texts with the fewest entities only, as many as make sure that one of them is shared
(a prefix filter, by chunks of about CHUNK texts of a term). The candidates are
then counted exactly. df(t) is counted over all terms of all documents: each
partition sends its distinct terms with their document counts as packed blobs,
dealt by hash; they meet the wanted terms there.

Terms are units (words, cut at marks) of three bytes or more that a letter leads
or that hold a digit; a run of more than a MB without white space is cut there.
Texts of more than a MB are read by pieces: one of 50 MB, all of it
addresses or all of it digits, takes less than 900 MB of a Python worker.

Defined results: a null text is empty and has no spans; a null id passes
through; each of repeated rows is a document; an empty table gives no rows;
`sanitise` keeps all columns and their names, `spans` ignores the others.
"""

from __future__ import annotations

import hashlib
import io
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import folder, written
from ._bytes import BLOCK_BYTES, SPACE, U64, Block, Rolling, blocks, units

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]+")
LONGEST_CARD = 2 * 19 - 1
GENERALISE, REMOVE, Z = 1 / 3, 2 / 3, 1.96
CHUNK = 1000
BROADCAST_ROWS = 20_000
FLUSH = 1_000_000
BUCKET_ROWS = 500_000
FOUND = "size long, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<long>, held string"
TERMS = "array<struct<s:int,f:int,remove:boolean>>"
_HINT = np.zeros(256, bool)
_HINT[[64, *range(48, 58)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _scan(text: str) -> Iterator[tuple[str, int, int, str]]:
    if "@" in text:
        for m in EMAIL.finditer(text):
            if m.group(1):
                yield "email", m.start(), m.end(), m.group().lower()
    for m in IP.finditer(text):
        if m.group(1) and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            yield "ip", m.start(), m.end(), m.group()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= LONGEST_CARD:
            digits = DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), digits
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = DIGIT.sub("", m.group())
            if 9 <= len(digits) <= 15:
                yield "phone", m.start(), m.end(), digits


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (code points, end exclusive) and normalised value, by kind, then start."""
    return list(_scan(text))


def _hash(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _likely(block: Block) -> list[int]:
    """The rows of a block that may hold personal data: those with a digit or an at sign."""
    hint = _HINT[block.data]
    if len(block) == 1:
        return [0] if hint.any() else []
    return np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hint)])[block.offsets])).tolist()


def _text(block: Block, i: int) -> str:
    return block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def _pieces(block: Block) -> Iterator[Block]:
    """The block, or, if it is one long text, pieces of it in turn that end at white space, or else between characters."""
    n, at = len(block.data), 0
    if len(block) > 1 or n <= BLOCK_BYTES:
        yield block
        return
    while at < n:
        end = min(at + BLOCK_BYTES, n)
        if end < n:
            spaces = np.flatnonzero(SPACE[block.data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                while end > at + 1 and block.data[end] & 0xC0 == 0x80:
                    end -= 1
        yield Block(block.first, block.data[at:end], np.array([0, end - at]))
        at = end


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of a block's terms."""
    start, end, _, data, first = units(block)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)])
    head = data[start] if len(start) else np.zeros(0, np.uint8)
    word = (end - start >= 3) & ((head >= 97) & (head <= 122) | (head >= 65) & (head <= 90) | (head >= 128) | (digits[end] > digits[start]))
    row = np.repeat(np.arange(len(block)), np.diff(first))
    return Rolling(data).of(start, end)[word], row[word], start[word], end[word]


def _distinct_terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct terms of each text, by row."""
    parts = [_terms(piece)[:2] for piece in _pieces(block)]
    h, row = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _found(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with the base spans and distinct entities, and (held) the text where it has entities."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], *T.DataType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_text = batch.schema.get_field_index("text")
            texts = batch.column(k_text)
            for block in blocks(texts):
                n = len(block)
                base, counts, entities, holds = [""] * n, np.zeros((4, n), np.int64), [np.zeros(0, np.int64)] * n, np.zeros(n, bool)
                for i in _likely(block):
                    told, ids = io.StringIO(), array("q")
                    for kind, s, f, value in _scan(_text(block, i)):
                        told.write(f"{kind}:{s}:{f},")
                        ids.append(_hash(kind, value))
                        counts[KINDS.index(kind), i] += 1
                    if ids:
                        base[i], entities[i], holds[i] = told.getvalue()[:-1], np.unique(np.frombuffer(ids, np.int64)), True
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in entities])]).astype(np.int32), np.concatenate([*entities, np.zeros(0, np.int64)]))
                columns = [batch.column(k).slice(block.first, n) for k in range(batch.num_columns) if k != k_text]
                held = texts.take(pa.array(block.first + np.arange(n), mask=~holds))
                columns += [pa.array(np.diff(block.offsets)), pa.array(base, pa.string()), *map(pa.array, counts), lists, held]
                yield pa.record_batch(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _emitted(texts: DataFrame) -> DataFrame:
    """The columns of texts (text last) but text, and t: a row for each distinct term of each text."""
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("t", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                h, row = _distinct_terms(block)
                for k in range(0, len(h), 100_000):
                    of = pa.array(block.first + row[k : k + 100_000])
                    yield pa.record_batch([*(batch.column(c).take(of) for c in range(batch.num_columns - 1)), pa.array(h[k : k + 100_000].view(np.int64))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _frequencies(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """t and df, the number of documents with the term, for the wanted terms (t)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            t, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(of.reshape(-1), weights=np.concatenate([p[1] for p in parts])).astype(np.uint32)
            bucket = (t % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, n, bucket = t[order], n[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            cuts = np.append(first, len(t))
            blobs = [(t[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.record_batch([pa.array(bucket[first]), pa.array([x[0] for x in blobs], pa.binary()), pa.array([x[1] for x in blobs], pa.binary())], names=["bucket", "t", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                h, n = np.unique(_distinct_terms(block)[0], return_counts=True)
                if len(h):
                    parts.append((h, n))
                    held += len(h)
                if held >= FLUSH:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    def meet(counts: pa.Table, terms: pa.Table) -> pa.Table:
        t = np.unique(terms.column("t").to_numpy().view(U64))
        total = np.zeros(len(t), np.int64)
        for keys, n in zip(counts.column("t"), counts.column("n")):
            if len(t):
                keys, n = np.frombuffer(keys.as_buffer(), U64), np.frombuffer(n.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(t, keys), len(t) - 1)
                hit = t[at] == keys
                total[at[hit]] += n[hit]  # the keys of a blob are distinct
        return pa.table({"t": pa.array(t.view(np.int64)), "df": pa.array(total)})

    # the bucket of the unsigned hash: 2**64 more where the signed one is negative
    bucket = F.pmod(F.pmod("t", F.lit(buckets)) + F.when(F.col("t") < 0, F.lit(2**64 % buckets)).otherwise(0), F.lit(buckets)).cast("long")
    blobs = docs.select("text").mapInArrow(emit, "bucket long, t binary, n binary")
    return blobs.groupBy("bucket").cogroup(wanted.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(meet, "t long, df long")


def least(df: Column, p: Column) -> Column:
    """What the number of documents with the entity must exceed, of df with the term, for P(e | t) > p at the lower confidence bound."""
    return df * p + F.lit(Z) * F.sqrt(df * p * (1 - p))


def _small(df: DataFrame, path: str) -> DataFrame:
    """df, written, and broadcast while it has at most BROADCAST_ROWS rows."""
    df = written(df, path)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _signature(*by: str) -> list[Column]:
    """The set of texts of a group, as two hashes, and the number of documents with them."""
    return [F.bit_xor(F.xxhash64("h1", "h2")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(5), "h2", "h1")).alias("x2"), F.sum("m").alias("w")]


def _entities(found: DataFrame, base: str) -> DataFrame:
    """h1, h2, m (documents with that text), a (a class of entities in it) and df_e, of entities in two documents or more, written."""
    texts = found.where(F.size("entities") > 0).groupBy("h1", "h2").agg(F.first("entities").alias("entities"), F.count(F.lit(1)).alias("m"))
    rows = written(texts.select("h1", "h2", "m", F.explode("entities").alias("e")), f"{base}/holders")
    known = _small(rows.groupBy("e").agg(*_signature()).where("w > 1").select("e", F.xxhash64("x1", "x2", "w").alias("a"), F.col("w").alias("df_e")), f"{base}/known")
    return written(rows.join(known, "e").select("h1", "h2", "m", "a", "df_e").distinct(), f"{base}/entities")


def _disclosing(entities: DataFrame, rows: DataFrame, docs: DataFrame, total: int, buckets: int, base: str) -> DataFrame:
    """h1, h2, t, remove: the terms that reveal an entity, for each text that holds both. rows: h1, h2, m, n (entity classes of the text), t."""
    low = F.lit(GENERALISE)
    seen = written(rows.groupBy("t").agg(*_signature()).where("w > 1"), f"{base}/seen")
    df = _frequencies(docs, seen.select("t"), buckets)
    known = written(seen.join(df, "t").where(F.col("w") > least(F.col("df"), low)).select("t", F.xxhash64("x1", "x2", "df").alias("b"), "df", "w"), f"{base}/terms")
    terms = written(rows.join(known, "t").select("h1", "h2", "m", "n", "b", "df", "w").distinct(), f"{base}/classes")
    chunk = F.pmod("h1", F.ceil(F.col("w") / F.lit(CHUNK)))
    fewest = Window.partitionBy("b", chunk).orderBy("n", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    may_lack = F.col("w") - F.floor(least(F.col("df"), low)) - 1
    some = terms.withColumn("before", F.coalesce(F.sum("m").over(fewest), F.lit(0))).where(F.col("before") <= may_lack)
    pairs = some.join(entities.select("h1", "h2", "a", "df_e"), ["h1", "h2"]).where(F.least("df_e", "w") > least(F.col("df"), low)).select("a", "b", "df", "df_e").distinct()
    both = pairs.join(terms.select("b", "h1", "h2", "m"), "b").join(entities.select("a", "h1", "h2"), ["a", "h1", "h2"])
    counted = both.groupBy("a", "b", "df", "df_e").agg(F.sum("m").alias("c"))
    part = F.col("df_e") / F.lit(float(total))  # P(e): half of the bits are told where P(e | t) is its root
    told = counted.where(F.col("c") > least(F.col("df"), F.greatest(low, F.pow(part, 0.5)))).select("a", "b", (F.col("c") > least(F.col("df"), F.greatest(F.lit(REMOVE), F.pow(part, 0.25)))).alias("remove"))
    told = written(told, f"{base}/told")
    places = told.join(entities.select("a", "h1", "h2"), "a").groupBy("h1", "h2", "b").agg(F.max("remove").alias("remove"))
    return places.join(terms.select("h1", "h2", "b"), ["h1", "h2", "b"]).join(known.select("b", "t"), "b").select("h1", "h2", "t", "remove")


def _located(rows: DataFrame) -> DataFrame:
    """h1, h2 and terms (s, f, remove): every place of the wanted terms (h1, h2, text, wanted) in a text, outside base spans."""

    def places(block: Block, i: int, wanted: pa.Array, keep: list) -> int:
        t, remove = (np.asarray(wanted.field(k)) for k in (0, 1))
        order = np.argsort(t)
        t, remove = t[order], remove[order]
        spans = np.array([(s, f) for _, s, f, _ in _scan(_text(block, i))], np.int64).reshape(-1, 2)
        one = Block(0, block.data[block.offsets[i] : block.offsets[i + 1]], np.array([0, block.offsets[i + 1] - block.offsets[i]]))
        zero, total = 0, 0
        for piece in _pieces(one):
            h, _, start, end = _terms(piece)
            points = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
            a, b = points[start] + zero, points[end] + zero
            step = np.zeros(len(a) + 1, np.int64)
            np.add.at(step, np.searchsorted(b, spans[:, 0], side="right"), 1)
            np.add.at(step, np.searchsorted(a, spans[:, 1]), -1)
            at = np.minimum(np.searchsorted(t, h.view(np.int64)), len(t) - 1)
            some = np.flatnonzero((t[at] == h.view(np.int64)) & (np.cumsum(step[:-1]) == 0))
            keep.append((a[some], b[some], remove[at[some]]))
            zero, total = zero + int(points[-1]), total + len(some)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                keep: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
                size = [places(block, i, batch.column(3)[block.first + i].values, keep) for i in range(len(block))]
                s, f, remove = (np.concatenate(x) for x in zip(*keep))
                structs = pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(remove.astype(bool))], names=["s", "f", "remove"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), structs)
                yield pa.record_batch([*(batch.column(k).slice(block.first, len(block)) for k in (0, 1)), lists], names=["h1", "h2", "terms"])

    return rows.mapInArrow(run, f"h1 long, h2 long, terms {TERMS}")


def _terms_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `_found` has of docs (h1, h2, the hashes of the text, and text), written; and by hashes, the terms (s, f, remove) that reveal an entity."""
    spark, base = docs.sparkSession, folder(docs.sparkSession)
    found = written(_found(docs), f"{base}/found")
    entities = _entities(found, base)
    keys = _small(entities.groupBy("h1", "h2", "m").agg(F.count(F.lit(1)).alias("n")), f"{base}/keys")
    total, size = found.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not entities.limit(1).count():
        return found, spark.createDataFrame([], f"h1 long, h2 long, terms {TERMS}")
    held = found.where(F.col("held").isNotNull()).select("h1", "h2", "held").join(keys, ["h1", "h2"])
    held = written(held.groupBy("h1", "h2", "m", "n").agg(F.first("held").alias("text")), f"{base}/held")
    rows = written(_emitted(held), f"{base}/rows")
    wanted = _disclosing(entities, rows, docs, total, max(16, int(size or 0) // (8 * BUCKET_ROWS)), base)
    wanted = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("t", "remove")).alias("wanted"))
    located = _located(held.select("h1", "h2", "text").join(wanted, ["h1", "h2"]).select("h1", "h2", "text", "wanted"))
    return found, _small(located.where(F.size("terms") > 0), f"{base}/located")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(F.lit(7), text, F.lit(11)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined; terms last) of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found, terms = _terms_of(_hashed(slim, "text"))
    out = found.join(terms, ["h1", "h2"], "left")
    places = F.array_sort(F.array_distinct(F.transform(F.coalesce("terms", F.array().cast(TERMS)), lambda x: F.struct(x["s"].alias("s"), x["f"].alias("f")))))
    told = F.transform(places, lambda x: F.concat(F.lit("term:"), x["s"].cast("string"), F.lit(":"), x["f"].cast("string")))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size(told) > 0, F.array_join(told, ","))).alias("spans"),
    )


def replaced(text: str, base: list[tuple[str, int, int, str]], terms) -> str:
    """The text with base spans as placeholders, and terms removed or generalised; overlapping spans are one."""
    marks = [(s, f, f"[{kind.upper()}]") for kind, s, f, _ in base]
    gone = {(t["s"], t["f"]) for t in terms or () if t["remove"]}
    marks += [(s, f, "" if (s, f) in gone else "[TERM]") for s, f in {(t["s"], t["f"]) for t in terms or ()}]
    out, at = [], 0
    for s, f, mark in sorted(marks):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, f)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts; all columns stay, and texts without spans are as they were.

    Terms are joined by two hashes of the text; texts without any aren't moved while the terms' table has at most BROADCAST_ROWS rows.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = _hashed(docs.select(row), "row.text")
    _, terms = _terms_of(keyed.select("h1", "h2", F.coalesce("row.text", F.lit("")).alias("text")))
    out = keyed.join(terms, ["h1", "h2"], "left").select("row", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(0).field(names.index("text")), batch.column(1).to_pylist()
            new: list[str | None] = [None] * batch.num_rows
            for block in blocks(texts):
                for i in _likely(block):
                    text = texts[block.first + i].as_py()
                    spans_there = base_spans(text)
                    if spans_there:
                        new[block.first + i] = replaced(text, spans_there, found[block.first + i])
            yield pa.record_batch([batch.column(0), pa.array(new, pa.string())], names=["row", "new"])

    done = out.mapInArrow(run, T.StructType([out.schema["row"], T.StructField("new", T.StringType())]))
    return done.select(*[F.coalesce("new", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
