"""Exact Jaccard join of documents on word shingles by parity sketches.

A document's set is its distinct shingles of five lower-cased words (fewer
words: the whole sequence; no words: empty, linked with nothing). Two documents
link when 100 * intersection >= 75 * union.

1. Documents of equal sets are one class; from here on classes take part, so a
   group of copies of any size costs one.
2. Parity sketch: shingles are hashed to the lanes of a sketch, and each flips
   (XORs) a pattern in its lane; a lane's word is the parity of what it holds.
   The number of lanes in which two sketches differ is a Hamming distance that
   never exceeds the symmetric difference of the sets, which for linked sets is
   at most h = n // 3 with n the size of either. By the pigeonhole principle two
   linked classes agree in all but h of the lanes that either fills. Taking
   filled lanes in one order for all, each class shows its first h + k, with
   k = 1 + n // 10, and linked classes meet in at least k of them (prefix
   filter). Lanes that hold nothing but shingles that are frequent in a sample
   come last in that order, so a passage that many documents share isn't where
   they meet. The order decides cost only, never results.
   Size bands: a class of n shingles has the number of lanes of its band (sizes
   within a factor of 8) and, where a linked set may be in the next band, that
   band's too. A weak class, which fills fewer than h + k lanes, shows all; one
   that fills h or fewer shows a plain prefix of its shingles as well, where two
   such classes meet.
3. Shown lanes are dealt by hash as packed blobs. Classes that agree in one are a
   group; a group is known by a signature of its members, so that one group
   that agrees in many lanes is told once. A partition that sees more than LOCAL
   classes of a lane tells that group itself and passes one member on, so that
   a frequent lane is thinned before the shuffle.
4. A class that meets others in fewer lanes than k for the smallest set it
   could link to, and never a weak class, links with nothing. Of the rest, each
   group's candidates are a star around its smallest class. They pass if sizes
   and a second sketch of 1024 one-bit lanes (whose Hamming distance is again a
   lower bound) allow, and are verified by their texts' sets: first each class
   with the hub it meets most often, then, of the rest, the pairs that aren't in
   one component by then.
5. Where a group isn't one component after that, every pair of it from different
   components is compared, by blocks of BLOCK members, by sizes and bit
   sketches: first, each component's nearest such pair of a block is verified and
   components grow (ROUNDS times); then all that pass, and that meet in k lanes of all
   groups together, are verified. So no link between components is lost, and no group is expanded
   into all its pairs.

Shingles are 64-bit hashes, classes 128-bit ones (set and size).

A star's texts are dealt to its hub by chunks of about SPOKES, each with the hub's text
once, so a hub of any size is split and its text is read once for a chunk.

Defined results: every row is a document of its own, so rows that repeat an id
with other texts may be in other components, and equal rows are copies; `link` leaves
out rows with a null id, `kept` keeps them; null text is empty; empty tables give no rows;
other columns are ignored by `link`, and kept, with their names, by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..scratch import folder, written
from ._bytes import U64, blocks, mix, shingles
from ._joins import met

WIDTH = 5
PERCENT = 75
LOCAL, BLOCK, SMALL = 64, 1024, 16
CELL_ROWS = 20_000
WEAK = 1 << 40
BAND = 8
SKETCH = 1024
FLUSH = 400_000
BUCKET_ROWS = 400_000
ROUNDS = 1
SAMPLE = 4096
FREQUENT = 0.002
SPOKES = 256
KEY = ["doc_id", "h1", "h2"]
SETS = "doc_id long, h1 long, h2 long, n long, c long, c2 long, sketch binary"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def class_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set of shingles."""
    n = np.diff(offsets).astype(U64)
    return mix(_sums(mix(values.copy()), offsets) + n), mix(_sums(mix(values ^ U64(0x5BD1E9955BD1E995)), offsets) ^ n)


def bit_sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One-bit lanes: each row's 1024 parities, as bytes; so many rows at a time that counts stay small."""
    out: list[bytes] = []
    for at in range(0, len(offsets) - 1, SKETCH):
        some = offsets[at : at + SKETCH + 1]
        rows = len(some) - 1
        lane = (values[some[0] : some[-1]] >> U64(20)) % U64(SKETCH)
        row = np.repeat(np.arange(rows), np.diff(some))
        odd = np.bincount(row * SKETCH + lane.astype(np.int64), minlength=rows * SKETCH).reshape(rows, SKETCH) & 1
        out += [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]
    return out


def _bands(n: np.ndarray) -> np.ndarray:
    """The band of each size: sizes from 8**band on."""
    return (np.log2(np.maximum(n, 1)) / 3 + 1e-12).astype(np.int64)


def met_at_least(n):
    """In how many shown lanes a set of this size meets a linked one that isn't smaller."""
    return 1 + n // 10


def shown(values: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that each row shows, the row of each, and whether that row is weak."""
    n = np.diff(offsets)
    rows = np.arange(len(n))
    band = _bands(n)
    top = BAND ** (band + 1)
    twice = (n > 0) & (100 * n >= PERCENT * top)
    common = np.isin(values, frequent) if len(frequent) else np.zeros(len(values), bool)
    keys, owners, weak = [], [], []
    for which, step in ((rows[n > 0], 0), (rows[twice], 1)):
        if not len(which):
            continue
        size = n[which]
        total = np.cumsum(size)
        at = np.repeat(offsets[which] - (total - size), size) + np.arange(total[-1])
        row = np.repeat(which, size)
        scheme = band[row] + step
        lanes = (BAND ** (scheme + 1)).astype(U64)
        v = values[at]
        lane = (v >> U64(7)) % lanes
        order = np.lexsort((lane, row))
        row, lane, word, scheme, rare = row[order], lane[order], mix(v[order] ^ U64(0x6A09E667F3BCC909)), scheme[order], ~common[at][order]
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lane[1:] != lane[:-1])]))
        parity = np.bitwise_xor.reduceat(word, cut)
        plain = ~np.logical_or.reduceat(rare, cut)
        row = row[cut]
        key = mix(mix(parity ^ (lane[cut] << U64(6)) ^ scheme[cut].astype(U64)) + plain.astype(U64))
        order = np.lexsort((key, plain, row))
        row, key = row[order], key[order]
        filled = np.bincount(row, minlength=len(n))
        rank = np.arange(len(row)) - (np.cumsum(filled) - filled)[row]
        wanted = n // 3 + met_at_least(n)
        keep = rank < wanted[row]
        keys.append(key[keep])
        owners.append(row[keep])
        weak.append((filled < wanted)[row[keep]])
        few = (filled <= n // 3) & (filled > 0)
        if few.any():
            row = np.repeat(rows, n)
            pick = few[row]
            row, v, late = row[pick], values[pick], common[pick]
            order = np.lexsort((v, late, row))
            row, v = row[order], v[order]
            count = np.bincount(row, minlength=len(n))
            rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            keep = rank <= n[row] - (PERCENT * n[row] + 99) // 100
            keys.append(mix(v[keep] ^ U64(0xA54FF53A5F1D36F1)))
            owners.append(row[keep])
            weak.append(np.ones(int(keep.sum()), bool))
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(weak)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sets(docs: DataFrame) -> DataFrame:
    """Key (id, hashes of the text), n, class (c, c2) and bit sketch of each document (doc_id, text, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values, offsets = shingles(block.words(), WIDTH)
                c, c2 = class_ids(values, offsets)
                bits = bit_sketches(values, offsets)
                yield pa.record_batch(
                    [*(batch.column(k).slice(block.first, len(block)) for k in (0, 2, 3)), pa.array(np.diff(offsets)), _long(c), _long(c2), pa.array(bits, pa.binary())],
                    names=[*KEY, "n", "c", "c2", "sketch"],
                )

    return docs.mapInArrow(run, SETS)


def frequent_shingles(docs: DataFrame, sample: int = SAMPLE, share: float = FREQUENT) -> np.ndarray:
    """Shingles in more than this share of about so many texts, picked by hash: at most (shingles a text) / share of them."""
    spark = docs.sparkSession
    every = max(1, -(-docs.count() // sample))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values, offsets = shingles(block.words(), WIDTH)
                c, _ = class_ids(values, offsets)
                yield pa.record_batch([_long(np.repeat(c, np.diff(offsets))), _long(values)], names=["c", "h"])

    pairs = some.mapInArrow(run, "c long, h long").distinct()
    least = max(4, int(sample * share))
    rows = pairs.groupBy("h").count().where(F.col("count") >= least).select("h").toPandas()
    del spark
    return np.unique(rows["h"].to_numpy(dtype=np.int64).view(U64))


def _groups(keys: np.ndarray, classes: np.ndarray, weak: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, class) rows: signature, class and number of lanes of each group of two or more, each once. Hot keys are signatures, and their groups may be of one."""
    order = np.lexsort((classes, keys))
    keys, classes, weak = keys[order], classes[order], weak[order]
    if len(keys):
        keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])
        keys, classes, weak = keys[keep], classes[keep], weak[keep]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(classes.view(U64).copy()))])
    signature = mix(total[first + size] - total[first] + size.astype(U64))
    own = np.isin(keys[first], hot)
    signature[own] = keys[first][own]
    frail = np.concatenate([[0], np.cumsum(weak)])
    lanes = np.where(frail[first + size] > frail[first], WEAK, 1)
    large = np.flatnonzero((size > 1) | own)
    which, at, of = np.unique(signature[large], return_index=True, return_inverse=True)
    times = np.bincount(of.reshape(-1), weights=lanes[large], minlength=len(which)).astype(np.int64)
    large = large[at]
    member = np.repeat(first[large], size[large]) + _counting(size[large])
    return np.repeat(which, size[large]).view(np.int64), classes[member], np.repeat(times, size[large])


def _counting(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and how often it came."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.diff(np.append(first, len(a)))


def groups(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """k (a group), c (a class of it) and lanes (in how many it agrees; WEAK and more where a weak class does)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            k, c, w = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, k))
            k, c, w = k[order], c[order], w[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            group = np.cumsum(first) - 1
            hot = (np.bincount(group) > LOCAL)[group]
            told = k[hot], c[hot], w[hot]
            thin = ~hot | first
            k, c, w = k[thin], c[thin], w[thin]
            of, told_of = ((x % U64(buckets)).astype(np.int64) for x in (k, told[0]))
            order = np.argsort(of, kind="stable")
            k, c, w, of = k[order], c[order], w[order], of[order]
            rows = []
            for q in np.unique(np.concatenate([of, told_of])):
                lo, hi = np.searchsorted(of, [q, q + 1])
                mine = told_of == q
                rows.append((int(q), *(x[lo:hi].tobytes() for x in (k, c, w)), *(x[mine].tobytes() for x in told)))
            types = [pa.int64()] + [pa.binary()] * 6
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["bucket", "k", "c", "w", "hk", "hc", "hw"])

        for batch in batches:
            for block in blocks(batch.column(1)):
                values, offsets = shingles(block.words(), WIDTH)
                ids = class_ids(values, offsets)[0].view(np.int64)
                new = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen and offsets[i + 1] > offsets[i]:
                        seen.add(x)
                        new[i] = True
                size = np.diff(offsets)
                values = values[np.repeat(new, size)]
                k, row, w = shown(values, np.concatenate([[0], np.cumsum(np.where(new, size, 0))]), shared.value)
                parts.append((k, ids[row], w))
                held += len(k)
                if held >= FLUSH:
                    yield flush()
                    parts, held = [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        join = lambda name, t: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=t)
        hot, members, weak = join("hk", U64), join("hc", np.int64), join("hw", bool)
        k, c, lanes = _groups(join("k", U64), join("c", np.int64), join("w", bool), np.unique(hot))
        k, c, lanes = np.concatenate([k, hot.view(np.int64)]), np.concatenate([c, members]), np.concatenate([lanes, np.where(weak, WEAK, 1)])
        return pa.table({"k": pa.array(k), "c": pa.array(c), "lanes": pa.array(lanes, pa.int64())})

    blobs = docs.mapInArrow(emit, "bucket long, k binary, c binary, w binary, hk binary, hc binary, hw binary")
    return blobs.groupBy("bucket").applyInArrow(meet, "k long, c long, lanes long").groupBy("k", "c").agg(F.sum("lanes").alias("lanes"))


def _promising(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The groups' classes that meet others often enough to link with any."""
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100)) / F.lit(10))
    often = found.groupBy("c").agg(F.sum("lanes").alias("all")).join(classes.select("c", "n"), "c").where(F.col("all") >= least).select("c")
    return found.join(often, "c").select("k", "c", "lanes")


def _stars(members: DataFrame) -> DataFrame:
    """a < b and met: each class with the smallest of each of its groups."""
    hubs = members.groupBy("k").agg(F.min("c").alias("a"))
    return members.join(hubs, "k").where(F.col("a") != F.col("c")).groupBy("a", F.col("c").alias("b")).agg(F.sum("lanes").alias("met"))


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches allow."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    n_a, n_b = F.col("na"), F.col("nb")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = [np.frombuffer(b"".join(batch.column(k).to_pylist()), U64).reshape(-1, SKETCH // 64) for k in (2, 3)]
                apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
                total = np.asarray(batch.column(4))
                keep = (100 + PERCENT) * apart <= (100 - PERCENT) * total
                yield pa.record_batch([batch.column(k).filter(pa.array(keep)) for k in range(2)], names=["a", "b"])

    return joined.select("a", "b", "sa", "sb", (n_a + n_b).alias("total")).mapInArrow(run, "a long, b long")


def _texts(classes: DataFrame, docs: DataFrame, copies: bool) -> DataFrame:
    """c and text of each of the classes (c, rep). copies: whether rows share a key."""
    texts = docs.join(classes.select("c", "rep.*"), KEY).select("c", "text")
    return texts.dropDuplicates(["c"]) if copies else texts


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs whose texts' sets link. A hub's text comes first, before those of a chunk of its spokes."""
    side = lambda x: texts.select(F.col("c").alias(x), "text")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPOKES)).cast("int").alias("chunks"))
    spokes = pairs.select("a", "b").join(hubs, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    spokes = spokes.join(side("b"), "b").select("a", "chunk", "b", "text")
    heads = hubs.join(side("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, U64)
        for batch in batches:
            b = batch.column(2)
            first = np.asarray(b.is_null())
            keep = np.zeros(len(first), bool)
            for block in blocks(batch.column(3)):
                values, offsets = shingles(block.words(), WIDTH)
                for i in range(len(block)):
                    own = values[offsets[i] : offsets[i + 1]]
                    if first[block.first + i]:
                        hub = own.copy()
                        continue
                    inner = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum()) if len(hub) else 0
                    keep[block.first + i] = inner > 0 and 100 * inner >= PERCENT * (len(hub) + len(own) - inner)
            yield pa.record_batch([x.filter(pa.array(keep)) for x in (batch.column(0), b)], names=["a", "b"])

    dealt = heads.unionByName(spokes).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _couples(gid: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each cell, some at a time: all of a block's members with each other, or those of two blocks across. Rows are sorted by cell."""
    first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    size = np.diff(np.append(first, len(gid)))
    small = (size <= SMALL) & (i[first] == j[first])
    for g in np.unique(size[small & (size > 1)]):
        x, y = np.triu_indices(g, 1)
        at = first[small & (size == g)]
        step = max(1, 200_000 // len(x))
        for k in range(0, len(at), step):
            yield (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
    for f, g in zip(first[~small], size[~small]):
        rows = np.arange(f, f + g)
        left, right = rows[own[rows] == i[f]], rows[own[rows] == j[f]]
        for k in range(0, len(left), 128):
            x, y = np.repeat(left[k : k + 128], len(right)), np.tile(right, len(left[k : k + 128]))
            keep = (x < y) | (i[f] != j[f])
            yield x[keep], y[keep]


def _unresolved(members: DataFrame, labels: DataFrame, classes: DataFrame, nearest: bool) -> DataFrame:
    """Pairs from different components within a group, as sizes and bit sketches allow, that meet in as many lanes as linked ones must.

    nearest: of each component in a block, only the pair that differs in the fewest bits.
    """
    known = members.join(labels, members["c"] == labels["node"], "left").select("k", "c", "lanes", F.coalesce("component", "c").alias("component"))
    open_groups = known.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("g")).where(F.col("lo") != F.col("hi"))
    cells = F.ceil(F.col("g") / F.lit(BLOCK)).cast("int")
    dealt = known.join(open_groups.select("k", cells.alias("cells")), "k").join(classes.select("c", "n", "sketch"), "c").withColumn("own", F.pmod(F.xxhash64("c"), F.col("cells")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "component", "n", "lanes", "sketch")
    buckets = max(16, members.count() // CELL_ROWS)

    def compare(table: pa.Table) -> pa.Table:
        k, i, j, own, c, component, n, lanes = (table.column(x).to_numpy() for x in ("k", "i", "j", "own", "c", "component", "n", "lanes"))
        order = np.lexsort((c, j, i, k))
        k, i, j, own, c, component, n, lanes = (x[order] for x in (k, i, j, own, c, component, n, lanes))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U64).reshape(-1, SKETCH // 64)[order]
        gid = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        found = []
        for x, y in _couples(gid, own, i, j):
            keep = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
            x, y = x[keep], y[keep]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            keep = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[x] + n[y])
            found.append((x[keep], y[keep], apart[keep]))
        x, y, apart = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        a, b = np.minimum(c[x], c[y]), np.maximum(c[x], c[y])
        if nearest and len(x):
            pair, side = np.tile(np.arange(len(x)), 2), np.concatenate([component[x], component[y]])
            order = np.lexsort((b[pair], a[pair], apart[pair], side, gid[x][pair]))
            of, who = gid[x][pair][order], side[order]
            best = np.unique(pair[order[np.concatenate([[True], (of[1:] != of[:-1]) | (who[1:] != who[:-1])])]])
            x, y, a, b = x[best], y[best], a[best], b[best]
        columns = (a, b, np.minimum(lanes[x], lanes[y]), met_at_least(np.minimum(n[x], n[y])))
        if len(a):  # one row for each pair
            order = np.lexsort((b, a))
            a, b, met, least = (z[order] for z in columns)
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            columns = (a[first], b[first], np.add.reduceat(met, first), least[first])
        return pa.table({name: pa.array(z, pa.int64()) for name, z in zip(("a", "b", "met", "least"), columns)})

    found = dealt.groupBy(F.pmod(F.xxhash64("k", "i", "j"), F.lit(buckets)).alias("bucket")).applyInArrow(compare, "a long, b long, met long, least long")
    if nearest:
        return found.select("a", "b").distinct()
    return found.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where(F.col("met") >= F.col("least")).select("a", "b")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, h1, h2 of the documents with an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.lit(11)).alias("h2"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The sets of keyed documents, without sketches; c, c2, n, component (a class) and the smallest doc_id of it, for each class; whether rows share a key."""
    base = folder(docs.sparkSession)
    own = written(sets(docs), f"{base}/sets")
    full = own.where("n > 0")
    copies = bool(full.groupBy(*KEY).count().where("count > 1").limit(1).count())
    classes = written(full.groupBy("c", "c2", "n").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows")), f"{base}/classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(total / 2 / BUCKET_ROWS))
    found = written(groups(docs, frequent_shingles(docs), buckets), f"{base}/groups")
    members = written(_promising(found, classes), f"{base}/members")
    stars = written(_stars(members), f"{base}/stars")
    texts = written(_texts(classes.join(members.select("c").distinct(), "c"), docs, copies), f"{base}/texts")
    most = stars.groupBy("b").agg(F.max(F.struct("met", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = written(_verified(_sifted(most, classes), texts), f"{base}/links")
    labels = components(links, "a", "b")
    rest = _between(stars.select("a", "b").join(most, ["a", "b"], "left_anti"), labels)
    links = written(links.unionByName(_verified(_sifted(rest, classes), texts)), f"{base}/rest")
    labels = components(links, "a", "b")
    for k in range(ROUNDS + 1):
        more = written(_unresolved(members, labels, classes, nearest=k < ROUNDS).join(links, ["a", "b"], "left_anti"), f"{base}/more{k}")
        if not more.limit(1).count():
            break
        found = written(_verified(more, texts), f"{base}/found{k}")
        if found.limit(1).count():
            links = written(links.unionByName(found), f"{base}/links{k}")
            labels = components(links, "a", "b")
    linked = classes.select("c", "c2", "n", "rep", "rows").join(labels.withColumnRenamed("node", "c"), "c", "left")
    several = written(linked.where(F.col("component").isNotNull()), f"{base}/several")
    least = written(several.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("of")), f"{base}/least")
    alone = linked.where(F.col("component").isNull()).select("c", "c2", "n", "rows", F.col("rep").alias("least"))
    return own.drop("sketch"), written(alone.unionByName(met(several, least, ["component"], "of").select(*alone.columns)), f"{base}/named"), copies


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document."""
    own, classes, _ = _classes(_keyed(docs))
    return met(own, classes, ["c", "c2", "n"], "rows").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents, one of each linked group: that with the smallest id (of those, the smallest hash of the text; of equal rows, any). All columns stay; rows without an id or without words stay."""
    own, classes, copies = _classes(_keyed(docs))
    least = classes.select("least.*").distinct()
    others = own.where("n > 0").join(least, KEY, "left_anti").select(*KEY).distinct()
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.lit(11)).alias("h2")).join(others, KEY, "left_anti")
    if copies:
        again = written(own.where("n > 0").groupBy(*KEY).count().where("count > 1").select(*KEY))
        rows = rows.join(again, KEY, "left_anti").unionByName(rows.join(again, KEY, "left_semi").dropDuplicates(KEY))
    return rows.select("row.*")
