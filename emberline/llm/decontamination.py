"""Benchmark decontamination: size-partitioned MinHash containment search.

DataFrame functions only. Texts are lower-cased and split at ASCII white space;
their sets are the distinct shingles of five words (fewer words: the whole
sequence is the one shingle). An item is found in a document when at least
THRESHOLD of its distinct shingles occur there.

Search: an item's MinHash sketch is its bottom-k sketch, the k smallest of its
shingle hashes, with k fixed by the item's size: an item of n shingles that is
contained to the threshold misses at most m = n - ceil(threshold * n) of them,
so a sketch of k = m + 1 always meets the document, whatever the document's
length; containment is not diluted by it the way a resemblance would be. So items
are partitioned by size, each partition with its own sketch length. A document looks up only
those of its hashes that are within the largest of all sketches, and only in the
sketches; what it meets there are candidates, and nothing else is looked at again.

Verification: the texts of the candidates' documents are read once more, and the
exact shingles (compared as strings) that item and document share are counted.

What is shuffled in the search is one row for each (document, item) that meet, as both
sketches and shingles are broadcast when the benchmark has at most BROADCAST_ROWS
shingles; beyond, (id, hash) rows are joined by a shuffle in which every hash
is split over SALTS tasks, for passages that many documents hold.

Defined results: null and empty texts hold nothing and match nothing; rows with
a null id take no part; a document whose id is repeated counts as the union of
its rows; repeated items are one item where texts are equal and the union of
their shingles where they differ; other columns are ignored. An item of fewer than five
words is one shingle of so many words, and found only in a document that
consists of just those; it isn't searched inside longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import folder, written

WIDTH = 5
THRESHOLD = 0.75
BROADCAST_ROWS = 200_000
CANDIDATE_ROWS = 20_000
SALTS = 16
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words of a text; one empty word for a null or blank text."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES)), SPACE)


def shingles(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """id, w (the words), pos (0-based), h (hash): one row per shingle, repeats included; w isn't copied for each while the plan is one piece of generated code."""
    w = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where(F.col("id").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(width), F.lit(0)))
    at = w.select("id", "w", F.explode_outer(starts).alias("pos"))  # never empty; outer: no filter is inferred that would split the text again
    return at.where(F.get("w", F.col("pos")) != "").withColumn("h", F.xxhash64(*[F.get("w", F.col("pos") + k) for k in range(width)]))


def _text(width: int) -> Column:
    return F.concat_ws(" ", *[F.get("w", F.col("pos") + k) for k in range(width)])


def sketched(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, h, shingle, n_item, need and in_sketch for each distinct shingle of each item."""
    distinct = shingles(items, id_col, text_col, width).select(F.col("id").alias("item_id"), "h", _text(width).alias("shingle")).distinct()
    whole = Window.partitionBy("item_id")
    need = F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).cast("long")
    rank = F.row_number().over(whole.orderBy("h", "shingle"))
    sized = distinct.withColumn("n_item", F.count(F.lit(1)).over(whole)).withColumn("need", need)
    return sized.withColumn("in_sketch", rank <= F.col("n_item") - F.col("need") + 1)


def _looked_up(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows (doc_id, h, ...) joined with table (h, ...): by a broadcast, or by a shuffle in which a hash is split."""
    if small:
        return rows.join(F.broadcast(table), "h")
    dealt = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"]).drop("salt")


def probed(docs: DataFrame, sketch: DataFrame, small: bool, width: int = WIDTH) -> DataFrame:
    """doc_id, h, item_id for each shingle of a document that is in the sketch (h, item_id) of an item."""
    largest = sketch.agg(F.max("h")).first()[0]
    rows = shingles(docs, "doc_id", "text", width).where(F.col("h") <= F.lit(largest).cast("long"))
    return _looked_up(rows.select(F.col("id").alias("doc_id"), "h"), sketch, small)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for each document that holds an item to the threshold."""
    base = folder(docs.sparkSession)
    known = written(sketched(items, width=width, threshold=threshold), f"{base}/known")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = written(probed(docs, known.where("in_sketch").select("h", "item_id").distinct(), small, width).select("doc_id", "item_id").distinct(), f"{base}/met")
    few = met.limit(CANDIDATE_ROWS + 1).count() <= CANDIDATE_ROWS
    told = F.broadcast if few else (lambda x: x)
    texts = docs.select("doc_id", "text").join(told(met.select("doc_id").distinct()), "doc_id", "left_semi")
    exact = shingles(texts, "doc_id", "text", width).select(F.col("id").alias("doc_id"), "h", _text(width).alias("said"))
    shared = _looked_up(exact, known.select("item_id", "h", "shingle", "n_item", "need"), small)
    once = shared.where(F.col("said") == F.col("shingle")).select("doc_id", "item_id", "n_item", "need", "shingle").distinct().join(told(met), ["doc_id", "item_id"], "left_semi")
    return once.groupBy("doc_id", "item_id", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= F.col("need")).select("doc_id", "item_id", "n_item", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item; all their columns stay. A document without an id stays."""
    return docs.join(contaminated(docs, items, threshold).select("doc_id").distinct(), "doc_id", "left_anti")
