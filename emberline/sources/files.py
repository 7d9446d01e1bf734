"""Files as tables: images, labels, manifests, event logs and tick records; and their sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as label_text
from ..functions import names
from ..schemas import EVENT, MANIFEST, TICK
from ..scratch import written

IMAGES = (".jpg", ".jpeg", ".png")
CORRUPT = "_corrupt_record"


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def parent(path: Column | str, up: int = 1) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1 - up)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"/[^/]*$", "")


def is_image(path: Column | str) -> Column:
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(r"\.(jpg|jpeg|png)$")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of the files below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "modificationTime", "length")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """The images in a directory, with file_ix by path."""
    rows = listing(spark, root, recursive=False).where(is_image("path"))
    return rows.withColumn("file_ix", F.row_number().over(Window.orderBy("path")) - 1)


def frames(spark: SparkSession, root: str) -> DataFrame:
    """image and seq of a directory's decodable images in the order of their names; undecodable ones are left out and take no number."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(root)
    return rows.withColumn("seq", F.row_number().over(Window.orderBy(basename("image.origin"))) - 1)


def tick_frames(spark: SparkSession, root: str, interval_s: float, base_ts: float = 1.7e9) -> DataFrame:
    """tick (the index of the file, so undecodable files leave gaps), timestamp and image."""
    files = image_files(spark, root).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), F.col("file_ix").alias("tick"))
    images = spark.read.format("image").option("dropInvalid", "true").load(root).withColumn("p", F.regexp_replace("image.origin", "^file:/+", "/"))
    return images.join(files, "p").select("tick", (F.lit(base_ts) + F.col("tick") * interval_s).alias("timestamp"), "image")


def source_kind(spec: str) -> str:
    """device, http, replay or unknown, for a source's address."""
    if spec.isdigit():
        return "device"
    if spec.startswith(("http://", "https://")):
        return "http"
    if os.path.isdir(spec):
        return "replay"
    raise ValueError(f"no source: {spec}")


def labelled(spark: SparkSession, root: str) -> DataFrame:
    """path, stem, label_text (null where missing), row count and suffix mark of an export: images in directories named images beside labels/<stem>.txt."""
    files = listing(spark, root)
    images = files.where(is_image("path") & (parent("path") == "images")).select("path", directory(directory(F.col("path"))).alias("dir"), names.stem(basename("path")).alias("stem"), names.has_suffix(basename("path")).alias("rf_matched"))
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).select("value", F.col("_metadata.file_path").alias("p"))
    texts = texts.where(parent("p") == "labels").select(directory(directory(F.col("p"))).alias("dir"), names.stem(basename("p")).alias("stem"), F.col("value").alias("label_text"))
    out = images.join(texts, ["dir", "stem"], "left")
    return out.withColumn("source_stem", names.source_id(basename("path"))).withColumn("n_rows", F.size(label_text.rows("label_text"))).withColumn("missing", F.col("label_text").isNull())


def reference(spark: SparkSession, root: str) -> DataFrame:
    """Any image below a reference root, without labels."""
    return listing(spark, root).where(is_image("path")).select("path", names.stem(basename("path")).alias("stem"), names.has_suffix(basename("path")).alias("rf_matched"))


def export_info(path: str) -> tuple[list[str], str | None]:
    """Class names (a list, or a table sorted by number) and licence of an export's descriptor; unreadable names are an error."""
    import yaml

    with open(path, encoding="utf-8") as file:
        data = yaml.safe_load(file)
    found = data.get("names") if isinstance(data, dict) else None
    if isinstance(found, dict):
        found = [found[k] for k in sorted(found, key=int)]
    if not isinstance(found, list) or not found:
        raise ValueError(f"{path} names no classes")
    extra = data.get("roboflow") if isinstance(data.get("roboflow"), dict) else {}
    return [str(x) for x in found], extra.get("license") or data.get("license")


def pooled(parts: list[tuple[int, DataFrame]], name: str = "filename") -> DataFrame:
    """The union of splits by rank; of a name that several hold, the first stays, with n_copies."""
    rows = None
    for rank, df in parts:
        df = df.withColumn("split_rank", F.lit(rank))
        rows = df if rows is None else rows.unionByName(df)
    w = Window.partitionBy(name)
    return rows.withColumn("n_copies", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("split_rank"))).where("rn = 1").drop("rn")


def class_folders(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """path, split, class of <root>/<split>/<class>/ images."""
    rows = listing(spark, root).where(is_image("path")).select("path", parent("path", 2).alias("split"), parent("path").alias("class"))
    return rows.where(F.col("split") == split) if split else rows


def classes_of(folders: DataFrame) -> list[str]:
    """The class names, sorted; none is an error."""
    found = [r[0] for r in folders.select("class").distinct().orderBy("class").collect()]
    if not found:
        raise ValueError("no class directories")
    return found


def images_parquet(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    """label and bytes of a table of encoded images; only these columns are read, and the filter reaches the scan."""
    rows = spark.read.parquet(path)
    if label is not None:
        rows = rows.where(F.col("label") == label)
    return rows.select("label", F.col("image.bytes").alias("bytes"))


def first_urls(index: Column, config: str) -> Column:
    """split and its first address, from a JSON index of configurations, splits and address lists."""
    parsed = F.from_json(index, "map<string,map<string,array<string>>>")
    entries = F.map_entries(F.try_element_at(parsed, F.lit(config)))
    return F.transform(F.filter(entries, lambda e: F.size(e["value"]) > 0), lambda e: F.struct(e["key"].alias("split"), F.get(e["value"], F.lit(0)).alias("url")))


def summary(files: DataFrame) -> DataFrame:
    """Files by directory and extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(parent("path").alias("directory"), ext.alias("ext")).groupBy("directory", "ext").agg(F.count(F.lit(1)).alias("n"))


# JSON lines


def _lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows with their position in the file; lines that can't be read have the corrupt column."""
    text = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    kept = list(schema.fields)
    schema = T.StructType(list(kept))
    parsed = F.from_json("value", schema.add(CORRUPT, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return text.select("pos", "value", parsed.alias("r")).select("pos", "value", *[F.col(f"r.{f.name}").alias(f.name) for f in kept], F.col(f"r.{CORRUPT}").alias(CORRUPT))


def read_events(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The event log; broken lines are left out, a missing file is empty, last keeps the n last rows in their order (0: all)."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT)
    rows = _lines(spark, path, EVENT).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "value")
    if last:
        rows = rows.orderBy(F.desc("pos")).limit(last)
    return rows.orderBy("pos").drop("pos")


def write_events(events: DataFrame, path: str) -> None:
    """Append the rows that are actions, as JSON lines."""
    events.where(F.col("action") != "none").write.mode("append").json(path)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Tick records; a broken line is an error that shows it, missing gates passed, missing detections are none."""
    rows = _lines(spark, path, TICK)
    broken = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: broken line: "), F.col("value"))).cast("long")).otherwise(F.col("tick"))
    return rows.select(
        broken.alias("tick"), "timestamp", "p_raw", F.coalesce("gate_passed", F.lit(True)).alias("gate_passed"), "gate_reason", F.coalesce("detections", F.array().cast(TICK["detections"].dataType)).alias("detections")
    )


def write_ticks(ticks: DataFrame, path: str) -> None:
    ticks.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str, field: str) -> DataFrame:
    """filename and the field of a manifest; broken lines and rows without either are left out, the last of a name counts."""
    rows = _lines(spark, path, MANIFEST).where(F.col(CORRUPT).isNull() & F.col("output").isNotNull() & F.col(field).isNotNull())
    return rows.groupBy(basename("output").alias("filename")).agg(F.max_by(field, "pos").alias(field))


def write_dataset(records: DataFrame, path: str) -> None:
    """Records by split and class, as Parquet."""
    records.write.mode("overwrite").partitionBy("split", "class").parquet(path)


def write_manifest(records: DataFrame, path: str) -> None:
    records.select(*[f.name for f in MANIFEST.fields]).write.mode("overwrite").json(path)


def write_list(paths: DataFrame, path: str) -> None:
    """A list of files, one per line; an empty one is refused."""
    if not paths.limit(1).count():
        raise ValueError("an empty subset")
    paths.select("path").write.mode("overwrite").text(path)


def descriptor(classes: list[str], splits: tuple[str, ...] = ("train", "val", "test")) -> str:
    """A dataset's descriptor as YAML text."""
    return "".join(f"{s}: {s}/images\n" for s in splits) + f"nc: {len(classes)}\nnames: [{', '.join(classes)}]\n"


def save_images(images: DataFrame, root: str, write: Callable[[str, bytes], None]) -> DataFrame:
    """name and whether it was written, for rows (name, data); one that fails doesn't stop the others."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for name, data in zip(part["name"], part["data"]):
                try:
                    write(f"{root}/{name}", bytes(data))
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"name": part["name"], "written": done})

    return images.select("name", "data").mapInPandas(run, "name string, written boolean")


# retention


def to_prune(files: DataFrame, now: datetime, days: float, most: int, mtime: str = "modificationTime") -> DataFrame:
    """The files that go: those older than so many days, then those beyond the newest `most` of the rest. An unknown time is the oldest."""
    known = F.coalesce(F.col(mtime).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    cutoff = F.lit(now.astimezone(UTC).timestamp() - days * 86400)
    rows = files.withColumn("__t", known).withColumn("__old", F.unix_micros("__t") / 1e6 < cutoff)
    young = rows.where(~F.col("__old"))
    stays = young.orderBy(F.desc("__t"), "path").limit(most).select("path")
    return rows.where("__old").select("path").unionByName(young.join(stays, "path", "left_anti").select("path"))


def prune(spark: SparkSession, root: str, now: datetime, days: float, most: int) -> int:
    """Delete what to_prune names; the number that went. Files that can't be deleted count as kept."""
    gone = 0
    for row in written(to_prune(listing(spark, root, recursive=False), now, days, most)).toLocalIterator():  # what goes is settled before any file does
        path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False))
    return gone
