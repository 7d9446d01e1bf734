"""File names: source ids, group keys, time stamps and sequence numbers in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

#: Patterns of names, and the prefixes and class table of known sources: fixed values.
AUGMENTED = r"(?i)^(.+)\.rf\.[0-9a-f]+\.(?:jpg|jpeg|png)$"
AUGMENTED_STEM = r"(?i)^(.+)\.rf\.[0-9a-f]+$"
VARIANT = r"^(.+?)_(?:aug|original)$"
DASHED = r"(?<!\d)(\d{4})[-_](\d{2})[-_](\d{2})[-_ tT](\d{2})[-_:.](\d{2})[-_:.](\d{2})(?!\d)"
PACKED = r"(?<!\d)(\d{8})[-_ tT](\d{6})(?!\d)"
RUN = r"(?<!\d)(\d{14,17})(?!\d)"
CAPTURE = r"^Image_(\d{14})\d{3}(?=$|_)"
SEQUENCE = r"^(.*\D)?(\d{2,})(\D*)$"
PREFIXES = {"fdm_": "fdm", "hf_normal_": "hf_normal"}
CLASSES = ("spaghetti", "layer_separation", "bed_adhesion", "blob_of_death", "warping", "stringing", "zits", "head", "error_extrusion")
CATASTROPHIC = ("spaghetti", "layer_separation", "bed_adhesion", "blob_of_death")
SYNONYMS = {"layer split": "layer_separation"}


def stem(name: Column | str) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]*$", "")


def source_id(name: Column | str) -> Column:
    """The photo that an augmented file came from; its stem where the name has no augmentation suffix."""
    return F.when(col(name).rlike(AUGMENTED), F.regexp_extract(col(name), AUGMENTED, 1)).otherwise(stem(name))


def has_suffix(name: Column | str) -> Column:
    return col(name).rlike(AUGMENTED)


def capture_key(name: Column | str) -> Column:
    """A stem without its last variant mark, if anything is left of it."""
    return F.when(col(name).rlike(VARIANT), F.regexp_extract(col(name), VARIANT, 1)).otherwise(col(name))


def export_key(name: Column | str) -> Column:
    """A stem without its augmentation suffix."""
    return F.when(col(name).rlike(AUGMENTED_STEM), F.regexp_extract(col(name), AUGMENTED_STEM, 1)).otherwise(col(name))


def class_key(name: Column | str) -> Column:
    """A class name in lower case, with punctuation and white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(name))), r"[_\-/.]+", " "), r"\s+", " "))


def class_map() -> dict[str, str | None]:
    """Normalised class names by unified class."""
    return {c.replace("_", " "): c for c in CLASSES} | SYNONYMS


def mapped_class(name: Column | str, table: dict[str, str | None] | None = None) -> Column:
    """struct(outcome, class): mapped, dropped (known, without a class) or unmapped."""
    table = class_map() if table is None else table
    key = class_key(name)
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]) if table else F.create_map().cast("map<string,string>")
    known = F.map_contains_key(pairs, key)
    target = F.try_element_at(pairs, key)
    return F.struct(F.when(~known, "unmapped").when(target.isNull(), "dropped").otherwise("mapped").alias("outcome"), target.alias("class"))


def _parsed(digits: Column) -> Column:
    return F.when(F.length(digits) >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")))


def name_timestamp(name: Column | str) -> Column:
    """The time in a name, by the first of three shapes that is a real time; null otherwise."""
    c = col(name)
    dashed = F.concat(*[F.regexp_extract(c, DASHED, k) for k in range(1, 7)])
    packed = F.concat(F.regexp_extract(c, PACKED, 1), F.regexp_extract(c, PACKED, 2))
    return F.coalesce(_parsed(dashed), _parsed(packed), _parsed(F.regexp_extract(c, RUN, 1)))


def capture_timestamp(name: Column | str) -> Column:
    """The time in names of the shape Image_<17 digits>."""
    return _parsed(F.regexp_extract(col(name), CAPTURE, 1))


def sequence_key(name: Column | str) -> Column:
    """struct(family, number) by the last run of two digits or more; null without one."""
    c = col(name)
    family = F.concat(F.regexp_extract(c, SEQUENCE, 1), F.lit("|"), F.regexp_extract(c, SEQUENCE, 3))
    return F.when(c.rlike(SEQUENCE), F.struct(family.alias("family"), F.try_to_number(F.lpad(F.regexp_extract(c, SEQUENCE, 2), 38, "0"), F.lit("9" * 38)).cast("decimal(38,0)").alias("number")))


def prefix_source(name: Column | str, prefixes: dict[str, str] | None = None) -> Column:
    """The source whose prefix a name has, unknown without one; a dataset's own prefixes are given."""
    out = F.lit("unknown")
    for prefix, source in reversed((PREFIXES | (prefixes or {})).items()):
        out = F.when(F.startswith(col(name), F.lit(prefix)), source).otherwise(out)
    return out


def manifest_source(listed: Column, name: Column | str) -> Column:
    """The listed source, else the part before the first "__", else unknown (an empty source counts as none)."""
    prefix = F.when(F.contains(col(name), F.lit("__")), F.substring_index(col(name), "__", 1))
    return F.coalesce(F.nullif(F.coalesce(listed, prefix), F.lit("")), F.lit("unknown"))


def collision_name(name: Column | str, rank: Column) -> Column:
    """name for the first of its kind (rank 0), then name_1, name_2, ... before the extension."""
    base, ext = stem(name), F.regexp_extract(col(name), r"(?<=.)(\.[^.]*)$", 1)
    return F.when(rank == 0, col(name)).otherwise(F.concat(base, F.lit("_"), rank.cast("string"), ext))
