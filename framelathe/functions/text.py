"""Strings: path classes, unit names, templates and numbers as Python prints them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunk and file numbers of a data path.  Fixed value.
CHUNK_FILE = r"chunk-(\d+)/(?:file|episode)[-_](\d+)"


def path_class(path: Column) -> Column:
    return (
        F.when(path.startswith("meta/"), "meta").when(path.startswith("data/"), "data").when(path.startswith("videos/"), "video").otherwise("other")
    )


def class_rank(path: Column) -> Column:
    """0 meta, 1 data, 2 video, 3 other: the order in which files are acquired."""
    return F.when(path.startswith("meta/"), 0).when(path.startswith("data/"), 1).when(path.startswith("videos/"), 2).otherwise(3)


def chunk_and_file(path: Column) -> tuple[Column, Column]:
    """Chunk and file numbers, (0, 0) where the path has none."""
    pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(path, CHUNK_FILE, k), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    return pick(1), pick(2)


def unit_id(chunk: Column, file: Column) -> Column:
    return F.format_string("%03d-%03d", chunk, file)


def suffix_after_dash(name: Column) -> Column:
    """What follows the first dash; null without one."""
    return F.get(F.split(name, "-", 2), 1)


def render_template(template: Column, values: Mapping[str, tuple[Column, int]]) -> Column:
    """Fill ``{name}`` and ``{name:0Nd}``; each value comes with its padding.  Unused values are ignored."""
    out = template
    for name, (value, width) in values.items():
        plain = value.cast("string")
        padded = F.when(F.length(plain) >= width, plain).otherwise(F.lpad(plain, max(width, 1), "0"))
        out = F.replace(out, F.lit("{%s:0%dd}" % (name, width)), padded)
        out = F.replace(out, F.lit("{%s}" % name), plain)
    return out


def python_float(c: Column) -> Column:
    """A double as Python prints it, for values of at least 1e-3 and below 1e7 (and 0); smaller ones as ``1e-05``."""
    text = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).cast("int")
    fixed = F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1")
    tiny = F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(~text.contains("E"), text).when(F.abs(c) >= 1e-4, fixed).otherwise(tiny)
