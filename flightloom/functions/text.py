"""Column expressions on text, and clean column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import parse_timestamp


def route_key(origin: Column, destination: Column) -> Column:
    """Origin code followed by destination code; NULL if either is NULL."""
    return F.concat(origin, destination)


def drop_prefix(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(n + 1), F.length(text))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def image_stamp(path: Column) -> Column:
    """``…/<id>_<stamp>.jpg`` -> ``<stamp>``; empty if the name has no such part."""
    return F.split_part(F.split_part(file_name(path), F.lit("_"), F.lit(2)), F.lit("."), F.lit(1))


def image_time(path: Column) -> Column:
    return parse_timestamp(image_stamp(path), "yyyyMMddHHmm")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def swap_word(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def unwrap(text: Column, left: int = 2, right: int = 2) -> Column:
    """Drop ``left`` leading and ``right`` trailing characters, as in ``['SBGR']``."""
    size = F.greatest(F.length(text) - F.lit(left + right), F.lit(0))
    return F.substring(text, F.lit(left + 1), size)


def join_list(values: Column) -> Column:
    return F.concat_ws(", ", values)


def label_hour(label: Column) -> Column:
    """Hour text out of a legacy polygon label such as ``('2022-06-01 17:00:00.jpg', 0)``."""
    return F.substring(label, 3, 13)


def label_time(label: Column) -> Column:
    return parse_timestamp(F.regexp_extract(label, r"'([^'.]*)", 1))


def label_polygon(label: Column) -> Column:
    return F.regexp_extract(label, r",\s*'?(\d+)'?\s*\)", 1).try_cast("int")


_UNWANTED = re.compile(r"""[\[\]<>'".,]""")


def clean_names(df: DataFrame) -> DataFrame:
    """Remove brackets, quotes, dots and commas from every column name."""
    return df.toDF(*[_UNWANTED.sub("", name) for name in df.columns])


def stable_bucket(key: Column, seed: int, buckets: int) -> Column:
    """Bucket 0..buckets-1 from the key alone: the same on every run, engine and partitioning."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
