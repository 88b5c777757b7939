"""Reading and writing posts as delimited text, and stacking them."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.schemas import RAW_COLUMNS, RAW_SEPARATOR, column_type

_BOM = chr(0xFEFF)  # byte order mark
_CORRUPT = "_corrupt_record"
_NULL = chr(0)  # stands for a field without any text, so that a quoted empty text stays a text


def _header(spark: SparkSession, path: str) -> str:
    """First line of a file; reading stops there."""
    rows = spark.read.text(path).head(1)
    return rows[0][0].lstrip(_BOM) if rows else ""


def detect_layout(spark: SparkSession, path: str) -> tuple[str, tuple[str, ...]]:
    """(delimiter, column names) from the header line: ``;`` if it has one, else ``,``."""
    return layout_of(_header(spark, path))


def layout_of(header: str) -> tuple[str, tuple[str, ...]]:
    sep = RAW_SEPARATOR if RAW_SEPARATOR in header else ","
    names = next(csv.reader([header], delimiter=sep), [])
    return sep, tuple(name.lstrip(_BOM) for name in names)


def _read(spark: SparkSession, paths: list[str], sep: str, columns: tuple[str, ...]) -> DataFrame:
    fields = [T.StructField(c, column_type(c)) for c in columns]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .options(header=True, sep=sep, multiLine=True, quote='"', escape='"', mode="PERMISSIVE",
                 columnNameOfCorruptRecord=_CORRUPT, nullValue=_NULL, ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False, encoding="UTF-8")
        .csv(paths)
    )


def read_post_file(spark: SparkSession, path: str) -> DataFrame | None:
    """Posts of one file with declared types; None if the file has no readable header.

    Lines that do not fit keep their text in ``_corrupt_record``.
    """
    sep, columns = detect_layout(spark, path)
    return _read(spark, [path], sep, columns) if columns else None


def list_files(spark: SparkSession, path: str, pattern: str = "*csv*") -> list[str]:
    """Paths of the files below a folder; only names are read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path)
    return sorted(r["path"] for r in files.select("path").collect())


def layouts_below(spark: SparkSession, path: str, pattern: str = "*csv*") -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files of each layout (delimiter, columns) below a folder, from their first lines, in one job however many files."""
    lines = spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    found: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for row in heads.orderBy("file").collect():
        layout = layout_of(row["head"].lstrip(_BOM))
        if layout[1]:
            found.setdefault(layout, []).append(row["file"])
    return found


def read_post_dir(spark: SparkSession, path: str, layout: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All files whose name contains ``csv``, stacked by column name; missing columns become null.

    Files of the same layout are read together. Only the header of each file is looked at beforehand;
    a given ``layout`` (delimiter, columns) skips that.
    """
    if layout is not None:
        return _read(spark, [path], *layout)
    groups = layouts_below(spark, path)
    if not groups:
        raise FileNotFoundError(f"no readable post file in {path}")
    return union_by_name([_read(spark, files, *key) for key, files in sorted(groups.items())])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def conform_columns(posts: DataFrame, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Exactly the given columns (the raw layout by default): missing ones are null, extra ones are an
    error, or dropped with ``strict=False``."""
    columns = list(RAW_COLUMNS if columns is None else columns)
    extra = [c for c in posts.columns if c not in columns]
    if strict and extra:
        raise ValueError(f"columns outside the layout: {extra}")
    have = set(posts.columns)
    return posts.select(*[
        F.col(c) if c in have else F.lit(None).cast(column_type(c)).alias(c) for c in columns
    ])


def write_raw_csv(posts: DataFrame, path: str, sep: str = RAW_SEPARATOR) -> None:
    """Raw posts as delimited text with a byte order mark at the start of each file."""
    flat = posts.select(*[
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)
        for f in posts.schema.fields
    ])
    first, *rest = flat.columns
    (
        flat.toDF(_BOM + first, *rest).write.mode("overwrite")
        .options(header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False, encoding="UTF-8")
        .csv(path)
    )
