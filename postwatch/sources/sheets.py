"""Keyword sheets and annotation files."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from postwatch.schemas import ANNOTATIONS

BOM = chr(0xFEFF)


def read_keyword_sheets(spark: SparkSession, trigger_path: str, term_unit_path: str) -> tuple[DataFrame, DataFrame]:
    """(triggers, terms and units), each by its own header, with any language columns in any order."""
    return read_sheet(spark, trigger_path), read_sheet(spark, term_unit_path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet by its own header: the first column is the row index ``pos``, every other one is text."""
    header = next(csv.reader([spark.read.text(path).head(1)[0][0].lstrip(BOM)]))
    fields = [T.StructField("pos", T.LongType()), *[T.StructField(c.strip(), T.StringType()) for c in header[1:]]]
    return spark.read.options(header=True, enforceSchema=True, quote='"', escape='"').schema(T.StructType(fields)).csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated posts ``(full_text, NER-Tags, NER-Words, rfind)``, lists as literals."""
    return spark.read.schema(ANNOTATIONS).options(
        header=True, multiLine=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
