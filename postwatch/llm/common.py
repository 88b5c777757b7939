"""What the operators share: reading a table, keeping an intermediate result, whole texts as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.session import scratch_path

#: White space of all word rules: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch of whole texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(text: Column | str = "text") -> Column:
    """The text as bytes, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null; an empty array for one without words."""
    cut = F.btrim(text, F.lit(BLANK))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, BLANKS))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.size(word_array(text)), F.lit(0)).cast("long")


def unit_interval(*cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns alone, so that reruns and lost tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)
