"""The file layout as tables: partitioned Parquet under one root.

``raw`` and ``preprocessed`` are partitioned by extraction date and language, ``labelled`` by language,
``predictions``, ``summaries`` and ``confusion`` by the key of the run. The partition that a job writes is replaced as a
whole, also by no rows at all, so a job that is run again leaves nothing of its last run behind.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.text import partition_date
from postwatch.operators.stats import latest_date

DATED = ["extraction_date", "lang"]
RUN = ["split", "extraction_date", "model_type", "lang", "class_lang"]
LIVE, TEST = "live", "test"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def save_posts(posts: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the partitions present in ``posts`` (or the whole table without partitions)."""
    writer = posts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def folder_of(values: dict[str, str | None]) -> str:
    return "/".join(f"{k}={NULL_PARTITION if v is None else v}" for k, v in values.items())


def replace_partition(rows: DataFrame, path: str, values: dict[str, str | None], sort_by: str | None = None) -> None:
    """The folder of one partition holds ``rows`` afterwards, and nothing else; no rows leave an empty table.

    ``sort_by`` keeps rows with the same value together in the files, spread over salts so that a frequent value is not one
    task's work.
    """
    rows = rows.drop(*values)
    if sort_by is not None:
        salt = F.pmod(F.xxhash64("id_str"), F.lit(8)) if "id_str" in rows.columns else F.lit(0)
        rows = rows.repartition(sort_by, salt).sortWithinPartitions(sort_by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{folder_of(values)}")


def write_raw(posts: DataFrame, path: str, date: str, lang: str) -> None:
    """Raw posts of an extraction date and language, ordered by trigger within the files."""
    replace_partition(posts, path, {"extraction_date": date, "lang": lang}, "trigger_kw" if "trigger_kw" in posts.columns else None)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path; no file is opened. None if the path is not there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()) if system.exists(where) else []


@dataclass(frozen=True)
class RunKey:
    """Identity of a prediction run. Live runs need a date, test runs have none."""

    model_type: str
    lang: str
    class_lang: str
    date: str | None = None
    test: bool = False

    def __post_init__(self):
        if self.date is None and not self.test:
            raise ValueError("a live run needs an extraction date")

    def columns(self) -> dict:
        values = {name: F.lit(value) for name, value in self.partition().items()}
        return {**values, "extraction_date": values["extraction_date"].cast("date")}

    def partition(self) -> dict[str, str | None]:
        return {
            "split": TEST if self.test else LIVE, "extraction_date": self.date,
            "model_type": self.model_type, "lang": self.lang, "class_lang": self.class_lang,
        }


class Tables:
    """Typed access to the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def read_partition(self, name: str, values: dict[str, str | None]) -> DataFrame:
        """One partition. Only its folder is listed, and it has the columns it was written with."""
        return self.spark.read.option("basePath", self.path(name)).parquet(f"{self.path(name)}/{folder_of(values)}")

    # keywords, embedding

    def write_keywords(self, keywords: DataFrame) -> None:
        save_posts(keywords, self.path("keywords"))

    def keywords(self, lang: str | None = None) -> DataFrame:
        words = self.read("keywords")
        return words if lang is None else words.where(F.col("lang") == lang)

    def load_embedding(self) -> DataFrame:
        return self.read("embedding").select("token", "vector")

    # posts

    def save_raw(self, posts: DataFrame, date: str, lang: str) -> None:
        write_raw(posts, self.path("raw"), date, lang)

    def load_raw(self, lang: str, date: str) -> DataFrame:
        return self.read_partition("raw", {"extraction_date": date, "lang": lang})

    def save_preprocessed(self, posts: DataFrame, date: str, lang: str) -> None:
        replace_partition(posts, self.path("preprocessed"), {"extraction_date": date, "lang": lang})

    def load_unlabelled(self, lang: str, date: str) -> DataFrame:
        return self.read_partition("preprocessed", {"extraction_date": date, "lang": lang})

    def save_labelled(self, posts: DataFrame, lang: str) -> None:
        """Labelled posts of one language."""
        replace_partition(posts, self.path("labelled"), {"lang": lang})

    def load_labelled(self, lang: str) -> DataFrame:
        return self.read_partition("labelled", {"lang": lang})

    # runs

    def save_run(self, name: str, rows: DataFrame, key: RunKey) -> None:
        replace_partition(rows, self.path(name), key.partition())

    def load_run(self, name: str, key: RunKey) -> DataFrame:
        return self.read_partition(name, key.partition())

    def save_predictions(self, scored: DataFrame, key: RunKey) -> None:
        self.save_run("predictions", scored, key)

    def load_predictions(self, key: RunKey) -> DataFrame:
        return self.load_run("predictions", key)

    def save_summary(self, summary: DataFrame, key: RunKey) -> None:
        self.save_run("summaries", summary, key)

    def save_confusion(self, counts: DataFrame, model_type: str, lang: str, class_lang: str) -> None:
        keyed = counts.withColumns({
            "model_type": F.lit(model_type), "lang": F.lit(lang), "class_lang": F.lit(class_lang)})
        save_posts(keyed, self.path("confusion"), ["model_type", "lang", "class_lang"])

    # dates

    def newest_raw_date(self, lang: str):
        return newest_date(self.spark, self.path("raw"), lang)

    def newest_preprocessed_date(self, lang: str):
        return newest_date(self.spark, self.path("preprocessed"), lang)


def newest_date(spark: SparkSession, path: str, lang: str) -> date:
    """Newest extraction date of a language, from the names of the partition folders alone."""
    prefix = "extraction_date="
    for name in reversed([n for n in folder_names(spark, path) if n.startswith(prefix) and NULL_PARTITION not in n]):
        if f"lang={lang}" in folder_names(spark, f"{path}/{name}"):
            return date.fromisoformat(name.removeprefix(prefix))
    raise LookupError(f"no data in language {lang!r}")


def newest_date_from_names(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``(lang, extraction_date)`` where only file names ``{date}-{lang}.ext`` carry both."""
    name = F.element_at(F.split(path_col, "/"), -1)
    named = files.select(
        F.regexp_extract(name, r"^\d+-\d+-\d+-([A-Za-z]+)", 1).alias("lang"),
        partition_date(name).alias("extraction_date"),
    ).where("lang <> ''")
    return latest_date(named)
