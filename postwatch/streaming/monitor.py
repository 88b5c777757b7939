"""The monitoring run as a stream over newly arrived files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.operators.bayes import BayesModel, predict_bayes
from postwatch.operators.cleaning import preprocess_text
from postwatch.operators.entities import extract_dates, extract_places, extract_tags
from postwatch.operators.matching import keyword_match


def read_post_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def drop_repeats(posts: DataFrame, ts_col: str = "created_at", id_col: str = "id_str",
                 delay: str = "1 day") -> DataFrame:
    """Each post once, however many keyword pairs found it; state is dropped after ``delay``."""
    return posts.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def monitor_stream(posts: DataFrame, keywords: DataFrame, model: BayesModel, out_path: str,
                   checkpoint: str, lexicon: DataFrame | None = None, max_seconds: int | None = None,
                   gazetteer: DataFrame | None = None) -> None:
    """Tag, gate, clean and classify what has arrived, then stop; with a ``gazetteer``, add the extracted information.

    Each micro-batch is an ordinary batch plan written to its own ``batch_id`` partition, which is
    replaced if the batch is retried, so the output has every post once. A run that is not through after
    ``max_seconds`` is stopped and raises ``TimeoutError``; the next run goes on with the batches that are left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        gated = keyword_match(batch, keywords, triggered_only=True)
        scored = predict_bayes(preprocess_text(gated, lexicon=lexicon), model)
        if gazetteer is not None:
            found = extract_places(extract_tags(scored), gazetteer)
            scored = found.withColumn("DATE", extract_dates("full_text"))
        (
            scored.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path)
        )

    query = (
        posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    try:
        if max_seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(max_seconds):
            raise TimeoutError(f"the stream was not through after {max_seconds} seconds")
    finally:
        if query.isActive:
            query.stop()
