"""The registered queries of the operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import langid, licenses, minhash, mixing, packing, patterns, pii, quality, search, sharding, simhash, spelling, toxicity
from postwatch.llm.common import small_batches, table, word_count


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a weight ``_quality``: 1 for good, 0.25 for bad, 0.5 for unlabelled documents."""
    known = labels.groupBy(F.col("doc_id").alias("_label_id")).agg(F.avg("quality").alias("_q"))
    joined = docs.join(known, F.col("doc_id") == F.col("_label_id"), "left")
    return joined.withColumn("_quality", F.coalesce(0.25 + 0.75 * F.col("_q"), F.lit(0.5))).drop("_label_id", "_q")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(with_quality(docs, table(spark, sf_dir, "labels")), size=F.col("size"), quality=F.col("_quality"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", F.col("row.source").alias("source"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def id_slot(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.train(docs, id_slot(4) != 2)
    return langid.predict(docs, models).withColumn("held_out", F.coalesce(id_slot(4) == 2, F.lit(False)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def document_path() -> Column:
    """A stand-in for the folders of a crawl: the source, blocks of 4,000 ids in it, and in these folders of 200 ids for every other group of
    20; one name in four is a licence file's. The given sources take turns by id, so that a folder holds documents of one source."""
    group = F.floor(F.col("doc_id") / 20)
    inner = F.when(group % 2 == 0, F.concat(F.lit("r"), F.floor(F.col("doc_id") / 200)))
    name = F.when(F.floor(group / 2) % 4 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("b"), F.floor(F.col("doc_id") / 4000)), inner, name)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), document_path().alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("key", "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.digest_column(pii.default_model(spark), F.col("text")).alias("d")).select("doc_id", "d.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), id_slot(5) != 0)
    return toxicity.predict(docs, machine).withColumn("held_out", F.coalesce(id_slot(5) == 0, F.lit(False)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and their likeness; bands and verified similarity are in ``minhash.near_duplicates``, which this leaves out."""
    return minhash.compare_with_next(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = patterns.pack_by_patterns(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_langid": op3_langid,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_minhash": op10_minhash,
    "op11_spelling": op11_spelling,
    "op12_patterns": op12_patterns,
    "op13_search": op13_search,
}

OP13_SQL = r"""
WITH folded AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     terms AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
     tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
     lengths AS (SELECT doc_id, sum(tf)::BIGINT AS len FROM tfs GROUP BY doc_id),
     sums AS (SELECT count(*) AS docs, sum(len)::BIGINT AS words FROM lengths),
     norms AS (SELECT doc_id, 100 - 75 + (75 * len * docs) // words AS m FROM lengths, sums),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
     dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM wanted) GROUP BY term),
     weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, sums),
     scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
                FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op13_search": OP13_SQL}
