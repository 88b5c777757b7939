"""How the given tables stand in for posts, and the small dictionaries used with them.

The dictionaries are written as ``VALUES`` so that the queries and their SQL share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.text import split_tokens
from postwatch.operators.cleaning import preprocess_text
from postwatch.operators.matching import keyword_match
from postwatch.session import scratch_path
from postwatch.sources.tables import Tables, save_posts

# Stems that occur in the invented prose; keyword and stem differ on purpose.
KEYWORDS = """SELECT * FROM (VALUES
 ('trigger', 'ingtions', 0, 'ingtion'), ('trigger', 'onthrees', 1, 'onthre'), ('trigger', 'erenly', 2, 'eren'),
 ('term', 'tions', 3, 'tion'), ('term', 'heiten', 4, 'heit'),
 ('unit', 'eaux', 5, 'eau'), ('unit', 'ciones', 6, 'ción')) AS k(kind, keyword, pos, stem)"""

# Whole words for the pair search, one of them of two words.
SEARCH_WORDS = """SELECT * FROM (VALUES
 ('en', 'trigger', 'that', 0), ('en', 'trigger', 'und der', 1), ('en', 'trigger', 'que', 2),
 ('en', 'term', 'with', 3), ('en', 'term', 'les', 4), ('en', 'term', 'von', 5)) AS k(lang, kind, keyword, pos)"""

# Known nouns (token = lemma) and irregular forms.
LEXICON = """SELECT * FROM (VALUES
 ('tion', 'tion'), ('th', 'th'), ('ha', 'ha'), ('eau', 'eau'), ('he', 'he'), ('nd', 'nd'), ('re', 're'),
 ('thereas', 'therea'), ('rewh', 'rew'), ('inoran', 'inor'), ('de', 'de'), ('la', 'la'), ('es', 'es')) AS k(token, lemma)"""

TRANSLATIONS = """SELECT * FROM (VALUES
 ('fr', 'de', 'of'), ('fr', 'la', 'the'), ('fr', 'et', 'and'), ('fr', 'les', 'the'), ('fr', 'que', 'that'),
 ('es', 'de', 'of'), ('es', 'la', 'the'), ('es', 'que', 'that'), ('es', 'en', 'in'),
 ('de', 'der', 'the'), ('de', 'und', 'and'), ('de', 'die', 'the'), ('de', 'in', 'in')) AS k(lang, token, translation)"""

GAZETTEER = """SELECT * FROM (VALUES
 ('rewh'), ('The'), ('of the'), ('and the of'), ('inoran'), ('de la'), ('la'), ('Orre'), ('und der')) AS k(place)"""

# Names of four and five words, some with two spaces.
LONG_PLACES = """SELECT * FROM (VALUES ('de la  de la'), ('in the of  the'), ('of the and the of'), ('and the of the in')) AS k(place)"""

MODEL_TYPE, CLASS_LANG, RUN_DATE = "bayes", "en", "2024-01-31"


#: How many stems the large keyword table has.
MANY_STEMS = 50_000


def many_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword table of stems of 2 to 12 letters cut out of the tokens; where and how long is decided by a hash of the token."""
    tokens = posts(spark, sf_dir).select(F.explode(split_tokens("full_text")).alias("token")).distinct().where(F.length("token") > 1)
    number = lambda at: F.conv(F.substring(F.md5("token"), at, 4), 16, 10).cast("int")
    size = F.least(F.length("token"), 2 + number(1) % 11)
    stems = tokens.select(F.substring("token", 1 + number(5) % (F.length("token") - size + 1), size).alias("stem")).distinct()
    chosen = stems.orderBy(F.md5("stem"), "stem").limit(MANY_STEMS)
    return chosen.select(F.lit("trigger").alias("kind"), F.concat("stem", F.lit("+")).alias("keyword"), F.lit(0).alias("pos"), "stem")


def many_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of sequences of the posts' words: one in eight of all runs of four words, and all runs of two and three words that skip
    every second word, most of which begin like a text and then part from it."""
    words = F.split(F.regexp_replace(F.array_join(split_tokens("full_text"), " "), r"(?<![^ ])[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?![^ ])", ""), " ")
    runs = F.get(F.transform(F.array(words), lambda ws: F.flatten(F.transform(ws, lambda w, i: F.array(
        F.array_join(F.slice(ws, i + 1, 4), " "), F.concat_ws(" ", w, F.get(ws, i + 2)), F.concat_ws(" ", w, F.get(ws, i + 2), F.get(ws, i + 4)))))), 0)
    names = posts(spark, sf_dir).where("trim(full_text) <> ''").select(F.posexplode(runs).alias("at", "place"))
    kept = (F.col("at") % 3 != 0) | F.substring(F.md5("place"), 1, 1).isin("0", "1")
    return names.where(kept & (F.trim("place") != "")).select("place").distinct()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores (one small file) is spread over them.

    Tables of cluster size have more splits than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("id_str"), F.col("text").alias("full_text"), "lang", "source"
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with ``irrelevant``, null where the document has no label."""
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id_str"), (1 - F.col("quality")).cast("double").alias("irrelevant")
    )
    return posts(spark, sf_dir).join(marks, "id_str", "left")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.sql(KEYWORDS)


def tagged(spark: SparkSession, frame: DataFrame, triggered_only: bool = False) -> DataFrame:
    return keyword_match(frame, keywords(spark), triggered_only=triggered_only)


def ready(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Tagged and cleaned posts."""
    return preprocess_text(tagged(spark, frame), lexicon=spark.sql(LEXICON))


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors, as a stored table: each lower-case token of the English documents takes one of the
    given vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    tokens = posts(spark, sf_dir).where("lang = 'en'").select(
        F.explode(split_tokens(F.lower("full_text"))).alias("token")).distinct()
    slot = (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % n).alias("vec_id")
    vectors = tokens.select("token", slot).join(
        vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("token", "vector")
    tables = Tables(spark, scratch_path(spark, "embedding"))
    save_posts(vectors, tables.path("embedding"))
    return tables.load_embedding()


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide keyword sheet: every token of the documents is a row, in the column of its language."""
    rows = posts(spark, sf_dir).select(
        F.col("id_str").cast("bigint").alias("doc_id"), "lang", "source",
        F.posexplode(split_tokens("full_text")).alias("at", "word"))
    kinds = F.array(*[F.lit(k) for k in (
        "structure_term", "person_term", "structure_unit", "person_unit", "other")])
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("at")).alias("pos"),
        *[F.when(F.col("lang") == c.lower(), F.col("word")).alias(c) for c in ("EN", "FR", "ES")],
        F.col("source").alias("displacement_type"),
        F.get(kinds, (F.length("word") % 5).cast("int")).alias("keyword_type"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accounts: one user object per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id_str"), "event_type",
        F.struct(
            F.col("user_id").alias("id"), F.concat(F.lit("o'b "), F.col("event_type")).alias("screen_name"),
            F.when(F.col("event_type") != "view", F.col("props")).alias("location"),
            F.date_format("ts", "yyyy-MM-dd").alias("created_at"),
            (F.col("value") > 10).alias("verified"),
        ).alias("user"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated posts: each distinct token that holds a trigger or unit stem is a tagged word.

    The word list ends with one word that is not in the text; the tag list is one longer still; some
    rows lack a list.
    """
    words = F.array_distinct(F.filter(
        split_tokens("full_text"), lambda t: F.contains(t, F.lit("ingtion")) | F.contains(t, F.lit("eau"))))
    tags = F.transform("words", lambda w: F.when(F.contains(w, F.lit("eau")), "B-unit").otherwise("B-trig"))

    def literal(items):
        # A word with an apostrophe stands in double quotes, as such lists are written.
        quoted = F.transform(items, lambda w: F.when(F.contains(w, F.lit("'")), F.concat(F.lit('"'), w, F.lit('"')))
                             .otherwise(F.concat(F.lit("'"), w, F.lit("'"))))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    base = posts(spark, sf_dir).withColumn("words", words)
    return base.select(
        "id_str", "full_text",
        F.when(F.col("source") != "src3", literal(F.array_append(tags, "B-fig"))).alias("NER-Tags"),
        literal(F.array_append("words", "not-there")).alias("NER-Words"),
        F.when(F.col("lang") != "de", F.col("lang") == "en").alias("rfind"),
    )
