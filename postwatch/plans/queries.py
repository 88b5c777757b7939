"""Registered queries: each operator on the given tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postwatch.functions import literals, text as tx
from postwatch.functions.lookup import map_tokens, never_broadcast
from postwatch.operators import (
    bayes, classify, cleaning, entities, keywords as kw, matching, models, pooling, spans, splits, stats,
    tagger, vocabulary as voc,
)
from postwatch.plans import fixtures as fx
from postwatch.plans import jobs
from postwatch.session import scratch_path, stored
from postwatch.sources import posts as src
from postwatch.sources import sheets
from postwatch.sources.tables import RunKey, Tables, latest_date, newest_date_from_names, save_posts
from postwatch.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RUN_DATE = fx.RUN_DATE


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def listed(c) -> F.Column:
    return F.array_join(c, "|")


def hit_lists(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[listed(k).alias(k) for k in kw.KINDS])


# --- fixtures shared by several queries -------------------------------------------------------------


def _ready(spark, sf) -> DataFrame:
    return fx.ready(spark, fx.labelled(spark, sf))


def _training(spark, sf) -> DataFrame:
    """Labelled posts with a trigger, cleaned."""
    marked = stats.labelled_only(fx.labelled(spark, sf))
    gated = fx.tagged(spark, marked, triggered_only=True)
    return cleaning.preprocess_text(gated, lexicon=spark.sql(fx.LEXICON))


def _unlabelled(spark, sf) -> DataFrame:
    """Posts with a trigger that nobody labelled, cleaned."""
    open_posts = fx.labelled(spark, sf).where(F.col("irrelevant").isNull()).drop("irrelevant")
    gated = fx.tagged(spark, open_posts, triggered_only=True)
    return cleaning.preprocess_text(gated, lexicon=spark.sql(fx.LEXICON))


def _dated(spark, sf) -> DataFrame:
    """Events as dated partitions: the event type stands for the language."""
    return fx.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id_str"), F.to_date("ts").alias("extraction_date"),
        F.col("event_type").alias("lang"), "value")


def _scored(spark, sf) -> DataFrame:
    """Events with a truth and a prediction."""
    e = fx.table(spark, sf, "events")
    return e.select("event_type", (F.col("value") > 10).cast("int").alias("irrelevant"),
                    (F.col("user_id") % 2).cast("int").alias("predicted_irrelevant"))


def _vectors(spark, sf) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id_str"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") < 5).cast("double").alias("irrelevant"))


def _tables(spark, name: str) -> Tables:
    return Tables(spark, scratch_path(spark, name))


def _full_posts(spark, sf) -> DataFrame:
    """Labelled posts with the metadata that the summary needs."""
    user = F.to_json(F.struct(
        F.col("id_str").cast("bigint").alias("id"), F.col("source").alias("screen_name"),
        F.col("lang").alias("location"), F.lit("2024-01-01").alias("created_at"),
        (F.length("full_text") > 500).alias("verified")))
    return fx.labelled(spark, sf).withColumns(
        {"user": user, "retweeted": F.col("source") == "src1", "created_at": F.lit("2024-01-02")})


# --- sources and sinks ------------------------------------------------------------------------------


@query
def read_post_file(spark, sf):
    path = scratch_path(spark, "file")
    flat = fx.posts(spark, sf).select("id_str", "full_text", "lang", "source")
    src.write_raw_csv(flat, path)
    return src.read_post_file(spark, path).select("id_str", "full_text", "lang", "source")


@query
def read_post_dir(spark, sf):
    path = scratch_path(spark, "dir")
    flat = fx.posts(spark, sf).select("id_str", "full_text", "lang")
    src.write_raw_csv(flat.where("lang = 'en'").drop("lang"), f"{path}/first")
    src.write_raw_csv(flat.where("lang <> 'en'").select("lang", "full_text", "id_str"), f"{path}/second", sep=",")
    return src.read_post_dir(spark, path).select("id_str", "full_text", "lang")


@query
def read_keyword_sheets(spark, sf):
    """Both sheets word by word; their language columns stand in different orders."""
    path = scratch_path(spark, "sheets")
    wide = fx.sheet(spark, sf)
    options = {"header": True, "quote": '"', "escape": '"', "compression": "gzip"}
    wide.select("pos", "FR", "EN", "ES", "displacement_type").write.options(**options).csv(f"{path}/triggers")
    wide.select("pos", "EN", "ES", "FR", "keyword_type").write.options(**options).csv(f"{path}/terms")
    triggers, terms = sheets.read_keyword_sheets(spark, f"{path}/triggers", f"{path}/terms")
    parts = {"displacement_type": triggers, "keyword_type": terms}
    return src.union_by_name([df.select("pos", "EN", "FR", "ES", F.col(kind).alias("type")) for kind, df in parts.items()])


@query
def read_annotations(spark, sf):
    path = scratch_path(spark, "annotations")
    fx.annotations(spark, sf).select(*spans.ANNOTATION_COLUMNS).write.options(
        header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = sheets.read_annotations(spark, path)
    return rows.select("full_text", F.col("NER-Tags").alias("tags"), F.col("NER-Words").alias("words"), "rfind")


@query
def load_embedding(spark, sf):
    return fx.embedding(spark, sf).select(
        "token", F.size("vector").cast("bigint").alias("dim"),
        F.round(F.get("vector", 0).cast("double"), 4).alias("first"))


@query
def load_labelled(spark, sf):
    tables = _tables(spark, "labelled")
    save_posts(stats.labelled_only(fx.labelled(spark, sf)), tables.path("labelled"), ["lang"])
    return tables.load_labelled("en").select("id_str", "irrelevant", F.length("full_text").cast("bigint").alias("n"))


@query
def load_unlabelled(spark, sf):
    tables = _tables(spark, "unlabelled")
    save_posts(_dated(spark, sf), tables.path("preprocessed"), ["extraction_date", "lang"])
    return tables.load_unlabelled("view", "2024-01-03").select("id_str", F.round("value", 4).alias("value"))


def _stored_runs(spark, sf) -> tuple[Tables, RunKey, RunKey]:
    tables = _tables(spark, "runs")
    scored = fx.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id_str"), "event_type",
        (F.col("user_id") % 2).cast("int").alias("predicted_irrelevant"))
    live, test = RunKey("bayes", "en", "en", RUN_DATE), RunKey("bayes", "en", "en", test=True)
    tables.save_predictions(scored, live)
    tables.save_predictions(scored.where("event_type = 'view'"), test)
    return tables, live, test


@query
def save_predictions(spark, sf):
    tables, _, _ = _stored_runs(spark, sf)
    return tables.read("predictions").groupBy(
        "split", F.col("extraction_date").cast("string").alias("extraction_date"), "model_type", "lang", "class_lang"
    ).agg(F.count("*").alias("n"), F.sum("predicted_irrelevant").alias("n_irrelevant"))


@query
def load_predictions(spark, sf):
    tables, live, test = _stored_runs(spark, sf)
    both = [tables.load_predictions(key).select("split", "id_str", "predicted_irrelevant") for key in (live, test)]
    return both[0].unionByName(both[1])


@query
def newest_raw_date(spark, sf):
    return latest_date(_dated(spark, sf)).withColumn("extraction_date", F.col("extraction_date").cast("string"))


@query
def latest_extraction_date(spark, sf):
    tables = _tables(spark, "dates")
    save_posts(_dated(spark, sf), tables.path("raw"), ["extraction_date", "lang"])
    return latest_date(tables.read("raw").select("lang", "extraction_date")).withColumn(
        "extraction_date", F.col("extraction_date").cast("string"))


@query
def newest_preprocessed_date(spark, sf):
    names = _dated(spark, sf).select(F.concat(
        F.lit("/data/"), F.date_format("extraction_date", "yyyy-MM-dd"), F.lit("-"), "lang", F.lit(".csv")
    ).alias("path"))
    return newest_date_from_names(names).withColumn("extraction_date", F.col("extraction_date").cast("string"))


@query
def known_languages(spark, sf):
    return kw.known_languages(fx.posts(spark, sf))


@query
def write_raw(spark, sf):
    tables = _tables(spark, "raw")
    found = matching.pair_search(fx.posts(spark, sf), spark.sql(fx.SEARCH_WORDS)).drop("lang")
    full = src.conform_columns(found, [*src.RAW_COLUMNS, "trigger_kw"], strict=False)
    tables.save_raw(full.drop("lang"), RUN_DATE, "en")
    return tables.load_raw("en", RUN_DATE).groupBy("trigger_kw").agg(
        F.count("*").alias("n"), F.count("created_at").alias("n_created"), F.sum(F.length("full_text")).alias("n_chars"))


@query
def write_raw_csv(spark, sf):
    path = scratch_path(spark, "rawcsv")
    full = src.conform_columns(fx.posts(spark, sf), strict=False)
    src.write_raw_csv(full, path)
    back = src.read_post_dir(spark, path, (src.RAW_SEPARATOR, tuple(src.RAW_COLUMNS)))
    return back.select("id_str", "full_text", "source", "lang", F.col("retweeted").isNull().alias("no_flag"))


@query
def save_posts_by_lang(spark, sf):
    path = scratch_path(spark, "saved")
    save_posts(fx.posts(spark, sf), path, ["lang"])
    save_posts(fx.posts(spark, sf).where("lang = 'fr'").limit(0), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query
def write_keywords(spark, sf):
    tables = _tables(spark, "keywords")
    wide = fx.sheet(spark, sf)
    words = kw.unpivot_languages(wide.drop("displacement_type"), ["pos", "keyword_type"])
    tables.write_keywords(kw.keyword_dedupe(words.withColumn("kind", F.lit("term"))))
    return tables.keywords("fr").select("keyword", "keyword_type", "pos")


@query
def save_confusion(spark, sf):
    tables = _tables(spark, "confusion")
    tables.save_confusion(stats.confusion_matrix(_scored(spark, sf)), "bayes", "en", "en")
    return tables.read("confusion").select("model_type", "lang", "class_lang", "tp", "fp", "fn", "tn")


# --- projections and filters ------------------------------------------------------------------------


@query
def labelled_only(spark, sf):
    return stats.labelled_only(fx.labelled(spark, sf)).select("id_str", "irrelevant")


@query
def trigger_gate(spark, sf):
    return hit_lists(matching.trigger_gate(fx.tagged(spark, fx.posts(spark, sf))), "id_str", "lang")


@query
def split_relevance(spark, sf):
    relevant, irrelevant = stats.split_relevance(fx.labelled(spark, sf))
    return relevant.select("id_str", F.lit("relevant").alias("part")).unionByName(
        irrelevant.select("id_str", F.lit("irrelevant").alias("part")))


@query
def split_keyword_kind(spark, sf):
    return kw.split_keyword_kind(fx.sheet(spark, sf)).groupBy("kind", "keyword_type").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query
def exclude_retweets(spark, sf):
    e = fx.users(spark, sf).withColumn("retweeted_status", F.col("user.location"))
    return matching.exclude_retweets(e).select("id_str", "event_type")


@query
def until_date(spark, sf):
    e = fx.table(spark, sf, "events")
    return matching.until_date(e, "ts", "2024-01-15").select("event_id", "event_type")


@query
def drop_incomplete_annotations(spark, sf):
    return spans.drop_incomplete_annotations(fx.annotations(spark, sf)).select(
        "full_text", F.col("NER-Tags").alias("tags"), F.col("NER-Words").alias("words"), "rfind")


@query
def post_summary(spark, sf):
    ready = cleaning.preprocess_text(_full_posts(spark, sf)).withColumn("predicted_irrelevant", F.lit(1))
    return _flat_summary(entities.post_summary(ready, "en"))


def _flat_summary(summary: DataFrame) -> DataFrame:
    lists = [c for c in entities.LISTS if c in summary.columns]
    plain = [c for c in summary.columns if c not in [*lists, "user_info"]]
    return summary.select(
        *plain, F.col("user_info.id").alias("user_id"), F.col("user_info.screen_name").alias("screen_name"),
        F.col("user_info.verified").alias("verified"), *[listed(c).alias(c.lower() + "_list") for c in lists])


@query
def user_struct(spark, sf):
    e = fx.users(spark, sf)
    as_json = e.withColumn("user", F.to_json("user"))
    return as_json.select("id_str", entities.user_struct("user").alias("u")).select("id_str", "u.*")


@query
def text_for_language(spark, sf):
    p = fx.posts(spark, sf).withColumn("full_text_translated", F.concat_ws(" ", "source", "full_text"))
    return p.select("id_str", entities.text_for_language("lang").alias("text"))


@query
def attach_prediction(spark, sf):
    scored = _scored(spark, sf).withColumn("prediction", F.col("predicted_irrelevant").cast("double"))
    return classify.attach_prediction(scored, ["event_type"]).groupBy("event_type", "predicted_irrelevant").agg(
        F.count("*").alias("n"))


@query
def conform_columns(spark, sf):
    return src.conform_columns(fx.posts(spark, sf), ["id_str", "created_at", "retweet_count", "lang"], strict=False)


@query
def language_column(spark, sf):
    wide = fx.sheet(spark, sf)
    known = [c for c in ("en", "fr", "pt") if kw.language_column(wide, c) is not None]
    return wide.agg(*[F.count(kw.language_column(wide, c)).alias(f"n_{c}") for c in known])


# --- joins ------------------------------------------------------------------------------------------


@query
def keyword_pairs(spark, sf):
    """Every query string with the number of posts that hold its words."""
    words = spark.sql(fx.SEARCH_WORDS)
    found = matching.pair_search(fx.posts(spark, sf), words).groupBy("query").agg(F.count("*").alias("n_posts"))
    return kw.keyword_pairs(words).join(found, "query", "left").select(
        "query", "term", "trigger", F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


@query
def pair_search(spark, sf):
    found = matching.pair_search(fx.posts(spark, sf), spark.sql(fx.SEARCH_WORDS))
    return found.select("id_str", "trigger_kw", "term_kw", "query")


@query
def pair_search_join(spark, sf):
    found = matching.pair_search(fx.posts(spark, sf), spark.sql(fx.SEARCH_WORDS), max_literal=0)
    return found.select("id_str", "trigger_kw", "term_kw", "query")


@query
def keyword_match(spark, sf):
    return hit_lists(fx.tagged(spark, fx.posts(spark, sf)), "id_str")


@query
def keyword_match_join(spark, sf):
    return hit_lists(matching.keyword_match_join(fx.posts(spark, sf), fx.keywords(spark)), "id_str")


@query
def keyword_match_many(spark, sf):
    """50,000 stems of 2 to 12 letters: how often each hits, in how many posts, and all hits of a post in their order."""
    tagged = matching.keyword_match_join(fx.posts(spark, sf), fx.many_stems(spark, sf))
    return tagged.select("id_str", F.size("trigger").cast("bigint").alias("n_hits"), F.md5(listed("trigger")).alias("hits"))


@query
def embedding_lookup(spark, sf):
    rows = fx.posts(spark, sf).select("id_str", F.explode(tx.split_tokens(F.lower("full_text"))).alias("token"))
    found = pooling.embedding_lookup(rows, fx.embedding(spark, sf))
    return found.groupBy("id_str").agg(
        F.count("*").alias("n"), F.round(F.sum(F.get("vector", 0).cast("double")), 3).alias("sum_first"))


@query
def zip_annotations(spark, sf):
    rows = spans.drop_incomplete_annotations(fx.annotations(spark, sf))
    pairs = spans.zip_shortest(literals.parse_list_literal("NER-Words"), literals.parse_list_literal("NER-Tags"))
    return rows.select("full_text", listed(F.transform(pairs, lambda p: F.concat_ws("/", p["word"], p["tag"]))).alias("pairs"))


@query
def lemma_lookup(spark, sf):
    """Irregular and regular lemmas through the join, counted per token; some words are four rules away from their noun."""
    text = F.replace(F.lower("full_text"), F.lit(" und "), F.lit(" tionssss "))
    tokens = fx.posts(spark, sf).withColumn("tokens", tx.split_tokens(F.replace(text, F.lit(" the "), F.lit(" eausesesses "))))
    mapped = cleaning.lemmatize(tokens, "tokens", spark.sql(fx.LEXICON), "lemmas", max_literal=0)
    return mapped.select(F.explode("lemmas").alias("lemma")).groupBy("lemma").agg(F.count("*").alias("n"))


@query
def stopword_anti(spark, sf):
    tokens = fx.posts(spark, sf).select("id_str", tx.split_tokens(F.lower("full_text")).alias("t"))
    kept = tokens.select("id_str", tx.remove_stopwords("t").alias("t"))
    return kept.select("id_str", F.size("t").cast("bigint").alias("n"), F.get("t", 0).alias("first"))


@query
def keyword_type_lookup(spark, sf):
    typed = fx.keywords(spark).withColumn("lang", F.lit("en")).withColumn("keyword_type", F.upper("kind"))
    hits = matching.explode_hits(fx.tagged(spark, fx.posts(spark, sf).withColumn("lang", F.lit("en"))))
    return kw.keyword_type_lookup(hits, typed).groupBy("keyword", "keyword_type").agg(F.count("*").alias("n"))


# --- aggregations -----------------------------------------------------------------------------------


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query
def label_stats(spark, sf):
    return _rounded(stats.label_stats(fx.labelled(spark, sf)), "share_relevant")


@query
def training_stats(spark, sf):
    marked = fx.tagged(spark, stats.labelled_only(fx.labelled(spark, sf)))
    return _rounded(stats.training_stats(marked), "share_with_trigger", "share_relevant")


@query
def vocabulary(spark, sf):
    return voc.vocabulary(fx.posts(spark, sf), "full_text")


@query
def mean_pool(spark, sf):
    tokens = fx.posts(spark, sf).select("id_str", tx.split_tokens(F.lower("full_text")).alias("tokens"))
    pooled = pooling.mean_pool(tokens, fx.embedding(spark, sf), "tokens")
    return _components(pooled, "features")


def _components(df: DataFrame, col: str) -> DataFrame:
    return df.select("id_str", F.posexplode(col).alias("dim", "value")).select(
        "id_str", "dim", (F.round("value", 4) + 0.0).alias("value"))


@query
def confusion_matrix(spark, sf):
    return stats.confusion_matrix(_scored(spark, sf), by=["event_type"])


@query
def balanced_accuracy(spark, sf):
    return _rounded(stats.balanced_accuracy(_scored(spark, sf), by=["event_type"]), "balanced_accuracy")


@query
def cv_summary(spark, sf):
    folds = stats.balanced_accuracy(_scored(spark, sf), by=["event_type"])
    return _rounded(stats.cv_summary(folds), "mean_score", "sd_score")


@query
def keyword_hits(spark, sf):
    """Hit rows of every post with their place in the ordered list."""
    return matching.explode_hits(fx.tagged(spark, fx.posts(spark, sf)))


@query
def entity_lists(spark, sf):
    ready = entities.extract_tags(fx.tagged(spark, fx.posts(spark, sf)))
    placed = entities.extract_places(ready, spark.sql(fx.GAZETTEER))
    full = placed.withColumn("DATE", entities.extract_dates("full_text"))
    return full.select("id_str", *[listed(c).alias(c.lower() + "_list") for c in entities.LISTS])


@query
def nb_statistics(spark, sf):
    classes, tokens = voc.nb_statistics(_training(spark, sf))
    return tokens.unionByName(classes.withColumn("token", F.lit(None).cast("string")))


# --- windows, sorts, unions -------------------------------------------------------------------------


@query
def keyword_dedupe(spark, sf):
    words = kw.unpivot_languages(fx.sheet(spark, sf).drop("displacement_type"), ["pos", "keyword_type"])
    typed = words.withColumn("keyword_type", F.concat_ws(":", "keyword_type", (F.col("pos") % 7).cast("string")))
    return kw.keyword_dedupe(typed.withColumn("kind", F.lit("term")))


@query
def stratified_split(spark, sf):
    marked = stats.labelled_only(fx.labelled(spark, sf)).select("id_str", "irrelevant")
    return splits.stratified_split(marked)


@query
def stratified_folds(spark, sf):
    marked = stats.labelled_only(fx.labelled(spark, sf)).select("id_str", "irrelevant")
    return splits.stratified_folds(marked)


@query
def token_context(spark, sf):
    rows = tagger.token_context(fx.posts(spark, sf), "id_str")
    return rows.select("id_str", "pos", "token", "previous", "following")


@query
def shuffle_rows(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id_str"))
    return splits.shuffle_rows(e)


@query
def union_by_name(spark, sf):
    c = fx.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id_str"), F.col("text").alias("full_text"), "role")
    return src.union_by_name([fx.posts(spark, sf).drop("source"), c])


@query
def append_matches(spark, sf):
    found = matching.pair_search(fx.posts(spark, sf), spark.sql(fx.SEARCH_WORDS))
    return found.groupBy("id_str").agg(F.count("*").alias("n_copies"))


@query
def combine_posts(spark, sf):
    """The labelled posts of a folder of delimited files, and the stored raw posts of the newest day."""
    tables, path = _tables(spark, "combine"), scratch_path(spark, "labelled-files")
    src.write_raw_csv(fx.labelled(spark, sf).select("id_str", "full_text", "lang", "irrelevant"), path)
    tables.write_keywords(spark.sql(fx.SEARCH_WORDS))
    for day in ("2024-01-30", RUN_DATE):
        corpus = fx.posts(spark, sf) if day == RUN_DATE else fx.posts(spark, sf).where("source = 'src1'")
        jobs.extract_pairs(tables, corpus, "en", day)
    parts = {"labelled": jobs.combine_posts(tables, "en", path), "raw": jobs.combine_posts(tables, "en")}
    return src.union_by_name([
        df.withColumn("irrelevant", F.col("irrelevant") if "irrelevant" in df.columns else F.lit(None).cast("double"))
        .select("id_str", "lang", "irrelevant", F.lit(name).alias("part")) for name, df in parts.items()])


# --- text functions ---------------------------------------------------------------------------------


@query
def split_tokens(spark, sf):
    p = fx.posts(spark, sf).select("id_str", tx.split_tokens("full_text").alias("t"))
    return p.select("id_str", F.posexplode("t").alias("pos", "token"))


@query
def strip_emoji(spark, sf):
    """Emoji are put between all words first."""
    with_emoji = F.regexp_replace("full_text", " ", " \U0001F44D\U0001F3FD \U0001F1E9\U0001F1EA❤️")
    return fx.posts(spark, sf).select("id_str", tx.strip_emoji(with_emoji).alias("text"))


@query
def squeeze_repeats(spark, sf):
    p = fx.posts(spark, sf).select(F.explode(tx.split_tokens("full_text")).alias("token")).distinct()
    return p.select("token", tx.squeeze_repeats(F.concat("token", F.right("token", F.lit(1)), F.right("token", F.lit(1)),
                                                         F.right("token", F.lit(1)))).alias("squeezed"))


@query
def strip_noise(spark, sf):
    urls = fx.table(spark, sf, "pages").select(F.concat_ws(" ", F.lit("x"), "url", F.lit("@user_name")).alias("t"))
    docs = fx.posts(spark, sf).select(tx.fold_spaces("full_text").alias("t"))
    return urls.unionByName(docs).select("t", tx.strip_noise("t").alias("clean"))


@query
def join_tokens(spark, sf):
    return fx.posts(spark, sf).select("id_str", tx.join_tokens(tx.split_tokens("full_text")).alias("text"))


@query
def translate_posts(spark, sf):
    parts = [
        cleaning.translate_by_lexicon(fx.posts(spark, sf).where(F.col("lang") == lang), spark.sql(fx.TRANSLATIONS),
                                      lang, "full_text")
        for lang in ("fr", "es", "de")
    ]
    return src.union_by_name(parts).select("id_str", "full_text_translated")


@query
def translate_hook(spark, sf):
    def shout(texts):
        return [t.replace("e", "3") for t in texts]

    return cleaning.translate_with(fx.posts(spark, sf), shout, "full_text").select("id_str", "full_text_translated")


@query
def translate_remembered(spark, sf):
    """The posts of a run and of the next one, with a translator that says in which run it was asked: the second run asks for the texts
    that the first did not have, and for no other."""
    memory = scratch_path(spark, "memory")
    told = lambda run: lambda texts: [f"{run}:{len(t)}" for t in texts]
    p = fx.posts(spark, sf)
    first = p.where("source <> 'src3'")
    cleaning.translate_remembered(first, told("first"), memory, "en", "full_text")
    again = cleaning.translate_remembered(p.unionByName(first), told("second"), memory, "en", "full_text")
    return again.select("id_str", "full_text_translated")


@query
def lowercase(spark, sf):
    return fx.posts(spark, sf).select("id_str", F.lower("full_text").alias("text"))


@query
def lemmatize(spark, sf):
    p = fx.posts(spark, sf).withColumn("tokens", tx.split_tokens(F.lower("full_text")))
    done = cleaning.lemmatize(p, "tokens", spark.sql(fx.LEXICON), "lemmas")
    return done.select("id_str", tx.join_tokens("lemmas").alias("text"))


@query
def remove_stopwords(spark, sf):
    kept = tx.remove_stopwords(tx.split_tokens(F.lower("full_text")))
    return fx.posts(spark, sf).select("id_str", tx.join_tokens(kept).alias("text"))


@query
def strip_punctuation(spark, sf):
    return fx.posts(spark, sf).select("id_str", tx.strip_punctuation("full_text").alias("text"))


@query
def preprocess_text(spark, sf):
    done = cleaning.preprocess_text(fx.posts(spark, sf), lexicon=spark.sql(fx.LEXICON))
    return done.select("id_str", "full_text_preprocessed")


@query
def preprocess_translated(spark, sf):
    parts = [
        cleaning.preprocess_text(fx.posts(spark, sf).where(F.col("lang") == lang), lang, spark.sql(fx.LEXICON),
                                 translations=spark.sql(fx.TRANSLATIONS))
        for lang in ("fr", "es", "de")
    ]
    return src.union_by_name(parts).select("id_str", "full_text_translated", "full_text_preprocessed")


@query
def stem_keywords(spark, sf):
    words = fx.posts(spark, sf).select(F.explode(tx.split_tokens("full_text")).alias("keyword")).distinct()
    return kw.stem_keywords(words)


@query
def word_tokenize(spark, sf):
    fused = F.replace(F.lower("full_text"), F.lit(" of "), F.lit(" cannot "))
    p = fx.posts(spark, sf).select("id_str", tx.word_tokenize(fused).alias("t"))
    return p.select("id_str", listed("t").alias("tokens"))


@query
def find_offset(spark, sf):
    return fx.posts(spark, sf).select(
        "id_str", tx.find_offset("full_text", F.lit("tion")).cast("bigint").alias("first_at"),
        tx.find_offset("full_text", F.lit("tion"), True).cast("bigint").alias("last_at"))


@query
def parse_object_literal(spark, sf):
    """Accounts written as object literals, with quotes inside and missing values."""
    u = F.col("user")
    written = F.concat(
        F.lit("{'id': "), u["id"], F.lit(", 'screen_name': \""), u["screen_name"], F.lit("\", 'location': "),
        F.coalesce(F.concat(F.lit("'"), u["location"], F.lit("'")), F.lit("None")), F.lit(", 'created_at': '"),
        u["created_at"], F.lit("', 'verified': "), F.initcap(u["verified"].cast("string")), F.lit("}"))
    rows = fx.users(spark, sf).withColumn("user", written)
    return rows.select("id_str", entities.user_struct("user").alias("u")).select("id_str", "u.*")


@query
def parse_list_literal(spark, sf):
    rows = fx.annotations(spark, sf)
    return rows.select("id_str", listed(literals.parse_list_literal("NER-Words")).alias("words"))


@query
def null_text(spark, sf):
    p = fx.labelled(spark, sf).withColumn("t", F.when(F.col("irrelevant").isNull(), F.col("full_text")))
    return p.select("id_str", tx.null_text("t").alias("text"), F.size(tx.split_tokens("t")).cast("bigint").alias("n"))


@query
def date_format_parse(spark, sf):
    named = F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), "event_type")
    return fx.table(spark, sf, "events").select(
        "event_id", F.date_format(tx.partition_date(named), "yyyy-MM-dd").alias("day"))


@query
def unpivot_languages(spark, sf):
    long = kw.unpivot_languages(fx.sheet(spark, sf).drop("displacement_type"), ["pos", "keyword_type"])
    return long.select("pos", "keyword_type", "lang", "keyword")


# --- features and models ----------------------------------------------------------------------------


@query
def dense_features(spark, sf):
    p = fx.posts(spark, sf).select("id_str", F.lower("full_text").alias("full_text_preprocessed"))
    built = pooling.dense_features(p, fx.embedding(spark, sf))
    return _components(built.withColumn("a", vector_to_array("features")), "a")


@query
def verified_feature(spark, sf):
    p = fx.posts(spark, sf).select("id_str", F.lower("full_text").alias("full_text_preprocessed"),
                                   (F.length("full_text") > 500).alias("verified"))
    built = pooling.dense_features(p, fx.embedding(spark, sf), verified_col="verified")
    return _components(built.withColumn("a", vector_to_array("features")), "a")


@query
def binary_features(spark, sf):
    """``contains(word)`` of every labelled post: the words that are there, in order."""
    rows = voc.token_rows(_training(spark, sf), "id_str", distinct=True)
    return rows.select("id_str", "token")


def _ruled_vectors(spark, sf, ring: bool = False) -> DataFrame:
    """Given vectors with a label by a rule that has a margin: all components are moved apart by class, or, for a ``ring``, the
    vectors of one class have length 1 and those of the other length 4. Labels follow from the sign of the first component."""
    from pyspark.ml.functions import array_to_vector

    own = F.col("embedding").cast("array<double>")
    positive = F.get("embedding", 0).cast("double") > 0
    length = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))

    def move(v, x):
        if ring:
            return x * (F.when(v["positive"], 1.0).otherwise(4.0) / v["length"])
        return F.round(4 * x / v["length"]) / 4 + F.when(v["positive"], 1.5).otherwise(-1.5)

    # Inside a lambda, whatever is not its argument is computed again for each component: a row's length is handed in.
    once = F.array(F.struct(own.alias("own"), length.alias("length"), positive.alias("positive")))
    moved = F.get(F.transform(once, lambda v: F.transform(v["own"], lambda x: move(v, x))), 0)
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id_str"), array_to_vector(moved).alias("features"), positive.cast("double").alias("irrelevant"))


def _ml_scores(spark, sf, family: str, params: dict | None = None, ring: bool = False) -> DataFrame:
    """Each half of the vectors, by a hash of the id, is scored by a model of the other half: no row by a model that has seen it."""
    data = _ruled_vectors(spark, sf, ring).withColumn("half", F.crc32(F.col("id_str").cast("binary")) % 2)
    parts = []
    for half in (0, 1):
        fitted = models.build_model(family, models.model_parameters(family) if params is None else params).fit(data.where(F.col("half") != half))
        parts.append(fitted.transform(data.where(F.col("half") == half)).select(
            "id_str", F.col("irrelevant").cast("int").alias("irrelevant"), F.col("prediction").cast("int").alias("predicted_irrelevant")))
    return parts[0].unionByName(parts[1])


@query
def linear_classifier(spark, sf):
    return _ml_scores(spark, sf, "linear")


@query
def random_forest(spark, sf):
    return _ml_scores(spark, sf, "randomforest")


@query
def rbf_svm(spark, sf):
    return _ml_scores(spark, sf, "svm", ring=True)


@query
def model_search(spark, sf):
    return _ml_scores(spark, sf, "tpot")


@query
def naive_bayes(spark, sf):
    train = stored(_training(spark, sf).select("id_str", "irrelevant", "full_text_preprocessed"), "training")
    model = bayes.fit_bayes(train)
    scored = bayes.predict_bayes(train, model)
    return scored.select("id_str", "irrelevant", F.round("log_odds", 4).alias("log_odds"), "predicted_irrelevant")


@query
def predict(spark, sf):
    model = classify.fit(_training(spark, sf), "bayes")
    open_posts = stored(_unlabelled(spark, sf).select("id_str", "lang", "trigger", "full_text_preprocessed"), "unlabelled")
    return model.predict(open_posts).select("id_str", "lang", "predicted_irrelevant")


@query
def fit(spark, sf):
    """Weights of the trained model."""
    model = bayes.fit_bayes(_training(spark, sf))
    return model.weights.select("token", F.round("gap", 4).alias("gap"))


@query
def cross_validate(spark, sf):
    narrow = _training(spark, sf).select("id_str", "irrelevant", "full_text_preprocessed")
    scored = classify.bayes_fold_predictions(splits.stratified_folds(narrow).persist())
    return scored.select("id_str", "irrelevant", "fold", "predicted_irrelevant")


@query
def evaluate(spark, sf):
    split = splits.stratified_split(_training(spark, sf))
    model = classify.fit(split.where(~F.col("is_test")), "bayes")
    _, counts = classify.evaluate(model, split.where("is_test"))
    return _rounded(counts, "balanced_accuracy")


@query
def build_model(spark, sf):
    """One prediction table per configured family on the given vectors."""
    families = [f for f in models.list_models() if f in models.FAMILIES and f != "tpot"]
    parts = [_ml_scores(spark, sf, f).withColumn("family", F.lit(f)) for f in families]
    return src.union_by_name(parts)


def _trained(spark, sf, name: str) -> tuple[Tables, object]:
    tables = _tables(spark, name)
    stems = fx.keywords(spark).withColumn("lang", F.lit("en")).withColumn("keyword_type", F.col("kind"))
    tables.write_keywords(stems.unionByName(stems.withColumn("lang", F.lit("fr"))))
    ready = fx.ready(spark, stats.labelled_only(_full_posts(spark, sf)))
    tables.save_labelled(ready.withColumn("full_text_translated", F.lit(None).cast("string")), "en")
    return tables, jobs.train_classifier(tables, "en", "bayes")


@query
def train_classifier(spark, sf):
    tables, report = _trained(spark, sf, "train")
    return report.confusion.select("tp", "fp", "fn", "tn", F.lit(round(report.score, 4)).alias("score"))


@query
def load_model(spark, sf):
    """A stored and reloaded forest predicts as before, vector by vector."""
    root = scratch_path(spark, "models")
    data = _vectors(spark, sf)
    fitted = models.build_model("randomforest", {"max_depth": 5, "n_estimators": 2, "random_state": 0}).fit(data)
    classify.save_classifier(classify.Classifier("randomforest", fitted), root, "en")
    again = classify.load_classifier(spark, root, "randomforest", "en").model.transform(data)
    before = fitted.transform(data).select("id_str", F.col("prediction").alias("before"))
    return again.join(before, "id_str").select("id_str", (F.col("prediction") == F.col("before")).alias("same"))


@query
def test_classifier(spark, sf):
    tables, _ = _trained(spark, sf, "test")
    tables.save_labelled(fx.ready(spark, stats.labelled_only(_full_posts(spark, sf)).where("lang = 'fr'")).withColumn(
        "full_text_translated", F.col("full_text")), "fr")
    jobs.test_classifier(tables, "fr", "en", "bayes")
    key = RunKey("bayes", "fr", "en", test=True)
    return tables.load_predictions(key).select("id_str", "split", "irrelevant", "predicted_irrelevant")


@query
def classify_posts(spark, sf):
    tables, _ = _trained(spark, sf, "classify")
    open_posts = _full_posts(spark, sf).where(F.col("irrelevant").isNull()).drop("irrelevant")
    tables.save_preprocessed(fx.ready(spark, open_posts), RUN_DATE, "en")
    summary = jobs.classify_posts(tables, "en", "en", "bayes")
    return summary.select("id_str", "predicted_irrelevant", listed("TRIGGER").alias("trigger_list"))


# --- information extraction -------------------------------------------------------------------------


@query
def extract_places_dates(spark, sf):
    p = entities.extract_places(fx.posts(spark, sf), spark.sql(fx.GAZETTEER))
    times = F.regexp_replace("full_text", r"\bthe\b", "on 12 March 2020, 10:30 pm or last week")
    return p.select("id_str", listed("LOCATION").alias("places"), listed(entities.extract_dates(times)).alias("dates"))


@query
def extract_places_join(spark, sf):
    p = entities.extract_places(fx.posts(spark, sf), spark.sql(fx.GAZETTEER), max_literal=0)
    return p.select("id_str", listed("LOCATION").alias("places"))


@query
def extract_places_many(spark, sf):
    """About a million names taken from the texts themselves: how many each post holds, and which, in their order."""
    p = entities.extract_places(fx.posts(spark, sf), fx.many_places(spark, sf))
    return p.select("id_str", F.size("LOCATION").cast("bigint").alias("n_places"), F.md5(listed("LOCATION")).alias("places"))


@query
def extract_tags(spark, sf):
    p = entities.extract_tags(fx.tagged(spark, fx.posts(spark, sf)))
    return p.select("id_str", *[listed(c).alias(c.lower() + "_list") for c in ("TRIGGER", "TERM", "UNIT", "FIGURE")])


@query
def annotation_spans(spark, sf):
    rows = spans.annotation_spans(fx.annotations(spark, sf), "id_str")
    return rows.select("id_str", F.col("n_missing").cast("bigint").alias("n_missing"), listed(F.transform(
        "entities", lambda e: F.concat_ws("/", e["start"], e["end"], e["tag"]))).alias("spans"))


@query
def annotation_occurrences(spark, sf):
    """Words that are annotated once for each time they occur, and once more than that."""
    words = F.filter(tx.split_tokens("full_text"), lambda t: (t.isin("the", "die", "que", "les") | F.contains(t, F.lit("ingtion"))) & ~F.contains(t, F.lit("'")))
    quoted = lambda items: F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    both = F.concat("_w", F.array_distinct("_w"))
    some = F.filter(F.array(F.struct(words.alias("_w"))), lambda r: F.size(r["_w"]) > 0)
    annotated = fx.posts(spark, sf).select("id_str", "full_text", "lang", F.inline(some)).select("id_str", "full_text", quoted(both).alias("NER-Words"), quoted(
        F.transform(both, lambda w: F.lit("B-term"))).alias("NER-Tags"), (F.col("lang") == "en").alias("rfind"))
    rows = spans.annotation_spans(annotated, "id_str", nth=True)
    return rows.select("id_str", F.col("n_missing").cast("bigint").alias("n_missing"), F.inline("entities")).select(
        "id_str", "n_missing", "start", "end")


@query
def token_labels(spark, sf):
    """Labelled token table the tagger is trained on."""
    rows = spans.annotation_spans(fx.annotations(spark, sf), "id_str")
    return spans.token_table(rows, "id_str").select("id_str", "pos", "token", "start", "end", "label")


RULED_LABELS = ["O", "B-term", "B-unit", "I-term", "I-unit"]
_GOES_ON = ("the", "and", "ing", "der", "die", "und", "des", "les", "que", "las")


def _ruled_tokens(posts: DataFrame) -> DataFrame:
    """Tokens of posts with labels by a rule: two endings begin an entity, each of its kind; ten endings go on with the entity
    before them, whichever it is, and are nothing elsewhere."""
    by_post = W.partitionBy("id_str").orderBy("pos")
    ending = F.right(F.lower("token"), F.lit(3))
    own = F.when(ending == "ion", "term").when(ending == "eau", "unit").when(ending.isin(*_GOES_ON), None).otherwise("")
    rows = tagger.token_context(posts, "id_str").withColumn("own", own)
    rows = rows.withColumn("kind", F.coalesce("own", F.last("own", ignorenulls=True).over(by_post), F.lit("")))
    label = F.when(F.col("kind") == "", "O").when(F.col("own").isNull(), F.concat(F.lit("I-"), "kind")).otherwise(F.concat(F.lit("B-"), "kind"))
    return rows.withColumn("label", label).drop("own", "kind")


def _ruled_texts(posts: DataFrame) -> DataFrame:
    """``(id_str, tokens)``: as ``_ruled_tokens``, for posts with an id of their own, which are labelled where they are, without a shuffle."""
    def label_all(endings: pd.Series) -> pd.Series:
        """A token that goes on (-1) has the kind of the last one before it that does not: 0, 1 and 2 as they are, 3 and 4 for what goes on."""
        def label(own: np.ndarray | None) -> np.ndarray:
            if own is None or not len(own):
                return np.empty(0, np.int32)
            last = np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), -1))
            kind = np.where(last >= 0, own[last], 0)
            return np.where((own < 0) & (kind > 0), kind + 2, kind).astype(np.int32)

        return pd.Series([label(x) for x in endings], dtype=object)

    def number(t):
        ending = F.right(F.lower(t["token"]), F.lit(3))
        return F.when(ending == "ion", 1).when(ending == "eau", 2).when(ending.isin(*_GOES_ON), -1).otherwise(0)

    # Marked so that no plan labels the tokens a second time.
    found = F.pandas_udf(label_all, "array<int>").asNondeterministic()
    rows = tagger.listed_context(posts, "id_str").withColumn("numbers", found(F.transform("tokens", number)))
    names = F.array(*[F.lit(x) for x in RULED_LABELS])
    return rows.select("id_str", F.zip_with("tokens", "numbers", lambda t, n: F.struct(
        t["pos"].alias("pos"), t["token"].alias("token"), t["previous"].alias("previous"), t["following"].alias("following"), F.get(names, n).alias("label"))).alias("tokens"))


def _by_id(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with an id of their own, posts with an id that several have)."""
    again = stored(posts.groupBy("id_str").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id_str").alias("_again")), "again")
    if again.isEmpty():
        return posts, posts.limit(0)
    same = F.col("id_str").eqNullSafe(F.col("_again"))
    return posts.join(never_broadcast(again), same, "left_anti"), posts.join(never_broadcast(again), same, "left_semi")


def _ruled_tagger(spark, single: DataFrame, repeated: DataFrame) -> tagger.Tagger:
    """Trained and read from where it is stored."""
    path = scratch_path(spark, "tagger")
    tagger.train_tagger(_ruled_tokens(repeated), "id_str", texts=_ruled_texts(single)).save(spark, path)
    return jobs.load_tagger(spark, path)


def _tags_of_texts(single: DataFrame, model: tagger.Tagger) -> DataFrame:
    """``(label, tag, n)`` of the tokens of posts with an id of their own: labels and tags meet post by post, tokens are not shuffled."""
    labels = _ruled_texts(single).select("id_str", F.transform("tokens", lambda t: t["label"]).alias("labels"))
    tags = tagger.tag_tokens(single, model).groupBy("id_str").agg(F.collect_list(F.struct("pos", "tag")).alias("tags"))
    both = F.transform("tags", lambda t: F.struct(F.get("labels", t["pos"]).alias("label"), t["tag"].alias("tag")))
    pairs = stored(labels.join(never_broadcast(tags), "id_str").select(F.inline(both)).groupBy("label", "tag").agg(F.count("*").alias("n")), "pairs")
    every = labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    rest = every.unionByName(pairs.select("label", (-F.col("n")).alias("n"))).groupBy("label").agg(F.sum("n").alias("n"))
    return pairs.unionByName(rest.select("label", F.lit("O").alias("tag"), "n"))


@query
def train_tagger(spark, sf):
    """Labels of the tokens of all posts against their tags."""
    single, repeated = _by_id(fx.posts(spark, sf))
    model = _ruled_tagger(spark, single, repeated)
    found = tagger.tag_tokens(repeated, model).select("id_str", "pos", "tag")
    scored = _ruled_tokens(repeated).join(found, ["id_str", "pos"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))
    counts = scored.groupBy("label", "tag").agg(F.count("*").alias("n")).unionByName(_tags_of_texts(single, model))
    return counts.groupBy("label", "tag").agg(F.sum("n").alias("n")).where("n > 0")


@query
def tag_posts(spark, sf):
    """Entities of all posts: a token that begins one and all that go on with it."""
    return tagger.tag_posts(fx.posts(spark, sf), _ruled_tagger(spark, *_by_id(fx.posts(spark, sf))))


@query
def merge_runs(spark, sf):
    """Runs of tagged tokens: a token with ``tion`` starts, one with ``th`` goes on."""
    rows = tagger.token_context(fx.posts(spark, sf), "id_str")
    tag = F.when(F.contains("token", F.lit("tion")), "B-term").when(F.contains("token", F.lit("th")), "I-term")
    return tagger.merge_runs(rows.withColumn("tag", tag).where("tag is not null").select("id_str", "pos", "token", "tag"))


@query
def extract_information(spark, sf):
    ready = fx.ready(spark, _full_posts(spark, sf)).withColumn("predicted_irrelevant", F.lit(0))
    return _flat_summary(entities.extract_information(ready, "en", spark.sql(fx.GAZETTEER))).drop("full_text")


# --- end-to-end jobs and stream ---------------------------------------------------------------------


@query
def build_keywords(spark, sf):
    wide = fx.sheet(spark, sf)
    built = kw.build_keywords(wide.drop("keyword_type"), wide.drop("displacement_type"))
    return built.select("lang", "kind", "keyword", "keyword_type", "pos")


@query
def extract_pairs(spark, sf):
    tables = _tables(spark, "extract")
    tables.write_keywords(spark.sql(fx.SEARCH_WORDS))
    found = jobs.extract_pairs(tables, fx.posts(spark, sf), "en", RUN_DATE)
    return found.groupBy("trigger_kw", "lang", F.col("extraction_date").cast("string").alias("extraction_date")).agg(
        F.count("*").alias("n"))


@query
def preprocess_posts(spark, sf):
    done = jobs.preprocess(fx.posts(spark, sf), fx.keywords(spark), "en", jobs.TextTools(spark.sql(fx.LEXICON)))
    return hit_lists(done, "id_str", "full_text_preprocessed")


@query
def monitor_posts(spark, sf):
    """Flagship: tag, gate, clean, train on the labelled posts, classify the others, extract.

    The cleaned posts are stored once in the shared folder and read for both training and prediction.
    """
    gated = fx.tagged(spark, _full_posts(spark, sf), triggered_only=True)
    path = scratch_path(spark, "monitor")
    save_posts(cleaning.preprocess_text(gated, lexicon=spark.sql(fx.LEXICON)), path)
    ready = spark.read.parquet(path)
    model = classify.fit(stats.labelled_only(ready), "bayes")
    scored = model.predict(ready.where(F.col("irrelevant").isNull()).drop("irrelevant"))
    return _flat_summary(entities.extract_information(scored, "en", spark.sql(fx.GAZETTEER))).drop("full_text")


@query
def train_default(spark, sf):
    tables = _tables(spark, "default")
    stems = fx.keywords(spark).withColumn("lang", F.lit("en")).withColumn("keyword_type", F.col("kind"))
    tables.write_keywords(stems)
    tools = jobs.TextTools(lexicon=spark.sql(fx.LEXICON))
    counts, report = jobs.train_default(tables, _full_posts(spark, sf), "en", "bayes", tools)
    scored = report.classifier.predict(tables.load_labelled("en")).select("id_str", F.col("irrelevant").cast("int").alias("irrelevant"), "predicted_irrelevant")
    folds = _rounded(report.cv, "mean_score", "sd_score")
    return scored.crossJoin(F.broadcast(folds)).crossJoin(F.broadcast(counts.select("n_labelled", "n_all"))).withColumn(
        "score", F.round(F.lit(report.score), 4))


@query
def train_entities(spark, sf):
    """The tagger of the annotated posts tags every post as before when it is stored and loaded."""
    numbered = fx.annotations(spark, sf)
    before = tagger.train_tagger(spans.token_table(spans.annotation_spans(numbered, "id_str"), "id_str"), "id_str")
    path = scratch_path(spark, "tagger")
    before.save(spark, path)
    found = [
        tagger.tag_tokens(fx.posts(spark, sf), model).groupBy("id_str").agg(
            F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias(name))
        for name, model in (("a", before), ("b", jobs.load_tagger(spark, path)))
    ]
    every = fx.posts(spark, sf).select("id_str").join(found[0], "id_str", "left").join(found[1], "id_str", "left")
    return every.select("id_str", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query
def re_extract(spark, sf):
    tables = _tables(spark, "again")
    scored = fx.ready(spark, _full_posts(spark, sf)).withColumn("predicted_irrelevant", F.lit(1))
    key = RunKey("bayes", "en", "en", RUN_DATE)
    tables.save_predictions(scored.drop("lang"), key)
    summary = jobs.re_extract(tables, key, jobs.TextTools(gazetteer=spark.sql(fx.GAZETTEER)))
    return summary.select("id_str", listed("LOCATION").alias("places"), listed("TRIGGER").alias("triggers"))


@query
def monitor_stream(spark, sf):
    """One run of the stream over the document files, with the summary; each post is offered as often as it was found."""
    model = bayes.fit_bayes(_training(spark, sf))
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # A pattern, as a stream takes no single file; the table can be a file or a folder of files.
    arriving = monitor.read_post_stream(spark, f"{sf}/{{documents.parquet}}", schema).select(
        F.col("doc_id").cast("string").alias("id_str"), F.col("text").alias("full_text"), "lang",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 600).alias("created_at"))
    twice = arriving.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    monitor.monitor_stream(monitor.drop_repeats(twice), fx.keywords(spark), model, out, state,
                           spark.sql(fx.LEXICON), gazetteer=spark.sql(fx.GAZETTEER))
    return spark.read.parquet(out).select("id_str", "predicted_irrelevant", *[listed(c).alias(c.lower() + "_list") for c in entities.LISTS])


# --- posts that are stored once per matching pair ---------------------------------------------------


def _repeated(spark, sf) -> DataFrame:
    """The search result: a post comes once for each pair, always with the same id."""
    return matching.pair_search(fx.posts(spark, sf), spark.sql(fx.SEARCH_WORDS))


def _both_ways(fn: Callable[[int | None], DataFrame]) -> DataFrame:
    """The result with the dictionary as a literal, and with the dictionary joined."""
    return fn(20_000).withColumn("way", F.lit("literal")).unionByName(fn(0).withColumn("way", F.lit("join")))


@query
def repeated_match(spark, sf):
    return _both_ways(lambda most: hit_lists(
        matching.keyword_match(_repeated(spark, sf), fx.keywords(spark), max_literal=most), "id_str", "query"))


@query
def repeated_search(spark, sf):
    twice = fx.posts(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _both_ways(lambda most: matching.pair_search(twice, spark.sql(fx.SEARCH_WORDS), max_literal=most)
                      .select("id_str", "copy", "query"))


@query
def repeated_lemmas(spark, sf):
    p = _repeated(spark, sf).withColumn("tokens", tx.split_tokens(F.lower("full_text")))
    return _both_ways(lambda most: cleaning.lemmatize(p, "tokens", spark.sql(fx.LEXICON), "lemmas", max_literal=most)
                      .select("id_str", "query", tx.join_tokens("lemmas").alias("text")))


@query
def repeated_translation(spark, sf):
    p = _repeated(spark, sf).where("lang = 'fr'")
    return _both_ways(lambda most: cleaning.translate_by_lexicon(p, spark.sql(fx.TRANSLATIONS), "fr", "full_text", max_literal=most)
                      .select("id_str", "query", "full_text_translated"))


@query
def repeated_places(spark, sf):
    """With names of up to five words."""
    names = spark.sql(fx.GAZETTEER).unionByName(spark.sql(fx.LONG_PLACES))
    return _both_ways(lambda most: entities.extract_places(_repeated(spark, sf), names, max_literal=most)
                      .select("id_str", "query", listed("LOCATION").alias("places")))


@query
def repeated_bayes(spark, sf):
    """The model scores a post the same however often it is stored."""
    model = bayes.fit_bayes(_training(spark, sf))
    # Both ways read the cleaned posts twice: they are cleaned once.
    ready = cleaning.preprocess_text(_repeated(spark, sf), lexicon=spark.sql(fx.LEXICON))
    ready = stored(ready.select("id_str", "query", "full_text_preprocessed"), "ready")
    return _both_ways(lambda most: bayes.predict_bayes(ready, model, max_rows=most)
                      .select("id_str", "query", F.round("log_odds", 4).alias("log_odds"), "predicted_irrelevant"))


# --- runs that are repeated, empty, or of several languages -----------------------------------------


@query
def rerun_with_fewer_keywords(spark, sf):
    tables, words = _tables(spark, "rerun"), spark.sql(fx.SEARCH_WORDS)
    tables.write_keywords(words)
    jobs.extract_pairs(tables, fx.posts(spark, sf), "en", RUN_DATE)
    tables.write_keywords(words.where("keyword <> 'que'"))
    found = jobs.extract_pairs(tables, fx.posts(spark, sf), "en", RUN_DATE)
    return found.select("id_str", "trigger_kw", "lang", F.col("extraction_date").cast("string").alias("extraction_date"))


@query
def day_without_hits(spark, sf):
    """A day with posts is run again with words that no post has: its table is there, and empty."""
    tables, words = _tables(spark, "empty"), spark.sql(fx.SEARCH_WORDS)
    tables.write_keywords(words)
    before = jobs.extract_pairs(tables, fx.posts(spark, sf), "en", RUN_DATE).count()
    tables.write_keywords(words.withColumn("keyword", F.concat("keyword", F.lit("-nowhere"))))
    found = jobs.extract_pairs(tables, fx.posts(spark, sf), "en", RUN_DATE)
    return found.agg(F.count("*").alias("n")).withColumn("n_before", F.lit(before).cast("bigint"))


@query
def labelled_languages(spark, sf):
    """Labelled posts of four languages are kept apart."""
    tables = _tables(spark, "languages")
    stems = fx.keywords(spark).withColumn("keyword_type", F.col("kind"))
    tables.write_keywords(src.union_by_name([stems.withColumn("lang", F.lit(x)) for x in ("en", "de", "fr", "es")]))
    tools = jobs.TextTools(spark.sql(fx.LEXICON), translations=spark.sql(fx.TRANSLATIONS))
    parts = [jobs.preprocess_posts(tables, x, tools, fx.labelled(spark, sf)) for x in ("en", "de", "fr", "es")]
    return src.union_by_name([p.select("id_str", "lang", "irrelevant") for p in parts])


@query
def monitor_job(spark, sf):
    """The stored run from search to summary, with a model trained on the labelled English posts."""
    tables = _tables(spark, "job")
    words = spark.sql(fx.SEARCH_WORDS).withColumns({"stem": F.col("keyword"), "keyword_type": F.col("kind")})
    tables.write_keywords(words)
    tools = jobs.TextTools(lexicon=spark.sql(fx.LEXICON), gazetteer=spark.sql(fx.GAZETTEER))
    _, report = jobs.train_default(tables, fx.labelled(spark, sf), "en", "bayes", tools)
    summary = jobs.monitor_posts(tables, fx.posts(spark, sf), "en", RUN_DATE, "bayes", "en", tools)
    return summary.select("id_str", "full_text_preprocessed", "predicted_irrelevant", listed("LOCATION").alias("location_list"),
                          listed("TRIGGER").alias("trigger_list"), listed("TERM").alias("term_list"))
