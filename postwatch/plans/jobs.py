"""End-to-end jobs over the tables of one root. Each stage is a lazy plan; writes and fits run it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.operators import keywords as kw
from postwatch.operators.classify import (
    Classifier, cross_validate, evaluate, fit, load_classifier, save_classifier, summarise_folds,
)
from postwatch.operators.cleaning import preprocess_text
from postwatch.operators.entities import extract_information
from postwatch.operators.matching import exclude_retweets, keyword_match, pair_search, trigger_gate, until_date
from postwatch.operators.models import is_known_model, list_models
from postwatch.operators.spans import annotation_spans, token_table
from postwatch.operators.splits import stratified_split
from postwatch.operators.stats import (
    confusion_matrix, label_stats, labelled_only, score_of_counts, training_stats,
)
from postwatch.operators.tagger import Tagger, train_tagger
from postwatch.schemas import RAW_COLUMNS
from postwatch.sources.posts import conform_columns, read_post_dir
from postwatch.sources.tables import RunKey, Tables


@dataclass
class TextTools:
    """Optional inputs of cleaning and extraction."""

    lexicon: DataFrame | None = None
    translator: Callable[[list[str]], list[str]] | None = None
    translations: DataFrame | None = None
    gazetteer: DataFrame | None = None
    tagger: Tagger | None = None
    memory: str | None = None  # where translations are remembered


@dataclass
class TrainingReport:
    stats: DataFrame
    score: float
    confusion: DataFrame
    cv: DataFrame | None
    classifier: Classifier


def build_keywords(tables: Tables, triggers: DataFrame, terms_units: DataFrame) -> DataFrame:
    tables.write_keywords(kw.build_keywords(triggers, terms_units))
    return tables.keywords()


def extract_pairs(tables: Tables, corpus: DataFrame, lang: str, run_date: str, ts_col: str | None = None) -> DataFrame:
    """Search a corpus for keyword pairs and store the matches as the raw posts of the day, in the raw layout.

    Retweets are left out where the corpus can tell them, and posts from the day of the run on if ``ts_col`` is given.
    Keywords that are gone since the last run of the day leave no posts behind; a day without hits is an empty table.
    """
    words = tables.keywords(lang)
    posts = exclude_retweets(corpus) if "retweeted_status" in corpus.columns else corpus
    posts = until_date(posts, ts_col, run_date) if ts_col else posts
    found = pair_search(posts, words)
    tables.save_raw(conform_columns(found, [*RAW_COLUMNS, "trigger_kw"], strict=False), run_date, lang)
    return tables.load_raw(lang, run_date)


def in_language(posts: DataFrame, lang: str) -> DataFrame:
    """Posts in a language, by their ``lang`` column if they have one; those that do not say count as in it."""
    return posts.where(F.col("lang").isNull() | (F.col("lang") == lang)) if "lang" in posts.columns else posts


def combine_posts(tables: Tables, lang: str, labelled: DataFrame | str | None = None,
                  date: str | None = None) -> DataFrame:
    """Posts to preprocess: those of a raw date (the newest by default), or the labelled ones of the language, given as a
    table or as a folder of delimited files."""
    if isinstance(labelled, str):
        labelled = read_post_dir(tables.spark, labelled)
    if labelled is not None:
        return in_language(labelled_only(labelled), lang)
    date = date or str(tables.newest_raw_date(lang))
    return tables.load_raw(lang, date)


def preprocess(posts: DataFrame, keywords: DataFrame, lang: str, tools: TextTools | None = None) -> DataFrame:
    """Keyword tags and cleaned text."""
    tools = tools or TextTools()
    tagged = keyword_match(posts, keywords)
    ready = preprocess_text(tagged, lang, tools.lexicon, tools.translator, tools.translations, memory=tools.memory)
    if "full_text_translated" not in ready.columns:
        # All languages share one stored layout.
        ready = ready.withColumn("full_text_translated", F.lit(None).cast("string"))
    return ready


def preprocess_posts(tables: Tables, lang: str, tools: TextTools | None = None, labelled: DataFrame | str | None = None,
                     date: str | None = None) -> DataFrame:
    posts = combine_posts(tables, lang, labelled, date)
    ready = preprocess(posts, tables.keywords(lang), lang, tools)
    if labelled is not None:
        tables.save_labelled(ready, lang)
        return tables.load_labelled(lang)
    date = date or str(tables.newest_raw_date(lang))
    tables.save_preprocessed(ready, date, lang)
    return tables.load_unlabelled(lang, date)


def _check(tables: Tables, model_type: str, *langs: str) -> None:
    for lang in langs:
        kw.require_language(tables.keywords(), lang)
    if not is_known_model(model_type):
        raise ValueError(f"unknown model {model_type!r}, known: {list_models()}")


def train_classifier(tables: Tables, lang: str, model_type: str, params: dict | None = None,
                     cross_valid: bool = False) -> TrainingReport:
    """Score a model trained on 80 %, then train on all posts with a trigger and store that model."""
    _check(tables, model_type, lang)
    labelled = tables.load_labelled(lang)
    gated = trigger_gate(labelled)
    embedding = None if model_type == "bayes" else tables.load_embedding()
    split = stratified_split(gated).persist()
    try:
        trial = fit(split.where(~F.col("is_test")), model_type, params, embedding)
        _, counts = evaluate(trial, split.where("is_test"))
        score = _store_counts(tables, counts, model_type, lang, lang)
        trial.release()
        cv = None
        if cross_valid:
            cv = summarise_folds(cross_validate(gated, model_type, params, embedding))
        final = fit(split, model_type, params, embedding)
        save_classifier(final, tables.path("models"), lang)
        final.release()
    finally:
        split.unpersist()
    stored = load_classifier(tables.spark, tables.path("models"), model_type, lang, embedding)
    return TrainingReport(training_stats(labelled), score, tables.read("confusion"), cv, stored)


def _store_counts(tables: Tables, counts: DataFrame, model_type: str, lang: str, class_lang: str) -> float:
    tables.save_confusion(counts, model_type, lang, class_lang)
    stored = tables.read("confusion").where(
        (F.col("model_type") == model_type) & (F.col("lang") == lang) & (F.col("class_lang") == class_lang))
    return stored.first()["balanced_accuracy"]


def model_exists(tables: Tables, model_type: str, lang: str) -> bool:
    folder = "base" if model_type == "bayes" else "metadata"
    path = f"{tables.path('models')}/{model_type}_{lang}/{folder}"
    try:
        return not tables.spark.read.text(path).limit(1).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def ensure_classifier(tables: Tables, lang: str, model_type: str, params: dict | None = None) -> Classifier:
    """The stored model, trained first if there is none."""
    if not model_exists(tables, model_type, lang):
        return train_classifier(tables, lang, model_type, params).classifier
    embedding = None if model_type == "bayes" else tables.load_embedding()
    return load_classifier(tables.spark, tables.path("models"), model_type, lang, embedding)


def _finish(tables: Tables, scored: DataFrame, key: RunKey, tools: TextTools) -> DataFrame:
    tables.save_predictions(scored, key)
    return re_extract(tables, key, tools)


def re_extract(tables: Tables, key: RunKey, tools: TextTools | None = None) -> DataFrame:
    """Extraction on stored predictions; replaces the stored summary of the run."""
    tools = tools or TextTools()
    gazetteer = tools.gazetteer
    if gazetteer is None:
        gazetteer = tables.spark.createDataFrame([], "place STRING")
    summary = extract_information(tables.load_predictions(key), key.lang, gazetteer, tools.tagger)
    tables.save_summary(summary, key)
    return tables.load_run("summaries", key)


def test_classifier(tables: Tables, lang: str, class_lang: str, model_type: str,
                    tools: TextTools | None = None) -> tuple[DataFrame, float]:
    """Test a stored model on the labelled posts of another language: (summary, balanced accuracy)."""
    _check(tables, model_type, lang, class_lang)
    classifier = ensure_classifier(tables, class_lang, model_type)
    key = RunKey(model_type, lang, class_lang, test=True)
    summary = _finish(tables, classifier.predict(tables.load_labelled(lang)), key, tools or TextTools())
    counts = score_of_counts(confusion_matrix(tables.load_predictions(key)))
    return summary, _store_counts(tables, counts, model_type, lang, class_lang)


test_classifier.__test__ = False  # a job, not a test case


def classify_posts(tables: Tables, lang: str, class_lang: str, model_type: str, date: str | None = None,
                   tools: TextTools | None = None) -> DataFrame:
    """Label the preprocessed posts of a date (the newest by default) and extract their information."""
    _check(tables, model_type, lang, class_lang)
    date = date or str(tables.newest_preprocessed_date(lang))
    classifier = ensure_classifier(tables, class_lang, model_type)
    scored = classifier.predict(tables.load_unlabelled(lang, date))
    return _finish(tables, scored, RunKey(model_type, lang, class_lang, date), tools or TextTools())


def train_default(tables: Tables, labelled: DataFrame, lang: str = "en", model_type: str = "svm",
                  tools: TextTools | None = None, cross_valid: bool = True) -> tuple[DataFrame, TrainingReport]:
    """Preprocess labelled posts and train on them: (label counts, report)."""
    preprocess_posts(tables, lang, tools, labelled)
    return label_stats(labelled), train_classifier(tables, lang, model_type, cross_valid=cross_valid)


def train_entities(annotations: DataFrame, path: str, max_iter: int = 50) -> Tagger:
    """Train the tagger on annotated posts and store it."""
    numbered = annotations.withColumn("_row", F.monotonically_increasing_id())
    train_tagger(token_table(annotation_spans(numbered, "_row"), "_row"), "_row", max_iter=max_iter).save(annotations.sparkSession, path)
    return load_tagger(annotations.sparkSession, path)


def load_tagger(spark: SparkSession, path: str) -> Tagger:
    return Tagger.load(spark, path)


def monitor_posts(tables: Tables, corpus: DataFrame, lang: str, run_date: str, model_type: str = "svm",
                  class_lang: str = "en", tools: TextTools | None = None, ts_col: str | None = None) -> DataFrame:
    """The full run of a day: search, tag and clean, classify, extract. Returns the summary."""
    _check(tables, model_type, lang, class_lang)
    extract_pairs(tables, corpus, lang, run_date, ts_col)
    preprocess_posts(tables, lang, tools, date=run_date)
    return classify_posts(tables, lang, class_lang, model_type, run_date, tools)
