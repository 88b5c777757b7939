"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

FAST = [
    "read_post_file", "read_post_dir", "load_predictions", "newest_preprocessed_date", "trigger_gate", "post_summary",
    "user_struct", "keyword_pairs", "pair_search", "keyword_match", "lemma_lookup", "training_stats", "vocabulary",
    "balanced_accuracy", "entity_lists", "nb_statistics", "keyword_dedupe", "stratified_folds", "shuffle_rows", "strip_emoji",
    "strip_noise", "translate_posts", "preprocess_text", "find_offset", "parse_object_literal", "naive_bayes", "predict",
    "evaluate", "repeated_match", "repeated_search", "repeated_lemmas", "repeated_translation", "repeated_places", "repeated_bayes",
    "rerun_with_fewer_keywords", "day_without_hits", "labelled_languages", "combine_posts", "load_model", "random_forest", "monitor_job", "annotation_spans", "token_labels", "merge_runs", "build_keywords", "mean_pool", "monitor_posts",
    "keyword_match_many", "extract_places_many", "annotation_occurrences", "translate_remembered", "cross_validate", "train_default", "train_tagger", "stem_keywords",
]


def rows_of(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, sf, db, name):
    got = rows_of(entry_points.queries()[name](spark, sf).toPandas())
    assert got == rows_of(db.execute(entry_points.oracle_sql()[name]).fetchdf())


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_stream_reads_a_table_of_several_files(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    of = lambda path: sorted(map(str, entry_points.queries()["monitor_stream"](spark, path).collect()))
    assert of(str(tmp_path)) == of(sf) != []
