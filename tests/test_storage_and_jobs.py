import pytest
from pyspark.sql import functions as F

from postwatch.plans import jobs
from postwatch.session import scratch_path, shared_folder
from postwatch.sources import posts as src
from postwatch.sources import sheets
from postwatch.sources.tables import RunKey, Tables, newest_date_from_names, save_posts


class FakeSession:
    """A session with the given setting, master and checkpoint folder."""

    def __init__(self, setting=None, master="yarn", folder=None):
        self.conf, self.sparkContext, self.master, self.folder = {"spark.checkpoint.dir": setting}, self, master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_follows_the_cluster(spark):
    assert shared_folder(FakeSession("hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(FakeSession(folder="hdfs:///own")) == "hdfs:///own"
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession())
    local = FakeSession(master="local[2]")
    assert shared_folder(local) == shared_folder(local) == local.folder
    assert scratch_path(spark, "x").startswith(shared_folder(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


AWKWARD = ['plain', 'semi;colon, comma', 'quote " inside', 'line\nbreak', ' spaces ', '', None, "back\\slash", 'é😀']


def test_csv_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(AWKWARD)], "id_str STRING, full_text STRING").coalesce(1)
    full = src.conform_columns(posts)
    assert full.columns == src.RAW_COLUMNS
    src.write_raw_csv(full, str(tmp_path / "raw"))
    file = src.list_files(spark, str(tmp_path / "raw"))[0]
    raw = open(file.replace("file:", ""), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfcreated_at;id;id_str;full_text")
    back = src.read_post_file(spark, file)
    assert {r["id_str"]: r["full_text"] for r in back.collect()} == {str(i): t for i, t in enumerate(AWKWARD)}
    assert dict(back.dtypes)["retweet_count"] == "bigint"


def test_directory_mixes_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id_str;full_text\n1;"x;y"\n')
    (tmp_path / "b.csv.txt").write_text("full_text,id_str,irrelevant\nz,2,1.0\n")
    (tmp_path / "notes.txt").write_text("ignored")
    (tmp_path / "empty.csv").write_text("")
    rows = {r["id_str"]: (r["full_text"], r["irrelevant"]) for r in src.read_post_dir(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("x;y", None), "2": ("z", 1.0)}
    assert src.read_post_file(spark, str(tmp_path / "empty.csv")) is None


def test_conform_columns_rejects_extras(spark):
    frame = spark.createDataFrame([("1", "x")], "id_str STRING, odd STRING")
    with pytest.raises(ValueError):
        src.conform_columns(frame)
    assert src.conform_columns(frame, ["id_str", "lang"], strict=False).columns == ["id_str", "lang"]


def test_sheets(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",EN,FR,ES,displacement_type\n0,displaced,déplacé,,forced\n")
    (tmp_path / "u.csv").write_text(",EN,FR,ES,keyword_type\n0,home,maison,casa,structure_term\n")
    triggers, terms = sheets.read_keyword_sheets(spark, str(tmp_path / "t.csv"), str(tmp_path / "u.csv"))
    assert tuple(triggers.first()) == (0, "displaced", "déplacé", None, "forced") and terms.first()["ES"] == "casa"
    (tmp_path / "v.csv").write_text(",EN,PT,keyword_type\n0,home,lar,structure_term\n")
    assert sheets.read_sheet(spark, str(tmp_path / "v.csv")).first()["PT"] == "lar"


def test_sheets_follow_their_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',FR,DE,EN,displacement_type\n0,déplacé,vertrieben,"say ""hi""",forced\n')
    (tmp_path / "u.csv").write_text(",EN,FR,ES,keyword_type\n0,home,maison,casa,structure_term\n")
    triggers, _ = sheets.read_keyword_sheets(spark, str(tmp_path / "t.csv"), str(tmp_path / "u.csv"))
    assert triggers.first().asDict() == {"pos": 0, "FR": "déplacé", "DE": "vertrieben", "EN": 'say "hi"', "displacement_type": "forced"}


def test_run_key():
    with pytest.raises(ValueError):
        RunKey("bayes", "en", "en")
    assert RunKey("bayes", "en", "en", test=True).date is None


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = spark.createDataFrame([(1, "en"), (2, "fr")], "x INT, lang STRING")
    save_posts(frame, path, ["lang"])
    save_posts(spark.createDataFrame([(3, "en")], "x INT, lang STRING"), path, ["lang"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(3, "en"), (2, "fr")}


def test_newest_date(spark):
    names = spark.createDataFrame([("/d/2024-01-02-en.csv",), ("/d/2024-01-10-en.csv",), ("/d/2023-05-01-fr.csv",), ("/d/x.csv",)], "path STRING")
    assert {(r["lang"], str(r["extraction_date"])) for r in newest_date_from_names(names).collect()} == {("en", "2024-01-10"), ("fr", "2023-05-01")}


USER = '{"id": 7, "screen_name": "s", "location": null, "created_at": "c", "verified": true}'


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    t = Tables(spark, str(tmp_path_factory.mktemp("root")))
    triggers = spark.createDataFrame([(0, "displaced", "déplacé", "forced")], "pos BIGINT, EN STRING, FR STRING, displacement_type STRING")
    terms = spark.createDataFrame([(0, "home", "maison", "structure_term"), (1, "people", "gens", "person_unit")],
                                  "pos BIGINT, EN STRING, FR STRING, keyword_type STRING")
    jobs.build_keywords(t, triggers, terms)
    return t


def labelled(spark, n=40):
    rows = [(str(i), f"{'flood' if i % 2 else 'party'} displaced home {i}", float((i + 1) % 2)) for i in range(n)]
    rows.append(("x", "no keyword", 1.0))
    rows.append(("y", "displaced", None))
    frame = spark.createDataFrame(rows, "id_str STRING, full_text STRING, irrelevant DOUBLE")
    return frame.withColumns({"user": F.lit(USER), "retweeted": F.lit(False), "retweeted_status": F.lit(None).cast("string")})


def test_full_run(spark, tables):
    counts, report = jobs.train_default(tables, labelled(spark), "en", "bayes", cross_valid=True)
    assert counts.first()["n_labelled"] == 41 and report.stats.first()["n_with_trigger"] == 40
    assert report.score == 1.0 and report.cv.first()["mean_score"] == 1.0

    corpus = spark.createDataFrame(
        [("a", "flood displaced home in Paris 12 March", None), ("b", "party displaced home", None), ("c", "displaced", None),
         ("d", "displaced home", "rt")], "id_str STRING, full_text STRING, retweeted_status STRING"
    ).withColumns({"user": F.lit(USER), "retweeted": F.lit(False), "created_at": F.lit("x")})
    tools = jobs.TextTools(gazetteer=spark.createDataFrame([("Paris",)], "place STRING"))
    summary = {r["id_str"]: r for r in jobs.monitor_posts(tables, corpus, "en", "2024-02-01", "bayes", "en", tools).collect()}
    assert {k: r["predicted_irrelevant"] for k, r in summary.items()} == {"a": 0, "b": 1}
    assert summary["a"]["LOCATION"] == ["Paris"] and summary["a"]["DATE"] == ["12 March"] and summary["a"]["TRIGGER"] == ["displaced"]
    assert summary["a"]["user_info"]["screen_name"] == "s"
    again = jobs.monitor_posts(tables, corpus, "en", "2024-02-01", "bayes", "en", tools)
    assert again.count() == 2
    assert str(tables.newest_raw_date("en")) == str(tables.newest_preprocessed_date("en")) == "2024-02-01"
    with pytest.raises(LookupError):
        tables.newest_raw_date("fr")

    french = labelled(spark, 6).withColumn("full_text", F.regexp_replace("full_text", "displaced", "déplacé"))
    jobs.preprocess_posts(tables, "fr", jobs.TextTools(translator=lambda ts: ts), french)
    _, score = jobs.test_classifier(tables, "fr", "en", "bayes")
    assert score == 1.0 and tables.load_predictions(RunKey("bayes", "fr", "en", test=True)).count() == 6


def test_dense_run_and_unknown_names(spark, tables):
    vectors = spark.createDataFrame([("flood", [1.0, 0.0]), ("party", [0.0, 1.0])], "token STRING, vector ARRAY<FLOAT>")
    save_posts(vectors, tables.path("embedding"))
    jobs.preprocess_posts(tables, "en", labelled=labelled(spark))
    report = jobs.train_classifier(tables, "en", "linear", {"max_iter": 3})
    assert report.score == 1.0 and jobs.model_exists(tables, "linear", "en")
    assert not jobs.model_exists(tables, "svm", "en")
    with pytest.raises(ValueError):
        jobs.train_classifier(tables, "xx", "linear")
    with pytest.raises(ValueError):
        jobs.train_classifier(tables, "en", "nope")


def test_runs_can_be_repeated(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    words = spark.createDataFrame(
        [("en", "trigger", "flee", 0, "flee", "x"), ("en", "trigger", "displaced", 1, "displac", "x"), ("en", "term", "home", 2, "home", "x")],
        "lang STRING, kind STRING, keyword STRING, pos INT, stem STRING, keyword_type STRING")
    corpus = spark.createDataFrame([("1", "flee home"), ("1", "flee home displaced"), ("2", "displaced home")], "id_str STRING, full_text STRING")
    t.write_keywords(words)
    first = jobs.extract_pairs(t, corpus, "en", "2024-01-01")
    assert sorted((r["id_str"], r["trigger_kw"]) for r in first.collect()) == [("1", "displaced"), ("1", "flee"), ("1", "flee"), ("2", "displaced")]
    assert set(src.RAW_COLUMNS) <= set(first.columns)
    t.write_keywords(words.where("keyword <> 'flee'"))
    assert {r["trigger_kw"] for r in jobs.extract_pairs(t, corpus, "en", "2024-01-01").collect()} == {"displaced"}
    assert jobs.extract_pairs(t, corpus.limit(0), "en", "2024-01-01").count() == 0
    assert jobs.preprocess_posts(t, "en", date="2024-01-01").count() == 0


def test_day_without_a_trigger_gives_an_empty_summary(spark, tables):
    jobs.preprocess_posts(tables, "en", labelled=labelled(spark))
    jobs.train_classifier(tables, "en", "bayes")
    quiet = spark.createDataFrame([("q", "nothing here")], "id_str STRING, full_text STRING")
    assert jobs.monitor_posts(tables, quiet, "en", "2024-03-01", "bayes", "en").count() == 0


def test_labelled_posts_of_other_languages_are_left_out(spark, tables):
    mixed = labelled(spark, 6).withColumn("lang", F.when(F.col("id_str") < "3", "en").otherwise("fr"))
    assert {r["id_str"] for r in jobs.combine_posts(tables, "en", mixed).collect()} == {"0", "1", "2"}


def test_missing_model_is_told_from_an_error(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    assert not jobs.model_exists(t, "bayes", "en")
    with pytest.raises(Exception):
        jobs.model_exists(Tables(spark, "nosuchscheme://x"), "bayes", "en")


def test_stream_equals_batch_and_can_continue(spark, tmp_path):
    from postwatch.operators.bayes import fit_bayes, predict_bayes
    from postwatch.operators.cleaning import preprocess_text
    from postwatch.operators.matching import keyword_match
    from postwatch.streaming import monitor

    words = spark.createDataFrame([("trigger", "displaced", 0, "displac")], "kind STRING, keyword STRING, pos INT, stem STRING")
    ready = preprocess_text(keyword_match(labelled(spark).where("irrelevant is not null"), words, triggered_only=True))
    model = fit_bayes(ready)
    schema = "id_str STRING, full_text STRING, created_at TIMESTAMP"
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, "id_str STRING, full_text STRING, created_at STRING").selectExpr(
            "id_str", "full_text", "to_timestamp(created_at) created_at").coalesce(1).write.mode("append").parquet(inbox)
        stream = monitor.read_post_stream(spark, inbox, spark.createDataFrame([], schema).schema)
        monitor.monitor_stream(monitor.drop_repeats(stream), words, model, out, state)

    arrive([("1", "flood displaced", "2024-01-01"), ("1", "flood displaced", "2024-01-01"), ("2", "nothing", "2024-01-01")])
    arrive([("1", "flood displaced", "2024-01-01"), ("3", "party displaced", "2024-01-01")])
    got = {r["id_str"]: r["predicted_irrelevant"] for r in spark.read.parquet(out).collect()}
    assert got == {"1": 0, "3": 1} and spark.read.parquet(out).count() == 2
    batch = spark.createDataFrame([("1", "flood displaced"), ("3", "party displaced")], "id_str STRING, full_text STRING")
    same = predict_bayes(preprocess_text(keyword_match(batch, words)), model)
    assert {r["id_str"]: r["predicted_irrelevant"] for r in same.collect()} == got


def test_sheets_are_written_compressed(spark, sf, tmp_path, monkeypatch):
    """A sheet has a row for every word of the posts: its files are compressed, and are read as before."""
    from postwatch.plans import queries

    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = queries.read_keyword_sheets(spark, sf)
    assert rows.count() == 2 * queries.fx.sheet(spark, sf).count()
    assert {p.suffix for p in tmp_path.glob("sheets/*/part-*")} == {".gz"}
