import json

import pytest
from pyspark.sql import functions as F

from postwatch.functions import literals
from postwatch.operators import entities as e
from postwatch.operators import spans, tagger
from postwatch.schemas import USER


def posts_of(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id_str STRING, full_text STRING")


@pytest.mark.parametrize("limit", [100, 0])
def test_places(spark, limit):
    gazetteer = spark.createDataFrame([("New York",), ("York",), ("New York City",), ("Paris",), ("City Hall",)], "place STRING")
    posts = posts_of(spark, "in New York City Hall, York! (Paris)", "new york", "", None, "New -- York", "York York")
    got = [r["LOCATION"] for r in e.extract_places(posts, gazetteer, max_literal=limit).orderBy("id_str").collect()]
    assert got == [["New York City", "City Hall", "York", "Paris"], [], [], [], ["York"], ["York", "York"]]


def test_words_are_split_once_for_places(spark):
    gazetteer = spark.createDataFrame([("Paris",), ("New York",)], "place STRING")
    plan = e.extract_places(posts_of(spark, "Paris"), gazetteer).select("LOCATION")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2  # white space, and the words' ends


def test_no_gazetteer(spark):
    none = spark.createDataFrame([], "place STRING")
    assert e.extract_places(posts_of(spark, "Paris"), none).first()["LOCATION"] == []


def test_dates_and_figures(one):
    text = "On 2020-03-12 at 10:30 pm, 12 March 2020 or March 3, 2021; last week, 31/12/2019, ip 70.23.22.57"
    assert one(text, e.extract_dates) == ["2020-03-12", "10:30 pm", "12 March 2020", "March 3, 2021", "last week", "31/12/2019"]
    assert one("1,200 people, 3 million and thousands", e.extract_figures) == ["1,200", "3 million", "thousands"]
    assert one(None, e.extract_dates) == []


@pytest.mark.parametrize("written, expected", [
    ("{'id': 5, 'screen_name': \"o'b\", 'location': None, 'verified': True}", (5, "o'b", None, None, True)),
    ("{'id': 5, 'screen_name': 'None', 'location': 'x', 'created_at': 'y', 'verified': False}", (5, "None", "x", "y", False)),
])
def test_object_literal(one, written, expected):
    assert tuple(one(written, lambda c: literals.parse_object_literal(c, USER))) == expected
    assert tuple(one(written, e.user_struct)) == expected


def test_json_user_and_quarantine(spark, one):
    assert tuple(one(json.dumps({"id": 1, "screen_name": "a: None, b", "verified": True, "other": 3}), e.user_struct)) == (
        1, "a: None, b", None, None, True)
    frame = spark.createDataFrame([("nonsense",), ("{'id': 1}",), (None,)], "u STRING")
    bad = frame.select(literals.unreadable("u", literals.parse_object_literal("u", USER)).alias("x"))
    assert [r["x"] for r in bad.collect()] == ["nonsense", None, None]


def test_list_literal(one):
    assert one("['a', 'b c']", literals.parse_list_literal) == ["a", "b c"]
    assert one("nope", literals.parse_list_literal) is None


def annotated(spark):
    return spark.createDataFrame([
        (1, "5 people displaced, people fled", "['B-fig', 'B-unit', 'B-trig', 'I-trig']", "['5', 'people', 'displaced']", False),
        (2, "people and people", "['B-unit']", "['people']", True),
        (3, "nothing here", "['B-unit']", "['people']", False),
        (4, "dropped", None, "['dropped']", False), (5, "dropped", "['x']", "['dropped']", None),
    ], "id INT, full_text STRING, `NER-Tags` STRING, `NER-Words` STRING, rfind BOOLEAN")


def test_spans(spark):
    rows = {r["id"]: r for r in spans.annotation_spans(annotated(spark), "id").collect()}
    assert [tuple(s) for s in rows[1]["entities"]] == [(0, 1, "B-fig"), (2, 8, "B-unit"), (9, 18, "B-trig")]
    assert [tuple(s) for s in rows[2]["entities"]] == [(11, 17, "B-unit")]
    assert rows[3]["entities"] == [] and rows[3]["n_missing"] == 1
    assert set(rows) == {1, 2, 3}
    assert spans.drop_incomplete_annotations(annotated(spark)).count() == 3


def test_nth_spans_of_listed_words(spark):
    """Words one after the other and from the end, an empty word, a missing one, one that overlaps itself; the lists are read once."""
    rows = spark.createDataFrame([
        (1, "aaa b aa", "['1', '2', '3', '4', '5', '6']", "['aa', 'b', 'aa', null, 'aa', '']", False),
        (2, "aaa b aa", "['1', '2', '3', '4']", "['aa', 'zz', 'aa', 'aa']", True),
        (3, "é\U0001F600é", "['1', '2']", "['é', 'é']", True), (4, "x", "nothing", "['x']", True),
    ], "id INT, full_text STRING, `NER-Tags` STRING, `NER-Words` STRING, rfind BOOLEAN")
    placed = spans.annotation_spans(rows, "id", nth=True)
    got = {r["id"]: ([(s["start"], s["end"], s["tag"]) for s in r["entities"]], r["n_missing"]) for r in placed.collect()}
    assert got == {1: ([(0, 2, "1"), (4, 5, "2"), (6, 8, "3"), (0, 0, "6")], 2), 2: ([(6, 8, "1"), (1, 3, "3")], 2), 3: ([(2, 3, "1"), (0, 1, "2")], 0)}
    plan = placed.select("id", F.inline("entities"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2


def test_token_table(spark):
    rows = spans.token_table(spans.annotation_spans(annotated(spark), "id"), "id").where("id = 1").orderBy("pos").collect()
    assert [(r["token"], r["label"], r["start"], r["previous"]) for r in rows] == [
        ("5", "B-fig", 0, None), ("people", "B-unit", 2, "5"), ("displaced,", "B-trig", 9, "people"),
        ("people", "O", 20, "displaced,"), ("fled", "O", 27, "people")]


def test_token_offsets_with_odd_space(spark):
    text = " a  b\n\tcc "
    frame = spark.createDataFrame([(1, text, [])], "id INT, text STRING, entities " + spans.SPANS)
    for r in spans.token_table(frame, "id").collect():
        assert text[r["start"]:r["end"]] == r["token"]


def test_context_needs_no_shuffle(spark):
    rows = tagger.token_context(posts_of(spark, "a b c", "", None), "id_str")
    assert [tuple(r) for r in rows.collect()] == [("0", 0, "a", None, "b"), ("0", 1, "b", "a", "c"), ("0", 2, "c", "b", None)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_merge_runs(spark):
    rows = [("1", 0, "10", "B-fig"), ("1", 1, "many", "I-fig"), ("1", 2, "x", "I-unit"), ("1", 4, "y", "I-unit"), ("1", 5, "z", "B-unit")]
    tagged = spark.createDataFrame(rows, "id_str STRING, pos INT, token STRING, tag STRING")
    got = sorted(tuple(r) for r in tagger.merge_runs(tagged).collect())
    assert got == [("1", 0, "fig", "10 many"), ("1", 2, "unit", "x"), ("1", 4, "unit", "y"), ("1", 5, "unit", "z")]


def test_tagger_recovers_training_spans(spark, tmp_path):
    from postwatch.plans.jobs import load_tagger, train_entities

    texts = [f"{n} people were displaced near town {n}" for n in range(2, 30)]
    rows = [(t, "['B-fig', 'B-unit', 'B-trig']", f"['{t.split()[0]}', 'people', 'displaced']", False) for t in texts]
    rows += [(f"nothing much to see by people {n}", "['B-unit']", "['people']", False) for n in range(2, 30)]
    annotations = spark.createDataFrame(rows, "full_text STRING, `NER-Tags` STRING, `NER-Words` STRING, rfind BOOLEAN")
    train_entities(annotations, str(tmp_path / "tagger"), max_iter=30)
    model = load_tagger(spark, str(tmp_path / "tagger"))
    posts = posts_of(spark, "7 people were displaced near town 7", "nothing to see")
    done = {r["id_str"]: r for r in e.extract_tags(posts, model).collect()}
    assert (done["0"]["TRIGGER"], done["0"]["UNIT"], done["0"]["FIGURE"], done["0"]["TERM"]) == (["displaced"], ["people"], ["7"], [])
    assert done["1"]["TRIGGER"] == []
    assert {(r["label"], r["text"]) for r in tagger.tag_posts(posts, model).collect()} == {("fig", "7"), ("unit", "people"), ("trig", "displaced")}


def test_summary_columns(spark):
    posts = posts_of(spark, "x").withColumns({
        "full_text_preprocessed": F.lit("x"), "predicted_irrelevant": F.lit(1), "retweeted": F.lit(False),
        "user": F.lit('{"id": 1, "screen_name": "a"}'), "full_text_translated": F.lit("y")})
    base = ["id_str", "full_text", "full_text_preprocessed", "predicted_irrelevant", "retweeted", "user_info"]
    assert e.post_summary(posts, "en").columns == base
    full = e.post_summary(posts.withColumn("irrelevant", F.lit(1.0)).withColumn("created_at", F.lit("d")), "fr").columns
    assert full == ["id_str", "created_at", "full_text", "full_text_preprocessed", "full_text_translated", "irrelevant",
                    "predicted_irrelevant", "retweeted", "user_info"]


def labelled_tokens(spark, posts):
    """Rows of (id, tokens with labels) as the tagger trains on them."""
    rows = []
    for i, post in enumerate(posts):
        words = [w for w, _ in post]
        for at, (w, label) in enumerate(post):
            rows.append((str(i), at, w, words[at - 1] if at else None, words[at + 1] if at + 1 < len(words) else None, label))
    return spark.createDataFrame(rows, "id_str STRING, pos INT, token STRING, previous STRING, following STRING, label STRING")


def test_tagger_decides_by_the_label_before(spark):
    """One word goes on with either entity: between two words that say nothing, only the label before it tells which."""
    import random

    rng = random.Random(2)
    posts = []
    for _ in range(150):
        post = []
        for _ in range(6):
            kind = rng.choice(["term", "unit", None])
            post += [(f"w{rng.randrange(40)}", "O") for _ in range(rng.randrange(3))]
            if kind:
                # The word between them hides the entity's first word from the features of the last.
                post += [({"term": "tide", "unit": "kilo"}[kind], f"B-{kind}"), ("of", f"I-{kind}"), ("more", f"I-{kind}")]
            else:
                post += [("of", "O"), ("more", "O")]
        posts.append(post)
    model = tagger.train_tagger(labelled_tokens(spark, posts[:100]), "id_str", num_features=1 << 10, max_iter=40, piece=7)
    texts = [" ".join(w for w, _ in p) for p in posts[100:]]
    got = {(r["id_str"], r["pos"]): r["tag"] for r in tagger.tag_tokens(posts_of(spark, *texts), model).collect()}
    want = {(str(i), at): label for i, p in enumerate(posts[100:]) for at, (_, label) in enumerate(p) if label != "O"}
    assert got == want
    found = [(r["label"], r["text"]) for r in tagger.tag_posts(posts_of(spark, "of more tide of more of more kilo of more"), model).orderBy("pos").collect()]
    assert found == [("term", "tide of more of more"), ("unit", "kilo of more")] or found == [("term", "tide of more"), ("unit", "kilo of more")]


def test_chain_sums_and_best_sequences_against_all_sequences():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    sizes, k = np.array([1, 4, 3]), 3
    scores, transitions = rng.normal(size=(8, k)), rng.normal(size=(k + 1, k))
    gold = rng.integers(0, k, 8)

    def value(own, e):
        return transitions[-1, own[0]] + sum(e[i, y] for i, y in enumerate(own)) + sum(transitions[a, b] for a, b in zip(own, own[1:]))

    loss, by_token, by_pair, best = 0.0, np.zeros((8, k)), np.zeros((k + 1, k)), []
    for lo, n in zip((0, 1, 5), sizes):
        e = scores[lo:lo + n]
        ways = list(product(range(k), repeat=int(n)))
        p = np.exp([value(w, e) for w in ways])
        p /= p.sum()
        right = tuple(gold[lo:lo + n])
        loss -= np.log(p[ways.index(right)])
        best += ways[int(p.argmax())]
        for w, share in [*zip(ways, p), (right, -1.0)]:
            by_pair[k, w[0]] += share
            for i, y in enumerate(w):
                by_token[lo + i, y] += share
                if i:
                    by_pair[w[i - 1], y] += share
    found = tagger.expected_counts(scores, sizes, transitions, gold)
    assert found[0] == pytest.approx(loss) and np.allclose(found[1], by_token) and np.allclose(found[2], by_pair)
    assert tagger.best_labels(scores, sizes, transitions).tolist() == best


def test_tagger_without_rows(spark):
    none = labelled_tokens(spark, [])
    model = tagger.train_tagger(none, "id_str", num_features=16)
    assert tagger.tag_tokens(posts_of(spark, "a b", "", None), model).count() == 0


def test_nth_occurrence(spark):
    rows = [("aba b aba aba", "['B-fig', 'I-fig', 'B-term', 'B-unit']", "['aba', 'aba', 'aba', 'aba']", last) for last in (False, True)]
    annotations = spark.createDataFrame(rows, "full_text STRING, `NER-Tags` STRING, `NER-Words` STRING, rfind BOOLEAN")
    got = [([(s["start"], s["end"], s["tag"]) for s in r["entities"]], r["n_missing"]) for r in spans.annotation_spans(annotations, nth=True).collect()]
    assert got == [([(0, 3, "B-fig"), (6, 9, "I-fig"), (10, 13, "B-term")], 1), ([(10, 13, "B-fig"), (6, 9, "I-fig"), (0, 3, "B-term")], 1)]
    same = spans.annotation_spans(annotations).collect()
    assert [len({(s["start"], s["end"]) for s in r["entities"]}) for r in same] == [1, 1]


def test_chain_sums_of_scores_far_apart():
    """Shares that doubles cannot hold are summed as logarithms; a training pass takes no more than a few microseconds a token."""
    import time

    import numpy as np

    rng = np.random.default_rng(2)
    sizes, k = np.array([3, 5]), 3
    scores, transitions = 2000 * rng.normal(size=(8, k)), 2000 * rng.normal(size=(k + 1, k))
    gold = rng.integers(0, k, 8)
    loss, by_token, by_pair = tagger.expected_counts(scores, sizes, transitions, gold)
    want = tagger._expected_counts_by_logs(scores, sizes, transitions, gold)
    assert loss == pytest.approx(want[0]) and np.allclose(by_token, want[1]) and np.allclose(by_pair, want[2]) and np.isfinite(loss)
    sizes, k = np.full(400, 128), 5
    scores, transitions, gold = rng.normal(size=(128 * 400, k)), rng.normal(size=(k + 1, k)), rng.integers(0, k, 128 * 400)
    began = time.process_time()
    found = tagger.expected_counts(scores, sizes, transitions, gold)
    fast, began = time.process_time() - began, time.process_time()
    want = tagger._expected_counts_by_logs(scores, sizes, transitions, gold)
    assert fast < 0.7 * (time.process_time() - began)
    assert found[0] == pytest.approx(want[0]) and np.allclose(found[1], want[1]) and np.allclose(found[2], want[2])


def test_texts_are_trained_on_where_they_are(spark):
    """Rows of tokens and lists of the same texts give one model, whether texts are longer than a piece, empty or have few tokens of a kind."""
    import numpy as np

    rng = np.random.RandomState(3)
    words = ["kilo", "more", "tide", "of", "Ärger", "x1"]
    posts = posts_of(spark, *[" ".join(rng.choice(words, n)) for n in (0, 1, 6, 7, 8, 40, 70, 15)], None)
    label = lambda t: F.when(t == "kilo", "B-unit").when(t == "more", None).otherwise("O")
    rows = tagger.token_context(posts, "id_str").withColumn("label", label(F.col("token")))
    texts = tagger.listed_context(posts, "id_str").select("id_str", F.transform("tokens", lambda t: t.withField("label", label(t["token"]))).alias("tokens"))
    assert sorted(map(str, texts.select("id_str", F.inline("tokens")).collect())) == sorted(map(str, rows.collect()))
    few = {"num_features": 1 << 6, "max_iter": 4, "piece": 7}
    models = [tagger.train_tagger(rows, "id_str", **few), tagger.train_tagger(rows.limit(0), "id_str", texts=texts, **few),
              tagger.train_tagger(rows.where("id_str < '4'"), "id_str", texts=texts.where("id_str >= '4'"), **few)]
    for model in models[1:]:
        assert model.labels == models[0].labels == ["O", "B-unit"]
        assert np.allclose(model.emissions, models[0].emissions, atol=1e-6) and np.allclose(model.transitions, models[0].transitions, atol=1e-6)


def test_a_pass_leaves_few_slopes_behind(spark):
    """As many tasks add up slopes as there are cores, however many partitions the texts have."""
    posts = posts_of(spark, *["kilo of more"] * 60).repartition(30)
    texts = tagger.listed_context(posts, "id_str").select("id_str", F.transform("tokens", lambda t: t.withField(
        "label", F.when(t["token"] == "kilo", "B-unit").otherwise("O"))).alias("tokens"))
    rows = tagger.token_context(posts.limit(0), "id_str").withColumn("label", F.lit("O"))
    spark.sparkContext.setJobGroup("slopes", "")
    tagger.train_tagger(rows, "id_str", num_features=16, max_iter=2, texts=texts)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    last = [tracker.getStageInfo(i) for j in sorted(tracker.getJobIdsForGroup("slopes"))[-3:] for i in tracker.getJobInfo(j).stageIds]
    assert last and max(s.numTasks for s in last if s) <= spark.sparkContext.defaultParallelism


def test_ruled_texts_as_ruled_tokens(spark):
    """Posts with an id of their own are labelled where they are, as the window labels them; ids of several posts are kept apart."""
    from postwatch.plans import queries

    texts = ["Station the and of", "the der nation ing beau les x", "", None, "la la", "ION die EAU und que las the", "bureau the"]
    posts = spark.createDataFrame([(str(i), t, "en", "s") for i, t in enumerate(texts)] + [("9", "nation the", "en", "s"), ("9", "the nation", "en", "s"), (None, "beau des", "en", "s")],
                                  "id_str STRING, full_text STRING, lang STRING, source STRING")
    single, repeated = queries._by_id(posts)
    assert sorted(r["full_text"] for r in repeated.collect()) == ["nation the", "the nation"] and single.count() == 8
    columns = ["id_str", "pos", "token", "previous", "following", "label"]
    of = lambda df: sorted(map(str, df.select(*columns).collect()))
    got = of(queries._ruled_texts(single).select("id_str", F.inline("tokens")))
    assert got == of(queries._ruled_tokens(single)) and len(got) == 24 and sum("I-" in r for r in got) == 11
