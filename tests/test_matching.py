import random

import pytest
from pyspark.sql import functions as F

from postwatch.operators import keywords as kw
from postwatch.operators import entities, matching as m


@pytest.fixture(scope="module")
def words(spark):
    rows = [("trigger", "displaced", 0, "displac"), ("trigger", "evacuated", 1, "evacu"), ("term", "home", 2, "home"),
            ("unit", "people", 3, "peopl"), ("term", "natural disaster", 4, "natural disast")]
    return spark.createDataFrame(rows, "kind STRING, keyword STRING, pos INT, stem STRING")


def tag(spark, words, text, fn=m.keyword_match, **options):
    row = fn(spark.createDataFrame([("1", text, "en")], "id_str STRING, full_text STRING, lang STRING"), words, **options).first()
    return row["trigger"], row["term"], row["unit"]


TEXT = "People displaced and evacuees displacement Displaced"


@pytest.mark.parametrize("fn", [m.keyword_match, m.keyword_match_join])
def test_hits(spark, words, fn):
    assert tag(spark, words, TEXT, fn) == (["displaced", "evacuated", "displaced"], [], [])
    assert tag(spark, words, "#homeless homehome natural disaster", fn) == ([], ["home", "home"], [])
    assert tag(spark, words, None, fn) == ([], [], [])
    assert tag(spark, words, TEXT, fn, ignore_case=True)[0] == ["displaced", "evacuated", "displaced", "displaced"]


def test_one_token_many_keywords_in_keyword_order(spark, words):
    assert tag(spark, words, "evacudisplac")[0] == ["displaced", "evacuated"]


def test_variants_agree(spark, words):
    rng = random.Random(1)
    parts = ["displac", "evacu", "home", "peopl", " ", " ", "x", "natural disast", "Home"]
    rows = [(str(i), "".join(rng.choice(parts) for _ in range(12)), "en") for i in range(200)]
    posts = spark.createDataFrame(rows, "id_str STRING, full_text STRING, lang STRING")
    first, second = m.keyword_match(posts, words), m.keyword_match_join(posts, words)
    assert first.exceptAll(second.select(first.columns)).count() == 0
    gated = m.keyword_match(posts, words, triggered_only=True)
    assert gated.exceptAll(m.trigger_gate(first)).count() == 0 == m.trigger_gate(first).exceptAll(gated).count()
    by_join = m.keyword_match(posts, words, triggered_only=True, max_literal=1)
    assert by_join.count() == gated.count()


def search_words(spark):
    rows = [("en", "trigger", "displaced", 0), ("en", "trigger", "had to flee", 1), ("en", "term", "house", 2), ("en", "term", "camp", 3)]
    return spark.createDataFrame(rows, "lang STRING, kind STRING, keyword STRING, pos INT")


@pytest.mark.parametrize("limit", [100, 0])
def test_pair_search(spark, limit):
    posts = spark.createDataFrame(
        [("1", "House camp Displaced", "en"), ("2", "flee had to the camp", "en"), ("3", "displaced", "en"), ("4", None, "en")],
        "id_str STRING, full_text STRING, lang STRING")
    found = m.pair_search(posts, search_words(spark), max_literal=limit)
    assert sorted((r["id_str"], r["query"]) for r in found.collect()) == [
        ("1", "camp displaced"), ("1", "house displaced"), ("2", "camp had to flee")]
    once = m.pair_search(posts, search_words(spark), distinct_posts=True, max_literal=limit)
    assert {r["id_str"]: (r["trigger_kw"], r["term_kw"]) for r in once.collect()} == {
        "1": (["displaced"], ["house", "camp"]), "2": (["had to flee"], ["camp"])}


def test_keyword_pairs(spark):
    assert {r["query"] for r in kw.keyword_pairs(search_words(spark)).collect()} == {
        "house displaced", "camp displaced", "house had to flee", "camp had to flee"}


def test_predicates(spark):
    posts = spark.createDataFrame([("1", None, "2024-01-01"), ("2", "x", "2024-01-02")], "id_str STRING, retweeted_status STRING, d STRING")
    assert [r["id_str"] for r in m.exclude_retweets(posts).collect()] == ["1"]
    dated = posts.withColumn("ts", F.to_timestamp("d"))
    assert [r["id_str"] for r in m.until_date(dated, "ts", "2024-01-02").collect()] == ["1"]


def test_build_keywords(spark):
    triggers = spark.createDataFrame(
        [(0, "displaced", "déplacé", None, "forced"), (1, "evacuated", None, "evacuado", "forced"), (2, "displaced", "x", None, "other")],
        "pos BIGINT, EN STRING, FR STRING, ES STRING, displacement_type STRING")
    terms = spark.createDataFrame(
        [(0, "home", "maison", None, "structure_term"), (1, "people", "gens", None, "person_unit"), (2, "no", "non", None, "ignored")],
        "pos BIGINT, EN STRING, FR STRING, ES STRING, keyword_type STRING")
    rows = {(r["lang"], r["kind"], r["keyword"]): (r["keyword_type"], r["pos"], r["stem"]) for r in kw.build_keywords(triggers, terms).collect()}
    assert rows[("en", "trigger", "displaced")] == ("other", 0, "displac")
    assert rows[("es", "trigger", "evacuado")] == ("forced", 1, "evacuado")
    assert rows[("en", "term", "home")][0] == "structure_term" and rows[("fr", "unit", "gens")][0] == "person_unit"
    assert not any(k[2] in ("no", "non") for k in rows) and len(rows) == 9
    with pytest.raises(ValueError):
        kw.require_language(kw.build_keywords(triggers, terms), "pt")


def test_new_language_by_column(spark):
    sheet = spark.createDataFrame([(0, "a", "b", "t")], "pos BIGINT, EN STRING, PT STRING, keyword_type STRING")
    long = kw.unpivot_languages(sheet, ["pos", "keyword_type"])
    assert {(r["lang"], r["keyword"]) for r in long.collect()} == {("en", "a"), ("pt", "b")}
    assert kw.unpivot_languages(sheet, ["pos", "keyword_type"], ["en", "xx"]).count() == 1


def test_keyword_types(spark, words):
    posts = spark.createDataFrame([("1", "displaced home", "en")], "id_str STRING, full_text STRING, lang STRING")
    typed = words.withColumn("lang", F.lit("en")).withColumn("keyword_type", F.upper("kind"))
    hits = kw.keyword_type_lookup(m.explode_hits(m.keyword_match(posts, words)), typed)
    assert {(r["keyword"], r["keyword_type"]) for r in hits.collect()} == {("displaced", "TRIGGER"), ("home", "TERM")}


def test_filters_are_no_part_of_the_plan(spark):
    """Filters of many names and stems come as a subquery: as literals they were printed and copied with every step of a plan."""
    posts = spark.createDataFrame([("1", "n1 n2 n30000 x"), ("2", None)], "id_str STRING, full_text STRING")
    names = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("place"))
    placed = entities.extract_places(posts, names, max_literal=0)
    assert len(placed._jdf.queryExecution().toString()) < 100_000
    assert {r["id_str"]: r["LOCATION"] for r in placed.collect()} == {"1": ["n1", "n2"], "2": []}
    many = spark.range(5_000).select(F.concat_ws(" ", F.lit("a"), F.concat("id", F.lit("tion"))).alias("full_text"), F.col("id").cast("string").alias("id_str"))
    words = spark.createDataFrame([("trigger", "tions", 0, "tion")], "kind STRING, keyword STRING, pos INT, stem STRING")
    tagged = m.keyword_match_join(many, words)
    assert len(tagged._jdf.queryExecution().toString()) < 50_000
    assert tagged.where(F.size("trigger") == 1).count() == 5_000


def test_large_tables_are_not_broadcast(spark):
    """The driver holds a table that is broadcast several times over; 200,000 rows took more than it has beside others."""
    from postwatch.functions.lookup import KEY, salted_join

    facts = spark.createDataFrame([("k", "t7"), ("k", "none")], f"{KEY} STRING, token STRING")
    for n, hinted in ((200_000, False), (1_000, True)):
        joined = salted_join(facts, spark.range(n).select(F.concat(F.lit("t"), "id").alias("token"), "id"), "token")
        assert ("strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString()) == hinted
        assert [r["id"] for r in joined.collect()] == [7]


def test_substrings_are_sifted_once(spark):
    """The generator asks for no test of the size of what was sifted, which would sift a second time."""
    tokens = spark.createDataFrame([("abcdef",), ("xyz",), ("",)], "token STRING")
    index = spark.createDataFrame([("bcde", "bcde"), ("yz", "yz")], "stem STRING, anchor STRING")
    found = m.stem_candidates(tokens, index)
    assert sorted(map(tuple, found.collect())) == [("abcdef", "bcde"), ("xyz", "yz")]
    assert "(size(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hits_of_many_tokens_are_not_broadcast(spark, monkeypatch):
    """Posts that come once for each pair, with more tokens that have hits than are broadcast: as with the literal, in joins by sorting."""
    from postwatch.functions import lookup

    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    stems = spark.createDataFrame([("trigger", "k1", 0, "ab"), ("term", "k2", 1, "bc"), ("unit", "k3", 2, "zz")], "kind STRING, keyword STRING, pos INT, stem STRING")
    posts = spark.createDataFrame([("1", "abc xab", "q1"), ("1", "abc xab", "q2"), ("2", "none", "q1"), ("3", None, "q1"), ("4", "bcd abc", "q1")], "id_str STRING, full_text STRING, query STRING")
    ways = [m.keyword_match(posts, stems, max_literal=most) for most in (100, 0)]
    literal, joined = (sorted(map(str, df.select("id_str", "query", "trigger", "term", "unit").collect())) for df in ways)
    assert literal == joined and len(joined) == 5
    assert "Broadcast" not in ways[1]._jdf.queryExecution().executedPlan().toString()
