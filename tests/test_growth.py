"""Steps whose cost decides the large runs: what their plans must not hold, and that results are as before."""

from pyspark.sql import functions as F

from postwatch.functions import text as tx
from postwatch.operators import entities, spans

SPANS = "id INT, text STRING, entities ARRAY<STRUCT<start: INT, end: INT, tag: STRING>>"
COLUMNS = ["id", "pos", "token", "start", "end", "previous", "following", "label"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_single_characters_are_replaced_by_patterns(spark):
    """``translate`` makes an object per character: every text paid for spaces and signs that few hold."""
    text = "a　b ​c ‐ d e.f'g@h\\i]j^k-l_m"
    df = spark.createDataFrame([(text,), (None,)], "t STRING")
    done = df.select(tx.split_tokens("t").alias("tokens"), tx.strip_punctuation("t").alias("bare"))
    assert "translate(" not in plan_of(done)
    rows = done.collect()
    assert rows[0].tokens == ["a", "b", "​c", "‐", "d", "e.f'g@h\\i]j^k-l_m"]
    assert rows[0].bare == "a　b ​c ‐ d efghijklm"
    assert rows[1].tokens == [] and rows[1].bare is None


def test_first_looks_lose_nothing(spark):
    """What is looked at before a pattern is tried lets every match of the pattern through."""
    months = "january feb MAR april may jun July aug sept sep Oct november dec".split()
    names = "yesterday today tonight Tomorrow monday tuesday wednesday thursday friday saturday sunday".split()
    dates = [f"1 {m}" for m in months] + [f"{m} 2" for m in months] + names + ["last week", "This night", "next year", "7:05 pm", "3.4.2020", "2020-01-02"]
    text = " ; ".join(dates) + " xmonday 5march"
    df = spark.createDataFrame([(text, " ".join("cannot Gimme gonna GOTTA lemme Wanna xgonna".split()), "--ab- -- c'd «é» ª", )], "t STRING, f STRING, w STRING")
    row = df.select(entities.extract_dates("t").alias("d"), tx.word_tokenize("f").alias("f"), entities.bare_words("w").alias("w"),
                    F.regexp_extract_all("t", F.lit(entities.DATE_PATTERN), F.lit(0)).alias("all")).first()
    assert row.d == row["all"] == dates
    assert row.f == "can not Gim me gon na GOT TA lem me Wan na xgonna".split()
    assert row.w == ["ab", "", "c'd", "é", "ª"]


def test_tokens_of_single_texts_are_not_shuffled(spark):
    rows = [(1, "  ab cd　ef gh ", [(2, 4, "A"), (3, 8, "B"), (8, 8, "C")]), (2, "", []), (3, None, []), (4, "ab\U0001F44D cd", [(2, 3, "E")]), (None, "no id", [])]
    done = spans.token_table(spark.createDataFrame(rows, SPANS), "id").select(COLUMNS)
    assert "Window" not in plan_of(done) and "Join" not in plan_of(done)
    found = sorted((tuple(r) for r in done.where("id is not null").collect()))
    assert found == [
        (1, 0, "ab", 2, 4, None, "cd", "A"), (1, 1, "cd", 5, 7, "ab", "ef", "B"), (1, 2, "ef", 8, 10, "cd", "gh", "O"), (1, 3, "gh", 11, 13, "ef", None, "O"),
        (4, 0, "ab\U0001F44D", 0, 3, None, "cd", "E"), (4, 1, "cd", 4, 6, "ab\U0001F44D", None, "O")]
    assert done.where("id is null").count() == 2


def test_tokens_of_an_id_with_two_texts_are_numbered_together(spark):
    rows = [(1, "a b", []), (1, "c", []), (2, "d e", [(2, 3, "T")])]
    found = spans.token_table(spark.createDataFrame(rows, SPANS), "id").select("id", "pos", "label").collect()
    assert sorted((tuple(r) for r in found)) == [(1, 0, "O"), (1, 1, "O"), (1, 2, "O"), (2, 0, "O"), (2, 1, "T")]


def test_a_dictionary_that_is_repeated_for_each_salt_is_not_broadcast(spark, monkeypatch):
    """Spark takes it for as small as its file; the join gives each row its entry, and drops or keeps the others."""
    from postwatch.functions import lookup

    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 2 * 128)
    dictionary = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "token STRING, value INT")
    facts = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k1", "b"), ("k3", "x"), ("k4", None), ("k1", "a")], f"{lookup.KEY} STRING, token STRING")
    for how, want in (("inner", [("a", 1)] * 3 + [("b", 2)]), ("left", [("a", 1)] * 3 + [("b", 2), ("x", None), (None, None)])):
        joined = lookup.salted_join(facts, dictionary, "token", how=how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, joined.select("token", "value").collect())) == sorted(map(str, [f"Row(token={t!r}, value={v!r})" for t, v in want]))
