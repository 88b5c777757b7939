"""Text normalisation of posts, lemmas and translation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions import text as tx
from postwatch.functions.lookup import KEY, MAX_LITERAL_ROWS, hashed_literal, map_tokens, salted_join, small_rows, value_key
from postwatch.session import scratch_path, stored

# Noun suffixes and what replaces them when looking for the base form, in this order
# (the published WordNet scheme).
NOUN_SUFFIXES = {"s": "", "ses": "s", "ves": "f", "xes": "x", "zes": "z", "ches": "ch", "shes": "sh",
                 "men": "man", "ies": "y"}


def _one_rule_away(forms: Column) -> Column:
    """All forms to which one suffix rule leads from one of ``forms``."""
    def stripped(suffix: str, base: str) -> Column:
        ending = F.filter(forms, lambda f: F.endswith(f, F.lit(suffix)))
        return F.transform(ending, lambda f: F.concat(F.left(f, F.length(f) - F.lit(len(suffix))), F.lit(base)))

    bases = [stripped(suffix, base) for suffix, base in NOUN_SUFFIXES.items()]
    return F.array_distinct(F.filter(F.flatten(F.array(*bases)), lambda f: f != ""))


def _shortest_noun(forms: Column, is_noun: Callable[[Column], Column]) -> Column:
    """The shortest of the known nouns among ``forms``, of several the first by code points; null if there is none."""
    return F.array_min(F.transform(F.filter(forms, is_noun), lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))["f"]


def lemma_in_place(token: Column, irregular: Callable[[Column], Column], is_noun: Callable[[Column], Column]) -> Column:
    """The base form of a token, or the token itself, with look-ups that travel with the query.

    The suffix rules are applied to what the last round gave, until a known noun comes out or no rule applies; the token itself
    counts with the first round. Every rule but one shortens a form and that one leads to no rule, so it ends within the token's length.
    """
    start = F.struct(F.array(token).alias("forms"), F.lit(None).cast("string").alias("noun"), F.lit(False).alias("over"), F.lit(True).alias("first"))

    def go_on(state: Column) -> Column:
        forms = _one_rule_away(state["forms"])
        noun = _shortest_noun(F.when(state["first"], F.concat(forms, F.array(token))).otherwise(forms), is_noun)
        return F.struct(forms.alias("forms"), noun.alias("noun"), (noun.isNotNull() | (F.size(forms) == 0)).alias("over"), F.lit(False).alias("first"))

    rounds = F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1)))
    ruled = F.aggregate(rounds, start, lambda state, _: F.when(state["over"], state).otherwise(go_on(state)), lambda state: F.coalesce(state["noun"], token))
    ends = lambda *endings: reduce(lambda a, b: a | b, [F.endswith(token, F.lit(e)) for e in endings])
    return F.coalesce(irregular(token), F.when(ends("ss", "ses", "mens"), ruled).when(ends("s", "men"), _after_one_round(token, is_noun)).otherwise(token))


def _after_one_round(token: Column, is_noun: Callable[[Column], Column]) -> Column:
    """``lemma_in_place`` of a token to whose forms no rule applies, as few tokens have others: two forms at most, the shorter one first."""
    ends = lambda ending: F.endswith(token, F.lit(ending))
    cut = lambda n: F.left(token, F.length(token) - F.lit(n))
    longer = {k: v for k, v in NOUN_SUFFIXES.items() if k not in ("s", "ses")}
    other = reduce(lambda form, rule: F.when(ends(rule[0]), F.concat(cut(len(rule[0])), F.lit(rule[1]))).otherwise(form), longer.items(), F.lit(None).cast("string"))
    noun = lambda form: F.when((form != "") & is_noun(form), form)
    return F.coalesce(noun(other), F.when(ends("s"), noun(cut(1))), token)


def lemma_table(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, value)`` of the distinct ``tokens(token)`` whose base form is another one, for lexicons of any size.

    Every token's forms, with the round that gave them, meet the known nouns in a join. Forms longer than all nouns are left
    out, so that a token of any length has few.
    """
    longest = lexicon.agg(F.max(F.length("lemma"))).first()[0] or 0
    regular = tokens.where(F.endswith("token", F.lit("s")) | F.endswith("token", F.lit("men")))
    fits = lambda fs: F.filter(fs, lambda f: F.length(f) <= F.lit(longest))
    found = "array<struct<round:int,form:string>>"
    listed = lambda fs, n: F.transform(fits(fs), lambda f: F.struct(n.cast("int").alias("round"), f.alias("form")))
    start = F.struct(F.array("token").alias("forms"), listed(F.array("token"), F.lit(1)).cast(found).alias("found"))

    def go_on(state: Column, n: Column) -> Column:
        forms = _one_rule_away(state["forms"])
        return F.struct(forms.alias("forms"), F.concat(state["found"], listed(forms, n).cast(found)).alias("found"))

    forms = F.aggregate(F.sequence(F.lit(1), F.length("token")), start,
                        lambda state, n: F.when(F.size(state["forms"]) == 0, state).otherwise(go_on(state, n)), lambda state: state["found"])
    nouns = lexicon.select(F.col("lemma").alias("form")).distinct()
    ruled = salted_join(regular.select("token", F.inline(forms)), nouns, "form", "token").groupBy("token").agg(
        F.min_by("form", F.struct("round", F.length("form").alias("n"), "form")).alias("value"))
    listed_forms = lexicon.where("token <> lemma").groupBy("token").agg(F.min("lemma").alias("value"))
    irregular = tokens.join(listed_forms, "token")
    return irregular.unionByName(ruled.join(listed_forms.select("token"), "token", "left_anti")).where("token <> value")


def lemmatize(posts: DataFrame, tokens_col: str, lexicon: DataFrame, out_col: str,
              max_literal: int = MAX_LITERAL_ROWS) -> DataFrame:
    """Noun lemma of each token; unknown tokens stay.

    ``lexicon(token, lemma)`` lists known nouns (token = lemma) and irregular forms, which keep their listed lemma. A lexicon of
    checked size is looked up where the tokens are, a larger one is joined with the distinct tokens.
    """
    rows = small_rows(lexicon.select("token", "lemma").distinct(), max_literal)
    if rows is not None:
        listed: dict[str, str] = {}
        for r in rows:
            if r["token"] != r["lemma"]:
                listed[r["token"]] = min(r["lemma"], listed.get(r["token"], r["lemma"]))
        lemma_of, nouns = hashed_literal(listed), hashed_literal({r["lemma"]: "x" for r in rows})
        # Few tokens are irregular: one test against a set spares the others the look-up.
        irregular = lambda t: F.when(t.isin(list(listed)), lemma_of(t))
        return posts.withColumn(out_col, F.transform(tokens_col, lambda t: lemma_in_place(t, irregular, lambda f: nouns(f).isNotNull())))
    # Read for the listed and for the regular forms.
    tokens = stored(posts.select(F.explode(F.array_distinct(tokens_col)).alias("token")).distinct(), "tokens")
    path = scratch_path(posts.sparkSession, "lemmas")
    lemma_table(tokens, lexicon).write.parquet(path)
    changed = posts.sparkSession.read.schema("token STRING, value STRING").parquet(path)
    return map_tokens(posts, tokens_col, changed, out_col, max_rows=max_literal)


def translate_with(posts: DataFrame, translate: Callable[[list[str]], list[str]],
                   text_col: str, out_col: str = "full_text_translated") -> DataFrame:
    """Translate by a user function, called once per Arrow batch with a list of texts; only the text
    column leaves the JVM.

    If a batch fails its texts are tried one by one; a text that fails by itself becomes ``""`` and
    its row is kept.
    """

    def one(text: str) -> str:
        try:
            return translate([text])[0] or ""
        except Exception:
            return ""

    def run(texts: pd.Series) -> pd.Series:
        asked = texts.fillna("").tolist()
        try:
            done = list(translate(asked)) if asked else []
            if len(done) != len(asked):
                raise ValueError("translator returned a different number of texts")
        except Exception:
            done = [one(t) for t in asked]
        return pd.Series([d or "" for d in done], dtype=object)

    # Marked so that no plan calls the translator a second time, for a filter on its answers.
    return posts.withColumn(out_col, F.pandas_udf(run, T.StringType()).asNondeterministic()(text_col))


def translate_remembered(posts: DataFrame, translate: Callable[[list[str]], list[str]], memory: str, lang: str,
                         text_col: str, out_col: str = "full_text_translated") -> DataFrame:
    """As ``translate_with``, with a memory: a table of (lang, text key, translation) below the path ``memory``.

    Only distinct texts of the language that the memory does not hold go to ``translate``, each once, and are then added to it; a text whose
    translation failed is not remembered, so the next run asks again. The memory is read by the language's partition and
    joined by key, without texts. A run that is repeated asks for nothing.
    """
    spark = posts.sparkSession
    known = _remembered(spark, memory, lang)
    keyed = posts.withColumn(KEY, value_key(text_col))
    asked = keyed.where(F.coalesce(F.col(text_col), F.lit("")) != "").groupBy(KEY).agg(F.first(text_col).alias("_text"))
    new = asked.join(known.select(F.col("key").alias(KEY)), KEY, "left_anti")
    answers = translate_with(new, translate, "_text", "translation").where("translation <> ''")
    answers.select(F.lit(lang).alias("lang"), F.col(KEY).alias("key"), "translation").write.mode("append").partitionBy("lang").parquet(memory)
    # A memory that two runs have added to may hold a text twice.
    once = _remembered(spark, memory, lang).groupBy(F.col("key").alias(KEY)).agg(F.min("translation").alias("_known"))
    return keyed.join(once, KEY, "left").withColumn(out_col, F.coalesce("_known", F.lit(""))).drop(KEY, "_known")


def _remembered(spark: SparkSession, memory: str, lang: str) -> DataFrame:
    schema = "key STRING, translation STRING, lang STRING"
    try:
        return spark.read.schema(schema).parquet(memory).where(F.col("lang") == lang).select("key", "translation")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select("key", "translation")


def translate_by_lexicon(posts: DataFrame, lexicon: DataFrame, lang: str, text_col: str,
                         out_col: str = "full_text_translated", max_literal: int = MAX_LITERAL_ROWS) -> DataFrame:
    """Token-by-token translation with ``lexicon(lang, token, translation)``; unknown tokens stay."""
    words = lexicon.where(F.col("lang") == lang).select("token", F.col("translation").alias("value"))
    tokens = posts.withColumn("_tokens", tx.split_tokens(text_col))
    mapped = map_tokens(tokens, "_tokens", words, "_translated", max_rows=max_literal)
    return mapped.withColumn(out_col, tx.join_tokens("_translated")).drop("_tokens", "_translated")


def preprocess_text(posts: DataFrame, language: str = "en", lexicon: DataFrame | None = None,
                    translator: Callable[[list[str]], list[str]] | None = None,
                    translations: DataFrame | None = None, text_col: str = "full_text",
                    keep_accents: bool = False,
                    stop_words: list[str] | None = None, memory: str | None = None) -> DataFrame:
    """Add ``full_text_preprocessed`` (and ``full_text_translated`` unless the language is English).

    Cleaning, translation, lower case, lemmas, stop words, punctuation, in this order. Without a
    lexicon tokens are their own lemmas. Another language needs a ``translator`` function or a
    ``translations`` lexicon; with ``memory``, the path of a table, a text is sent to the translator once and for all.
    """
    clean = tx.first_clean(text_col, keep_accents)
    if language == "en":
        work = posts.withColumn("_tokens", tx.split_tokens(F.lower(clean)))
    else:
        work = posts.withColumn("_clean", clean)
        if translator is not None and memory is not None:
            work = translate_remembered(work, translator, memory, language, "_clean")
        elif translator is not None:
            work = translate_with(work, translator, "_clean")
        elif translations is not None:
            work = translate_by_lexicon(work, translations, language, "_clean")
        else:
            raise ValueError(f"posts in {language!r} need a translator or a translation lexicon")
        work = work.withColumn("_tokens", tx.split_tokens(F.lower(tx.null_text("full_text_translated"))))
        work = work.drop("_clean")
    if lexicon is not None:
        work = lemmatize(work, "_tokens", lexicon, "_tokens")
    kept = tx.remove_stopwords("_tokens", stop_words)
    cleaned = F.trim(tx.strip_punctuation(tx.join_tokens(kept)))
    return work.withColumn("full_text_preprocessed", cleaned).drop("_tokens")
