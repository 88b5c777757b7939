"""Keyword tables: from wide sheets to ``keywords(lang, kind, keyword, keyword_type, pos, stem)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.stemmer import porter_stem

# Keyword types of the term/unit sheet, by kind.
KIND_TYPES = {"term": ["structure_term", "person_term"], "unit": ["structure_unit", "person_unit"]}
KINDS = ("trigger", "term", "unit")


def split_keyword_kind(sheet: DataFrame) -> DataFrame:
    """Add ``kind`` (term or unit) from ``keyword_type``; other types are dropped."""
    kind = reduce(
        lambda acc, item: acc.when(F.col("keyword_type").isin(item[1]), F.lit(item[0])),
        list(KIND_TYPES.items())[1:],
        F.when(F.col("keyword_type").isin(KIND_TYPES["term"]), F.lit("term")),
    )
    return sheet.withColumn("kind", kind).where(F.col("kind").isNotNull())


def language_column(sheet: DataFrame, lang: str) -> Column | None:
    """The sheet column of a language, or None if the sheet has none."""
    return F.col(lang.upper()) if lang.upper() in sheet.columns else None


def sheet_languages(sheet: DataFrame, type_col: str) -> list[str]:
    """Language codes of a sheet: every upper-case two-letter column."""
    return [c.lower() for c in sheet.columns if len(c) == 2 and c.isupper() and c != type_col]


def unpivot_languages(sheet: DataFrame, ids: list[str], langs: list[str] | None = None) -> DataFrame:
    """Wide language columns to rows ``(*ids, lang, keyword)``; missing words and languages are dropped."""
    langs = sheet_languages(sheet, ids[-1]) if langs is None else langs
    present = [c.upper() for c in langs if language_column(sheet, c) is not None]
    return (
        sheet.unpivot(ids, present, "lang", "keyword")
        .where(F.col("keyword").isNotNull())
        .withColumn("lang", F.lower("lang"))
    )


def keyword_dedupe(words: DataFrame) -> DataFrame:
    """One row per (lang, kind, keyword): the first position, the type of the last one.

    Positions are reduced per type first: that step keeps numbers only, so it hashes without sorting,
    and a keyword with very many rows is reduced before the shuffle.
    """
    per_type = words.groupBy("lang", "kind", "keyword", "keyword_type").agg(
        F.min("pos").alias("_first"), F.max("pos").alias("_last")
    )
    return per_type.groupBy("lang", "kind", "keyword").agg(
        F.max_by("keyword_type", "_last").alias("keyword_type"), F.min("_first").alias("pos")
    )


def stem_keywords(words: DataFrame) -> DataFrame:
    return words.withColumn("stem", porter_stem("keyword"))


def build_keywords(triggers: DataFrame, terms_units: DataFrame) -> DataFrame:
    """Keyword dictionary of all sheet languages."""
    trig = unpivot_languages(triggers, ["pos", "displacement_type"]).select(
        "lang", F.lit("trigger").alias("kind"), "keyword",
        F.col("displacement_type").alias("keyword_type"), "pos",
    )
    rest = unpivot_languages(split_keyword_kind(terms_units), ["pos", "kind", "keyword_type"]).select(
        "lang", "kind", "keyword", "keyword_type", "pos"
    )
    return stem_keywords(keyword_dedupe(trig.unionByName(rest)))


def known_languages(keywords: DataFrame) -> DataFrame:
    return keywords.select("lang").distinct()


def is_known_language(keywords: DataFrame, lang: str) -> bool:
    return not keywords.where(F.col("lang") == lang).isEmpty()


def require_language(keywords: DataFrame, lang: str) -> None:
    if not is_known_language(keywords, lang):
        known = sorted(r["lang"] for r in known_languages(keywords).collect())
        raise ValueError(f"unknown language {lang!r}, known: {known}")


def keyword_pairs(keywords: DataFrame) -> DataFrame:
    """Query strings ``term trigger`` of each language, as an equi join of the two word lists."""
    term = keywords.where("kind = 'term'").select("lang", F.col("keyword").alias("term"))
    trigger = keywords.where("kind = 'trigger'").select("lang", F.col("keyword").alias("trigger"))
    return trigger.join(term, "lang").withColumn("query", F.concat_ws(" ", "term", "trigger"))


def keyword_type_lookup(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """Add ``keyword_type`` to hits ``(lang, kind, keyword, ...)``."""
    types = keywords.select("lang", "kind", "keyword", "keyword_type")
    return hits.join(types, ["lang", "kind", "keyword"], "left")
