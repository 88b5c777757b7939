"""Information extraction: places, dates, custom entities and the summary table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions.literals import parse_object_literal
from postwatch.functions.lookup import KEY, MAX_LITERAL_ROWS, bloom_filter, one_of_each, salted_join, sift, small_rows, value_key
from postwatch.functions.text import ALNUM, fold_spaces, null_text
from postwatch.operators.tagger import Tagger, tag_tokens
from postwatch.schemas import USER
from postwatch.session import scratch_path, stored

# Dates, times of day and numbers as written in posts.
MONTH = ("(?:january|february|march|april|may|june|july|august|september|october|november|december"
         "|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)")
DATE_PATTERN = (
    r"(?i)\b(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
    r"|(?:0?[1-9]|[12][0-9]|3[01])[/.](?:0?[1-9]|1[0-2])[/.](?:19|20)[0-9]{2}"
    rf"|[0-9]{{1,2}} {MONTH}(?: (?:19|20)[0-9]{{2}})?"
    rf"|{MONTH} [0-9]{{1,2}}(?:,? (?:19|20)[0-9]{{2}})?"
    r"|[0-9]{1,2}:[0-9]{2}(?: ?[ap]m)?"
    r"|yesterday|today|tonight|tomorrow"
    r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|(?:last|this|next) (?:night|week|month|year|weekend))\b"
)
# A date begins with a digit or with letters that its names have in these places: a look at them spares most places the pattern.
DATE_START = "(?=[0-9]|[adfjlmnostwyADFJLMNOSTWY][acehopruACEHOPRU][bcdegilmnprstuvxyBCDEGILMNPRSTUVXY])"
FIGURE_PATTERN = (r"(?i)\b(?:[0-9]+(?:[.,][0-9]+)*(?: (?:hundred|thousand|million|billion))?"
                  r"|dozens|hundreds|thousands|millions)\b")
TAG_COLUMNS = {"B-trig": "TRIGGER", "B-term": "TERM", "B-unit": "UNIT", "B-fig": "FIGURE"}
LISTS = ["LOCATION", "DATE", "TRIGGER", "TERM", "UNIT", "FIGURE"]

_EDGES = r"(?=[^%s ])(?:(?<![^ ])[^%s \p{L}\p{N}]+|[^%s \p{L}\p{N}]+(?![^ ]))" % ((ALNUM,) * 3)


def empty_list() -> Column:
    return F.array().cast("array<string>")


def extract_dates(text: Column | str) -> Column:
    return F.regexp_extract_all(null_text(text), F.lit(DATE_START + DATE_PATTERN), F.lit(0))


def extract_figures(text: Column | str) -> Column:
    return F.regexp_extract_all(null_text(text), F.lit(FIGURE_PATTERN), F.lit(0))


def bare_words(text: Column | str) -> Column:
    """Tokens without punctuation at their ends (a token of punctuation only becomes empty)."""
    return F.split(F.regexp_replace(fold_spaces(text), _EDGES, ""), " ")


def _maximal(lengths: Column, longest: int) -> Column:
    """Match lengths per position, 0 where the match lies inside one that starts before it."""
    def covered(n, i):
        return reduce(lambda a, d: a | (F.coalesce(F.get(lengths, i - d), F.lit(0)) - d >= n), range(1, longest), F.lit(False))

    return F.transform(lengths, lambda n, i: F.when((n > 0) & ~covered(n, i), n).otherwise(0))


def extract_places(posts: DataFrame, gazetteer: DataFrame, text_col: str = "full_text",
                   out_col: str = "LOCATION", max_literal: int = MAX_LITERAL_ROWS) -> DataFrame:
    """Add the ordered list of gazetteer names, of any number of words, in each text.

    At each word the longest name counts; a name inside another one does not. White space in names counts as one
    space. ``gazetteer(place)`` of checked size is tested in place, a larger one is joined on the word sequences.
    """
    names = gazetteer.select(fold_spaces("place").alias("place")).where("place <> ''").distinct()
    rows = small_rows(names, max_literal)
    if rows is None:
        return _places_by_join(posts, names, text_col, out_col)
    by_words: dict[int, list[str]] = {}
    for r in rows:
        by_words.setdefault(len(r["place"].split(" ")), []).append(r["place"])
    sizes = sorted(by_words)
    firsts = sorted({p.split(" ")[0] for ps in by_words.values() for p in ps})

    def length_at(words, w, i):
        longest = F.lit(0)
        for n in sizes:
            gram = F.array_join(F.slice(words, i + 1, n), " ")
            longest = F.when(gram.isin(by_words[n]), F.lit(n)).otherwise(longest)
        return F.when(w.isin(firsts), longest).otherwise(F.lit(0))

    def names_in(words):
        lengths = F.transform(words, lambda w, i: length_at(words, w, i))
        spots = F.get(F.transform(F.array(lengths), lambda ls: F.transform(
            _maximal(ls, sizes[-1]), lambda n, i: F.struct(n.alias("n"), i.alias("i")))), 0)
        return F.transform(
            F.filter(spots, lambda s: s["n"] > 0),
            lambda s: F.array_join(F.slice(words, s["i"] + 1, s["n"]), " "),
        )

    # Most texts hold no name: one hash test per word decides that before anything else is built. The words are split once for both.
    found = lambda words: F.when(F.exists(words, lambda w: w.isin(firsts)), names_in(words)).otherwise(empty_list())
    return posts.withColumn(out_col, F.get(F.transform(F.array(bare_words(text_col)), found), 0) if firsts else empty_list())


def place_trie(names: DataFrame) -> DataFrame:
    """``(n, prefix, is_name, goes_on)``: the first n words of all names, for every n; whether they are a name, and whether longer
    names begin with them."""
    words = F.split("place", " ")
    rows = names.select(F.size(words).alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("prefix")))).alias("p"))
    return rows.groupBy("p.n", "p.prefix").agg(
        F.max(F.col("size") == F.col("p.n")).alias("is_name"), F.max(F.col("size") > F.col("p.n")).alias("goes_on"))


def _places_by_join(posts: DataFrame, names: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """The trie is walked word by word: a text is exploded only at words with which a name may begin, and after each
    word only the places at which a name may go on are joined with the next level."""
    path = scratch_path(posts.sparkSession, "trie")
    place_trie(names).write.partitionBy("n").parquet(path)
    trie = posts.sparkSession.read.parquet(path)
    longest = trie.agg(F.max("n")).first()[0] or 0
    keyed = posts.withColumn(KEY, value_key(F.col(text_col).alias("t")))
    level = lambda n: trie.where(F.col("n") == n).select("prefix", "is_name", "goes_on")
    spots = F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.get("_words", i + 1).alias("next")))
    texts = sift(
        one_of_each(keyed, bare_words(text_col), "_words"), spots, "_spots", lambda s, begins, two, alone: begins(s["w"]) & (alone(s["w"]) | F.coalesce(two(F.concat_ws(" ", s["w"], s["next"])), F.lit(False))),
        bloom_filter(level(1), "prefix"), bloom_filter(level(2), "prefix"), bloom_filter(level(1).where("is_name"), "prefix"))
    spots = F.transform("_spots", lambda s: F.struct(s["i"].alias("i"), F.slice("_words", s["i"] + 1, F.lit(max(longest, 1))).alias("ahead")))
    # Each level is written once: what ends there, and what goes on, are read from it.
    walk = texts.select(KEY, F.inline(spots))
    ended = []
    for n in range(1, longest + 1):
        tried = walk.where(F.size("ahead") >= n).withColumn("prefix", F.array_join(F.slice("ahead", 1, n), " "))
        met = stored(salted_join(tried, level(n), "prefix", row_bytes=256).withColumn("ahead", F.when(F.col("goes_on"), F.col("ahead"))), "walk")
        ended.append(met.where(F.col("is_name")).select(KEY, "i", F.lit(n).alias("n"), F.col("prefix").alias("place")))
        walk = met.where("goes_on").select(KEY, "i", "ahead")
    hits = reduce(DataFrame.unionByName, ended) if ended else texts.select(KEY, F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit("").alias("place")).limit(0)
    found = hits.groupBy(KEY, "i").agg(F.max_by("place", "n").alias("place"), F.max("n").alias("n"))
    per_text = found.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("i", "n", "place"))).alias("_hits"))
    # In order of their start, a name inside another one ends no later than the furthest end so far.
    kept = F.aggregate("_hits", F.struct(F.lit(0).alias("end"), empty_list().alias("names")), lambda a, h: F.when(
        h["i"] + h["n"] > a["end"], F.struct((h["i"] + h["n"]).alias("end"), F.array_append(a["names"], h["place"]).alias("names"))).otherwise(a))
    listed = per_text.select(KEY, kept["names"].alias("_places"))
    joined = keyed.join(listed, KEY, "left").withColumn(out_col, F.coalesce("_places", empty_list()))
    return joined.drop(KEY, "_places")


def extract_tags(posts: DataFrame, tagger: Tagger | None = None, text_col: str = "full_text") -> DataFrame:
    """Add ``TRIGGER``, ``TERM``, ``UNIT`` and ``FIGURE``.

    With a tagger these are its ``B-`` tokens; other labels are ignored. Without one they are the
    keyword hits of the post and the numbers in its text.
    """
    if tagger is None:
        return posts.withColumns({
            "TRIGGER": F.col("trigger"), "TERM": F.col("term"), "UNIT": F.col("unit"),
            "FIGURE": extract_figures(text_col),
        })
    keyed = posts.withColumn(KEY, value_key(F.col(text_col).alias("t")))
    tagged = tag_tokens(keyed, tagger, KEY, text_col).where(F.col("tag").isin(list(TAG_COLUMNS)))
    ordered = F.sort_array(F.collect_set(F.struct("pos", "token", "tag")))
    lists = tagged.groupBy(KEY).agg(ordered.alias("_tags"))
    joined = keyed.join(lists, KEY, "left").drop(KEY)

    def tokens_of(tag: str) -> Column:
        return F.transform(F.filter("_tags", lambda s: s["tag"] == tag), lambda s: s["token"])

    for tag, column in TAG_COLUMNS.items():
        joined = joined.withColumn(column, F.coalesce(tokens_of(tag), empty_list()))
    return joined.drop("_tags")


def text_for_language(lang: Column | str, text_col: str = "full_text",
                      translated_col: str = "full_text_translated") -> Column:
    """English posts are read as they are, others in translation."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.when(lang == "en", F.col(text_col)).otherwise(F.col(translated_col))


def user_struct(user: Column | str, data_type: T.DataType | None = None) -> Column:
    """The five kept fields of a user object given as a struct, JSON text or Python-literal text."""
    parsed = F.col(user) if isinstance(user, str) else user
    if not isinstance(data_type, T.StructType):
        is_json = F.rlike(parsed, F.lit(r'^\s*\{\s*"'))
        parsed = F.when(is_json, F.from_json(parsed, USER)).otherwise(parse_object_literal(parsed, USER))
    return F.struct(*[parsed[f.name].alias(f.name) for f in USER.fields])


def post_summary(posts: DataFrame, language: str, *extra: str) -> DataFrame:
    """The fixed summary columns; ``created_at`` and ``irrelevant`` only if the posts have them."""
    have = set(posts.columns)
    columns = ["id_str"]
    columns += ["created_at"] if "created_at" in have else []
    columns += ["full_text", "full_text_preprocessed"]
    columns += ["full_text_translated"] if language != "en" else []
    columns += ["irrelevant"] if "irrelevant" in have else []
    columns += ["predicted_irrelevant", "retweeted"]
    user_type = posts.schema["user"].dataType
    return posts.select(*columns, user_struct("user", user_type).alias("user_info"), *extra)


def extract_information(posts: DataFrame, language: str, gazetteer: DataFrame,
                        tagger: Tagger | None = None) -> DataFrame:
    """Summary columns plus the six entity lists of each post."""
    text_col = "full_text" if language == "en" else "full_text_translated"
    tagged = extract_tags(posts, tagger, text_col)
    placed = extract_places(tagged, gazetteer, text_col, "LOCATION")
    return post_summary(placed.withColumn("DATE", extract_dates(text_col)), language, *LISTS)
