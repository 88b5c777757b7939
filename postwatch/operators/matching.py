"""Finding keywords in posts: stem hits, the trigger gate, and the search for keyword pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.lookup import KEY, bloom_filter, never_broadcast, one_of_each, salted_join, sift, small_rows, value_key
from postwatch.functions.text import SPACES, null_text, split_tokens
from postwatch.operators.keywords import KINDS
from postwatch.session import stored

MAX_LITERAL_KEYWORDS = 2_000
_ENTRY = "array<struct<kind:string,stem:string,keyword:string>>"


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda would repeat it for each element)."""
    return F.get(F.transform(F.array(value), body), 0)


def _words_of_kind(hits: Column | str, kind: str) -> Column:
    return F.transform(F.filter(hits, lambda k: k["kind"] == kind), lambda k: k["keyword"])


def _literal_entries(rows: list) -> Column:
    entries = [
        F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["stem"]).alias("stem"),
                 F.lit(r["keyword"]).alias("keyword"))
        for r in rows
    ]
    return F.array(*entries).cast(_ENTRY)


def keyword_match(posts: DataFrame, keywords: DataFrame, text_col: str = "full_text",
                  ignore_case: bool = False, triggered_only: bool = False,
                  max_literal: int = MAX_LITERAL_KEYWORDS) -> DataFrame:
    """Add the ordered hit lists ``trigger``, ``term`` and ``unit``.

    A keyword is hit by each token that contains its stem: in token order, then keyword order, repeats
    kept, the original keyword listed. ``keywords(kind, keyword, pos, stem)`` is the dictionary of one
    language. A dictionary of checked size is a literal in a single pass over each text without any
    shuffle; a larger one goes through ``keyword_match_join``. ``triggered_only`` is the trigger gate as
    a plain text filter in front: a stem in the text is a stem in one of its tokens.
    """
    wanted = keywords.select("kind", "stem", "keyword", "pos").distinct()
    rows = small_rows(wanted, max_literal)
    if rows is None:
        tagged = keyword_match_join(posts, keywords, text_col, ignore_case)
        return trigger_gate(tagged) if triggered_only else tagged
    # A stem with white space lies in no token.
    rows = [r for r in rows if r["stem"] and not set(r["stem"]) & SPACES]
    rows = sorted(rows, key=lambda r: (r["pos"], r["keyword"], r["kind"]))
    text = null_text(text_col)
    text = F.lower(text) if ignore_case else text
    if triggered_only:
        stems = [r["stem"] for r in rows if r["kind"] == "trigger"]
        posts = posts.where(reduce(lambda a, s: a | F.contains(text, F.lit(s)), stems, F.lit(False)))

    # Only keywords that occur somewhere in the text are tried on its tokens.
    in_text = F.filter(_literal_entries(rows), lambda k: F.contains(text, k["stem"]))
    hits = _bind(
        in_text,
        lambda near: F.when(
            F.size(near) > 0,
            F.flatten(F.transform(
                split_tokens(text), lambda t: F.filter(near, lambda k: F.contains(t, k["stem"]))
            )),
        ),
    )
    tagged = posts.withColumn("_hits", F.coalesce(hits, F.array().cast(_ENTRY)))
    for kind in KINDS:
        tagged = tagged.withColumn(kind, _words_of_kind("_hits", kind))
    return tagged.drop("_hits")


MAX_GRAM, SAMPLED_TOKENS = 4, 200_000


def _grams(token: Column, widths: list[int]) -> Column:
    """The distinct substrings of a token that are of one of the ``widths``."""
    of_width = [F.when(F.length(token) >= w, F.transform(
        F.sequence(F.lit(1), F.length(token) - w + 1), lambda i: F.substring(token, i, F.lit(w)))).otherwise(F.array().cast("array<string>")) for w in widths]
    return F.array_distinct(F.flatten(F.array(*of_width)))


def stem_index(stems: DataFrame, tokens: DataFrame, width: int = MAX_GRAM, sampled: int = SAMPLED_TOKENS) -> DataFrame:
    """``(stem, anchor)``: of the substrings of a stem of ``width`` characters (all of a shorter stem) the rarest in the tokens.

    A stem lies in a token only if its anchor does, so the anchors are the keys of an inverted index of stems. How rare a
    substring is, is counted over about ``sampled`` of the distinct ``tokens``; it decides how long the search takes, not what it finds.
    """
    n = tokens.count()
    drawn = tokens.where(F.pmod(F.xxhash64("token"), F.lit(max(1, n // sampled))) == 0)
    counts = drawn.select(F.explode(_grams(F.col("token"), [width])).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("_n"))
    short = F.length("stem") < width
    parts = stems.select("stem", F.explode(F.when(short, F.array("stem")).otherwise(_grams(F.col("stem"), [width]))).alias("anchor"))
    rarest = F.min_by("anchor", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("anchor").alias("a")))
    return parts.join(counts, "anchor", "left").groupBy("stem").agg(rarest.alias("anchor"))


def stem_candidates(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """``(token, stem)`` of all distinct ``tokens`` that hold the anchor of a stem.

    A filter of the anchors sorts out a token's other substrings before they are exploded. The generator is an outer one, here and below:
    for any other Spark first tests whether there are items, and so sifts twice. The join drops the nulls.
    """
    known = bloom_filter(index.select("anchor").distinct(), "anchor")
    widths = sorted(r[0] for r in index.select(F.length("anchor")).distinct().collect())  # at most MAX_GRAM
    sifted = sift(tokens, _grams(F.col("token"), widths), "_grams", lambda gram, held: held(gram), known)
    return salted_join(sifted.select("token", F.explode_outer("_grams").alias("anchor")), index, "anchor", "token").select("token", "stem")


def keyword_match_join(posts: DataFrame, keywords: DataFrame, text_col: str = "full_text",
                       ignore_case: bool = False) -> DataFrame:
    """``keyword_match`` for dictionaries of any size.

    Whether a stem lies in a token depends on the token alone, so the distinct tokens of all posts meet an inverted index of the
    stems, each under its rarest substring, and the candidates are checked. The tokens with hits then meet the texts again, of which a
    filter of these tokens explodes few others. Posts with the same text share their hits.
    """
    words = keywords.where(F.length("stem") > 0).select("kind", "stem", "keyword", F.col("pos").alias("_kpos")).distinct()
    text = F.lower(null_text(text_col)) if ignore_case else null_text(text_col)
    keyed = posts.withColumn(KEY, value_key(text.alias("t")))
    tokens = one_of_each(keyed, split_tokens(text), "_tokens")
    distinct = stored(tokens.select(F.explode(F.array_distinct("_tokens")).alias("token")).distinct(), "tokens")
    index = stored(stem_index(words.select("stem").distinct(), distinct), "stems")
    found = stem_candidates(distinct, index).where(F.contains("token", "stem"))
    entry = F.struct("_kpos", "keyword", "kind", "stem")
    by_token = stored(salted_join(found, words, "stem", "token").groupBy("token").agg(F.sort_array(F.collect_set(entry)).alias("_entries")), "hits")
    numbered = F.transform("_tokens", lambda t, i: F.struct(i.alias("_tpos"), t.alias("token")))
    placed = sift(tokens, numbered, "_placed", lambda x, held: held(x["token"]), bloom_filter(by_token, "token"))
    rows = placed.select(KEY, F.inline_outer("_placed"))
    joined = salted_join(rows, by_token, "token", row_bytes=512)
    hits = joined.groupBy(KEY).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_tpos", "_entries"))), lambda x: x["_entries"])).alias("_hits"))
    tagged = keyed.join(never_broadcast(hits), KEY, "left")
    empty = F.array().cast("array<string>")
    for kind in KINDS:
        tagged = tagged.withColumn(kind, F.coalesce(_words_of_kind("_hits", kind), empty))
    return tagged.drop("_hits", KEY)


def explode_hits(tagged: DataFrame, id_col: str = "id_str") -> DataFrame:
    """Hit lists to rows ``(id, lang, kind, hit_pos, keyword)``."""
    def listed(kind: str) -> Column:
        return F.transform(kind, lambda k, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("hit_pos"), k.alias("keyword")))

    lists = F.flatten(F.array(*[listed(kind) for kind in KINDS]))
    return tagged.select(id_col, "lang", F.explode(lists).alias("h")).select(id_col, "lang", "h.*")


def trigger_gate(tagged: DataFrame) -> DataFrame:
    """Hard rule: only posts with at least one trigger are trained on or predicted."""
    return tagged.where(F.size("trigger") > 0)


def exclude_retweets(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("retweeted_status").isNull())


def until_date(posts: DataFrame, ts_col: str, run_date: str) -> DataFrame:
    """Posts before the day of the run, compared on the raw column so that it reaches the scan."""
    return posts.where(F.col(ts_col) < F.lit(run_date).cast("timestamp"))


def _words_by_join(posts: DataFrame, wanted: DataFrame, tokens: Column) -> DataFrame:
    """Keywords whose words all occur in a post, as ``_found``; posts without any are left out."""
    words = F.array_distinct(split_tokens(F.lower("keyword")))
    needed = wanted.select("kind", "keyword", "pos", F.size(words).alias("_n"), F.explode(words).alias("word"))
    keyed = posts.withColumn(KEY, value_key(tokens.alias("t")))
    wants = bloom_filter(needed.select("word").distinct(), "word")
    texts = one_of_each(keyed, F.array_distinct(tokens), "_words")
    post_words = sift(texts, F.col("_words"), "_wanted", lambda w, held: held(w), wants).select(KEY, F.explode_outer("_wanted").alias("word"))
    found = (
        salted_join(post_words, needed, "word")
        .groupBy(KEY, "kind", "keyword", "pos", "_n").agg(F.size(F.collect_set("word")).alias("_have"))
        .where("_have = _n")
        .groupBy(KEY)
        .agg(F.sort_array(F.collect_set(F.struct("pos", "keyword", "kind"))).alias("_found"))
    )
    return keyed.join(found, KEY).drop(KEY)


def pair_search(posts: DataFrame, keywords: DataFrame, text_col: str = "full_text",
                distinct_posts: bool = False,
                max_literal: int = MAX_LITERAL_KEYWORDS) -> DataFrame:
    """Posts that hold all words of a term and all words of a trigger.

    As with one search per pair, a post comes once per matching pair, with ``trigger_kw``, ``term_kw``
    and ``query``. ``distinct_posts=True`` keeps each post once, with the lists of matched words.
    Both lists are found row by row (or, for a large dictionary, by an equi join of words), so posts
    are never joined with pairs.
    """
    wanted = keywords.where("kind in ('trigger', 'term')").select("kind", "keyword", "pos").distinct()
    rows = small_rows(wanted, max_literal)
    tokens = split_tokens(F.lower(null_text(text_col)))
    if rows is None:
        matched, found = _words_by_join(posts, wanted, tokens), F.col("_found")
    else:
        entries = [
            F.struct(
                F.lit(r["kind"]).alias("kind"),
                F.lit(r["keyword"]).alias("keyword"),
                F.array(*[F.lit(w) for w in r["keyword"].lower().split()]).alias("words"),
            )
            for r in sorted(rows, key=lambda r: (r["pos"], r["keyword"], r["kind"]))
        ]
        matched, found = posts, _bind(
            tokens,
            lambda ts: F.filter(
                F.array(*entries), lambda k: F.forall(k["words"], lambda w: F.array_contains(ts, w))
            ),
        )
    if distinct_posts:
        lists = _bind(found, lambda f: F.struct(
            _words_of_kind(f, "trigger").alias("trigger_kw"), _words_of_kind(f, "term").alias("term_kw")))
        both = lambda w: (F.size(w["trigger_kw"]) > 0) & (F.size(w["term_kw"]) > 0)
        rows_of = F.filter(F.array(lists), both)
    else:
        rows_of = _bind(found, lambda f: F.flatten(F.transform(
            _words_of_kind(f, "trigger"),
            lambda trigger: F.transform(_words_of_kind(f, "term"), lambda term: F.struct(
                trigger.alias("trigger_kw"), term.alias("term_kw"),
                F.concat_ws(" ", term, trigger).alias("query"))),
        )))
    # One generator yields the rows, so the texts are searched once.
    return matched.select("*", F.inline(rows_of)).drop("_found")
