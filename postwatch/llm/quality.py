"""Quality rules: counts of single texts, and lines that many documents of a host share.

Only built-in functions are used. A text is read once: what it needs further is a narrow table of line hashes,
which is written to the shared folder. Lines are counted over different texts, so that plain copies of a document do
not make its lines frequent; their removal is the work of another operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.lookup import never_broadcast
from postwatch.llm.common import BLANKS, store, word_array, word_count

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 0.2
#: A line is frequent if more different texts of its host hold it than both limits allow. The share is 0: a limit
#: that grows with the host would spare lines just where they are repeated most.
MOST_TEXTS, MOST_SHARE, LEAST_LEFT = 50, 0.0, 0.3
#: A table of frequent lines up to this many rows is broadcast; beyond it, Spark joins.
SMALL_LINES = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more in the array ``words``."""

    def hashes(h: Column) -> Column:
        return F.when(F.size(h) < window, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda p, i: (p["x"] == F.get(s, i - 1)["x"]) | (p["x"] == F.get(s, i + 1)["x"]))
            return F.sort_array(F.transform(again, lambda p: p["i"]))

        steps = let(let(ranked, places), lambda at: F.transform(
            at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(window)), F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes),
               lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = word_array(text)
    measured = docs.select("*", F.size(words).cast("long").alias("n_words"),
                           F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
                           F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                           let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                           repeated_words(words).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(MOST_REPEATED))
    return measured.withColumn("base_failed", failed)


def line_table(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, text_hash, lines of (pos, h, words)) and the counts, one row for each row of ``docs``.

    Lines are lower-cased, trimmed, with single blanks; lines without a word are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    line = lambda x: F.lower(F.btrim(F.regexp_replace(x, BLANKS, " ")))
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda x, i: let(line(x), lambda y: F.struct(
            i.alias("pos"), F.when(y != "", F.xxhash64(y)).alias("h"), word_count(y).cast("int").alias("words")))),
        lambda x: x["h"].isNotNull())
    return text_counts(known).select(
        "doc_id", "host", F.xxhash64(text, F.length(text)).alias("text_hash"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", lines.alias("lines"))


def frequent_lines(lines: DataFrame, most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE) -> DataFrame:
    """(host, h, n_texts, first_id): lines that more than ``most_texts`` different texts of a host hold, and more
    than ``most_share`` of them, if that is not 0. ``first_id`` is the smallest doc_id with the line."""
    texts = lines.groupBy("host", "text_hash").agg(
        F.min("doc_id").alias("doc_id"), F.first(F.col("lines.h")).alias("h"))
    counts = texts.select("host", "doc_id", F.explode(F.array_distinct("h")).alias("h")).groupBy("host", "h").agg(
        F.count("*").alias("n_texts"), F.min("doc_id").alias("first_id")).where(F.col("n_texts") > most_texts)
    if not most_share:
        return counts.select("host", "h", "n_texts", "first_id")
    sizes = texts.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("host_texts"))
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("_host"))).where(
        F.col("n_texts") > F.col("host_texts") * F.lit(most_share)).select("host", "h", "n_texts", "first_id")


def judge(docs: DataFrame, most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT,
          id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The counts of each row with ``text_hash``, ``cut`` (positions of the lines to remove) and ``kept``.

    A frequent line is removed from every document but the first that has it. A document is rejected if it fails
    the base rules, or keeps less than ``least_left`` of its words or fewer than ``LEAST_WORDS`` words.
    Null hosts are a host of their own; null and empty texts have no words and are rejected. Repeated rows
    get equal verdicts; an empty table gives an empty result; other columns are ignored.
    """
    lines = store(line_table(docs, id_col, host_col, text_col), "lines")
    frequent = store(frequent_lines(lines, most_texts, most_share), "frequent").select(
        F.col("host").alias("_host"), F.col("h").alias("_h"), "first_id")
    small = frequent.count() <= SMALL_LINES
    held = lines.select("doc_id", "host", "text_hash", F.explode("lines").alias("line"))
    cut = (held.join(F.broadcast(frequent) if small else never_broadcast(frequent), (F.col("line.h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host")))
           .where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
           .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"))
           .agg(F.collect_set(F.struct("line.pos", "line.words")).alias("cut")))
    judged = lines.drop("lines").join(
        never_broadcast(cut), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & F.col("host").eqNullSafe(F.col("_host")), "left")
    gone = F.aggregate(F.coalesce("cut", F.array().cast("array<struct<pos:int,words:int>>")), F.lit(0), lambda a, x: a + x["words"])
    left = F.col("n_words") - gone
    kept = ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= F.col("n_words") * F.lit(least_left))
    return judged.withColumn("kept", kept).withColumn("cut", F.col("cut.pos")).drop("_id", "_hash", "_host")


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, without their frequent lines; the columns of ``docs``, ``n_chars`` follows the text."""
    judged = store(judge(docs, **options), "judged").where("kept").groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host")).agg(F.first("cut").alias("_cut"))
    joined = docs.join(never_broadcast(judged), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text", F.length("text")) == F.col("_hash"))
                       & F.col("source").eqNullSafe(F.col("_host")))
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_cut")), lambda i: F.get(x, i))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(let(F.split("text", "\n"), stay), "\n"))
    out = joined.withColumn("_text", text)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])
