import random
import re
import string

import plain_stemmer
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postwatch.functions import text as tx
from postwatch.functions.stemmer import IRREGULAR, STEP2, STEP3, STEP4, porter_stem


def reference_clean(text):
    """Token-by-token definition in plain Python."""
    out = []
    for token in text.split():
        token = re.sub(r"(.)\1{2,}", r"\1\1\1", token)
        out.append(re.sub(r"@[A-Za-z0-9]+|[^0-9A-Za-z \t]|\w+://\S+", "", token))
    return " ".join(out).strip()


def test_squeeze(one):
    assert one("soooo baaaad!!!! aa", tx.squeeze_repeats) == "sooo baaad!!! aa"


@pytest.mark.parametrize("text, expected", [
    ("https://t.co/ab", ""), ("@user_name", "name"), ("bob@x.com", "bobcom"), ("hé://zz", ""), ("él", "l"),
    ("@ab_cd://x", ""), ("a@@b", "a"), ("", ""), ("x y", "x y"),
])
def test_noise(one, text, expected):
    assert one(text, tx.strip_noise) == expected == reference_clean(text)


def test_noise_can_keep_accents(one):
    assert one("él! ñu", lambda c: tx.strip_noise(c, keep_accents=True)) == "él ñu"


def test_split_on_unicode_space(one):
    text = "\x1fa" + chr(0xA0) + "b" + chr(0x2003) + "c" + chr(0xA0)
    assert one(text, tx.split_tokens) == text.split() == ["a", "b", "c"]


def test_null_text(one):
    assert one(None, tx.split_tokens) == []
    assert one(None, tx.first_clean) == ""
    assert one(None, tx.word_tokenize) == []


@pytest.mark.parametrize("emoji", ["\U0001F600", "\U0001F44D\U0001F3FD", "\U0001F1E9\U0001F1EA", "❤️",
                                   "1️⃣", "\U0001F468‍\U0001F469‍\U0001F467", "✂"])
def test_emoji(one, emoji):
    assert one(f"a{emoji}b 1 # *", tx.strip_emoji) == "ab 1 # *"


def test_word_tokenize(one):
    assert one("i cannot canned gonna wanna «x»", tx.word_tokenize) == [
        "i", "can", "not", "canned", "gon", "na", "wan", "na", "«", "x", "»"]


def test_stop_words_keep_repeats(one):
    assert one("the cat the cat thes", lambda c: tx.remove_stopwords(tx.split_tokens(c))) == ["cat", "cat", "thes"]


def test_punctuation(one):
    assert one("a" + string.punctuation + "b", tx.strip_punctuation) == "ab"


@pytest.mark.parametrize("word", ["b", "zz", "abcb", "a", "cb"])
def test_offsets(one, word):
    text = "abcb"
    assert one(text, lambda c: tx.find_offset(c, F.lit(word))) == text.find(word)
    assert one(text, lambda c: tx.find_offset(c, F.lit(word), True)) == text.rfind(word)


def test_partition_date(one):
    assert str(one("2024-01-31-en.csv", tx.partition_date)) == "2024-01-31"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aab@_é:/.! \t\n1Z" + chr(0xA0) + chr(0x2003), max_size=40), min_size=40, max_size=60))
def test_first_clean_equals_token_definition(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["x"] for r in frame.select("i", tx.first_clean("t").alias("x")).collect()}
    assert got == {i: reference_clean(t) for i, t in enumerate(texts)}
    twice = frame.select(tx.squeeze_repeats("t").alias("a"), tx.squeeze_repeats(tx.squeeze_repeats("t")).alias("b"))
    assert twice.where("a <> b").count() == 0


STEMS = [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"),
    ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
    ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("cease", "ceas"), ("controll", "control"),
    ("displaced", "displac"), ("evacuated", "evacu"), ("evacuees", "evacue"), ("homeless", "homeless"),
    ("is", "is"), ("Displaced", "displac"), ("enjoy", "enjoy"), ("say", "say"), ("died", "die"), ("news", "news"),
]


def test_porter(spark):
    words = spark.createDataFrame(STEMS, "word STRING, stem STRING")
    assert words.where(porter_stem("word") != F.col("stem")).count() == 0 and words.count() == len(STEMS)


def test_porter_against_letter_by_letter(spark):
    """Every suffix behind stems of all shapes, runs of y, double letters, short and empty words, and words that are no English."""
    rng = random.Random(3)
    ends = ["", "s", "sses", "ies", "ied", "eed", "ed", "ing", "y", "e", "ll", *STEP2, *STEP3, *STEP4]
    made = {"".join(rng.choice("aeiouybstlwxzry") for _ in range(rng.randint(0, 7))) + rng.choice(ends) for _ in range(8_000)}
    made |= {stem + x + y for stem in ("b", "rezb") for x in ends for y in ends}
    words = sorted(made | {"", "a", "yyyy", "syyyed", "ayyying", "\u00dcber", "nai\u0308ve", "x\ned", "s-ing", "42ed", "\U0001f600ing"} | set(IRREGULAR) | {w.upper() for w in IRREGULAR})
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in [*words, None]], "w STRING").select("w", porter_stem("w").alias("s")).collect()}
    assert got.pop(None) is None
    assert got == {w: plain_stemmer.porter_stem(w) for w in words}
