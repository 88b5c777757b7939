import pytest

from postwatch.functions.lookup import map_tokens
from postwatch.operators import cleaning as c


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, w) for w in ("house", "bus", "box", "church", "man", "city", "wolf", "class", "glass", "bush", "quiz")] + [("feet", "foot"), ("foot", "foot")]
    return spark.createDataFrame(rows, "token STRING, lemma STRING")


FORMS = {"houses": "house", "buses": "bus", "boxes": "box", "churches": "church", "men": "man", "cities": "city",
         "wolves": "wolf", "classes": "class", "bushes": "bush", "feet": "foot", "unknown": "unknown", "was": "was",
         "house": "house", "quizzes": "quizzes", "housess": "house", "gas": "gas"}


@pytest.mark.parametrize("limit", [1000, 0])
def test_lemmas(spark, lexicon, limit):
    posts = spark.createDataFrame([("1", list(FORMS)), ("2", []), ("3", ["men", "x", "men"])], "id_str STRING, toks ARRAY<STRING>")
    done = {r["id_str"]: r["l"] for r in c.lemmatize(posts, "toks", lexicon, "l", max_literal=limit).collect()}
    assert done == {"1": list(FORMS.values()), "2": [], "3": ["man", "x", "man"]}


def test_distinct_tokens_are_read_once_for_a_large_lexicon(spark, monkeypatch):
    """The posts are searched for distinct tokens in one pass, which is stored."""
    names, store = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, name: names.append(name) or store(df, name))
    lexicon = spark.createDataFrame([("box", "box"), ("geese", "goose")], "token STRING, lemma STRING")
    posts = spark.createDataFrame([(["boxes", "geese", "x"],)], "toks ARRAY<STRING>")
    assert c.lemmatize(posts, "toks", lexicon, "o", max_literal=0).first()["o"] == ["box", "goose", "x"]
    assert names == ["tokens"]


@pytest.mark.parametrize("limit", [100, 0])
def test_lemmas_with_one_and_with_several_rounds(spark, limit):
    lexicon = spark.createDataFrame([(w, w) for w in ("box", "boxe", "wolf", "city", "man", "men", "glas", "glass", "s", "bus")] + [("geese", "goose")], "token STRING, lemma STRING")
    want = {"boxes": "box", "wolves": "wolf", "cities": "city", "men": "man", "mens": "men", "glasses": "glass", "bus": "bus", "buses": "bus", "s": "s",
            "geese": "goose", "ss": "s", "knowns": "knowns", "glass": "glas", "": "", "ies": "ies", "box": "box"}
    posts = spark.createDataFrame([(list(want),)], "toks ARRAY<STRING>")
    got = c.lemmatize(posts, "toks", lexicon, "o", max_literal=limit).first()["o"]
    assert dict(zip(want, got)) == want


def test_map_tokens_can_drop_unknown(spark):
    posts = spark.createDataFrame([("1", ["a", "b"])], "id_str STRING, toks ARRAY<STRING>")
    words = spark.createDataFrame([("a", "A")], "token STRING, value STRING")
    for limit in (10, 0):
        assert map_tokens(posts, "toks", words, "o", keep_unknown=False, max_rows=limit).first()["o"] == ["A", None]


def posts_of(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id_str STRING, full_text STRING")


def test_preprocess_english(spark, lexicon):
    texts = ["The men's HOUSES were floooooded!!! https://t.co/x @user", "", None, "don't is the"]
    done = c.preprocess_text(posts_of(spark, *texts), lexicon=lexicon).orderBy("id_str").collect()
    assert [r["full_text_preprocessed"] for r in done] == ["man house floooded", "", "", ""]


def test_translation_hook_keeps_failed_rows(spark):
    def translate(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t + ", the!" for t in texts]

    done = c.preprocess_text(posts_of(spark, "maison", "bad one", None), "fr", translator=translate).orderBy("id_str").collect()
    assert [r["full_text_translated"] for r in done] == ["maison, the!", "", ", the!"]
    # Punctuation sticks to words until after the stop words.
    assert [r["full_text_preprocessed"] for r in done] == ["maison the", "", "the"]


def test_translation_lexicon(spark):
    words = spark.createDataFrame([("fr", "maison", "house"), ("es", "maison", "no")], "lang STRING, token STRING, translation STRING")
    done = c.preprocess_text(posts_of(spark, "Une maison maison"), "fr", translations=words).first()
    assert done["full_text_translated"] == "Une house house" and done["full_text_preprocessed"] == "une house house"
    with pytest.raises(ValueError):
        c.preprocess_text(posts_of(spark, "x"), "fr")


def test_translations_are_remembered(spark, tmp_path):
    """The second run asks for nothing, a changed text is asked for, and a failed one again."""
    asked = spark.sparkContext.accumulator(0)

    def translate(texts):
        asked.add(len(texts))
        return ["" if t == "fails" else t.upper() for t in texts]

    posts, memory = posts_of(spark, "un deux", "un deux", None, "", "trois", "fails"), str(tmp_path / "memory")

    def run(frame, lang="fr"):
        before = asked.value
        got = {r["id_str"]: r["full_text_translated"] for r in c.translate_remembered(frame, translate, memory, lang, "full_text").collect()}
        return got, asked.value - before

    want = {"0": "UN DEUX", "1": "UN DEUX", "2": "", "3": "", "4": "TROIS", "5": ""}
    assert run(posts.where("full_text <> 'fails'")) == ({k: v for k, v in want.items() if k in "0134"}, 2)
    assert run(posts.where("full_text <> 'fails'"))[1] == 0
    assert run(posts) == (want, 1) and run(posts) == (want, 1)
    assert run(posts.where("full_text <> 'fails'"), "es")[1] == 2


def test_words_many_rules_away(spark, lexicon):
    """Suffix rules go on until nothing changes, in place and by the join; runs of an ending of any length end."""
    words = {"housessss": "house", "glassesses": "glass", "busesesseses": "bus", "x" + "s" * 3000: "x" + "s" * 3000, "city" + "s" * 200: "city", "menmen": "menmen", "s": "s"}
    posts = spark.createDataFrame([("1", list(words))], "id_str STRING, toks ARRAY<STRING>")
    for limit in (1000, 0):
        assert c.lemmatize(posts, "toks", lexicon, "l", max_literal=limit).first()["l"] == list(words.values())
