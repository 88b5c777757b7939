import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postwatch.llm import langid

from .conftest import make


def brute_probability(words, order, discount, alphabet):
    """P(character | context) by interpolated Kneser-Ney over dictionaries."""
    grams = [Counter() for _ in range(order)]
    for word, n in words.items():
        text = "\x02" + word + "\x03"
        for at in range(1, len(text)):
            for k in range(order):
                if at - k >= 0:
                    grams[k][text[at - k:at + 1]] += n
    counts = [Counter() for _ in range(order)]
    for k in range(order):
        for gram, n in grams[k].items():
            if k == order - 1 or gram[0] == "\x02":
                counts[k][gram] = n
            else:
                counts[k][gram] = sum(1 for g in grams[k + 1] if g[1:] == gram)
    sums, lost = [defaultdict(float) for _ in range(order)], [defaultdict(float) for _ in range(order)]
    for k in range(order):
        for gram, n in counts[k].items():
            sums[k][gram[:-1]] += n
            lost[k][gram[:-1]] += min(discount, n * discount)

    def p(gram):
        low = p(gram[1:]) if len(gram) > 1 else 1 / alphabet
        k = len(gram) - 1
        total = sums[k].get(gram[:-1])
        if not total:
            return low
        n = counts[k].get(gram, 0)
        return (n - min(discount, n * discount)) / total + lost[k][gram[:-1]] / total * low

    return p


def test_kneser_ney():
    words = {"aa": Counter({"abab": 3, "abc": 2, "b": 1, "cab": 4}), "bb": Counter({"xyz": 2, "xx": 5, "ab": 1})}
    counts = pd.DataFrame([(lang, w, n) for lang, c in words.items() for w, n in c.items()], columns=["lang", "word", "n"])
    for order in (1, 2, 3, 4):
        models = langid.fit(counts, order=order)
        for word in ("abab", "zab", "q", "xyzabc"):
            got = models.word_scores([word])[0]
            for i, lang in enumerate(models.languages):
                p = brute_probability(words[lang], order, langid.DISCOUNT, 1 / models.floor)
                text = "\x02" + word + "\x03"
                want = sum(math.log(p(text[max(0, at - order + 1):at + 1])) for at in range(1, len(text)))
                assert got[i] == pytest.approx(want, rel=1e-4), (order, word, lang)
            assert got[-1] == len(word) + 1
    mass = sum(np.exp(langid.fit(counts, order=1).word_scores([c])[0, 0]) for c in "ab")
    assert 0 < mass < 1


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    syllables = {"aa": "ka lo mi ru te".split(), "bb": "str ing the ou gh".split(), "cc": "éa üo ñi ça ñu".split()}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)) + ". 12", lang, "s"))
    return make(spark, rows)


def test_held_out_accuracy(corpus):
    models = langid.train(corpus, F.col("doc_id") % 4 != 2)
    found = langid.predict(corpus, models).join(corpus.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found) and np.mean([r.rejected for r in found]) < 0.15


def test_labels_of_held_out_rows_are_not_used(corpus):
    learn = F.col("doc_id") % 4 != 2
    wrong = corpus.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("aa")))
    run = lambda docs: sorted(langid.predict(corpus, langid.train(docs, learn)).select("doc_id", "lang_pred", "score").collect())
    assert run(corpus) == run(wrong)


def test_rejection_and_edges(corpus, edges, nothing, edge_rows):
    models = langid.train(corpus, F.lit(True))
    found = langid.predict(edges, models).collect()
    assert len(found) == len(edge_rows)
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {langid.UNKNOWN}
    assert all(r.score == 0 and r.rejected for r in found if r.lang_pred == langid.UNKNOWN)
    assert next(r for r in found if r.doc_id == 7).rejected
    assert all(r.lang_pred in models.languages for r in found if r.doc_id in (4, 5, 6, 7, 8, 9))
    assert langid.predict(nothing, models).count() == 0
    empty = langid.train(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.predict(edges, empty).collect()} == {langid.UNKNOWN}


def test_texts_do_not_depend_on_their_batch(corpus):
    models = langid.train(corpus, F.lit(True))
    texts = [r.text for r in corpus.limit(30).collect()] + ["", "12 !", "ka"]
    whole = models.predict(texts)
    for i, text in enumerate(texts):
        one = models.predict([text]).iloc[0]
        assert one.lang_pred == whole.lang_pred[i] and one.score == pytest.approx(whole.score[i])


def test_languages_without_blanks(spark):
    """Whole paragraphs are one word; two languages share their letters and differ in their order."""
    rng = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(60)]
    pieces = {lang: ["".join(rng.sample(signs, 3)) for _ in range(40)] for lang in ("ja", "zh")}
    rows = [(i, "".join(rng.choice(pieces[lang]) for _ in range(50)) + "。", lang, "s") for i in range(300) for lang in [("ja", "zh")[i % 2]]]
    rows += [(1000 + i, "ka lo mi ru te " * 5, "aa", "s") for i in range(60)]
    docs = make(spark, rows)
    models = langid.train(docs, F.col("doc_id") % 5 != 0)
    assert models.languages == ["aa", "ja", "zh"]
    found = langid.predict(docs, models).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97 and np.mean([r.rejected for r in found]) < 0.15


def test_long_words_count_whole(spark):
    """The models of one long word are those of its counts, without a mark inside it."""
    rng = random.Random(2)
    word = "".join(rng.choice("abcde") for _ in range(1000))
    models = langid.train(make(spark, [(i, word, "aa", "s") for i in range(20)]), F.lit(True))
    n = 20 - make(spark, [(i, word, "aa", "s") for i in range(20)]).where(langid.unit_interval("doc_id", F.lit(langid.SEED + 1)) < langid.HELD_BACK).count()
    want = langid.fit(pd.DataFrame([("aa", word, n)], columns=["lang", "word", "n"]))
    assert all((a == b).all() for a, b in zip(models.hashes + models.probability, want.hashes + want.probability))
