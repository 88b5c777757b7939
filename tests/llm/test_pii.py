import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwatch.llm import pii


@pytest.fixture(scope="module")
def model(spark):
    return pii.default_model(spark)


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_patterns():
    rng = random.Random(1)
    for marks, size in (("a1.@-+ 0259()4é_", 30), ("0123456789 -.", 40), ("ab@.", 16), ("+12 ()-", 30)):
        for _ in range(5000):
            text = "".join(rng.choice(marks) for _ in range(rng.randint(0, size)))
            assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("0001.0255.1.00000256 1.2.3.0000000255 4041894974608795") == brute_base("0001.0255.1.00000256 1.2.3.0000000255 4041894974608795")


def test_base_patterns_are_linear():
    text = "a" * 300_000 + "@" + "1" * 300_000 + " " + "9." * 100_000 + "+1 " * 100_000 + "@a" * 100_000
    assert len(pii.base_spans(text)) < 10**6


def test_training_examples_are_found(spark, model):
    for row in pii.labelled_table(spark).collect():
        (base, further), = pii.find_spans([row.text], model)
        for kind, start, end in row.spans:
            assert any(k == kind and s < end and e > start for k, s, e in base + further), row.text
        assert len(base + further) == len(row.spans), row.text


def test_new_texts(model):
    (_, found), = pii.find_spans(["you may call 917-555-0143 or (415) 555-0199, or write to mary [at] company [dot] org soon"], model)
    assert [k for k, *_ in found] == ["email", "phone", "phone"]
    clean = "In 2021 version 3.11.4 had 120-130 users at 10.30 on 2021-03-04; item 12345678 cost 1,200.50 at the dot of noon."
    assert pii.find_spans([clean], model) == [([], [])]


def test_viterbi(model):
    rng = random.Random(2)
    vocabulary = [w for e in pii.EXAMPLES for w in e.replace("{", " ").replace("}", " ").split()]
    words = [rng.choice(vocabulary) for _ in range(3000)]
    starts = np.array(sorted({0, *rng.sample(range(3000), 60)}))
    score, want = model.emissions(words, starts), []
    for a, b in zip(starts, [*starts[1:], len(words)]):
        best, back = score[a], []
        for t in range(a + 1, b):
            paths = best[:, None] + model.trans
            back.append(paths.argmax(0))
            best = paths.max(0) + score[t]
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        want += reversed(labels)
    got = model.decode(words, starts)
    assert (got == np.array(want)).all() and (got > 0).sum() > 100
    for word, row in zip(words[:300], model.words(words)[0]):
        plain = model.emit[:, [model.features[f] for f in pii.word_features(word) if f in model.features]].sum(1)
        assert np.allclose(model.table[row], plain, atol=1e-5)


def test_documents(edges, nothing, model, edge_rows):
    found = pii.find_personal_data(edges, model)
    assert found.columns == [*edges.columns, "found"] and found.count() == len(edge_rows)
    assert found.where(F.size("found.base") + F.size("found.further") > 0).count() == 0
    assert pii.find_personal_data(nothing, model).count() == 0 and pii.redact_documents(nothing, model).count() == 0
    assert sorted(map(str, pii.redact_documents(edges, model).collect())) == sorted(map(str, edges.collect()))


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "é mail a@b.co now +1 (988) 555-2485", 35), (2, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact_documents(docs, model).collect()}
    assert out == {1: ("é mail <EMAIL> now <PHONE>", 26), 2: (None, None)}
    assert pii.redact_text("0123456789", [("ip", 2, 5), ("card", 4, 8)]) == "01<IP>89"


def test_large_labelled_table_is_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        pii.train(pii.labelled_table(spark))
