import math
import re

import pytest
from pyspark.sql import functions as F

from postwatch.llm import licenses

MIT_TEXT = licenses.TEXTS["MIT"][1]
FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "nothing here"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d/e.txt", None), (5, "z.txt", "plain"), (6, "z/own.txt", "Text before.\nThis work is licensed under the GNU General Public License, version 3.\nMore."),
    (7, "z/other.txt", ""), (8, None, "no path"), (9, "a/x.txt", "Intro. Licensed under CC BY-NC 4.0. Then prose goes on."), (10, "ab/x.txt", "not below a"),
    (11, "a/b/COPYING", "Released under the MIT License, which is a licence for all of this and for much more that differs."),
    (12, "k/x.txt", "Our licence to kill and permission to land are no licences."), (13, "a/b/c.txt", "same path again"), (13, "a/b/c.txt", "same path again"),
    (14, "f/LICENCE.md", "Title of the work\n\n" + MIT_TEXT.replace(" copy", "\ncopy")), (15, "f/g/h/i.py", "print"),
    (16, "f/mit.txt", "mit der Zeit und mit dem Licht"), (None, "n/LICENSE", "Licensed under the ISC License"), (17, "n/x", "y"), (None, "q/z", "the of"),
]
SCHEMA = "key long, path string, text string"


def spelled(text):
    """Words of a text by the rule of the module, letter by letter in Python."""
    return [w.rstrip(".-") for w in re.findall(r"[^\W_](?:[^\W_]|[.-])*", (text or "").lower().replace("licence", "license"))]


def best_spans(files, templates, least):
    """key -> (licence, cosine): every span of a template's length and the whole text, at every place, against every template."""
    texts = [(n, spelled(t)) for n, ts in templates.items() for t in ts]
    df = {}
    for _, _, text in files:
        for w in set(spelled(text)):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((1 + len(files)) / (1 + df.get(w, 1))) + 1
    length = lambda ws: math.sqrt(sum(idf(w) ** 2 for w in ws))
    best = {}
    for key, _, text in files:
        ws = spelled(text)
        for name, t in texts:
            own = set(t)
            telling = {w for w in own if re.fullmatch(licenses.TELLING, w)} or ({t[-1]} if t[0].startswith("spdx") else set())
            spans = [(at, set(ws[at:at + len(t)])) for at in range(len(ws))] + ([(0, set(ws))] if len(ws) <= 2 * len(t) else [])
            for at, span in spans:
                if span and telling <= span and not any(re.fullmatch(licenses.KINDS, w) for w in span - own):
                    cosine = round(sum(idf(w) ** 2 for w in own & span) / length(own) / length(span), 9)
                    if cosine >= least:
                        best[key] = min(best.get(key, (9,)), (-cosine, -len(t), at, name))
    return {k: (v[3], -v[0]) for k, v in best.items()}


def brute(files):
    own = best_spans(files, licenses.default_templates(), licenses.LEAST_COSINE)
    out = {}
    for key, path, _ in files:
        if key in own:
            out[key, path] = (own[key][0], path)
            continue
        folder = (path or "").split("/")[:-1]
        out[key, path] = (None, None)
        for n in range(len(folder), -1, -1):
            givers = [(-own[k][1], p, own[k][0]) for k, p, _ in files if k in own and p and p.split("/")[:-1] == folder[:n] and re.search(licenses.LICENCE_FILE, p)]
            if givers:
                out[key, path] = (min(givers)[2], min(givers)[1])
                break
    return out


def test_against_brute_force(spark):
    found = licenses.scan(spark.createDataFrame(FILES, SCHEMA)).collect()
    assert len(found) == len(FILES)
    want = brute(FILES)
    assert {(r.key, r.path): (r.licence, r.covered_by) for r in found} == want
    assert want[2, "a/b/c.txt"] == ("MIT", "a/b/COPYING") and want[3, "a/b/LICENSE"][0] == "Apache-2.0" and want[9, "a/x.txt"][0] == "CC-BY-NC-4.0"
    assert want[15, "f/g/h/i.py"] == ("MIT", "f/LICENCE.md") and want[17, "n/x"][0] == "ISC"
    assert all(want[k] == (None, None) for k in [(12, "k/x.txt"), (5, "z.txt"), (10, "ab/x.txt"), (7, "z/other.txt")])


STATED = {
    "This project is licensed under the MIT License.": "MIT",
    "Released under the MIT License by Foo Bar in 2020.": "MIT",
    "Licensed under the Apache License, Version 2.0 by the authors of this page.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}": "GPL-2.0",
    "SPDX-License-Identifier: CC-BY-ND-4.0 and words": "CC-BY-ND-4.0",
    "SPDX-License-Identifier: Unheard-Of-1.0": None,
    MIT_TEXT: "MIT",
    "Copyright (c) 2020 Foo\n" + MIT_TEXT.replace(", ", ",\n# "): "MIT",
    MIT_TEXT.replace("Software", "Work").replace("free of charge", "at no charge"): "MIT",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007": "GPL-3.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
    licenses.GNU_HEADER.format(kind="General Public License", version="either version 2 of the License, or (at your option) any later version"): "GPL-2.0",
    licenses.GNU_HEADER.format(kind="General Public License", version="either version 3 of the\n * License, or (at your option) any later version"): "GPL-3.0",
    licenses.GNU_HEADER.format(kind="Lesser General Public License", version="either version 3 of the License, or any later version"): "LGPL-3.0",
    "This work is licensed under the GNU General Public License, version 4.": None,
    licenses.TEXTS["BSD-3-Clause"][0].replace("met: ", "met:\n * "): "BSD-3-Clause",
    licenses.TEXTS["BSD-2-Clause"][0] + "\nTHIS SOFTWARE IS PROVIDED AS IS": "BSD-2-Clause",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0, see there": "CC-BY-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY 3.0.": None,
    "A licence to kill, version 3, was given under the terms of the public.": None,
    "mit licensed under the table": None,
    "It is distributed under the BSD 3-Clause Licence, with thanks": "BSD-3-Clause",
}


def test_statements(spark):
    """Wrapped, on one line, reworded, within prose, and versions that must not be mixed up, among plain documents."""
    files = [(i, f"{i}.txt", t) for i, t in enumerate(STATED)] + [(1000 + i, f"p{i}", "the sun of this place is under a cloud and you may use a copy") for i in range(60)]
    found = {r.key: r.licence for r in licenses.own_licences(spark.createDataFrame(files, SCHEMA)).collect()}
    assert {t: found.get(i) for i, t in enumerate(STATED)} == STATED
    assert max(found) < 1000


def test_frequencies_are_those_of_the_files(spark):
    files = spark.createDataFrame([(1, "a", "One two two. Licence"), (2, "b", "one, license-2.0 -x- two"), (3, "c", None), (4, "d", "ONE")], SCHEMA)
    assert {r.term: r.df for r in licenses.document_frequencies(files).collect()} == {"one": 3, "two": 2}


def test_header_lines(spark):
    files = spark.createDataFrame([(1, "a.txt", "x\n" * 50 + "Released under the MIT License."), (2, "LICENSE", "x\n" * 50 + "Released under the MIT License.")], SCHEMA)
    found = {r.key: (r.licence, r.cosine) for r in licenses.scan(files, header_lines=20).collect()}
    assert found == {1: ("MIT", None), 2: ("MIT", 1.0)}


def test_edges(edges, nothing):
    from postwatch.llm.queries import document_path

    pick = lambda df: df.select(F.col("doc_id").alias("key"), document_path().alias("path"), "text")
    assert licenses.scan(pick(edges)).where("licence IS NULL").count() == edges.count()
    assert licenses.scan(pick(nothing)).count() == 0


def test_very_long_runs(spark):
    long = [(1, "a", "a-" * 200_000), (2, "b", "." * 300_000 + " Licensed under the MIT License " + "license " * 20_000), (3, "c", "-" * 300_000)]
    assert {r.key: r.licence for r in licenses.own_licences(spark.createDataFrame(long, SCHEMA)).collect()} == {2: "MIT"}


def test_folders(spark):
    table = spark.createDataFrame([("a/b/c",), ("c",), (None,)], "p string")
    assert [r.f for r in table.select(licenses.folders(F.col("p")).alias("f")).collect()] == [["a/b", "a", ""], [""], [""]]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_needed_terms_lose_nothing(least):
    """Whatever a span shares of a template beside the needed terms, its cosine is below the least one."""
    for weights in ([1.0] * 5, [3.0, 1.0, 1.0, 0.5], [1.0], [2.0, 2.0]):
        norm = math.sqrt(sum(w * w for w in weights))
        unit = {f"t{i}": w / norm for i, w in enumerate(weights)}
        needed = licenses.needed_terms(unit, least)
        assert math.sqrt(sum(w * w for t, w in unit.items() if t not in needed)) < least


def test_many_lists(spark, monkeypatch):
    """What lists of terms weigh comes to the spans by a salted join beyond the broadcast bound, with equal results."""
    from postwatch.functions import lookup

    files = spark.createDataFrame([(i, "x", f"word{i % 3} and {t}") for i, t in enumerate(list(STATED) * 3)], SCHEMA)
    small = sorted(map(tuple, licenses.own_licences(files).collect()))
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, licenses.own_licences(files).collect())) == small and len(small) > 30
