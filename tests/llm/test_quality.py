import re
from collections import Counter, defaultdict

from postwatch.llm import quality

from .conftest import WORD, make


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def counts_of(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def brute_kept(rows, most_texts, most_share, least_left):
    texts, holders = defaultdict(dict), defaultdict(dict)
    for i, t, _, host in rows:
        first = texts[host].get(t or "")
        texts[host][t or ""] = i if first is None else min(first, i)
    for host, known in texts.items():
        for t, i in known.items():
            for line in {norm(x) for x in t.split("\n")} - {""}:
                holders[host, line][t] = i
    out = []
    for i, t, _, host in rows:
        gone = cut = 0
        for line in (t or "").split("\n"):
            h = holders.get((host, norm(line)), {})
            if len(h) > most_texts and len(h) > most_share * len(texts[host]) and i != min(h.values()):
                gone, cut = gone + len(WORD.findall(line)), cut + 1
        n = len(WORD.findall(t or ""))
        out.append((i, not brute_counts(t)[5] and n - gone >= 10 and n - gone >= least_left * n, cut))
    return out


def corpus():
    rows, shared = [], "this very common Line of ten or more words stands here often"
    for i in range(60):
        body = "\n".join(f"line {k} of text {i} with words w{i}x{k} and more" for k in range(i % 4 + 1))
        rows.append((i, f"{shared.upper() if i % 5 == 0 else shared}\n  {body}" if i % 3 else body, "aa", "s1" if i % 2 else "s2"))
    rows += [(100 + i, f"{shared}\nx{i}", "aa", "s1") for i in range(10)]
    rows += [(200 + i, "A copied document whose only line has ten words or more", "aa", "s1") for i in range(40)]
    return rows


def test_counts(docs, rows):
    found = {r.doc_id: counts_of(r) for r in quality.judge(docs).collect()}
    assert found == {i: brute_counts(t) for i, t, *_ in rows}


def test_line_rule(spark):
    rows = corpus()
    for texts, share, left in ((5, 0.01, 0.3), (5, 0.9, 0.3), (12, 0.01, 0.9), (1000, 0, 0.3)):
        found = quality.judge(make(spark, rows), most_texts=texts, most_share=share, least_left=left).collect()
        assert sorted((r.doc_id, r.kept, len(r.cut or ())) for r in found) == sorted(brute_kept(rows, texts, share, left))
    kept = {i: k for i, k, _ in brute_kept(rows, 5, 0.01, 0.3)}
    assert sum(kept[100 + i] for i in range(10)) == 0 and all(kept[200 + i] for i in range(40))


def test_clean_documents(spark):
    rows = corpus()
    docs = make(spark, rows)
    out = {r.doc_id: r for r in quality.clean_documents(docs, most_texts=5, most_share=0.01).collect()}
    want = {i: n for i, k, n in brute_kept(rows, 5, 0.01, 0.3) if k}
    assert set(out) == set(want)
    for i, t, *_ in rows:
        if i in out:
            lines = t.split("\n")
            left = [x for x in lines if norm(x) != norm(lines[0])] if want[i] else lines
            assert out[i].text == "\n".join(left) and out[i].n_chars == len(out[i].text)


def test_limit_does_not_loosen_with_the_host(spark):
    """The same line in the same number of texts gets the same verdict in a host of ten times the texts."""
    shared = "this line of boilerplate stands in sixty different texts of its host"
    for size in (4_000, 40_000):
        rows = [(i, (f"{shared}\n" if i < 60 else "") + f"own words of text {i} and as many more as a text needs to stay", "aa", "s1") for i in range(size)]
        cut = quality.judge(make(spark, rows)).where("cut IS NOT NULL").select("doc_id", "cut").collect()
        assert sorted((r.doc_id, r.cut) for r in cut) == [(i, [0]) for i in range(1, 60)]


def test_edges(edges, nothing, edge_rows):
    found = quality.judge(edges).collect()
    assert sorted(counts_of(r) for r in found) == sorted(brute_counts(t) for _, t, *_ in edge_rows)
    assert not any(r.kept for r in found if r.n_words == 0)
    assert quality.judge(nothing).count() == 0 and quality.clean_documents(nothing).count() == 0
    assert quality.clean_documents(edges).columns == edges.columns


def test_verdicts_are_not_broadcast(spark, docs):
    """There is a verdict for each document, however small the file of all of them."""
    plan = quality.clean_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
