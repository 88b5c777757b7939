"""SQL for the registered queries, written from the definitions token by token.

Shared steps are common table expressions; a query's SQL gets those it mentions.
"""

from __future__ import annotations

import re

from postwatch.functions.text import STOP_WORDS
from postwatch.operators.entities import DATE_PATTERN, FIGURE_PATTERN
from postwatch.plans import fixtures as fx

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPLIT = r"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def _split(c: str) -> str:
    return _SPLIT.format(c=c)


def _tokens(source: str, text: str, *keep: str) -> str:
    cols = ", ".join(keep)
    return (f"SELECT {cols}, unnest(l) AS tok, generate_subscripts(l, 1) AS pos "
            f"FROM (SELECT {cols}, {_split(text)} AS l FROM {source})")


def _stems(words: str) -> str:
    """Porter stems of ``words`` (keyword), one subquery a step; ``s`` is a word's letters as v (vowel) and c (consonant)."""
    shape = r"regexp_replace(regexp_replace(replace(regexp_replace(w, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY'), '[^aeiouy]', 'c', 'g'), '[aeiouy]', 'v', 'g')"

    def m(s: str) -> str:
        return f"len(string_split({s}, 'vc')) - 1"

    def short(w: str, s: str) -> str:
        return f"({s} = 'vc' OR ({s} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')))"

    def mend(n: int) -> str:
        w, s = f"left(w, -{n})", f"left(s, -{n})"
        return f"""CASE WHEN {s} NOT LIKE '%v%' THEN w WHEN regexp_matches({w}, '(at|bl|iz)$') THEN {w} || 'e'
            WHEN {s} LIKE '%c' AND length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1)
                THEN CASE WHEN right({w}, 1) IN ('l', 's', 'z') THEN {w} ELSE left(w, -{n + 1}) END
            WHEN {m(s)} = 1 AND {short(w, s)} THEN {w} || 'e' ELSE {w} END"""

    def swap(rules: str) -> str:
        pairs = [r.split(":") for r in rules.split()]
        return "CASE " + " ".join(
            f"WHEN w LIKE '%{old}' THEN CASE WHEN {m(f'left(s, -{3 if old == 'logi' else len(old)})')} > 0 THEN left(w, -{len(old)}) || '{new}' ELSE w END"
            for old, new in pairs) + " ELSE w END"

    fourth = "CASE " + " ".join(
        f"WHEN w LIKE '%{x}' THEN CASE WHEN {m(f'left(s, -{len(x)})')} > 1 {also} THEN left(w, -{len(x)}) ELSE w END"
        for x in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
        for also in ["AND regexp_matches(w, '[st]ion$')" if x == "ion" else ""]) + " ELSE w END"
    steps = [
        """CASE WHEN w LIKE '%ies' THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END WHEN w LIKE '%sses' THEN left(w, -2)
            WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END""",
        f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END
            WHEN w LIKE '%eed' THEN CASE WHEN {m('left(s, -3)')} > 0 THEN left(w, -1) ELSE w END
            WHEN w LIKE '%ed' THEN {mend(2)} WHEN w LIKE '%ing' THEN {mend(3)} ELSE w END""",
        "CASE WHEN w LIKE '%y' AND length(w) > 2 AND left(s, -1) LIKE '%c' THEN left(w, -1) || 'i' ELSE w END",
        swap("alli:al"),
        swap("ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
             "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful logi:log"),
        swap("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"),
        fourth,
        f"CASE WHEN w LIKE '%e' AND ({m('left(s, -1)')} > 1 OR ({m('left(s, -1)')} = 1 AND NOT {short('left(w, -1)', 'left(s, -1)')})) THEN left(w, -1) ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {m('left(s, -1)')} > 1 THEN left(w, -1) ELSE w END",
    ]
    sql = f"SELECT keyword, lower(keyword) AS w FROM ({words})"
    for step in steps:
        sql = f"SELECT keyword, {step} AS w FROM (SELECT keyword, w, {shape} AS s FROM ({sql}))"
    return f"""SELECT keyword, CASE WHEN lower(keyword) IN ('sky', 'news', 'howe', 'proceed', 'exceed', 'succeed', 'inning', 'outing', 'canning') THEN lower(keyword)
        WHEN lower(keyword) = 'skies' THEN 'sky' WHEN lower(keyword) IN ('dying', 'lying', 'tying') THEN left(lower(keyword), 1) || 'ie'
        WHEN lower(keyword) IN ('innings', 'outings', 'cannings') THEN left(lower(keyword), -1)
        WHEN length(keyword) <= 2 THEN lower(keyword) ELSE w END AS stem FROM ({sql})"""


_WAYS = "CROSS JOIN (VALUES ('literal'), ('join')) AS w(way)"

_CTES = {
    "kw": fx.KEYWORDS,
    "search": fx.SEARCH_WORDS,
    "lex": fx.LEXICON,
    "trans": fx.TRANSLATIONS,
    "gaz": fx.GAZETTEER,
    "longgaz": fx.LONG_PLACES,
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS id_str, doc_id, text AS full_text, lang, source FROM documents",
    "marks": "SELECT CAST(doc_id AS VARCHAR) AS id_str, CAST(1 - quality AS DOUBLE) AS irrelevant FROM labels",
    "marked": "SELECT d.*, m.irrelevant FROM docs d LEFT JOIN marks m USING (id_str)",
    "toks": _tokens("docs", "full_text", "id_str", "lang"),
    "lowtoks": _tokens("docs", "lower(full_text)", "id_str", "lang"),
    # keyword hits
    "hits": "SELECT t.id_str, k.kind, k.keyword, t.pos AS tpos, k.pos AS kpos FROM toks t JOIN kw k ON contains(t.tok, k.stem)",
    "hitlists": """SELECT d.id_str,
        coalesce(string_agg(h.keyword, '|' ORDER BY tpos, kpos) FILTER (h.kind = 'trigger'), '') AS trigger,
        coalesce(string_agg(h.keyword, '|' ORDER BY tpos, kpos) FILTER (h.kind = 'term'), '') AS term,
        coalesce(string_agg(h.keyword, '|' ORDER BY tpos, kpos) FILTER (h.kind = 'unit'), '') AS unit
        FROM docs d LEFT JOIN hits h USING (id_str) GROUP BY d.id_str""",
    "changedtoks": _tokens("(SELECT id_str, replace(replace(lower(full_text), ' und ', ' tionssss '), ' the ', ' eausesesses ') AS t FROM docs)", "t", "id_str"),
    # cleaning: one row per distinct token
    "chars": """SELECT tok, unnest(regexp_extract_all(tok, '.')) AS c, generate_subscripts(regexp_extract_all(tok, '.'), 1) AS i
        FROM (SELECT DISTINCT tok FROM toks)""",
    "runs": """SELECT tok, c, i, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3
        FROM chars WINDOW w AS (PARTITION BY tok ORDER BY i)""",
    "ctoks": r"""SELECT tok, regexp_replace(string_agg(c, '' ORDER BY i),
        '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+://\S+)', '', 'g') AS clean FROM runs
        WHERE NOT coalesce(c = c1 AND c = c2 AND c = c3, false) GROUP BY tok""",
    # lemma of a token: the shortest known noun it is a form of
    "nouns": "SELECT DISTINCT lemma FROM lex",
    "suffixes": """SELECT * FROM (VALUES ('s', ''), ('ses', 's'), ('ves', 'f'), ('xes', 'x'), ('zes', 'z'),
        ('ches', 'ch'), ('shes', 'sh'), ('men', 'man'), ('ies', 'y')) AS s(suffix, base)""",
    "ftoks": "SELECT DISTINCT tok FROM lowtoks UNION SELECT DISTINCT tok FROM changedtoks UNION SELECT DISTINCT lower(clean) FROM ctoks WHERE clean <> '' "
             "UNION SELECT DISTINCT lower(translation) FROM trans",
    "rules": """SELECT tok, tok AS form, 0 AS round FROM ftoks UNION
        SELECT tok, substr(form, 1, length(form) - length(suffix)) || base, round + 1 FROM rules JOIN suffixes ON suffix(form, suffixes.suffix)""",
    "ruled_nouns": """SELECT tok, first(form ORDER BY greatest(round, 1), length(form), form) AS noun FROM rules JOIN nouns ON form = nouns.lemma GROUP BY tok""",
    "lemmas": """SELECT tok, coalesce(
        (SELECT min(lemma) FROM lex WHERE lex.token = ftoks.tok AND token <> lemma), noun, tok) AS lemma FROM ftoks LEFT JOIN ruled_nouns USING (tok)""",
    "pretoks": f"""SELECT t.id_str, t.pos, m.lemma AS token FROM toks t JOIN ctoks c USING (tok)
        JOIN lemmas m ON m.tok = lower(c.clean) WHERE m.lemma NOT IN ({_STOPS})""",
    "plain": f"""SELECT d.id_str, coalesce(p.txt, '') AS full_text_preprocessed FROM docs d LEFT JOIN (
        SELECT t.id_str, string_agg(lower(clean), ' ' ORDER BY pos) AS txt FROM toks t JOIN ctoks USING (tok)
        WHERE clean <> '' AND lower(clean) NOT IN ({_STOPS}) GROUP BY t.id_str) p USING (id_str)""",
    "pre": """SELECT d.id_str, coalesce(p.txt, '') AS full_text_preprocessed FROM docs d LEFT JOIN (
        SELECT id_str, string_agg(token, ' ' ORDER BY pos) AS txt FROM pretoks GROUP BY id_str) p USING (id_str)""",
    # training posts and naive Bayes
    "train": "SELECT m.id_str, CAST(m.irrelevant AS INT) AS y FROM marked m JOIN hitlists h USING (id_str) "
             "WHERE h.trigger <> '' AND m.irrelevant IN (0, 1)",
    "todo": "SELECT m.id_str, m.lang FROM marked m JOIN hitlists h USING (id_str) WHERE h.trigger <> '' AND m.irrelevant IS NULL",
    "words": "SELECT DISTINCT id_str, token FROM pretoks",
    "sizes": "SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM train",
    "counts": "SELECT token, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM words JOIN train USING (id_str) GROUP BY token",
    "odds": """SELECT token, ln((c1 + .5) / (n1 + .5 * b)) - ln((c0 + .5) / (n0 + .5 * b)) AS present,
        ln((n1 - c1 + .5) / (n1 + .5 * b)) - ln((n0 - c0 + .5) / (n0 + .5 * b)) AS absent
        FROM (SELECT *, CASE WHEN c0 + c1 = n0 + n1 THEN 1 ELSE 2 END AS b FROM counts, sizes)""",
    "bias": "SELECT ln((max(n1) + .5) / (max(n0) + .5)) + sum(absent) AS b FROM odds, sizes",
    "scores": """SELECT d.id_str, bias.b + coalesce(g.gain, 0) AS s FROM docs d CROSS JOIN bias LEFT JOIN (
        SELECT id_str, sum(present - absent) AS gain FROM words JOIN odds USING (token) GROUP BY id_str) g USING (id_str)""",
    # seeded order within the labelled posts
    "ranked": """SELECT id_str, irrelevant, row_number() OVER (PARTITION BY irrelevant ORDER BY md5('42:' || id_str), id_str) AS r,
        count(*) OVER (PARTITION BY irrelevant) AS n FROM marked WHERE irrelevant IN (0, 1)""",
    "tranked": """SELECT id_str, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id_str), id_str) AS r,
        count(*) OVER (PARTITION BY y) AS n FROM train""",
    "hsizes": "SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM tranked WHERE r > ceil(.2 * n)",
    "hcounts": "SELECT token, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM words JOIN tranked USING (id_str) "
               "WHERE r > ceil(.2 * n) GROUP BY token",
    "hodds": """SELECT token, ln((c1 + .5) / (n1 + .5 * b)) - ln((c0 + .5) / (n0 + .5 * b)) AS present,
        ln((n1 - c1 + .5) / (n1 + .5 * b)) - ln((n0 - c0 + .5) / (n0 + .5 * b)) AS absent
        FROM (SELECT *, CASE WHEN c0 + c1 = n0 + n1 THEN 1 ELSE 2 END AS b FROM hcounts, hsizes)""",
    "hbias": "SELECT ln((max(n1) + .5) / (max(n0) + .5)) + sum(absent) AS b FROM hodds, hsizes",
    "hscored": """SELECT t.id_str, t.y, CAST(hbias.b + coalesce(g.gain, 0) >= 0 AS INT) AS p FROM tranked t CROSS JOIN hbias LEFT JOIN (
        SELECT id_str, sum(present - absent) AS gain FROM words JOIN hodds USING (token) GROUP BY id_str) g USING (id_str)
        WHERE t.r <= ceil(.2 * t.n)""",
    "confusion": """SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
        count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM hscored""",
    "folds": "SELECT id_str, y, (r - 1) % 5 AS fold FROM tranked",
    "fsizes": "SELECT a.fold, count(*) FILTER (f.y = 0) AS n0, count(*) FILTER (f.y = 1) AS n1 "
              "FROM (SELECT DISTINCT fold FROM folds) a JOIN folds f ON f.fold <> a.fold GROUP BY a.fold",
    "fcounts": "SELECT a.fold, w.token, count(*) FILTER (f.y = 0) AS c0, count(*) FILTER (f.y = 1) AS c1 "
               "FROM (SELECT DISTINCT fold FROM folds) a JOIN folds f ON f.fold <> a.fold JOIN words w USING (id_str) GROUP BY a.fold, w.token",
    "fodds": """SELECT fold, token, n0, n1, ln((c1 + .5) / (n1 + .5 * b)) - ln((c0 + .5) / (n0 + .5 * b)) AS present,
        ln((n1 - c1 + .5) / (n1 + .5 * b)) - ln((n0 - c0 + .5) / (n0 + .5 * b)) AS absent
        FROM (SELECT *, CASE WHEN c0 + c1 = n0 + n1 THEN 1 ELSE 2 END AS b FROM fcounts JOIN fsizes USING (fold))""",
    "fbias": "SELECT fold, ln((max(n1) + .5) / (max(n0) + .5)) + sum(absent) AS b FROM fodds GROUP BY fold",
    "fscored": """SELECT f.id_str, f.y, f.fold, CAST(b.b + coalesce(g.gain, 0) >= 0 AS INT) AS p FROM folds f JOIN fbias b USING (fold) LEFT JOIN (
        SELECT id_str, sum(present - absent) AS gain FROM folds JOIN words USING (id_str) JOIN fodds USING (fold, token) GROUP BY id_str) g USING (id_str)""",
    "foldsums": """SELECT round(avg(s), 4) AS mean_score, round(stddev_samp(s), 4) AS sd_score FROM (SELECT fold, avg(recall) AS s FROM (
        SELECT fold, y, avg(CAST(y = p AS INT)) AS recall FROM fscored GROUP BY fold, y) GROUP BY fold)""",
    "signs": "SELECT CAST(vec_id AS VARCHAR) AS id_str, CAST(embedding[1] > 0 AS INT) AS y FROM embeddings",
    # word vectors
    "emb": """SELECT tok AS token, embedding AS vector FROM (
        SELECT DISTINCT tok FROM lowtoks WHERE lang = 'en') JOIN embeddings
        ON vec_id = CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)""",
    "dims": "SELECT token, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS dim FROM emb",
    "pooled": """SELECT d.id_str, g.dim, round(coalesce(p.m, 0), 4) + 0.0 AS value FROM docs d
        CROSS JOIN (SELECT DISTINCT dim FROM dims) g LEFT JOIN (
        SELECT id_str, dim, avg(CAST(v AS DOUBLE)) AS m FROM lowtoks t JOIN dims ON token = t.tok GROUP BY id_str, dim
        ) p ON p.id_str = d.id_str AND p.dim = g.dim""",
    # keyword sheet
    "sheet": f"""SELECT doc_id * 100000 + pos - 1 AS pos, CASE WHEN lang = 'en' THEN tok END AS EN,
        CASE WHEN lang = 'fr' THEN tok END AS FR, CASE WHEN lang = 'es' THEN tok END AS ES, source AS displacement_type,
        ['structure_term', 'person_term', 'structure_unit', 'person_unit', 'other'][length(tok) % 5 + 1] AS keyword_type
        FROM ({_tokens('docs', 'full_text', 'doc_id', 'lang', 'source')})""",
    "long": """SELECT pos, keyword_type, displacement_type, lower(lang) AS lang, keyword
        FROM (UNPIVOT (SELECT * FROM sheet) ON EN, FR, ES INTO NAME lang VALUE keyword)""",
    # accounts, scores and dates from events
    "users": """SELECT CAST(event_id AS VARCHAR) AS id_str, event_type, user_id AS id, 'o''b ' || event_type AS screen_name,
        CASE WHEN event_type <> 'view' THEN props END AS location, strftime(ts, '%Y-%m-%d') AS created_at,
        value > 10 AS verified FROM events""",
    "scored": "SELECT event_type, CAST(value > 10 AS INT) AS y, CAST(user_id % 2 AS INT) AS p FROM events",
    "recalls": "SELECT event_type, y, avg(CAST(y = p AS INT)) AS recall FROM scored GROUP BY event_type, y",
    "balanced": "SELECT event_type, avg(recall) AS s FROM recalls GROUP BY event_type",
    "dated": "SELECT CAST(event_id AS VARCHAR) AS id_str, CAST(ts AS DATE) AS d, event_type AS lang, value FROM events",
    # pair search
    "found": f"""SELECT d.id_str, d.full_text, s.kind, s.keyword FROM (
        SELECT id_str, full_text, list_distinct({_split('lower(full_text)')}) AS w FROM docs) d
        JOIN search s ON list_has_all(d.w, string_split(s.keyword, ' '))""",
    "pairs": """SELECT a.id_str, a.full_text, a.keyword AS trigger_kw, b.keyword AS term_kw, b.keyword || ' ' || a.keyword AS query
        FROM found a JOIN found b USING (id_str) WHERE a.kind = 'trigger' AND b.kind = 'term'""",
    # tokens labelled by rule: endings that begin an entity, endings that go on with the one before
    "endings": """SELECT id_str, tok, pos, CASE WHEN right(lower(tok), 3) IN ('the', 'and', 'ing', 'der', 'die', 'und', 'des', 'les', 'que', 'las') THEN NULL WHEN right(lower(tok), 3) = 'ion' THEN 'term'
        WHEN right(lower(tok), 3) = 'eau' THEN 'unit' ELSE '' END AS own FROM toks""",
    "kinds": """SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY id_str ORDER BY pos), '') AS kind FROM endings""",
    "ruled": """SELECT *, CASE WHEN kind = '' THEN 'O' WHEN own IS NULL THEN 'I-' || kind ELSE 'B-' || kind END AS label FROM kinds""",
    # annotations
    "anno": f"""SELECT id_str, full_text, CASE WHEN lang <> 'de' THEN lang = 'en' END AS rfind, w AS wl,
        CASE WHEN source <> 'src3' THEN list_append(list_transform(w, lambda x: CASE WHEN contains(x, 'eau') THEN 'B-unit' ELSE 'B-trig' END), 'B-fig') END AS tl
        FROM (SELECT *, list_filter(list_distinct_ordered, lambda x: contains(x, 'ingtion') OR contains(x, 'eau')) AS w FROM (
        SELECT *, list_transform(list_filter(list_zip({_split('full_text')}, range(1, len({_split('full_text')}) + 1)),
        lambda z: true), lambda z: z[1]) AS list_distinct_ordered FROM docs))""",
    # places
    "bare": r"""SELECT id_str, pos, regexp_replace(regexp_replace(tok, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS w FROM toks""",
    "grams": """SELECT id_str, pos, w AS g1, w || ' ' || lead(w, 1) OVER o AS g2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g3
        FROM bare WINDOW o AS (PARTITION BY id_str ORDER BY pos)""",
    "lens": """SELECT id_str, pos, g1, g2, g3, CASE WHEN g3 IN (SELECT place FROM gaz) THEN 3 WHEN g2 IN (SELECT place FROM gaz) THEN 2
        WHEN g1 IN (SELECT place FROM gaz) THEN 1 ELSE 0 END AS n FROM grams""",
    "maxi": """SELECT *, lag(n, 1, 0) OVER o AS n1, lag(n, 2, 0) OVER o AS n2 FROM lens WINDOW o AS (PARTITION BY id_str ORDER BY pos)""",
    "places": """SELECT d.id_str, coalesce(p.places, '') AS places FROM docs d LEFT JOIN (
        SELECT id_str, string_agg(CASE n WHEN 3 THEN g3 WHEN 2 THEN g2 ELSE g1 END, '|' ORDER BY pos) AS places
        FROM maxi WHERE n > 0 AND NOT (n1 > n OR n2 > n + 1) GROUP BY id_str) p USING (id_str)""",
    # names of any length: the longest at each word, unless it lies in one that starts before it
    "names": r"""SELECT DISTINCT trim(regexp_replace(place, '\s+', ' ', 'g')) AS name, len(string_split(trim(regexp_replace(place, '\s+', ' ', 'g')), ' ')) AS n
        FROM (SELECT place FROM gaz UNION ALL SELECT place FROM longgaz)""",
    "wordlists": "SELECT id_str, list(w ORDER BY pos) AS ws FROM bare GROUP BY id_str",
    "spots": """SELECT id_str, pos, max(n) AS n, arg_max(name, n) AS name FROM bare JOIN wordlists USING (id_str) JOIN names
        ON array_to_string(ws[pos:pos + names.n - 1], ' ') = names.name GROUP BY id_str, pos""",
    "named": """SELECT * FROM spots s WHERE NOT EXISTS (
        SELECT 1 FROM spots o WHERE o.id_str = s.id_str AND o.pos < s.pos AND o.pos + o.n >= s.pos + s.n)""",
    "lists": f"""SELECT id_str, places AS location_list, array_to_string(regexp_extract_all(full_text, '{DATE_PATTERN}'), '|') AS date_list,
        trigger AS trigger_list, term AS term_list, unit AS unit_list,
        array_to_string(regexp_extract_all(full_text, '{FIGURE_PATTERN}'), '|') AS figure_list
        FROM docs JOIN hitlists USING (id_str) JOIN places USING (id_str)""",
    "meta": """SELECT id_str, '2024-01-02' AS created_at, full_text, irrelevant, source = 'src1' AS retweeted, doc_id AS user_id,
        source AS screen_name, length(full_text) > 500 AS verified FROM marked""",
    # many stems: all substrings of the distinct tokens meet the stems
    "cut": """SELECT tok, least(length(tok), 2 + CAST('0x' || substr(md5(tok), 1, 4) AS INT) % 11) AS size, CAST('0x' || substr(md5(tok), 5, 4) AS INT) AS spot
        FROM (SELECT DISTINCT tok FROM toks WHERE length(tok) > 1)""",
    "manystems": f"""SELECT stem FROM (SELECT DISTINCT substr(tok, 1 + spot % (length(tok) - size + 1), size) AS stem FROM cut)
        ORDER BY md5(stem), stem LIMIT {fx.MANY_STEMS}""",
    "subs": """SELECT DISTINCT tok, substr(tok, spot, size) AS stem FROM (SELECT tok, size, unnest(range(1, length(tok) - size + 2)) AS spot
        FROM (SELECT DISTINCT tok FROM toks) CROSS JOIN (SELECT unnest(range(2, 13)) AS size) WHERE size <= length(tok))""",
    "stemhits": """SELECT tok, count(*) AS n, string_agg(stem || '+', '|' ORDER BY stem || '+') AS hits FROM subs JOIN manystems USING (stem) GROUP BY tok""",
    # many places: the longest name at each word, unless it lies in one before it
    "skips": """SELECT id_str, pos, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
        FROM bare WINDOW o AS (PARTITION BY id_str ORDER BY pos)""",
    "runs4": "SELECT DISTINCT concat_ws(' ', w, w1, w2, w3) AS place FROM skips",
    "manynames": """SELECT DISTINCT trim(regexp_replace(place, ' +', ' ', 'g')) AS name FROM (
        SELECT place FROM runs4 WHERE substr(md5(place), 1, 1) IN ('0', '1') UNION ALL
        SELECT concat_ws(' ', w, w2) FROM skips UNION ALL SELECT concat_ws(' ', w, w2, w4) FROM skips) WHERE trim(place) <> ''""",
    "manyspots": """SELECT id_str, pos, max(n) AS n, arg_max(g, n) AS name FROM (
        SELECT id_str, pos, 1 AS n, w AS g FROM skips UNION ALL SELECT id_str, pos, 2, w || ' ' || w1 FROM skips UNION ALL
        SELECT id_str, pos, 3, w || ' ' || w1 || ' ' || w2 FROM skips UNION ALL SELECT id_str, pos, 4, w || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM skips)
        JOIN manynames ON g = name GROUP BY id_str, pos""",
    "manynamed": """SELECT * FROM (SELECT *, max(pos + n) OVER (PARTITION BY id_str ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM manyspots) WHERE reach IS NULL OR pos + n > reach""",
    # annotated occurrences: the text is cut at the word, from the side that is searched first
    "marked_words": """SELECT id_str, tok AS word FROM toks WHERE (tok IN ('the', 'die', 'que', 'les') OR contains(tok, 'ingtion')) AND NOT contains(tok, chr(39))""",
    "listedwords": """SELECT id_str, word, unnest(range(1, n + 2)) AS k, len(string_split(full_text, word)) - 1 AS have, lang = 'en' AS rfind,
        CASE WHEN lang = 'en' THEN string_split(reverse(full_text), reverse(word)) ELSE string_split(full_text, word) END AS parts, full_text
        FROM (SELECT id_str, word, count(*) AS n FROM marked_words GROUP BY id_str, word) JOIN docs USING (id_str)""",
    "occurred": """SELECT id_str, word, CASE WHEN rfind THEN length(full_text) - s - length(word) ELSE s END AS s FROM (
        SELECT *, length(array_to_string(parts[1:k], '')) + (k - 1) * length(word) AS s FROM listedwords WHERE k <= have)""",
    # annotation spans
    "apairs": """SELECT id_str, full_text, rfind, unnest(list_append(wl, 'not-there')) AS word,
        unnest(tl) AS tag, generate_subscripts(tl, 1) AS i FROM anno WHERE tl IS NOT NULL AND rfind IS NOT NULL""",
    "aspans": """SELECT id_str, i, tag, CASE WHEN rfind THEN
        length(full_text) - length(word) - (strpos(reverse(full_text), reverse(word)) - 1) ELSE strpos(full_text, word) - 1 END AS s,
        length(word) AS len, contains(full_text, word) AS there FROM apairs""",
    "tokpos": r"""SELECT id_str, pos, tok, sum(length(tok) + length(gap)) OVER (PARTITION BY id_str ORDER BY pos) - length(tok) - length(gap) AS s
        FROM (SELECT id_str, unnest(string_split_regex(full_text, '\s+')) AS tok,
        unnest(list_append(regexp_extract_all(full_text, '\s+'), '')) AS gap,
        generate_subscripts(string_split_regex(full_text, '\s+'), 1) AS pos FROM anno WHERE tl IS NOT NULL AND rfind IS NOT NULL)""",
    # runs of tagged tokens
    "mtags": "SELECT id_str, pos - 1 AS pos, tok, CASE WHEN contains(tok, 'tion') THEN 'B' ELSE 'I' END AS t FROM toks "
             "WHERE contains(tok, 'tion') OR contains(tok, 'th')",
    "mruns": """SELECT *, sum(CASE WHEN t = 'B' OR prev IS NULL OR prev <> pos - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id_str ORDER BY pos) AS run
        FROM (SELECT *, lag(pos) OVER (PARTITION BY id_str ORDER BY pos) AS prev FROM mtags)""",
}
# distinct values of a list in first-occurrence order
_CTES["anno"] = f"""SELECT id_str, full_text, CASE WHEN lang <> 'de' THEN lang = 'en' END AS rfind, coalesce(w, []) AS wl,
    CASE WHEN source <> 'src3' THEN list_append(list_transform(coalesce(w, []),
    lambda x: CASE WHEN contains(x, 'eau') THEN 'B-unit' ELSE 'B-trig' END), 'B-fig') END AS tl
    FROM docs LEFT JOIN (SELECT id_str, list(tok ORDER BY first_at) AS w FROM (
    SELECT id_str, tok, min(pos) AS first_at FROM toks WHERE contains(tok, 'ingtion') OR contains(tok, 'eau') GROUP BY id_str, tok)
    GROUP BY id_str) USING (id_str)"""

_LITERAL = "'[''' || array_to_string({c}, ''', ''') || ''']'"
_WORDS = _LITERAL.format(c="list_append(wl, 'not-there')")
_TAGS = _LITERAL.format(c="tl")
_HITS = "SELECT id_str, trigger, term, unit FROM hitlists"
_PAIRS = "SELECT id_str, trigger_kw, term_kw, query FROM pairs"
_NEWEST = "SELECT lang, CAST(max(d) AS VARCHAR) AS extraction_date FROM dated GROUP BY lang"
_POOLED = "SELECT id_str, dim, value FROM pooled"
_PRED = "SELECT t.id_str, t.lang, CAST(s >= 0 AS INT) AS predicted_irrelevant FROM todo t JOIN scores USING (id_str)"
_USERS = "SELECT id_str, id, screen_name, location, created_at, verified FROM users"
_DEDUPED = "lang, 'term' AS kind, keyword, arg_max(keyword_type, pos) AS keyword_type, min(pos) AS pos"

_QUERIES = {
    "read_post_file": "SELECT id_str, full_text, lang, source FROM docs",
    "read_post_dir": "SELECT id_str, full_text, CASE WHEN lang <> 'en' THEN lang END AS lang FROM docs",
    "read_keyword_sheets": "SELECT pos, EN, FR, ES, displacement_type AS type FROM sheet UNION ALL SELECT pos, EN, FR, ES, keyword_type FROM sheet",
    "read_annotations": f"SELECT full_text, {_TAGS} AS tags, {_WORDS} AS words, rfind FROM anno",
    "load_embedding": "SELECT token, CAST(len(vector) AS BIGINT) AS dim, round(CAST(vector[1] AS DOUBLE), 4) AS first FROM emb",
    "load_labelled": "SELECT id_str, irrelevant, length(full_text) AS n FROM marked WHERE lang = 'en' AND irrelevant IN (0, 1)",
    "load_unlabelled": "SELECT id_str, round(value, 4) AS value FROM dated WHERE lang = 'view' AND d = DATE '2024-01-03'",
    "save_predictions": f"""SELECT 'live' AS split, '{fx.RUN_DATE}' AS extraction_date, 'bayes' AS model_type, 'en' AS lang, 'en' AS class_lang,
        count(*) AS n, CAST(sum(p) AS BIGINT) AS n_irrelevant FROM scored UNION ALL
        SELECT 'test', NULL, 'bayes', 'en', 'en', count(*), CAST(sum(p) AS BIGINT) FROM scored WHERE event_type = 'view'""",
    "load_predictions": """SELECT 'live' AS split, CAST(event_id AS VARCHAR) AS id_str, CAST(user_id % 2 AS INT) AS predicted_irrelevant FROM events
        UNION ALL SELECT 'test', CAST(event_id AS VARCHAR), CAST(user_id % 2 AS INT) FROM events WHERE event_type = 'view'""",
    "newest_raw_date": _NEWEST,
    "latest_extraction_date": _NEWEST,
    "newest_preprocessed_date": _NEWEST,
    "known_languages": "SELECT DISTINCT lang FROM documents",
    "write_raw": "SELECT trigger_kw, count(*) AS n, CAST(0 AS BIGINT) AS n_created, CAST(sum(length(full_text)) AS BIGINT) AS n_chars FROM pairs GROUP BY trigger_kw",
    "write_raw_csv": "SELECT id_str, full_text, source, lang, true AS no_flag FROM docs",
    "save_posts_by_lang": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "write_keywords": "SELECT keyword, arg_max(keyword_type, pos) AS keyword_type, min(pos) AS pos FROM long WHERE lang = 'fr' GROUP BY keyword",
    "save_confusion": """SELECT 'bayes' AS model_type, 'en' AS lang, 'en' AS class_lang, count(*) FILTER (y = 1 AND p = 1) AS tp,
        count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM scored""",
    "labelled_only": "SELECT id_str, irrelevant FROM marks WHERE irrelevant IN (0, 1)",
    "trigger_gate": "SELECT h.id_str, d.lang, h.trigger, h.term, h.unit FROM hitlists h JOIN docs d USING (id_str) WHERE h.trigger <> ''",
    "split_relevance": "SELECT id_str, CASE irrelevant WHEN 0 THEN 'relevant' ELSE 'irrelevant' END AS part FROM marks WHERE irrelevant IN (0, 1)",
    "split_keyword_kind": """SELECT CASE WHEN keyword_type LIKE '%term' THEN 'term' ELSE 'unit' END AS kind, keyword_type, count(*) AS n,
        CAST(sum(pos) AS BIGINT) AS sum_pos FROM sheet WHERE keyword_type <> 'other' GROUP BY 1, 2""",
    "exclude_retweets": "SELECT id_str, event_type FROM users WHERE location IS NULL",
    "until_date": "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'",
    "drop_incomplete_annotations": f"SELECT full_text, {_TAGS} AS tags, {_WORDS} AS words, rfind FROM anno WHERE tl IS NOT NULL AND rfind IS NOT NULL",
    "post_summary": """SELECT id_str, created_at, full_text, full_text_preprocessed, irrelevant, 1 AS predicted_irrelevant,
        retweeted, user_id, screen_name, verified FROM meta JOIN plain USING (id_str)""",
    "user_struct": _USERS,
    "parse_object_literal": _USERS,
    "text_for_language": "SELECT id_str, CASE WHEN lang = 'en' THEN full_text ELSE source || ' ' || full_text END AS text FROM docs",
    "attach_prediction": "SELECT event_type, p AS predicted_irrelevant, count(*) AS n FROM scored GROUP BY 1, 2",
    "conform_columns": "SELECT id_str, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS BIGINT) AS retweet_count, lang FROM docs",
    "language_column": "SELECT count(EN) AS n_en, count(FR) AS n_fr FROM sheet",
    "keyword_pairs": """SELECT b.keyword || ' ' || a.keyword AS query, b.keyword AS term, a.keyword AS trigger,
        (SELECT count(*) FROM pairs p WHERE p.query = b.keyword || ' ' || a.keyword) AS n_posts
        FROM search a JOIN search b USING (lang) WHERE a.kind = 'trigger' AND b.kind = 'term'""",
    "pair_search": _PAIRS,
    "pair_search_join": _PAIRS,
    "keyword_match": _HITS,
    "keyword_match_join": _HITS,
    "keyword_match_many": """SELECT id_str, coalesce(sum(n), 0)::BIGINT AS n_hits, md5(coalesce(string_agg(hits, '|' ORDER BY pos), '')) AS hits
        FROM docs LEFT JOIN toks USING (id_str) LEFT JOIN stemhits USING (tok) GROUP BY id_str""",
    "embedding_lookup": "SELECT id_str, count(*) AS n, round(sum(CAST(vector[1] AS DOUBLE)), 3) AS sum_first FROM lowtoks JOIN emb ON tok = token GROUP BY id_str",
    "zip_annotations": """SELECT full_text, array_to_string(list_transform(list_zip(list_append(wl, 'not-there'), tl), lambda z: z[1] || '/' || z[2]), '|') AS pairs
        FROM anno WHERE tl IS NOT NULL AND rfind IS NOT NULL""",
    "lemma_lookup": "SELECT lemma, count(*) AS n FROM changedtoks JOIN lemmas USING (tok) GROUP BY lemma",
    "stopword_anti": f"""SELECT d.id_str, count(t.tok) AS n, arg_min(t.tok, t.pos) AS first FROM docs d
        LEFT JOIN (SELECT * FROM lowtoks WHERE tok NOT IN ({_STOPS})) t USING (id_str) GROUP BY d.id_str""",
    "keyword_type_lookup": "SELECT keyword, upper(kind) AS keyword_type, count(*) AS n FROM hits GROUP BY 1, 2",
    "label_stats": """SELECT count(irrelevant) AS n_labelled, count(*) AS n_all, count(*) FILTER (irrelevant = 0) AS n_relevant,
        count(*) FILTER (irrelevant = 1) AS n_irrelevant, round(count(*) FILTER (irrelevant = 0) / count(irrelevant), 4) AS share_relevant FROM marked""",
    "training_stats": """SELECT count(*) FILTER (trigger <> '') AS n_with_trigger, count(*) FILTER (trigger = '') AS n_without_trigger,
        round(count(*) FILTER (trigger <> '') / count(*), 4) AS share_with_trigger,
        count(*) FILTER (trigger <> '' AND irrelevant = 0) AS n_trigger_relevant,
        count(*) FILTER (trigger <> '' AND irrelevant = 1) AS n_trigger_irrelevant,
        round(count(*) FILTER (trigger <> '' AND irrelevant = 0) / count(*) FILTER (trigger <> ''), 4) AS share_relevant
        FROM marks JOIN hitlists USING (id_str)""",
    "vocabulary": "SELECT tok AS token, count(*) AS n, count(DISTINCT id_str) AS n_docs FROM toks GROUP BY tok",
    "mean_pool": _POOLED,
    "dense_features": _POOLED,
    "confusion_matrix": """SELECT event_type, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
        count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM scored GROUP BY event_type""",
    "balanced_accuracy": "SELECT event_type, round(s, 4) AS balanced_accuracy FROM balanced",
    "cv_summary": "SELECT round(avg(s), 4) AS mean_score, round(stddev_samp(s), 4) AS sd_score FROM balanced",
    "keyword_hits": """SELECT h.id_str, d.lang, h.kind, CAST(row_number() OVER (PARTITION BY h.id_str, h.kind ORDER BY tpos, kpos) - 1 AS INT) AS hit_pos,
        h.keyword FROM hits h JOIN docs d USING (id_str)""",
    "entity_lists": "SELECT * FROM lists",
    "nb_statistics": """SELECT y AS label, token, count(*) AS n_posts FROM words JOIN train USING (id_str) GROUP BY 1, 2
        UNION ALL SELECT y, NULL, count(*) FROM train GROUP BY 1""",
    "keyword_dedupe": """SELECT lang, 'term' AS kind, keyword, arg_max(keyword_type || ':' || (pos % 7), pos) AS keyword_type, min(pos) AS pos
        FROM long GROUP BY lang, keyword""",
    "stratified_split": "SELECT id_str, irrelevant, r <= ceil(.2 * n) AS is_test FROM ranked",
    "stratified_folds": "SELECT id_str, irrelevant, CAST((r - 1) % 5 AS INT) AS fold FROM ranked",
    "token_context": """SELECT id_str, CAST(pos - 1 AS INT) AS pos, tok AS token, lag(tok) OVER o AS previous, lead(tok) OVER o AS following
        FROM toks WINDOW o AS (PARTITION BY id_str ORDER BY pos)""",
    "shuffle_rows": """SELECT CAST(event_id AS VARCHAR) AS id_str, row_number() OVER (ORDER BY md5('42:' || event_id), CAST(event_id AS VARCHAR)) - 1 AS row_index
        FROM events""",
    "union_by_name": """SELECT id_str, full_text, lang, NULL AS role FROM docs UNION ALL
        SELECT conv_id || ':' || turn, text, NULL, role FROM conversations""",
    "append_matches": "SELECT id_str, count(*) AS n_copies FROM pairs GROUP BY id_str",
    "combine_posts": "SELECT id_str, lang, irrelevant, 'labelled' AS part FROM marked WHERE irrelevant IN (0, 1) AND lang = 'en' "
                     "UNION ALL SELECT id_str, 'en' AS lang, CAST(NULL AS DOUBLE) AS irrelevant, 'raw' AS part FROM pairs",
    "stem_keywords": _stems("SELECT DISTINCT tok AS keyword FROM toks"),
    "split_tokens": "SELECT id_str, CAST(pos - 1 AS INT) AS pos, tok AS token FROM toks",
    "strip_emoji": "SELECT id_str, replace(full_text, ' ', '  ') AS text FROM docs",
    "squeeze_repeats": """SELECT tok AS token, string_agg(c, '' ORDER BY i) || CASE WHEN max(last) = max(last1) AND max(last) = max(last2) THEN ''
        WHEN max(last) = max(last1) THEN max(last) ELSE max(last) || max(last) END AS squeezed
        FROM (SELECT r.*, right(tok, 1) AS last, coalesce(nullif(substr(tok, length(tok) - 1, 1), ''), '-') AS last1,
        coalesce(nullif(substr(tok, length(tok) - 2, 1), ''), '-') AS last2 FROM runs r)
        WHERE NOT coalesce(c = c1 AND c = c2 AND c = c3, false) GROUP BY tok""",
    "strip_noise": r"""SELECT t, regexp_replace(t, '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+://\S+)', '', 'g') AS clean FROM (
        SELECT 'x ' || url || ' @user_name' AS t FROM pages UNION ALL SELECT trim(regexp_replace(full_text, '\s+', ' ', 'g')) FROM docs)""",
    "join_tokens": "SELECT id_str, string_agg(tok, ' ' ORDER BY pos) AS text FROM toks GROUP BY id_str",
    "translate_posts": """SELECT id_str, string_agg(coalesce(translation, tok), ' ' ORDER BY pos) AS full_text_translated
        FROM toks LEFT JOIN trans ON trans.lang = toks.lang AND token = tok WHERE toks.lang <> 'en' GROUP BY id_str""",
    "translate_hook": "SELECT id_str, replace(full_text, 'e', '3') AS full_text_translated FROM docs",
    "lowercase": "SELECT id_str, lower(full_text) AS text FROM docs",
    "translate_remembered": """SELECT id_str, CASE WHEN full_text = '' THEN '' WHEN full_text IN (SELECT full_text FROM docs WHERE source <> 'src3')
        THEN 'first:' ELSE 'second:' END || CASE WHEN full_text = '' THEN '' ELSE CAST(length(full_text) AS VARCHAR) END AS full_text_translated
        FROM (SELECT * FROM docs UNION ALL SELECT * FROM docs WHERE source <> 'src3')""",
    "lemmatize": "SELECT id_str, string_agg(lemma, ' ' ORDER BY pos) AS text FROM lowtoks JOIN lemmas USING (tok) GROUP BY id_str",
    "remove_stopwords": f"""SELECT d.id_str, coalesce(string_agg(t.tok, ' ' ORDER BY t.pos), '') AS text FROM docs d
        LEFT JOIN (SELECT * FROM lowtoks WHERE tok NOT IN ({_STOPS})) t USING (id_str) GROUP BY d.id_str""",
    "strip_punctuation": r"""SELECT id_str, regexp_replace(full_text, '[!-/:-@\[-`{-~]', '', 'g') AS text FROM docs""",
    "preprocess_text": "SELECT id_str, full_text_preprocessed FROM pre",
    "preprocess_translated": f"""SELECT id_str, string_agg(coalesce(translation, clean), ' ' ORDER BY pos) AS full_text_translated,
        coalesce(string_agg(lemma, ' ' ORDER BY pos) FILTER (lemma NOT IN ({_STOPS})), '') AS full_text_preprocessed
        FROM toks JOIN ctoks USING (tok) LEFT JOIN trans ON trans.lang = toks.lang AND token = clean
        JOIN lemmas m ON m.tok = lower(coalesce(translation, clean)) WHERE toks.lang <> 'en' AND clean <> '' GROUP BY id_str""",
    "word_tokenize": f"""SELECT id_str, array_to_string({_split("regexp_replace(replace(lower(full_text), ' of ', ' can not '), '[«“‘„»”’]', ' x ', 'g')")}, '|') AS tokens FROM docs""",
    "find_offset": """SELECT id_str, strpos(full_text, 'tion') - 1 AS first_at, CASE WHEN contains(full_text, 'tion')
        THEN length(full_text) - 4 - (strpos(reverse(full_text), 'noit') - 1) ELSE -1 END AS last_at FROM docs""",
    "parse_list_literal": "SELECT id_str, array_to_string(list_append(wl, 'not-there'), '|') AS words FROM anno",
    "null_text": f"SELECT id_str, CASE WHEN irrelevant IS NULL THEN full_text ELSE '' END AS text, "
                 f"CASE WHEN irrelevant IS NULL THEN len({_split('full_text')}) ELSE 0 END AS n FROM marked",
    "date_format_parse": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "unpivot_languages": "SELECT pos, keyword_type, lang, keyword FROM long",
    "verified_feature": """SELECT id_str, dim, value FROM pooled UNION ALL
        SELECT id_str, 64, CAST(length(full_text) > 500 AS DOUBLE) FROM docs""",
    "binary_features": "SELECT id_str, token FROM words JOIN train USING (id_str)",
    "naive_bayes": """SELECT id_str, CAST(y AS DOUBLE) AS irrelevant, round(s, 4) AS log_odds, CAST(s >= 0 AS INT) AS predicted_irrelevant
        FROM train JOIN scores USING (id_str)""",
    "predict": _PRED,
    "fit": "SELECT token, round(present - absent, 4) AS gap FROM odds",
    "cross_validate": """SELECT f.id_str, CAST(f.y AS DOUBLE) AS irrelevant, CAST(f.fold AS INT) AS fold,
        CAST(b.b + coalesce(g.gain, 0) >= 0 AS INT) AS predicted_irrelevant FROM folds f JOIN fbias b USING (fold) LEFT JOIN (
        SELECT id_str, sum(present - absent) AS gain FROM folds JOIN words USING (id_str) JOIN fodds USING (fold, token) GROUP BY id_str
        ) g USING (id_str)""",
    "evaluate": """SELECT tp, fp, fn, tn, (SELECT round(avg(recall), 4) FROM (
        SELECT y, avg(CAST(y = p AS INT)) AS recall FROM hscored GROUP BY y)) AS balanced_accuracy FROM confusion""",
    "train_classifier": """SELECT tp, fp, fn, tn, (SELECT round(avg(recall), 4) FROM (
        SELECT y, avg(CAST(y = p AS INT)) AS recall FROM hscored GROUP BY y)) AS score FROM confusion""",
    "test_classifier": """SELECT t.id_str, 'test' AS split, CAST(t.y AS DOUBLE) AS irrelevant, CAST(s >= 0 AS INT) AS predicted_irrelevant
        FROM train t JOIN scores USING (id_str) JOIN docs d USING (id_str) WHERE d.lang = 'fr'""",
    "classify_posts": """SELECT t.id_str, CAST(s >= 0 AS INT) AS predicted_irrelevant, h.trigger AS trigger_list
        FROM todo t JOIN scores USING (id_str) JOIN hitlists h USING (id_str)""",
    "extract_places_dates": f"""SELECT id_str, places, array_to_string(regexp_extract_all(
        regexp_replace(full_text, '\\bthe\\b', 'on 12 March 2020, 10:30 pm or last week', 'g'), '{DATE_PATTERN}'), '|') AS dates
        FROM docs JOIN places USING (id_str)""",
    "extract_places_join": "SELECT id_str, places FROM places",
    "extract_places_many": """SELECT id_str, count(name) AS n_places, md5(coalesce(string_agg(name, '|' ORDER BY pos), '')) AS places
        FROM docs LEFT JOIN manynamed USING (id_str) GROUP BY id_str""",
    "extract_tags": "SELECT id_str, trigger_list, term_list, unit_list, figure_list FROM lists",
    "annotation_occurrences": """SELECT id_str, n_missing, CAST(s AS INT) AS start, CAST(s + length(word) AS INT) AS end
        FROM occurred JOIN (SELECT id_str, sum(CASE WHEN k > have THEN 1 ELSE 0 END)::BIGINT AS n_missing FROM listedwords GROUP BY id_str) USING (id_str)""",
    "annotation_spans": """SELECT id_str, count(*) FILTER (NOT there) AS n_missing,
        coalesce(string_agg(s || '/' || (s + len) || '/' || tag, '|' ORDER BY i) FILTER (there), '') AS spans FROM (
        SELECT * FROM aspans WHERE i <= (SELECT count(*) FROM apairs a WHERE a.id_str = aspans.id_str AND a.word IS NOT NULL)) GROUP BY id_str""",
    "token_labels": """SELECT t.id_str, CAST(row_number() OVER (PARTITION BY t.id_str ORDER BY pos) - 1 AS INT) AS pos, t.tok AS token,
        CAST(t.s AS INT) AS start, CAST(t.s + length(t.tok) AS INT) AS "end",
        coalesce((SELECT arg_min(a.tag, a.i) FROM aspans a WHERE a.id_str = t.id_str AND a.there AND a.s < t.s + length(t.tok) AND a.s + a.len > t.s), 'O') AS label
        FROM tokpos t WHERE t.tok <> ''""",
    "merge_runs": "SELECT id_str, CAST(min(pos) AS INT) AS pos, 'term' AS label, string_agg(tok, ' ' ORDER BY pos) AS text FROM mruns GROUP BY id_str, run",
    "extract_information": """SELECT id_str, created_at, full_text_preprocessed, irrelevant, 0 AS predicted_irrelevant, retweeted, user_id,
        screen_name, verified, location_list, date_list, trigger_list, term_list, unit_list, figure_list
        FROM meta JOIN pre USING (id_str) JOIN lists USING (id_str)""",
    "build_keywords": """SELECT lang, 'trigger' AS kind, keyword, arg_max(displacement_type, pos) AS keyword_type, min(pos) AS pos FROM long GROUP BY lang, keyword
        UNION ALL SELECT lang, CASE WHEN keyword_type LIKE '%term' THEN 'term' ELSE 'unit' END, keyword, arg_max(keyword_type, pos), min(pos)
        FROM long WHERE keyword_type <> 'other' GROUP BY 1, 2, 3""",
    "extract_pairs": f"SELECT trigger_kw, 'en' AS lang, '{fx.RUN_DATE}' AS extraction_date, count(*) AS n FROM pairs GROUP BY trigger_kw",
    "preprocess_posts": "SELECT id_str, full_text_preprocessed, trigger, term, unit FROM pre JOIN hitlists USING (id_str)",
    "monitor_posts": """SELECT id_str, created_at, full_text_preprocessed, CAST(s >= 0 AS INT) AS predicted_irrelevant, retweeted, user_id,
        screen_name, verified, location_list, date_list, trigger_list, term_list, unit_list, figure_list
        FROM todo JOIN meta USING (id_str) JOIN pre USING (id_str) JOIN lists USING (id_str) JOIN scores USING (id_str)""",
    "train_default": """SELECT id_str, t.y AS irrelevant, CAST(s >= 0 AS INT) AS predicted_irrelevant, mean_score, sd_score, score,
        (SELECT count(irrelevant) FROM marked) AS n_labelled, (SELECT count(*) FROM marked) AS n_all
        FROM train t JOIN scores USING (id_str) CROSS JOIN foldsums CROSS JOIN (
        SELECT round(avg(recall), 4) AS score FROM (SELECT y, avg(CAST(y = p AS INT)) AS recall FROM hscored GROUP BY y))""",
    "re_extract": "SELECT id_str, location_list AS places, trigger_list AS triggers FROM lists",
    "monitor_stream": "SELECT lists.*, CAST(s >= 0 AS INT) AS predicted_irrelevant FROM lists JOIN scores USING (id_str) WHERE trigger_list <> ''",
    "load_model": "SELECT CAST(vec_id AS VARCHAR) AS id_str, true AS same FROM embeddings",
    "train_tagger": "SELECT label, label AS tag, count(*) AS n FROM ruled GROUP BY label",
    "tag_posts": """SELECT id_str, CAST(min(pos) - 1 AS INT) AS pos, any_value(kind) AS label, string_agg(tok, ' ' ORDER BY pos) AS text
        FROM (SELECT *, sum(CAST(label[1] = 'B' AS INT)) OVER (PARTITION BY id_str ORDER BY pos) AS run FROM ruled)
        WHERE label <> 'O' GROUP BY id_str, run""",
    "train_entities": "SELECT id_str, true AS same FROM docs",
    # families: the label is the sign of a component
    **dict.fromkeys(("linear_classifier", "random_forest", "rbf_svm", "model_search"),
                    "SELECT id_str, y AS irrelevant, y AS predicted_irrelevant FROM signs"),
    "build_model": "SELECT id_str, y AS irrelevant, y AS predicted_irrelevant, family FROM signs "
                   "CROSS JOIN (VALUES ('randomforest'), ('svm'), ('linear')) AS f(family)",
    # posts stored once per pair, by both ways
    "repeated_match": f"SELECT id_str, query, trigger, term, unit, way FROM pairs JOIN hitlists USING (id_str) {_WAYS}",
    "repeated_search": f"SELECT id_str, copy, query, way FROM pairs CROSS JOIN (VALUES (1), (2)) AS c(copy) {_WAYS}",
    "repeated_lemmas": f"""SELECT id_str, query, text, way FROM pairs JOIN (
        SELECT id_str, string_agg(lemma, ' ' ORDER BY pos) AS text FROM lowtoks JOIN lemmas USING (tok) GROUP BY id_str) USING (id_str) {_WAYS}""",
    "repeated_translation": f"""SELECT id_str, query, full_text_translated, way FROM pairs JOIN (
        SELECT id_str, string_agg(coalesce(translation, tok), ' ' ORDER BY pos) AS full_text_translated
        FROM toks LEFT JOIN trans ON trans.lang = 'fr' AND token = tok WHERE toks.lang = 'fr' GROUP BY id_str) USING (id_str) {_WAYS}""",
    "repeated_places": f"""SELECT id_str, query, coalesce(places, '') AS places, way FROM pairs LEFT JOIN (
        SELECT id_str, string_agg(name, '|' ORDER BY pos) AS places FROM named GROUP BY id_str) USING (id_str) {_WAYS}""",
    "repeated_bayes": f"""SELECT id_str, query, round(s, 4) AS log_odds, CAST(s >= 0 AS INT) AS predicted_irrelevant, way
        FROM pairs JOIN scores USING (id_str) {_WAYS}""",
    # stored runs
    "rerun_with_fewer_keywords": f"""SELECT id_str, trigger_kw, 'en' AS lang, '{fx.RUN_DATE}' AS extraction_date FROM pairs WHERE trigger_kw <> 'que'""",
    "day_without_hits": "SELECT CAST(0 AS BIGINT) AS n, count(*) AS n_before FROM pairs",
    "labelled_languages": "SELECT id_str, lang, irrelevant FROM marked WHERE irrelevant IN (0, 1)",
    "monitor_job": """SELECT id_str, full_text_preprocessed, CAST(s >= 0 AS INT) AS predicted_irrelevant, location_list, trigger_list, term_list
        FROM pairs JOIN pre USING (id_str) JOIN lists USING (id_str) JOIN scores USING (id_str) WHERE trigger_list <> ''""",
}


# The stored run uses the search words as its keywords, and learns from English posts.
_JOB_CTES = {
    "kw": "SELECT kind, keyword, pos, keyword AS stem FROM search",
    "train": "SELECT m.id_str, CAST(m.irrelevant AS INT) AS y FROM marked m JOIN hitlists h USING (id_str) "
             "WHERE h.trigger <> '' AND m.irrelevant IN (0, 1) AND m.lang = 'en'",
}


_OWN_CTES = {"monitor_job": _JOB_CTES, "train_default": {"train": _JOB_CTES["train"]}}


def _with(sql: str, own: dict[str, str] | None = None) -> str:
    """Put the mentioned common table expressions, and theirs, in front."""
    needed: list[str] = []
    known = _CTES | (own or {})
    names = lambda text, name: re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text)

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name, body in known.items():
            if name not in needed and name not in above and names(text, name):
                visit(body, (*above, name))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{name} AS {'' if names(known[name], name) else 'MATERIALIZED '}({known[name]})" for name in needed)
    return f"WITH RECURSIVE {ctes}\n{sql}" if needed else sql


def oracles() -> dict[str, str]:
    return {name: _with(sql, _OWN_CTES.get(name)) for name, sql in _QUERIES.items()}
