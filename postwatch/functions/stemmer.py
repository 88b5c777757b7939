"""Porter stemming of keywords (M. F. Porter, "An algorithm for suffix stripping", 1980).

With the widely used extensions: a few irregular forms, short words kept, ``ies``/``ied`` on
four-letter words, ``y`` after a consonant only, ``bli`` and ``logi``/``fulli`` suffixes. A stem is one
expression of built-in functions. Each step sees the word and its shape, a string of c and v for its letters;
the shape of a word's beginning is the beginning of its shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement of steps 2 and 3 (stem measure above 0), suffixes of step 4
# (stem measure above 1), each tried in this order.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shape(word: Column) -> Column:
    """c (consonant) or v (vowel) for each letter; y after a consonant is a vowel, so in a run of them every other one."""
    marked = F.replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), F.lit("yy"), F.lit("yY"))
    return F.regexp_replace(F.regexp_replace(marked, "[^aeiouy]", "c"), "[aeiouy]", "v")


def _cut(text: Column, n: int | Column) -> Column:
    return F.left(text, F.length(text) - n)


def _measure(shape: Column) -> Column:
    """How often a vowel is followed by a consonant."""
    return F.length(shape) - F.length(F.replace(shape, F.lit("vc"), F.lit("v")))


def _short_end(stem: Column, shape: Column) -> Column:
    return (shape == "vc") | (shape.endswith("cvc") & ~F.right(stem, F.lit(1)).isin("w", "x", "y"))


def _ending(word: Column, suffixes: Iterable[str]) -> Column:
    """The longest of ``suffixes`` that the word ends in; empty if none."""
    return F.regexp_extract(word, rf"(?:{'|'.join(suffixes)})\z", 0)


def _plural(w: Column, _: Column) -> Column:
    return (F.when(w.endswith("ies"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
            .when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w))


def _mend(stem: Column, shape: Column) -> Column:
    """A stem that lost ``ed`` or ``ing``: its e is put back, or its double consonant made single."""
    last = F.right(stem, F.lit(1))
    double = (F.length(stem) > 1) & (last == F.right(_cut(stem, 1), F.lit(1))) & shape.endswith("c")
    return (F.when(stem.rlike(r"(?:at|bl|iz)\z"), F.concat(stem, F.lit("e")))
            .when(double, F.when(last.isin("l", "s", "z"), stem).otherwise(_cut(stem, 1)))
            .when((_measure(shape) == 1) & _short_end(stem, shape), F.concat(stem, F.lit("e"))).otherwise(stem))


def _past(w: Column, shape: Column) -> Column:
    def without(n: int) -> Column:
        return F.when(_cut(shape, n).contains("v"), _mend(_cut(w, n), _cut(shape, n))).otherwise(w)

    return (F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
            .when(w.endswith("eed"), F.when(_measure(_cut(shape, 3)) > 0, _cut(w, 1)).otherwise(w))
            .when(w.endswith("ed"), without(2)).when(w.endswith("ing"), without(3)).otherwise(w))


def _final_y(w: Column, shape: Column) -> Column:
    turns = w.endswith("y") & (F.length(w) > 2) & _cut(shape, 1).endswith("c")
    return F.when(turns, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _adverb(w: Column, shape: Column) -> Column:
    """``alli`` becomes ``al`` before the other suffixes are looked at, as one may show then (``rationalli``)."""
    return F.when(w.endswith("alli") & (_measure(_cut(shape, 4)) > 0), _cut(w, 2)).otherwise(w)


def _replace(rules: dict[str, str]) -> Callable[[Column, Column], Column]:
    table = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])

    def step(w: Column, shape: Column) -> Column:
        def swap(suffix: Column) -> Column:
            kept = F.length(suffix) - F.when(suffix == "logi", 1).otherwise(0)
            fits = (suffix != "") & (_measure(_cut(shape, kept)) > 0)
            return F.when(fits, F.concat(_cut(w, F.length(suffix)), table[suffix])).otherwise(w)

        return _let(_ending(w, rules), swap)

    return step


def _step4(w: Column, shape: Column) -> Column:
    def drop(suffix: Column) -> Column:
        stem = _cut(w, F.length(suffix))
        fits = (_measure(_cut(shape, F.length(suffix))) > 1) & ((suffix != "ion") | stem.rlike(r"[st]\z"))
        return F.when(fits, stem).otherwise(w)

    return _let(_ending(w, STEP4), drop)


def _final_e(w: Column, shape: Column) -> Column:
    stem, cut = _cut(w, 1), _cut(shape, 1)
    drops = w.endswith("e") & ((_measure(cut) > 1) | ((_measure(cut) == 1) & ~_short_end(stem, cut)))
    return F.when(drops, stem).otherwise(w)


def _final_l(w: Column, shape: Column) -> Column:
    return F.when(w.endswith("ll") & (_measure(_cut(shape, 1)) > 1), _cut(w, 1)).otherwise(w)


def _taken(step: Callable[[Column, Column], Column], word: Column) -> Column:
    return _let(word, lambda w: _let(_shape(w), lambda shape: step(w, shape)))


def porter_stem(word: Column | str) -> Column:
    """The stem of a word; null for null."""
    low = F.lower(F.col(word) if isinstance(word, str) else word)
    steps = (_plural, _past, _final_y, _adverb, _replace(STEP2), _replace(STEP3), _step4, _final_e, _final_l)
    stem = low
    for step in steps:
        stem = _taken(step, stem)
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(irregular[low], F.when(F.length(low) <= 2, low).otherwise(stem))
