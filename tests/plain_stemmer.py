"""Porter stemming letter by letter, which the stemmer of columns is held against."""

from postwatch.functions.stemmer import IRREGULAR, STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel); y after a consonant is a vowel."""
    shape = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and shape[-1:] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if "v" not in _shape(stem):
                continue
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_end(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _final_y(w: str) -> str:
    stem = w[:-1]
    return stem + "i" if w.endswith("y") and len(stem) > 1 and _shape(stem)[-1] == "c" else w


def _replace(w: str, rules: dict[str, str]) -> str:
    for suffix, new in rules.items():
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            kept = w[:-3] if suffix == "logi" else stem
            return stem + new if _measure(kept) > 0 else w
    return w


def _step2(w: str) -> str:
    while w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    return _replace(w, STEP2)


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            return w[:-1]
    return w


def _final_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def porter_stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _step2(_final_y(_past(_plural(w))))
    return _final_l(_final_e(_step4(_replace(w, STEP3))))
