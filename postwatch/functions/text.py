"""Text functions: ``Column -> Column``, all JVM-side.

The cleaning steps work on the whole string. White space is folded to single spaces first; none of
the later patterns can match across a space, so the result is the same as cleaning token by token,
without building an array and without leaving generated code.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space on which tokens are split (Unicode White_Space plus the four ASCII
# separators U+001C to U+001F).
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Emoji code points (ranges of the Unicode emoji data, with the joiner, the variation
# selector, skin tones, flags, tag sequences and keycaps).
EMOJI = (
    r"[0-9#*]\x{FE0F}?\x{20E3}"
    r"|(?=[\x{203C}-\x{10FFFF}])[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F7F0}"
    r"\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}"
    r"\x{1F18E}\x{1F191}-\x{1F19A}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}"
    r"\x{1F251}\x{E0062}-\x{E007F}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}"
    r"\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}"
    r"\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}\x{2611}\x{2614}\x{2615}\x{2618}"
    r"\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}\x{262E}\x{262F}\x{2638}-\x{263A}\x{2640}"
    r"\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267B}\x{267E}"
    r"\x{267F}\x{2692}-\x{2697}\x{2699}\x{269B}\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}"
    r"\x{26B0}\x{26B1}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26C8}\x{26CE}\x{26CF}\x{26D1}\x{26D3}"
    r"\x{26D4}\x{26E9}\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}"
    r"\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}"
    r"\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}"
    r"\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{3030}\x{303D}\x{3297}\x{3299}]"
    r"[\x{FE0F}\x{200D}]*"
)

# English stop words, written without apostrophes because cleaning removes those first.
STOP_WORDS = (
    "i im ill id me my myself we our ours ourselves you youre youve youll youd your yours yourself "
    "yourselves he hes him his himself she shes her hers herself it its itself they theyre theyll them "
    "their theirs themselves what whats which who whom this that thats thatll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both "
    "each few more most other some such nor only own same so than too very can will just should shouldve "
    "now could would u not isnt arent wasnt werent havent hasnt hadnt wont wouldnt dont doesnt didnt cant "
    "couldnt shouldnt mightnt mustnt aint neednt"
).split()

# Fused English words that count as two feature tokens.
FUSED_WORDS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na",
               "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}

# Single characters are one table look-up per character in a Java pattern, ranges are not; so the hot
# patterns list them, and look at the rare wide spaces only from the first of them up. ``translate`` makes an object for
# each character of a text, so single characters are replaced by patterns as well.
_WIDE_SPACES = "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = set(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE_SPACES)
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
#: ``WHITESPACE``, written for speed.
SPACE_RUN = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0%s]+" % _WIDE
_PUNCTUATION = "[" + "".join("\\" + c for c in string.punctuation) + "]+"
ALNUM = string.digits + string.ascii_letters
_MAYBE_EMOJI = r"[\x{203C}-\x{10FFFF}]"
_SQUEEZE = r"(\S)\1{3,}"
_NOISE = f"[^{ALNUM} @]+|@[{ALNUM}]*"
_NOISE_ACCENTS = rf"[^{ALNUM}\p{{L}} @]+|@[{ALNUM}]*"
# A scheme can only start after a character that is itself removed or a space, hence the look-behind;
# with the possessive quantifier it keeps the scan linear on long words.
_URL = rf"|(?<![{ALNUM}])[\p{{L}}\p{{N}}_]++://[^ ]+"
_URL_ACCENTS = rf"|(?<![{ALNUM}\p{{L}}])[\p{{L}}\p{{N}}_]++://[^ ]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_text(c: Column | str) -> Column:
    """A missing text counts as an empty one."""
    return F.coalesce(_col(c), F.lit(""))


def fold_spaces(c: Column | str) -> Column:
    """Every white-space run becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(null_text(c), SPACE_RUN, " "))


def split_tokens(c: Column | str) -> Column:
    """White-space tokens of a text; never null, never an empty token."""
    return F.array_remove(F.split(null_text(c), SPACE_RUN), "")


def join_tokens(tokens: Column | str) -> Column:
    return F.trim(F.array_join(_col(tokens), " "))


def strip_emoji(c: Column | str) -> Column:
    """Remove emoji. One look for any character from U+203C up spares most texts the long pattern."""
    c = null_text(c)
    return F.when(F.rlike(c, F.lit(_MAYBE_EMOJI)), F.regexp_replace(c, EMOJI, "")).otherwise(c)


def squeeze_repeats(c: Column | str) -> Column:
    """A run of more than three equal characters is cut to three (white space is left alone)."""
    return F.regexp_replace(null_text(c), _SQUEEZE, "$1$1$1")


def strip_noise(c: Column | str, keep_accents: bool = False) -> Column:
    """Remove mentions, URLs and everything but ASCII letters, digits and spaces.

    Expects single spaces. The URL branch costs a look-ahead per word, so texts without ``://`` take
    the shorter pattern.
    """
    c = null_text(c)
    base = _NOISE_ACCENTS if keep_accents else _NOISE
    url = _URL_ACCENTS if keep_accents else _URL
    return F.when(F.contains(c, F.lit("://")), F.regexp_replace(c, base + url, "")).otherwise(
        F.regexp_replace(c, base, "")
    )


def first_clean(c: Column | str, keep_accents: bool = False) -> Column:
    """Emoji, white space, repeats and noise removed; words keep their case."""
    squeezed = squeeze_repeats(fold_spaces(strip_emoji(c)))
    return F.trim(strip_noise(squeezed, keep_accents))


def remove_stopwords(tokens: Column | str, stop_words: list[str] | None = None) -> Column:
    """Drop stop words, keeping order and repeats. A long literal list becomes a hash-set test."""
    words = list(STOP_WORDS if stop_words is None else stop_words)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def strip_punctuation(c: Column | str) -> Column:
    """Delete the 32 ASCII punctuation characters."""
    return F.regexp_replace(_col(c), _PUNCTUATION, "")


def word_tokenize(c: Column | str) -> Column:
    """Feature tokens of a cleaned text: typographic quotes stand alone, fused words are split."""
    heads = "|".join(f"{v.split()[0]}(?={v.split()[1]}\\b)" for v in FUSED_WORDS.values())
    first = "".join(sorted({f(v[0]) for v in FUSED_WORDS for f in (str.lower, str.upper)}))
    spaced = F.regexp_replace(null_text(c), r"(?=[^\x00-\x7F])[«“‘„»”’]", " $0 ")
    # One look at a letter spares most places the costly word boundary.
    return split_tokens(F.regexp_replace(spaced, f"(?=[{first}])(?iU)\\b({heads})", "$1 "))


def find_offset(text: Column | str, word: Column | str, last: Column | bool = False) -> Column:
    """0-based offset of the first (or last) occurrence of ``word``; -1 if there is none."""
    text, word = _col(text), _col(word)
    first_at = F.position(word, text) - 1
    last_at = F.when(
        F.contains(text, word),
        F.length(text) - F.length(word) - (F.position(F.reverse(word), F.reverse(text)) - 1),
    ).otherwise(F.lit(-1))
    if isinstance(last, bool):
        return last_at if last else first_at
    return F.when(F.coalesce(last, F.lit(False)), last_at).otherwise(first_at)


def partition_date(name: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date at the start of a file or folder name (``2024-01-31-en``)."""
    return F.to_date(F.regexp_extract(_col(name), r"^(\d+-\d+-\d+)", 1), fmt)
