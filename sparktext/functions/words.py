"""Word lists and the word-level stemmer."""

from __future__ import annotations

from functools import lru_cache

# The common English stop-word list.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Porter's suffix tables (steps 2, 3 and 4 of the published algorithm).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _is_consonant(word: str, i: int) -> bool:
    if word[i] in "aeiou":
        return False
    if word[i] == "y":
        return i == 0 or not _is_consonant(word, i - 1)
    return True


def _measure(stem: str) -> int:
    flags = [_is_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(flags, flags[1:]) if not a and b)


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _is_consonant(word, len(word) - 1)


def _ends_cvc(word: str) -> bool:
    n = len(word)
    return (
        n > 2
        and _is_consonant(word, n - 1)
        and not _is_consonant(word, n - 2)
        and _is_consonant(word, n - 3)
        and word[-1] not in "wxy"
    )


def _longest_first(suffixes, length):
    return tuple(sorted(suffixes, key=length, reverse=True))


_STEP2 = _longest_first(STEP2, lambda p: len(p[0]))
_STEP3 = _longest_first(STEP3, lambda p: len(p[0]))
_STEP4 = _longest_first(STEP4, len)


def _swap(word: str, table, least: int) -> str:
    """Replace the longest matching suffix if the rest has a measure above ``least``."""
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def porter_stem(word: str) -> str:
    """Porter (1980) stem of one lower-case word."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if _has_vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double_consonant(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _ends_cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1_000_000)
def cached_stem(word: str) -> str:
    return porter_stem(word)
