"""Text functions as Column builders. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktext.functions.words import ENGLISH_STOP_WORDS

# Character classes. Whitespace, digits and word characters are the Unicode
# ones, punctuation is the 32 ASCII signs.
SPACE = r"\p{Z}\t\n\x0B\f\r\x1c-\x1f\x85"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
DIGITS = r"\p{Nd}+"
NOT_LETTERS = rf"[^a-zA-Z{SPACE}]"
NOT_LETTERS_DIGITS = rf"[^a-zA-Z0-9{SPACE}]"
SPACES = rf"[{SPACE}]+"
WORDS = rf"[^{SPACE}]+"
TAG = r"<[^\n]*?>"
TERM = r"[\p{L}\p{N}_]{2,}"
WORD_OR_SIGN = rf"[\p{{L}}\p{{N}}_]+|[^{SPACE}\p{{L}}\p{{N}}_]"
ARTICLE = rf"(?i)\b(Art|Article)\.*[{SPACE}]*(\p{{Nd}}+(?:-\p{{Nd}}+)?)\b"
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body``, so it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def keep_if(value: Column, condition: Callable[[Column], Column]) -> Column:
    """``value`` as a generator that emits no row when the condition fails.

    A plain filter over a computed column is pushed below the projection and evaluates the
    whole expression twice.
    """
    return F.explode(F.filter(F.array(value), condition))


def each(array: Column, position: bool = False) -> Column:
    """Explode a computed array.

    A plain ``explode(f(text))`` makes the optimizer add a filter on ``size(f(text)) > 0``, so f
    runs several times per row; bound by ``let`` it runs once.
    """
    bound = let(array, lambda a: a)
    return F.posexplode(bound) if position else F.explode(bound)


def lower(c: Column | str) -> Column:
    return F.lower(_col(c))


def remove_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), PUNCTUATION, "")


def remove_numbers(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), DIGITS, "")


def remove_special_characters(c: Column | str, keep_digits: bool = False) -> Column:
    return F.regexp_replace(_col(c), NOT_LETTERS_DIGITS if keep_digits else NOT_LETTERS, "")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), TAG, "")


def words(c: Column | str) -> Column:
    """Whitespace tokens."""
    return F.regexp_extract_all(_col(c), F.lit(WORDS), F.lit(0))


def word_tokens(c: Column | str) -> Column:
    """Words and single signs as separate tokens."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_OR_SIGN), F.lit(0))


def terms(c: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TERM), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("bigint")


def drop_stop_words(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams with low <= n <= high, words joined by one space."""
    if (low, high) == (1, 1):
        return tokens

    def of_size(toks: Column, n: int) -> Column:
        if n == 1:
            return toks

        def gram(i: Column) -> Column:
            return F.concat(F.get(toks, i), *[x for k in range(1, n) for x in (F.lit(" "), F.get(toks, i + k))])

        grams = F.transform(F.sequence(F.lit(0), F.size(toks) - F.lit(n)), gram)
        return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda toks: F.concat(*[of_size(toks, n) for n in range(low, high + 1)]))


def term_counts(tokens: Column) -> Column:
    """Count equal tokens inside the row: array of (term, tf), no shuffle needed.

    The tokens are sorted once, then the start of each run gives term and length.
    """

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(
            starts,
            lambda p: F.transform(
                p,
                lambda at, j: F.struct(
                    F.get(s, at - 1).alias("term"),
                    (F.coalesce(F.get(p, j + 1), F.size(s) + 1) - at).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def article_numbers(c: Column | str) -> Column:
    """Sorted set of article numbers such as ``8`` or ``6-1``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(ARTICLE), F.lit(2))))


def spaced_characters(c: Column | str) -> Column:
    return F.array_join(F.filter(F.split(_col(c), ""), lambda x: x != ""), " ")


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(F.trim(_col(c)), SENTENCE_END), lambda s: s != "")


def pieces(c: Column | str, size: int = 500, threshold: int = 512) -> Column:
    """Cut texts of more than ``threshold`` words into pieces of ``size`` words; others stay one piece."""

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws), F.lit(size))
        many = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(size)), " "))
        return F.when(F.size(ws) > threshold, many).otherwise(F.array(F.array_join(ws, " ")))

    return let(words(c), cut)


def concat_fields(*cols: Column | str, sep: str = " ") -> Column:
    """Concatenate with a separator; NULL in any field gives NULL."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_col(c))
    return F.concat(*parts)


def scalar_members(c: Column | str) -> Column:
    """JSON object text -> map of its top-level scalars; lists and objects are dropped."""
    members = F.from_json(_col(c), "map<string,string>")
    return F.map_filter(members, lambda _k, v: v.isNull() | ~v.rlike(r"^\s*[\[{]"))
