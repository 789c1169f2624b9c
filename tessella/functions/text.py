"""Column functions on text: tokens, n-grams, letter values, ciphers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter values of the standard alphabetic system, and the mirrored and shifted alphabets.
LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"
LETTER_VALUES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400)
LATIN = "abcdefghijklmnopqrstuvwxyz"
FINALS, MEDIALS = "ךםןףץ", "כמנפצ"


def words(text: Column) -> Column:
    """Lower-case runs of characters that are not white space, in order; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a token: key, idx (from 0), token."""
    return docs.select(key, F.posexplode(words(F.col(text))).alias("idx", "token"))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items of an array, joined by a blank."""
    starts = F.sequence(F.lit(1), F.size(items) - (n - 1))
    return F.when(F.size(items) >= n, F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def fold_finals(text: Column) -> Column:
    return F.translate(text, FINALS, MEDIALS)


def letter_sum(text: Column, letters: str, values: tuple[int, ...]) -> Column:
    """The sum of the values of a text's letters; others count nothing."""
    value_of = F.create_map(*(F.lit(x) for pair in zip(letters, values, strict=True) for x in pair))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a + F.coalesce(F.element_at(value_of, c), F.lit(0)))


def ordinal_value(text: Column, letters: str = LATIN) -> Column:
    return letter_sum(text, letters, tuple(range(1, len(letters) + 1)))


def reduced_value(text: Column, letters: str = LATIN) -> Column:
    return letter_sum(text, letters, tuple(i % 9 + 1 for i in range(len(letters))))


def mirror_cipher(text: Column, letters: str = LATIN) -> Column:
    """First letter for last, second for last but one, and so on."""
    return F.translate(text, letters, letters[::-1])


def half_shift_cipher(text: Column, letters: str = LATIN) -> Column:
    half = len(letters) // 2
    return F.translate(text, letters, letters[half:] + letters[:half])


def sentences(text: Column) -> Column:
    """Parts of a text between full stops, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s) != "")


def without_markup(html: Column) -> Column:
    """Text of a page by patterns: elements that are not shown, comments and tags become blanks, five references are decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def roman(number: Column) -> Column:
    """Whole numbers from 1 to 3999 in Roman numerals, null else."""
    units = (("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))
    parts = []
    for place, (one, five, ten) in zip((1000, 100, 10, 1), units, strict=True):
        digit = (F.floor(number / place) % 10).cast("int")
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten] if five else ["", one, one * 2, one * 3]
        parts.append(F.element_at(F.array(*map(F.lit, forms)), digit + 1))
    return F.when(number.between(1, 3999), F.concat(*parts))
