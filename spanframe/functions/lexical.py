"""Lexical attributes of a token as Columns: no Python runs for any of them.

Patterns are Java's: classes are spelt as Unicode properties, and \\z is used for the end, as $ also matches before a last newline.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion gajillion bazillion".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth thousandth millionth billionth trillionth quadrillionth quintillionth sextillionth septillionth octillionth nonillionth decillionth gajillionth bazillionth".split()
BRACKETS = tuple("()[]{}<>")
LEFT_PUNCT = tuple("([{<\"'«‘‚‛“„‟‹❮") + ("``",)
RIGHT_PUNCT = tuple(")]}>\"'»’”›❯") + ("''",)
QUOTES = tuple("\"'`«»‘’‚‛“”„‟‹›❮❯") + ("''", "``")
#: Characters that aren't decimal digits but are equivalent to ASCII ones, such as superscripts.
COMPAT_DIGITS = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Nd", "Cs") and unicodedata.normalize("NFKC", c).isascii() and unicodedata.normalize("NFKC", c).isdigit())
DIGIT = r"[\p{Nd}" + COMPAT_DIGITS + "]"


def _every(t: Column, cls: str, least: str = "+") -> Column:
    return t.rlike(rf"\A{cls}{least}\z")


def lower(t: Column) -> Column:
    return F.lower(t)


def norm(t: Column, given: Column | None = None) -> Column:
    """The given norm, unless there is none or it is empty; then lower case."""
    return F.lower(t) if given is None else F.coalesce(F.nullif(given, F.lit("")), F.lower(t))


def prefix(t: Column) -> Column:
    return F.substring(t, 1, 1)


def suffix(t: Column) -> Column:
    return F.right(t, F.lit(3))


def length(t: Column) -> Column:
    return F.length(t)


def _shape(t: Column, digit: str) -> Column:
    s = F.regexp_replace(t, r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]", "x")
    s = F.regexp_replace(s, r"[\p{IsAlphabetic}&&\p{IsUppercase}]", "X")
    s = F.regexp_replace(s, digit, "d")
    return F.when(F.length(t) >= 100, F.lit("LONG")).otherwise(F.regexp_replace(s, r"(?s)(.)\1{3,}", "$1$1$1$1"))


def shape(t: Column) -> Column:
    """The rules' shape: X, x and d for letters and any digits, runs cut to four, LONG from 100 characters."""
    return _shape(t, DIGIT)


def has_shape(t: Column, value: str) -> Column:
    """shape(t) == value. Each character of a shape stands for one of the text, and all but X, x and d for themselves, so most
    texts are told apart before any class is looked up."""
    if value == "LONG":
        return F.length(t) >= 100
    runs = re.search(r"(?s)(.)\1{3}", value)
    test = F.length(t) >= len(value) if runs else F.length(t) == len(value)
    for c in dict.fromkeys(c for c in value if c not in "Xxd"):
        test = test & t.contains(c)
    return test & (shape(t) == value)


def encoder_shape(t: Column) -> Column:
    """The encoder's shape: only ASCII digits become d."""
    return _shape(t, "[0-9]")


def is_alpha(t: Column) -> Column:
    return _every(t, r"\p{IsAlphabetic}")


def is_ascii(t: Column) -> Column:
    return _every(t, r"[\x00-\x7F]", "*")


def is_bracket(t: Column) -> Column:
    return t.isin(*BRACKETS)


def is_currency(t: Column) -> Column:
    return _every(t, r"\p{Sc}")


def is_digit(t: Column) -> Column:
    return _every(t, DIGIT)


def is_left_punct(t: Column) -> Column:
    return t.isin(*LEFT_PUNCT)


def is_right_punct(t: Column) -> Column:
    return t.isin(*RIGHT_PUNCT)


def is_quote(t: Column) -> Column:
    return t.isin(*QUOTES)


def is_lower(t: Column) -> Column:
    return t.rlike(r"\p{IsLowercase}") & ~t.rlike(r"\p{IsUppercase}")


def is_upper(t: Column) -> Column:
    return t.rlike(r"\p{IsUppercase}") & ~t.rlike(r"\p{IsLowercase}")


def is_title(t: Column) -> Column:
    """Upper case only after what has no case, lower case only after what has one, and something with case."""
    wrong = r"\p{IsUppercase}\p{IsUppercase}|\p{IsLowercase}\p{IsUppercase}|(?:\A|[^\p{IsUppercase}\p{IsLowercase}])\p{IsLowercase}"
    return t.rlike(r"[\p{IsUppercase}\p{IsLowercase}]") & ~t.rlike(wrong)


def is_punct(t: Column) -> Column:
    return _every(t, r"\p{P}")


def is_space(t: Column) -> Column:
    """For rules: not the empty token."""
    return _every(t, WS)


def is_space_or_empty(t: Column) -> Column:
    """For the encoder and the decoders."""
    return _every(t, WS, "*")


def is_stop(t: Column, words) -> Column:
    return F.lower(t).isin(*sorted({w.lower() for w in words})) if words else F.lit(False)


def like_email(t: Column) -> Column:
    """A match at the beginning is enough: what follows the address doesn't matter."""
    return t.contains("@") & t.rlike(r"\A[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+")


def has_digit(t: Column) -> Column:
    """A digit of any kind; tokens of ASCII alone, which most are, need only the small class."""
    return t.rlike("[0-9]") | ((F.octet_length(t) != F.length(t)) & t.rlike(DIGIT))


def like_num(t: Column, english: bool = True) -> Column:
    """One sign in front and any commas and points don't count. Regular expressions are only run on tokens with a digit."""
    signed = F.substring(t, 1, 1).isin("+", "-", "±", "~")
    # Most tokens have nothing to take away and nothing to make small, and translate() goes by characters.
    whole = F.when(signed, F.substring(t, F.lit(2), F.length(t))).otherwise(t)
    compact = F.when(t.contains(",") | t.contains("."), F.translate(whole, ",.", "")).otherwise(whole)
    plain = compact.rlike(rf"\A{DIGIT}+(?:/{DIGIT}+)?\z")
    if not english:
        return has_digit(t) & plain
    # ASCII lower case only.
    words, low = (*CARDINALS, *ORDINALS), F.translate(compact, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = F.when(t.rlike("[A-Z]"), low.isin(*words)).otherwise(compact.isin(*words))
    return F.when(has_digit(t), plain | compact.rlike(rf"\A{DIGIT}+(?:[sS][tT]|[nNrR][dD]|[tT][hH])\z")).otherwise(named)


def is_public_ipv4(t: Column) -> Column:
    """Dotted quad with an optional port and path, in no reserved network."""
    well = t.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?:[/?#](?s:.)*)?\z")
    octets = [F.regexp_extract(t, r"\A([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", k).try_cast("int") for k in range(1, 5)]
    a, b, c, d = octets
    small = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    open_ = (a >= 1) & (a <= 223) & ~d.isin(0, 255) & ~a.isin(10, 127) & ~((a == 169) & (b == 254)) & ~((a == 192) & (b == 168)) & ~((a == 172) & b.between(16, 31))
    return F.coalesce(well & small & open_, F.lit(False))


_HOST = r"[A-Za-z0-9\x{a1}-\x{ffff}]"


def like_url(t: Column) -> Column:
    domain = rf"\A(?:[\p{{IsAlphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}+.-]{{2,}}://)?(?:{_HOST}[A-Za-z0-9\x{{a1}}-\x{{ffff}}_-]{{0,62}}\.)+[a-z\x{{df}}-\x{{f6}}\x{{f8}}-\x{{ff}}]{{2,63}}(?::[0-9]{{2,5}})?(?:[/?#][^{WS}]*)?\z"
    never = (t == "") | t.startswith(".") | t.endswith(".") | t.contains("@")
    sure = t.startswith("http://") | t.startswith("https://") | (t.startswith("www.") & (F.length(t) >= 5))
    return sure | (~never & (is_public_ipv4(t) | t.rlike(domain)))


def default_edits(p: str) -> int:
    """Edits that a fuzzy match allows: 0.3 of the length, rounded half to even, two at least."""
    n = 3 * len(p)
    q, r = divmod(n, 10)
    return max(2, q + (r > 5 or r == 5 and q % 2))


def default_edits_of(p: Column) -> Column:
    return F.greatest(F.lit(2), F.bround((F.length(p) * 3).cast("decimal(20,1)") / 10, 0).cast("int"))


def within_edits(a: Column, b: Column, most: int) -> Column:
    """The Levenshtein distance in code points, null beyond the bound."""
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1))


def fuzzy_match(t: Column, pattern: str, edits: int | None = None) -> Column:
    return (t == pattern) | (F.levenshtein(t, F.lit(pattern), edits or default_edits(pattern)) >= 0)


def iob_code(t: Column) -> Column:
    """'', I, O, B or 0..3 as 0..3; null otherwise."""
    return F.when(t == "", 0).when(t == "I", 1).when(t == "O", 2).when(t == "B", 3).when(t.isin("0", "1", "2", "3"), t.cast("int"))


#: Boolean attributes by the name that patterns use.
FLAGS = {
    "IS_ALPHA": is_alpha, "IS_ASCII": is_ascii, "IS_BRACKET": is_bracket, "IS_CURRENCY": is_currency, "IS_DIGIT": is_digit, "IS_LEFT_PUNCT": is_left_punct, "IS_RIGHT_PUNCT": is_right_punct,
    "IS_QUOTE": is_quote, "IS_LOWER": is_lower, "IS_UPPER": is_upper, "IS_TITLE": is_title, "IS_PUNCT": is_punct, "IS_SPACE": is_space, "LIKE_EMAIL": like_email, "LIKE_NUM": like_num, "LIKE_URL": like_url,
}
