"""String functions as column expressions: normalisers, keys, scores, masks. Regexes use ASCII classes on purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fill words of the stop lists and prefixes of card brands, in order of precedence.
CARD_BRANDS = (
    ("visa", "^4"),
    ("mastercard", "^(5[1-5]|2(2[2-9]|[3-6][0-9]|7[01]|720))"),
    ("amex", "^3[47]"),
    ("discover", "^(6011|65|64[4-9]|622)"),
    ("diners", "^(30[0-5]|3[68]|39)"),
    ("jcb", "^35(2[89]|[3-8][0-9])"),
    ("unionpay", "^62"),
    ("rupay", "^(60|65|81|82|508)"),
)
#: Letters whose upper case is several, with the single letter that stands for it, where there is one.
_LONG_CAPITALS = [chr(x) for x in range(0x80, 0x10000) if len(chr(x).upper()) > 1 and len(chr(x).title()) == 1]
_SINGLE_CAPITALS = ("ß" + "".join(_LONG_CAPITALS), "ẞ" + "".join(x.title() for x in _LONG_CAPITALS))


def first_rule(c: Column, rules: tuple[tuple[str, str], ...], otherwise: str | None = None) -> Column:
    """The name of the first rule (name, pattern) whose pattern is found."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(n)) for n, p in rules), F.lit(otherwise).cast("string"))


def words_of_label(c: Column) -> Column:
    """Lower-case words of a label or field name, camel case and letter-digit borders split, ASCII only."""
    split = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(split), "[^a-z0-9]+", " "))


def words_of_caption(c: Column) -> Column:
    """As `words_of_label`, but only lower-to-upper borders are split."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "))


def key_of_label(c: Column) -> Column:
    """A vault key in any script: letters, digits and marks joined by _, asides in brackets dropped, 60 at most."""
    joined = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")), r"[^\p{L}\p{N}\p{M}]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, 60), "_+$", "")


def capturable(c: Column) -> Column:
    key = key_of_label(c)
    return (key != "") & ~key.rlike(r"^[\p{N}_]+$")


def option_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    """ASCII letters and digits, everything else a dash; runs stay, ends are trimmed, nothing gives 'form'."""
    s = F.regexp_replace(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.when(s == "", "form").otherwise(s)


def decode_entities(c: Column) -> Column:
    """Six entities, the ampersand first, so that doubly escaped text unfolds."""
    pairs = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def unwrap_redirect(url: Column, param: str) -> Column:
    """The decoded target in a query parameter of a redirect, else the URL itself."""
    return F.when(url.rlike(f"[?&]{param}=[^&#]+"), F.url_decode(F.regexp_extract(url, f"[?&]{param}=([^&#]+)", 1))).otherwise(url)


def initial(c: Column) -> Column:
    """The first letter in upper case, still one letter: those that Java writes as several (ß as SS) have their single capital (ẞ),
    or stay. No letter gives an empty text, null gives null."""
    letter = F.regexp_extract(c, r"\p{L}", 0)
    return F.when(F.length(F.upper(letter)) > 1, F.translate(letter, *_SINGLE_CAPITALS)).otherwise(F.upper(letter))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def card_brand(number: Column) -> Column:
    return first_rule(digits(number), CARD_BRANDS, "")


def mask_card(number: Column) -> Column:
    d = digits(number)
    return F.when(d == "", "").otherwise(F.concat(F.lit("•••• "), F.right(d, F.lit(4))))


def card_type(c: Column) -> Column:
    kind = first_rule(F.lower(c), (("Debit", "debit"), ("Credit", "credit"), ("Cash", "cash"), ("Prepaid", "prepaid")))
    return F.coalesce(kind, c, F.lit(""))


def search_score(query: Column, text: Column) -> Column:
    """How many words of the query, repeats included, are substrings of the text, case aside."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))


def token_score(label_words: Column, phrase: Column) -> Column:
    """Hits squared over the phrase's length, times 1.6 if all its words are in the label."""
    words = F.split(phrase, " ")
    hits, n = F.size(F.filter(words, lambda w: F.array_contains(label_words, w))), F.size(words)
    return hits * hits / n * F.when(hits == n, 1.6).otherwise(1.0)


def option_score(caption: Column, value: Column) -> Column:
    """3 equal, 2 one begins the other, 1 one holds the other, 0 else, of words."""
    a, b = words_of_caption(caption), words_of_caption(value)
    return F.when((a == "") | (b == ""), 0).when(a == b, 3).when(F.startswith(a, b) | F.startswith(b, a), 2).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(0)


def same_value(a: Column, b: Column) -> Column:
    """Equal without case and signs, or at least four digits that are equal."""
    x, y, p, q = option_key(a), option_key(b), digits(a), digits(b)
    return ((x != "") & (x == y)) | ((F.length(p) >= 4) & (p == q))


def option_matches(option: Column, value: Column) -> Column:
    """Equal keys, or the shorter one of at least three characters begins the other."""
    a, b = option_key(option), option_key(value)
    shorter = F.least(F.length(a), F.length(b))
    return (shorter > 0) & ((a == b) | ((shorter >= 3) & (F.startswith(a, b) | F.startswith(b, a))))


def collapse_doubled(c: Column) -> Column:
    """A text that is the same half twice, once."""
    t = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    half = F.floor(F.length(t) / 2).cast("int")
    even = (F.length(t) % 2 == 0) & (F.left(t, half) == F.right(t, half))
    odd = (F.length(t) % 2 == 1) & (F.left(t, half) == F.right(t, half)) & (F.substring(t, half + 1, F.lit(1)) == " ")
    return F.when((t != "") & (even | odd), F.left(t, half)).otherwise(t)


def question_score(c: Column) -> Column:
    """Short questions first: 100 less the length up to 90, 300 for ?, 120 for a closing : or *, 200 off for long prose."""
    n = F.length(c)
    prose = (n > 120) & ~F.contains(c, F.lit("?"))
    return 100 - F.least(n, F.lit(90)) + F.when(F.contains(c, F.lit("?")), 300).otherwise(0) + F.when(c.rlike("[*:][ ]*$"), 120).otherwise(0) - F.when(prose, 200).otherwise(0)


def win_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\xFF]", "?")


def column_number(letters: Column) -> Column:
    """A sheet's column letters as a number from 0."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0), lambda a, x: a * 26 + x) - 1


def column_letters(index: Column) -> Column:
    """Letters of a sheet's column number below 18,278."""
    n = index + 1
    a, b, c = F.pmod(n - 1, F.lit(26)), F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    letter = lambda x: F.char((65 + x).cast("int"))
    return F.concat(F.when(b > 26, letter(c - 1)).otherwise(""), F.when(b > 0, letter(F.pmod(b - 1, F.lit(26)))).otherwise(""), letter(a))
