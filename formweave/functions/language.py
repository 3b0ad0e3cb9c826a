"""Language and script detection, font choice, local digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts in order of precedence, with the first and last code point and the default language.
SCRIPTS = (
    ("Kannada", 0x0C80, 0x0CFF, "kn"),
    ("Tamil", 0x0B80, 0x0BFF, "ta"),
    ("Telugu", 0x0C00, 0x0C7F, "te"),
    ("Malayalam", 0x0D00, 0x0D7F, "ml"),
    ("Bengali", 0x0980, 0x09FF, "bn"),
    ("Gujarati", 0x0A80, 0x0AFF, "gu"),
    ("Gurmukhi", 0x0A00, 0x0A7F, "pa"),
    ("Odia", 0x0B00, 0x0B7F, "or"),
    ("Sinhala", 0x0D80, 0x0DFF, "si"),
    ("Devanagari", 0x0900, 0x097F, "hi"),
    ("Kana", 0x3040, 0x30FF, "ja"),
    ("Hangul", 0xAC00, 0xD7AF, "ko"),
    ("Han", 0x4E00, 0x9FFF, "zh"),
    ("Thai", 0x0E00, 0x0E7F, "th"),
    ("Hebrew", 0x0590, 0x05FF, "he"),
    ("Greek", 0x0370, 0x03FF, "el"),
    ("Arabic", 0x0600, 0x06FF, "ar"),
    ("Cyrillic", 0x0400, 0x04FF, "ru"),
)
SCRIPT_SHARE = 0.12
#: Function words and letters of the Latin languages, in the order of ties.
WORDS = {
    "en": "the and for your with name first last address date birth email number country city state zip please",
    "es": "el la los las de y para por con usted nombre apellido direccion fecha correo numero pais ciudad codigo",
    "fr": "le la les de et pour vous votre avec nom prenom adresse date naissance courriel numero pays ville code",
    "de": "der die das und für fur mit sie ihre name vorname nachname adresse geburtsdatum strasse stadt land nummer",
}
LETTERS = {"es": "[ñ¿¡]", "fr": "[çœàèùâêîôû]", "de": "[ßäöü]"}


def script_counts(c: Column) -> Column:
    """Struct (n, k, script, lang) of the script with the most characters, the first of equals."""
    return F.array_max(F.array(*(F.struct(F.regexp_count(c, F.lit(f"[{chr(a)}-{chr(b)}]")).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("script"), F.lit(lang).alias("lang")) for k, (s, a, b, lang) in enumerate(SCRIPTS))))


def with_script(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with the struct `script` (script, lang, share) of each text: the main script, if it has more than 12 % of the
    letters; else null. What is before the first of the scripts goes in one pass, and a text with nothing else is not counted. Counts
    come out of an explode of one row, through which a filter on `script` isn't pushed: it would run each regex again."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    first = min(a for _, a, _, _ in SCRIPTS)
    beyond = df.withColumn("_beyond", F.regexp_replace(t, f"[\\x{{0}}-\\x{{{first - 1:X}}}]+", ""))
    counts = F.struct(script_counts(F.col("_beyond")).alias("top"), F.greatest(F.regexp_count(t, F.lit(r"\p{L}")), F.lit(1)).alias("letters"))
    counted = beyond.withColumn("_counts", F.explode(F.array(F.when(F.col("_beyond") != "", counts))))
    share = F.col("_counts.top.n") / F.col("_counts.letters")
    found = F.when((F.col("_counts.top.n") > 0) & (share > SCRIPT_SHARE), F.struct("_counts.top.script", "_counts.top.lang", share.alias("share")))
    return counted.withColumn("script", found).drop("_beyond", "_counts")


def latin_votes(c: Column) -> dict[str, Column]:
    """Votes of each language: distinct function words found, and two for its letters."""
    tokens = F.array_distinct(F.split(F.regexp_replace(F.lower(F.trim(c)), r"[^a-zäöüßçñàèùâêîôûœ¿¡'\s]", " "), r"\s+"))
    out = {}
    for lang, words in WORDS.items():
        votes = F.size(F.array_intersect(tokens, F.array(*map(F.lit, words.split()))))
        out[lang] = votes + F.when(F.lower(c).rlike(LETTERS[lang]), 2).otherwise(0) if lang in LETTERS else votes
    return out


def with_language(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with the struct `language` (lang, confidence): the script's language, else the vote; nothing counts as
    English without confidence."""
    votes = [F.struct(v.alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, v) in enumerate(latin_votes(F.coalesce(F.col(text_col), F.lit(""))).items())]
    d = with_script(df, text_col).withColumn("_votes", F.array(*votes))
    d = d.withColumns({"_best": F.array_max("_votes"), "_total": F.aggregate("_votes", F.lit(0), lambda n, x: n + x.n)})
    some = F.col("_total") > 0
    lang = F.coalesce("script.lang", F.when(some, F.col("_best.lang")).otherwise("en"))
    confidence = F.coalesce("script.share", F.when(some, F.col("_best.n") / F.col("_total")).otherwise(0.0))
    return d.withColumn("language", F.struct(lang.alias("lang"), confidence.alias("confidence"))).drop("_votes", "_best", "_total", "script")


def font_of(c: Column) -> Column:
    """The font family for a text, by the first script found."""
    rules = (("cjk-jp", r"[\x{3040}-\x{30FF}]"), ("cjk-kr", r"[\x{AC00}-\x{D7AF}]"), ("cjk-sc", r"\p{IsHan}"), ("devanagari", r"\p{IsDevanagari}"), ("arabic", r"\p{IsArabic}"), ("cyrillic-greek", r"[\x{0370}-\x{04FF}]"))
    return F.coalesce(*(F.when(c.rlike(p), F.lit(n)) for n, p in rules), F.lit("latin"))


def local_digits(c: Column, lang: str) -> Column:
    """Digits in the script of Hindi or Arabic; other languages keep them."""
    zero = {"hi": 0x0966, "ar": 0x0660}.get(lang)
    return F.translate(c, "0123456789", "".join(chr(zero + k) for k in range(10))) if zero else c
