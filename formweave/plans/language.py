"""Language, script, font and fill language."""

import pandas as pd
from pyspark.sql import functions as F

from formweave.functions import language as L
from formweave.functions import predicates as P
from formweave.functions import translit as T
from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query

_TEXTS = Rows("texts", "id bigint,t string", [(1, "Please enter your first name and address"), (2, "Nombre y apellido, por favor ñ"), (3, "Votre nom et adresse à Paris"), (4, "Bitte geben Sie Ihre Adresse für die Straße"), (5, "पूरा नाम 123"), (6, "全名"), (7, "ひらがなと漢字"), (8, ""), (9, None), (10, "12345"), (11, "Имя и фамилия"), (12, "الاسم الكامل"), (13, "name имя")]).over(id="c_custkey * 100 + id", t="CASE WHEN c_custkey % 2 = 1 THEN t || ' ' || c_mktsegment ELSE t END")
_COUNTS = " UNION ALL ".join(f"SELECT id, {k} AS k, '{s}' AS script, '{lang}' AS lang, len(regexp_extract_all(coalesce(t, ''), '[\\x{{{a:04X}}}-\\x{{{b:04X}}}]')) AS n FROM src" for k, (s, a, b, lang) in enumerate(L.SCRIPTS))
_BEST = f"c AS ({_COUNTS}), b AS (SELECT id, arg_max(script, n * 100 - k) AS script, arg_max(lang, n * 100 - k) AS lang, max(n) AS n FROM c GROUP BY id), l AS (SELECT id, greatest(len(regexp_extract_all(coalesce(t, ''), '\\p{{L}}')), 1) AS letters FROM src), s AS (SELECT id, script, lang, n / letters AS share FROM b JOIN l USING (id) WHERE n > 0 AND n / letters > {L.SCRIPT_SHARE})"
_VOTE = "v AS (" + " UNION ALL ".join(
    f"SELECT id, {k} AS k, '{lang}' AS lang, len(list_intersect(list_distinct(regexp_split_to_array(regexp_replace(lower(trim(coalesce(t, ''))), '[^a-zäöüßçñàèùâêîôûœ¿¡''\\s]', ' ', 'g'), '\\s+')), string_split('{words}', ' '))) + {'CASE WHEN regexp_matches(lower(coalesce(t, %s)), %s) THEN 2 ELSE 0 END' % (repr(''), repr(L.LETTERS[lang])) if lang in L.LETTERS else 0} AS n FROM src"
    for k, (lang, words) in enumerate(L.WORDS.items())
) + "), w AS (SELECT id, arg_max(lang, n * 100 - k) AS lang, max(n) AS top, sum(n) AS total FROM v GROUP BY id)"
_DETECT = f"{_BEST}, {_VOTE} SELECT src.id, coalesce(s.lang, CASE WHEN total > 0 THEN w.lang ELSE 'en' END) AS lang, round(coalesce(share, CASE WHEN total > 0 THEN top / total ELSE 0.0 END), 6)::DOUBLE AS confidence FROM src LEFT JOIN s USING (id) JOIN w ON w.id = src.id"


def _detect(df):
    return L.with_language(df, "t").select("id", "language.lang", F.round("language.confidence", 6).alias("confidence"))


@query("f14_detect_language", f"WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_DETECT}")
def f14(spark, sf):
    return _detect(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")))


@query("a10_language_vote", f"WITH {_TEXTS.cte}, src AS (SELECT * FROM texts), {_DETECT}")
def a10(spark, sf):
    return _detect(_TEXTS.frame(spark, sf))


@query("a11_script_share", f"WITH {_TEXTS.cte}, src AS (SELECT * FROM texts), {_BEST} SELECT id, script, round(share, 6)::DOUBLE AS share FROM s")
def a11(spark, sf):
    return L.with_script(_TEXTS.frame(spark, sf), "t").where("script IS NOT NULL").select("id", "script.script", F.round("script.share", 6).alias("share"))


@query("f18_font_choice", f"WITH {_TEXTS.cte} SELECT id, CASE WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{30FF}}]') THEN 'cjk-jp' WHEN regexp_matches(t, '[\\x{{AC00}}-\\x{{D7AF}}]') THEN 'cjk-kr' WHEN regexp_matches(t, '\\p{{Han}}') THEN 'cjk-sc' WHEN regexp_matches(t, '\\p{{Devanagari}}') THEN 'devanagari' WHEN regexp_matches(t, '\\p{{Arabic}}') THEN 'arabic' WHEN regexp_matches(t, '[\\x{{0370}}-\\x{{04FF}}]') THEN 'cyrillic-greek' ELSE 'latin' END AS font FROM texts WHERE t IS NOT NULL")
def f18(spark, sf):
    return _TEXTS.frame(spark, sf).where("t IS NOT NULL").select("id", L.font_of(F.col("t")).alias("font"))


_NAMES = Rows("names", "id bigint,v string", [(1, "Anna 12"), (2, "ivan"), (3, "Mary Smith"), (4, ""), (5, "a@b.c")]).over(id="c_custkey * 100 + id", v="CASE WHEN c_custkey % 2 = 1 THEN lower(c_mktsegment) || ' ' || v ELSE v END")


def _map_sql(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


_keys = lambda *tables: "(?is)" + "|".join(sorted((k for t in tables for k in t), key=lambda k: -len(k))) + "|."
_by_key = lambda table, digits: f"array_to_string(list_transform(regexp_extract_all(v, '{_keys(table)}'), lambda x: coalesce({_map_sql(table)}[lower(x)], translate(x, '0123456789', '{digits}'))), '')"
_CONSONANT = f"{_map_sql(T.HINDI_CONSONANTS)}[lower(x)]"
_HINDI_SQL = f"""array_to_string(list_transform(h, lambda x, i: CASE WHEN {_CONSONANT} IS NOT NULL THEN CASE WHEN c[i - 1] THEN '{T.VIRAMA}' ELSE '' END || {_CONSONANT}
 WHEN {_map_sql({k: a for k, (a, _) in T.HINDI_VOWELS.items()})}[lower(x)] IS NOT NULL THEN CASE WHEN c[i - 1] THEN {_map_sql({k: m for k, (_, m) in T.HINDI_VOWELS.items()})}[lower(x)] ELSE {_map_sql({k: a for k, (a, _) in T.HINDI_VOWELS.items()})}[lower(x)] END
 ELSE translate(x, '0123456789', '०१२३४५६७८९') END), '')"""
_SCRIPTS_SQL = f"""k AS (SELECT *, regexp_extract_all(v, '{_keys(T.HINDI_CONSONANTS, T.HINDI_VOWELS)}') AS h FROM src), f AS (SELECT *, list_transform(h, lambda x: {_CONSONANT} IS NOT NULL) AS c FROM k)
SELECT id, {_by_key(T.RUSSIAN, '0123456789')} AS ru, {_HINDI_SQL} AS hi, {_by_key(T.ARABIC, '٠١٢٣٤٥٦٧٨٩')} AS ar FROM f"""


def _scripts(df):
    """Greedy, longest key first, in Arrow batches; the scan keeps state, so no expression fits."""

    def udf(lang):
        return F.pandas_udf(lambda s: s.map(lambda x: T.to_script(x, lang)), "string")

    return df.select("id", udf("ru")("v").alias("ru"), udf("hi")("v").alias("hi"), udf("ar")("v").alias("ar"))


@query("f15_transliterate", f"WITH {_NAMES.cte}, src AS (SELECT * FROM names), {_SCRIPTS_SQL}")
def f15(spark, sf):
    return _scripts(_NAMES.frame(spark, sf))


@query("f15_transliterated_items", f"WITH src AS (SELECT item_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS v FROM benchmark), {_SCRIPTS_SQL}")
def f15_items(spark, sf):
    """Whole texts of `benchmark`, their ASCII letters."""
    return _scripts(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("v")))


@query("f15_local_digits", "SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS hi, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS ar FROM orders")
def f15_digits(spark, sf):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", L.local_digits(key, "hi").alias("hi"), L.local_digits(key, "ar").alias("ar"))


_VALUES = Rows("vals", "id bigint,v string", [(1, "please call before delivery"), (2, "Anna"), (3, "   "), (4, None), (5, "12/03/2020"), (6, "leave at the door, thanks a lot")]).over(id="c_custkey * 100 + id")


@query("f16_fill_in_language", f"WITH {_VALUES.cte} SELECT id, CASE WHEN trim(coalesce(v, '')) = '' THEN NULL WHEN id % 100 IN (1, 6) THEN '<es>' || v ELSE v END AS value FROM vals")
def f16(spark, sf):
    """Blank gives null, prose goes to the injected translator (a stand-in here), the rest to transliteration (none for es)."""

    @F.pandas_udf("string")
    def translate(s: pd.Series) -> pd.Series:
        return "<es>" + s

    v = F.col("v")
    return _VALUES.frame(spark, sf).select("id", F.when(F.trim(F.coalesce(v, F.lit(""))) == "", None).when(P.translatable(v), translate(v)).otherwise(v).alias("value"))


@query("a16_distinct_lines", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, pos::INT AS pos, reverse(line) AS shown FROM l")
def a16(spark, sf):
    """Distinct lines are translated once and joined back by their hash."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    once = lines.select("line").distinct().withColumn("shown", F.reverse("line"))
    return lines.join(once, "line").select("doc_id", "pos", "shown")
