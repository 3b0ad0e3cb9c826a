"""Scalar functions: normalisers, scores, cards, dates, numbers, digests."""

from pyspark.sql import functions as F

from formweave.functions import dates as D
from formweave.functions import text as X
from formweave.plans.fixtures import Rows, table
from formweave.plans.predicates import _CAP, _LABELS, _NORM
from formweave.plans.registry import query


@query("f1_label_words", f"WITH {_LABELS.cte} SELECT id, {_NORM('name')} AS words, {_CAP('name')} AS caption FROM labels_")
def f1(spark, sf):
    return _LABELS.frame(spark, sf).select("id", X.words_of_label(F.col("name")).alias("words"), X.words_of_caption(F.col("name")).alias("caption"))


_SCRIPTS = Rows("scripts", "id bigint,label string", [(1, "पूरा नाम"), (2, "全名 (Full Name)"), (3, "Date of expiry"), (4, "  __ "), (5, "Número de teléfono"), (6, "а" * 70), (7, "الاسم الكامل"), (8, "1. 2")]).over(id="c_custkey * 100 + id", label="CASE WHEN c_custkey % 2 = 0 THEN label ELSE label || ' ' || c_mktsegment END")


@query("f2_unicode_key", f"WITH {_SCRIPTS.cte} SELECT id, regexp_replace(left(regexp_replace(regexp_replace(lower(regexp_replace(label, '\\([^)]*\\)', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '_+$', '') AS key FROM scripts")
def f2(spark, sf):
    return _SCRIPTS.frame(spark, sf).select("id", X.key_of_label(F.col("label")).alias("key"))


@query("f3_option_key", "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key FROM part")
def f3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.option_key(F.col("p_type")).alias("key"))


_PHRASES = Rows("phrases", "ord bigint,concept string,phrase string", [(1, "given", "first name"), (1, "given", "given name"), (2, "family", "last name"), (2, "family", "surname"), (3, "full", "name"), (4, "birth", "date of birth"), (5, "phone", "phone number"), (5, "phone", "phone")])
_ASKED = Rows("asked", "id bigint,label string", [(1, "First Name"), (2, "Last name of applicant"), (3, "Name"), (4, "Date of Birth (mm/dd/yyyy)"), (5, "Telephone"), (6, "phoneNumber"), (7, "Birth place"), (8, "Middle name")]).over(id="c_custkey * 100 + id", label="CASE WHEN c_custkey % 2 = 0 THEN label ELSE c_mktsegment || ' ' || label END")


@query("f4_token_score", f"""WITH {_PHRASES.cte}, {_ASKED.cte}, s AS (SELECT id, concept, phrase, len(list_filter(string_split(phrase, ' '), lambda w: list_contains(string_split({_NORM('label')}, ' '), w))) AS h, len(string_split(phrase, ' ')) AS n FROM asked CROSS JOIN phrases)
SELECT id, concept, round(max(h * h / n * CASE WHEN h = n THEN 1.6 ELSE 1.0 END), 6)::DOUBLE AS score FROM s GROUP BY 1, 2""")
def f4(spark, sf):
    scored = _ASKED.frame(spark, sf).crossJoin(F.broadcast(_PHRASES.frame(spark, sf))).withColumn("s", X.token_score(F.split(X.words_of_label(F.col("label")), " "), F.col("phrase")))
    return scored.groupBy("id", "concept").agg(F.round(F.max("s"), 6).cast("double").alias("score"))


_OPTIONS = Rows("options", "q bigint,pos bigint,option string,value string", [(1, 1, "Indian", "India"), (1, 2, "India", "India"), (2, 1, "Married", "M"), (2, 2, "M", "M"), (3, 1, "United States of America", "united states"), (4, 1, "Yes", "No"), (5, 1, "", "x"), (6, 1, "Full-time", "full time")]).over(q="c_custkey * 100 + q", value="CASE WHEN c_custkey % 5 = 0 THEN value || ' ' || c_nationkey ELSE value END")
_OPT = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


@query("f5_option_score", f"WITH {_OPTIONS.cte}, w AS (SELECT q, pos, {_CAP('option')} AS a, {_CAP('value')} AS b FROM options) SELECT q, pos, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 3 WHEN starts_with(a, b) OR starts_with(b, a) THEN 2 WHEN contains(a, b) OR contains(b, a) THEN 1 ELSE 0 END AS score FROM w")
def f5(spark, sf):
    return _OPTIONS.frame(spark, sf).select("q", "pos", X.option_score(F.col("option"), F.col("value")).alias("score"))


@query("j14_option_match", f"WITH {_OPTIONS.cte}, w AS (SELECT *, {_OPT('option')} AS a, {_OPT('value')} AS b FROM options) SELECT q, min(pos) AS pos FROM w WHERE least(length(a), length(b)) > 0 AND (a = b OR (least(length(a), length(b)) >= 3 AND (starts_with(a, b) OR starts_with(b, a)))) GROUP BY q")
def j14(spark, sf):
    return _OPTIONS.frame(spark, sf).where(X.option_matches(F.col("option"), F.col("value"))).groupBy("q").agg(F.min("pos").alias("pos"))


@query("f6_initial", r"SELECT doc_id, upper(regexp_extract(text, '\p{L}')) AS initial FROM documents")
def f6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.initial(F.col("text")).alias("initial"))


@query("f7_composite", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), c_mktsegment || ', ' || n_name) AS address FROM customer JOIN nation ON n_nationkey = c_nationkey")
def f7(spark, sf):
    """A stored composite, else its members joined."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    stored = F.nullif(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(""), F.lit(""))
    return rows.select("c_custkey", F.coalesce(stored, F.concat_ws(", ", "c_mktsegment", "n_name")).alias("address"))


_SSN = Rows("ssn", "id bigint,number string", [(1, "123-45-6789"), (2, "123456789"), (3, "12"), (4, None)]).over(id="c_custkey * 100 + id", number="CASE WHEN c_custkey % 2 = 0 THEN number ELSE lpad('' || c_custkey, 9, '0') END")


@query("f9_number_bundle", f"WITH {_SSN.cte}, d AS (SELECT id, regexp_replace(coalesce(number, ''), '[^0-9]', '', 'g') AS d FROM ssn) SELECT id, CASE WHEN length(d) = 9 THEN substr(d, 1, 3) END AS a, CASE WHEN length(d) = 9 THEN substr(d, 4, 2) END AS b, CASE WHEN length(d) = 9 THEN substr(d, 6, 4) END AS c FROM d")
def f9(spark, sf):
    d = X.digits(F.col("number"))
    part = lambda k, n: F.when(F.length(d) == 9, F.substring(d, k, n))
    return _SSN.frame(spark, sf).select("id", part(1, 3).alias("a"), part(4, 2).alias("b"), part(6, 4).alias("c"))


@query("f10_slug", r"SELECT p_partkey, CASE WHEN trim(regexp_replace(lower(p_name || '  ' || p_brand || '!'), '[^a-z0-9]', '-', 'g'), '-') = '' THEN 'form' ELSE trim(regexp_replace(lower(p_name || '  ' || p_brand || '!'), '[^a-z0-9]', '-', 'g'), '-') END AS slug FROM part")
def f10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit("  "), "p_brand", F.lit("!"))).alias("slug"))


@query("f11_strip_and_decode", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')) AS digest FROM pages")
def f11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.decode_entities(X.strip_tags(F.col("html")))).alias("digest"))


_LINKS = Rows("links", "id bigint,url string", [(1, "//duck.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=1"), (2, "https://b.example/"), (3, "/l/?k=1&uddg=http%3A%2F%2Fc.example")]).over(id="c_custkey * 100 + id", url="url || '&c=' || c_custkey")


@query("f12_unwrap_redirect", f"WITH {_LINKS.cte} SELECT id, CASE WHEN regexp_matches(url, '[?&]uddg=[^&#]+') THEN url_decode(regexp_extract(url, '[?&]uddg=([^&#]+)', 1)) ELSE url END AS target FROM links")
def f12(spark, sf):
    return _LINKS.frame(spark, sf).select("id", X.unwrap_redirect(F.col("url"), "uddg").alias("target"))


@query("f13_catalog_search", """WITH s AS (SELECT p_partkey, p_name, len(list_filter(['brand#1', 'steel', 'ST', 'brand#1'], lambda w: contains(lower(p_name || ' ' || p_brand || ' ' || p_type), lower(w)))) AS score FROM part)
SELECT p_partkey, p_name, score FROM s WHERE score > 0 ORDER BY score DESC, p_name, p_partkey""")
def f13(spark, sf):
    """Catalog search: the query's words as substrings of name and tags, best first."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    scored = table(spark, sf, "part").select("p_partkey", "p_name", X.search_score(F.lit("brand#1 steel ST  brand#1"), text).cast("long").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "p_name", "p_partkey")


_CARDS = Rows("cards", "id bigint,number string,kind string", [(1, "4111 1111 1111 1111", "credit card"), (2, "5500-0000-0000-0004", "DEBIT"), (3, "340000000000009", "x"), (4, "6011000000000004", None), (5, "30000000000004", "prepaid"), (6, "3530111333300000", ""), (7, "6200000000000005", "cash"), (8, "6521111111111117", "y"), (9, "8111", "z"), (10, None, "q"), (11, "6221261111117766", "c"), (12, "2720990000000007", "d"), (13, "5081", "e")]).over(id="c_custkey * 100 + id", number="CASE WHEN c_custkey % 3 = 0 THEN number || (c_custkey % 10) ELSE number END")


@query("f28_card_brand", rf"""WITH {_CARDS.cte}, d AS (SELECT id, kind, regexp_replace(coalesce(number, ''), '[^0-9]', '', 'g') AS d FROM cards)
SELECT id, CASE WHEN regexp_matches(d, '^4') THEN 'visa' WHEN regexp_matches(d, '^(5[1-5]|2(2[2-9]|[3-6][0-9]|7[01]|720))') THEN 'mastercard' WHEN regexp_matches(d, '^3[47]') THEN 'amex' WHEN regexp_matches(d, '^(6011|65|64[4-9]|622)') THEN 'discover'
 WHEN regexp_matches(d, '^(30[0-5]|3[68]|39)') THEN 'diners' WHEN regexp_matches(d, '^35(2[89]|[3-8][0-9])') THEN 'jcb' WHEN starts_with(d, '62') THEN 'unionpay' WHEN regexp_matches(d, '^(60|65|81|82|508)') THEN 'rupay' ELSE '' END AS brand,
 CASE WHEN d = '' THEN '' ELSE '•••• ' || right(d, 4) END AS mask, CASE WHEN contains(lower(kind), 'debit') THEN 'Debit' WHEN contains(lower(kind), 'credit') THEN 'Credit' WHEN contains(lower(kind), 'cash') THEN 'Cash' WHEN contains(lower(kind), 'prepaid') THEN 'Prepaid' ELSE coalesce(kind, '') END AS type FROM d""")
def f28(spark, sf):
    n = F.col("number")
    return _CARDS.frame(spark, sf).select("id", X.card_brand(n).alias("brand"), X.mask_card(n).alias("mask"), X.card_type(F.col("kind")).alias("type"))


_QUESTIONS = Rows("questions", "id bigint,q string", [(1, "Are you over 18?"), (2, "Name:"), (3, "City City"), (4, "GenderGender"), (5, "x" * 130), (6, "Required *")]).over(id="c_custkey * 100 + id", q="CASE WHEN c_custkey % 2 = 0 THEN q ELSE c_mktsegment || ' ' || q END")


@query("f29_f30_questions", f"""WITH {_QUESTIONS.cte}, t AS (SELECT id, q, trim(regexp_replace(q, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM questions)
SELECT id, CASE WHEN left(t, length(t) // 2) = right(t, length(t) // 2) AND (length(t) % 2 = 0 OR substr(t, length(t) // 2 + 1, 1) = ' ') THEN left(t, length(t) // 2) ELSE t END AS cleaned,
 (100 - least(length(q), 90) + CASE WHEN contains(q, '?') THEN 300 ELSE 0 END + CASE WHEN regexp_matches(q, '[*:] *$') THEN 120 ELSE 0 END - CASE WHEN length(q) > 120 AND NOT contains(q, '?') THEN 200 ELSE 0 END)::INT AS score FROM t""")
def f29(spark, sf):
    return _QUESTIONS.frame(spark, sf).select("id", X.collapse_doubled(F.col("q")).alias("cleaned"), X.question_score(F.col("q")).alias("score"))


@query("f19_win_ansi", r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g')) AS digest FROM documents")
def f19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.win_ansi(F.col("text"))).alias("digest"))


_REFS = Rows("refs", "ref string", [("A1",), ("Z9",), ("AA10",), ("AZ3",), ("BA7",), ("ZZ1",), ("AAA2",)]).over(ref="ref || (c_custkey % 1000)")


@query("f33_sheet_refs", f"WITH {_REFS.cte}, l AS (SELECT ref, regexp_extract(ref, '^[A-Z]+') AS s, regexp_extract(ref, '[0-9]+$')::INT AS sheet_row FROM refs) SELECT ref, sheet_row, (list_reduce(list_prepend(0, list_transform(string_split(s, ''), lambda c: ascii(c) - 64)), lambda a, x: a * 26 + x) - 1)::INT AS col, s AS letters FROM l")
def f33(spark, sf):
    letters = F.regexp_extract("ref", "^[A-Z]+", 0)
    col = X.column_number(letters)
    return _REFS.frame(spark, sf).select("ref", F.regexp_extract("ref", "[0-9]+$", 0).cast("int").alias("sheet_row"), col.alias("col"), X.column_letters(col).alias("letters"))


_DATES = Rows("dates", "id bigint,d string,hint string", [(1, "01/15/1985", "dd/mm/yyyy"), (2, "15/01/1985", "MM/DD/YYYY"), (3, "2/3/31", "yyyy-mm-dd"), (4, "2/3/30", "d mmm yyyy"), (5, "2001-05-01", ""), (6, "13/13/2000", "x"), (7, "2/29/2023", "x"), (8, "nope", "x"), (9, "05/01/2024", "Date (DD-MM-YY)")]).over(id="c_custkey * 100 + id", d="CASE WHEN c_custkey % 2 = 0 THEN d ELSE lpad('' || (1 + c_custkey % 12), 2, '0') || '/' || lpad('' || (1 + c_custkey * 7 % 28), 2, '0') || '/' || (1930 + c_custkey % 90) END")
_PARSED = r"""SELECT id, d, hint, CASE WHEN regexp_matches(d, '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_cast(d AS DATE) WHEN regexp_matches(d, '^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$') THEN
  try_cast((CASE WHEN length(split_part(d, '/', 3)) = 4 THEN split_part(d, '/', 3) WHEN split_part(d, '/', 3)::INT > 30 THEN '19' || split_part(d, '/', 3) ELSE '20' || split_part(d, '/', 3) END) || '-' ||
   (CASE WHEN split_part(d, '/', 1)::INT > 12 AND split_part(d, '/', 2)::INT <= 12 THEN lpad(split_part(d, '/', 2), 2, '0') || '-' || lpad(split_part(d, '/', 1), 2, '0') ELSE lpad(split_part(d, '/', 1), 2, '0') || '-' || lpad(split_part(d, '/', 2), 2, '0') END) AS DATE) END AS p FROM dates"""


@query("d1_age", f"WITH {_DATES.cte}, p AS ({_PARSED}) SELECT id, CASE WHEN date_sub('year', p, DATE '2026-02-28') BETWEEN 0 AND 149 THEN date_sub('year', p, DATE '2026-02-28') END::INT AS age FROM p")
def d1(spark, sf):
    born = D.parse_date(F.col("d"), 30)
    return _DATES.frame(spark, sf).select("id", D.age(born, F.lit("2026-02-28").cast("date")).alias("age"))


@query("d3_parse_vault_date", f"WITH {_DATES.cte}, p AS ({_PARSED}) SELECT id, p AS parsed FROM p")
def d3(spark, sf):
    return _DATES.frame(spark, sf).select("id", D.parse_date(F.col("d"), 30).alias("parsed"))


@query("d4_requested_format", f"""WITH {_DATES.cte}, p AS ({_PARSED}), f AS (SELECT id, p, CASE WHEN regexp_matches(lower(hint), 'yyyy[^a-z]*mm[^a-z]*dd') THEN 1 WHEN regexp_matches(lower(hint), 'dd?[^a-z]*mmm[^a-z]*yy') THEN 2 WHEN regexp_matches(lower(hint), 'dd?[^a-z]*mm[^a-z]*yy') THEN 3 ELSE 4 END AS f FROM p)
SELECT id, CASE f WHEN 1 THEN strftime(p, '%Y-%m-%d') WHEN 2 THEN strftime(p, '%d %b %Y') WHEN 3 THEN strftime(p, '%d/%m/%Y') ELSE strftime(p, '%m/%d/%Y') END AS shown FROM f""")
def d4(spark, sf):
    parsed = D.parse_date(F.col("d"), 30)
    return _DATES.frame(spark, sf).select("id", D.format_date(parsed, D.date_format_hint(F.col("hint"))).alias("shown"))


@query("d5_day_first", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders")
def d5(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", D.day_first(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"))


@query("d6_default_date", "SELECT DISTINCT '03/04/2026' AS today, strftime(o_orderdate, '%m/%d/%Y') AS d FROM orders")
def d6(spark, sf):
    return table(spark, sf, "orders").select(F.date_format(F.lit("2026-03-04").cast("date"), "MM/dd/yyyy").alias("today"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("d")).distinct()


@query("d7_year_class", "SELECT CASE WHEN o_orderdate::DATE > DATE '1997-06-01' THEN 'future' WHEN 1997 - year(o_orderdate) >= 14 THEN 'birth' ELSE 'recent' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def d7(spark, sf):
    kind = D.year_class(F.col("o_orderdate").cast("date"), F.lit("1997-06-01").cast("date"))
    return table(spark, sf, "orders").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_YEARS = Rows("years", "y string", [("30",), ("31",), ("69",), ("70",), ("05",), ("1999",)]).over(y="CASE WHEN c_custkey % 2 = 0 THEN y ELSE lpad('' || (c_custkey % 100), 2, '0') END")


@query("d8_year_pivots", f"WITH {_YEARS.cte} SELECT y, CASE WHEN length(y) > 2 THEN y::INT WHEN y::INT > 30 THEN 1900 + y::INT ELSE 2000 + y::INT END AS born, CASE WHEN length(y) > 2 THEN y::INT WHEN y::INT > 69 THEN 1900 + y::INT ELSE 2000 + y::INT END AS expires FROM years")
def d8(spark, sf):
    return _YEARS.frame(spark, sf).select("y", D.full_year(F.col("y"), 30).alias("born"), D.full_year(F.col("y"), 69).alias("expires"))


_LUHN = Rows("luhn", "n string", [("4111111111111111",), ("4111111111111112",), ("79927398713",), ("79927398710",), ("0",)]).over(n="n || lpad('' || c_custkey, 6, '0')")


@query("m1_luhn", f"""WITH {_LUHN.cte}, d AS (SELECT n, unnest(string_split(reverse(n), '')) AS c, generate_subscripts(string_split(reverse(n), ''), 1) AS i FROM luhn),
s AS (SELECT n, sum(CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT * 2 > 9 THEN c::INT * 2 - 9 ELSE c::INT * 2 END) AS s FROM d GROUP BY n) SELECT n, s % 10 = 0 AS valid FROM s""")
def m1(spark, sf):
    return _LUHN.frame(spark, sf).select("n", F.expr("luhn_check(n)").alias("valid"))


_PAIRS = Rows("pairs", "id bigint,a string,b string", [(1, "Main St.", "main st"), (2, "(555) 123-4567", "5551234567x"), (3, "12", "1-2a"), (4, "", ""), (5, "abc", "abd")]).over(id="c_custkey * 100 + id", a="CASE WHEN c_custkey % 8 = 0 THEN a || ' ' || c_nationkey ELSE a END", b="CASE WHEN c_custkey % 4 = 0 THEN b || ' ' || c_nationkey ELSE b END")


@query("m2_same_value", f"WITH {_PAIRS.cte} SELECT id, ({_OPT('a')} <> '' AND {_OPT('a')} = {_OPT('b')}) OR (length(regexp_replace(a, '[^0-9]', '', 'g')) >= 4 AND regexp_replace(a, '[^0-9]', '', 'g') = regexp_replace(b, '[^0-9]', '', 'g')) AS same FROM pairs")
def m2(spark, sf):
    return _PAIRS.frame(spark, sf).select("id", X.same_value(F.col("a"), F.col("b")).alias("same"))


_RECTS = Rows("rects", "id bigint,x1 double,y1 double,x2 double,y2 double", [(1, 10.0, 20.0, 5.0, 30.0), (2, 0.0, 0.0, 1.0, 9.0), (3, 4.0, 4.0, 6.0, 6.0)]).over(id="c_custkey * 100 + id", x1="x1 + c_custkey % 5")


@query("m3_rect_filter", f"WITH {_RECTS.cte} SELECT id, least(x1, x2) AS x, least(y1, y2) AS y, abs(x1 - x2) AS w, abs(y1 - y2) AS h FROM rects WHERE abs(x1 - x2) >= 2 AND abs(y1 - y2) >= 2")
def m3(spark, sf):
    w, h = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    return _RECTS.frame(spark, sf).select("id", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), w.alias("w"), h.alias("h")).where("w >= 2 AND h >= 2")


@query("c9_base64url", "SELECT c_custkey, translate(rtrim(to_base64(encode(c_name || '??>>')), '='), '+/', '-_') AS code FROM customer")
def c9(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.translate(F.rtrim(F.base64(F.concat("c_name", F.lit("??>>")).cast("binary")), F.lit("=")), "+/", "-_").alias("code"))


@query("c2_seal_open", "SELECT c_custkey, c_name AS opened FROM customer")
def c2(spark, sf):
    """AES-256-GCM seal and open; only the opened text is comparable, as nonces differ."""
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    sealed = table(spark, sf, "customer").select("c_custkey", F.aes_encrypt("c_name", key, F.lit("GCM")).alias("s"))
    return sealed.select("c_custkey", F.try_aes_decrypt("s", key, F.lit("GCM")).cast("string").alias("opened"))


@query("c6_manifest_digest", "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def c6(spark, sf):
    """Canonical bytes in a fixed order, then a digest."""
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x.o_orderkey.cast("string"), x.o_orderstatus)), "\n")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(text, 256).alias("digest"))
