"""Extraction from literal documents, and from documents and pages of the test data."""

from pyspark.sql import functions as F

from formweave.functions import extract as X
from formweave.functions import labels as L
from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query

_LICENCE = "ANSI 636\nDLDCSDOE\nDACJANE\nDBB01151985\nDBA12312030\nDAK123456789\nDAQD123"
_DOCS = Rows("docs", "doc_id bigint,text string", [(1, "Surname: Rao\nGiven Name: Asha\nSurname: Other\nColour: red"), (2, "DOB: 1/2/1990\r\nAddress: 1 Main St: Apt 2"), (3, "nothing here"), (4, "Family-Name: Lee\nexpires: 2030"), (5, "Given Names\nANNA MARIA\nSurname\nERIKSSON"), (6, ""), (7, "City: Springfield State: IL Zip: 62704\nLast name: Lee\nSex - F"), (8, "Full Name: Ann  Mary Lou Poe\nPlace of birth date: 1/2/1990\ncellphone: 555"), (9, "Country   France\nTown: Nice\nno label - here")]).over(doc_id="c_custkey * 100 + doc_id", text="CASE WHEN c_custkey % 2 = 1 THEN text || chr(10) || 'Surname: ' || c_name ELSE text END")
_MRZ = Rows("docs", "doc_id bigint,text string", [(1, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"), (2, "no zone"), (3, "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"), (4, "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"), (5, "JOHN DOE\n123 MAPLE STREET\nSPRINGFIELD IL 62704"), (6, "B<UTOERIKSSON<<ANNA<MARIA\n898902361UTO7408122F1204159")]).over(doc_id="c_custkey * 100 + doc_id")
_CODES = Rows("docs", "doc_id bigint,text string", [(1, _LICENCE), (2, "DCGCAN\nDCSROY\nDBB19850115\nDAG 12 Elm St "), (3, "DAASMITH,JANE,ANN\nDBB03031975\nDBC2"), (4, "DCSDOE,\nDAK627040000\nDBC1\nDBA1231"), (5, None)]).over(doc_id="c_custkey * 100 + doc_id", text="CASE WHEN c_custkey % 2 = 1 THEN text || chr(10) || 'DAJ' || c_nationkey ELSE text END")
_RULES = "a(alias, whole, ord, key) AS (VALUES " + ", ".join(f"('{a}', {str(w).lower()}, {i}, '{k}')" for a, w, i, k in L.label_rules(L.LABELS)) + ")"
_ONE_WORD = "|".join(x for x in L.PACKED if not x.endswith(" name"))
_PACKED_SQL = rf"""l AS (SELECT doc_id, unnest(r) AS raw, generate_subscripts(r, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS r FROM docs)),
b AS (SELECT doc_id, pos, string_split(regexp_replace(regexp_replace(raw, '(?i)\s+((?:{_ONE_WORD})\s*[:\-]\s)', chr(10) || '\1', 'g'), '(?i)\s+((?:first|middle|last)\nname\s*[:\-]\s)', chr(10) || '\1', 'g'), chr(10)) AS r FROM l),
g AS (SELECT doc_id, pos * 1000 + generate_subscripts(r, 1) AS pos, trim(unnest(r)) AS line FROM b),
m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '{L.SEPARATED}') THEN [regexp_extract(line, '{L.SEPARATED}', 1), regexp_extract(line, '{L.SEPARATED}', 2)] ELSE [regexp_extract(line, '{L.SPACED}', 1), regexp_extract(line, '{L.SPACED}', 2)] END AS p FROM g),
w AS (SELECT doc_id, pos, trim(p[2]) AS value, trim(regexp_replace(regexp_replace(lower(p[1]), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM m WHERE trim(p[2]) <> ''),
k AS (SELECT doc_id, pos, value, arg_min(key, ord) AS key FROM w JOIN a ON label = alias OR (NOT whole AND ends_with(label, ' ' || alias)) GROUP BY doc_id, pos, value),
n AS (SELECT *, regexp_split_to_array(value, '\s+') AS p FROM k),
v AS (SELECT doc_id, pos, key, value FROM n WHERE key <> 'full' UNION ALL SELECT doc_id, pos, 'first_name', p[1] FROM n WHERE key = 'full' UNION ALL SELECT doc_id, pos, 'middle_name', array_to_string(p[2:len(p) - 1], ' ') FROM n WHERE key = 'full' AND len(p) > 2 UNION ALL SELECT doc_id, pos, 'last_name', p[len(p)] FROM n WHERE key = 'full' AND len(p) > 1)"""
_LINES = "l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS pos FROM docs)"


@query("x1_label_values", f"WITH {_DOCS.cte}, {_RULES}, {_PACKED_SQL} SELECT doc_id, key, arg_min(value, pos) AS value FROM v GROUP BY 1, 2")
def x1(spark, sf):
    return L.label_values(_DOCS.frame(spark, sf))


@query("x1_labels_in_documents", f"WITH docs AS (SELECT doc_id, text FROM documents), {_RULES}, {_PACKED_SQL} SELECT doc_id, key, arg_min(value, pos) AS value FROM v GROUP BY 1, 2")
def x1_in_documents(spark, sf):
    return L.label_values(table(spark, sf, "documents").select("doc_id", "text"))


@query("x2_desktop_values")
def x2(spark, sf):
    return L.desktop_values(_DOCS.frame(spark, sf).unionByName(_MRZ.frame(spark, sf).withColumn("doc_id", F.col("doc_id") + 100)))


@query("x1_document_labels", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '^[^:]{2,40}:\\s*\\S') GROUP BY doc_id")
def x1_documents(spark, sf):
    return X.lines(table(spark, sf, "documents")).where(F.col("line").rlike(r"^[^:]{2,40}:\s*\S")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("w5_next_line", f"WITH {_DOCS.cte}, {_LINES}, n AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS value FROM l WHERE line <> '') SELECT doc_id, arg_min(value, pos) AS value FROM n WHERE lower(line) = 'surname' AND value IS NOT NULL GROUP BY 1")
def w5(spark, sf):
    return X.next_line_values(_DOCS.frame(spark, sf), "surname")


@query("w3_first_write_wins", "WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS pos, unnest(string_split(text, ' ')) AS word FROM documents), k AS (SELECT doc_id, lower(left(word, 1)) AS key, arg_min(word, pos) AS value FROM w WHERE word <> '' GROUP BY 1, 2) SELECT doc_id, key, value FROM k")
def w3(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    return words.groupBy("doc_id", F.lower(F.left("word", F.lit(1))).alias("key")).agg(F.min_by("word", "pos").alias("value"))


@query("x3_email", r"SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email FROM documents")
def x3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.email(F.col("text")).alias("email"))


_CARD = Rows("docs", "doc_id bigint,text string", [(1, "card 4111 1111 1111 1111 exp 12/30"), (2, "card 4111 1111 1111 1112"), (3, "4111-1111-1111-1112 then 5500000000000004"), (4, "none")]).over(doc_id="c_custkey * 100 + doc_id", text="CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || ' ' || text ELSE text END")


@query("x4_card", f"WITH {_CARD.cte} SELECT doc_id, CASE doc_id % 100 WHEN 1 THEN '4111 1111 1111 1111' WHEN 3 THEN '5500 0000 0000 0004' END AS card FROM docs")
def x4(spark, sf):
    return _CARD.frame(spark, sf).select("doc_id", X.card_number(F.col("text")).alias("card"))


@query("x4_cards_in_documents")
def x4_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.card_number(F.col("text")).alias("card")).where("card IS NOT NULL")


_PHONES = Rows("docs", "doc_id bigint,text string", [(1, "Call (212) 555-0101 now"), (2, "2125550101"), (3, "+1 212-555-0101"), (4, "12-34"), (5, "x 1.212.555.0101 y 212 555 0102")]).over(doc_id="c_custkey * 100 + doc_id", text="CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || ' ' || text ELSE text END")


@query("x5_phone", f"WITH {_PHONES.cte} SELECT doc_id, CASE doc_id % 100 WHEN 1 THEN '(212) 555-0101' WHEN 3 THEN '+1 212-555-0101' WHEN 5 THEN '1.212.555.0101' END AS phone FROM docs")
def x5(spark, sf):
    return _PHONES.frame(spark, sf).select("doc_id", X.phone(F.col("text")).alias("phone"))


_NUMBERS = Rows("numbers", "id bigint,n string", [(1, "2125550101"), (2, "A1234567"), (3, "12345-6789"), (4, "D123-456-789"), (5, "987654")]).over(id="c_custkey * 100 + id", n="CASE WHEN c_custkey % 3 = 1 THEN n || (c_custkey % 10) ELSE n END")


@query("x6_number_routing", f"WITH {_NUMBERS.cte} SELECT id, CASE WHEN regexp_matches(n, '^[0-9]{{5}}-[0-9]{{4}}$') THEN NULL WHEN regexp_matches(n, '^[0-9]{{10}}$') THEN 'phone' WHEN regexp_matches(n, '^[A-Z][0-9]{{7,8}}$') THEN 'passport' WHEN regexp_matches(n, '^[A-Z][0-9-]{{6,}}$') THEN 'license' ELSE 'id' END AS kind FROM numbers")
def x6(spark, sf):
    n = F.col("n")
    kind = F.when(n.rlike("^[0-9]{5}-[0-9]{4}$"), None).when(n.rlike("^[0-9]{10}$"), "phone").when(n.rlike("^[A-Z][0-9]{7,8}$"), "passport").when(n.rlike("^[A-Z][0-9-]{6,}$"), "license").otherwise("id")
    return _NUMBERS.frame(spark, sf).select("id", kind.alias("kind"))


@query("x7_mrz")
def x7(spark, sf):
    return L.mrz(_MRZ.frame(spark, sf))


_ELEMENTS = "e(ord, code, key) AS (VALUES " + ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(L.AAMVA)) + ")"
_AAMVA_SQL = r"""p AS (SELECT doc_id, ord, code, key, trim(regexp_extract(text, '(?:^|[\n\r])(?:DL|ID)?' || code || '([^\n\r]*)', 1)) AS v FROM docs, e),
c AS (SELECT doc_id, bool_or(code = 'DCG' AND contains(upper(v), 'CAN')) AS can, bool_or(key IN ('last_name', 'first_name') AND v <> '') AS named FROM p GROUP BY 1),
d AS (SELECT doc_id, string_split(trim(regexp_extract(text, '(?:^|[\n\r])(?:DL|ID)?DAA([^\n\r]*)', 1)), ',') AS a FROM docs),
q AS (SELECT doc_id, ord, key, can, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits, regexp_replace(v, '\s', '', 'g') AS z FROM p JOIN c USING (doc_id)),
r AS (SELECT doc_id, ord, key, CASE WHEN contains(key, 'date') THEN CASE WHEN length(digits) <> 8 THEN '' WHEN can THEN digits[5:6] || '/' || digits[7:8] || '/' || digits[1:4] ELSE digits[1:2] || '/' || digits[3:4] || '/' || digits[5:8] END
  WHEN key = 'zip' THEN CASE WHEN NOT regexp_matches(z, '^[0-9]{9}$') THEN z WHEN z[6:9] = '0000' THEN z[1:5] ELSE z[1:5] || '-' || z[6:9] END
  WHEN key = 'gender' THEN CASE v WHEN '1' THEN 'M' WHEN '2' THEN 'F' END ELSE trim(regexp_replace(v, ',+$', '')) END AS value FROM q
  UNION ALL SELECT doc_id, 90, n.key, trim(n.value) FROM d JOIN c USING (doc_id), unnest([{'key': 'last_name', 'value': a[1]}, {'key': 'first_name', 'value': a[2]}, {'key': 'middle_name', 'value': array_to_string(a[3:], ' ')}]) u(n) WHERE NOT named)"""


@query("x8_aamva", f"WITH {_CODES.cte}, {_ELEMENTS}, " + _AAMVA_SQL + " SELECT doc_id, key, arg_min(value, ord) AS value FROM r WHERE value <> '' GROUP BY 1, 2")
def x8(spark, sf):
    return L.aamva(_CODES.frame(spark, sf))


@query("x10_country_codes", "SELECT n_nationkey, upper(left(n_name, 3)) AS code, n_name AS country FROM nation")
def x10(spark, sf):
    n = table(spark, sf, "nation")
    codes = n.select("n_nationkey", F.upper(F.left("n_name", F.lit(3))).alias("code"))
    return codes.join(F.broadcast(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"))), F.col("k") == F.col("n_nationkey")).select("n_nationkey", "code", "country")


_SANITY = Rows("found", "doc_id bigint,key string,value string", [(1, "dob", "01/02/1850"), (2, "dob", "01/02/1990"), (3, "id", "12345"), (4, "id", "A12345"), (5, "name", "x")]).over(doc_id="c_custkey * 100 + doc_id", value="CASE WHEN c_custkey % 3 = 1 THEN c_nationkey || value ELSE value END")


@query("x11_sanity", f"WITH {_SANITY.cte} SELECT doc_id, key, value FROM found WHERE NOT (key = 'dob' AND coalesce(try_cast(right(value, 4) AS INT) NOT BETWEEN 1900 AND 2026, true)) AND NOT (key = 'id' AND regexp_matches(value, '^[0-9]{{5}}$'))")
def x11(spark, sf):
    year = F.right("value", F.lit(4)).try_cast("int")
    bad = ((F.col("key") == "dob") & ~F.coalesce(year.between(1900, 2026), F.lit(False))) | ((F.col("key") == "id") & F.col("value").rlike("^[0-9]{5}$"))
    return _SANITY.frame(spark, sf).where(~bad)


@query("x12_page_links", r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title, generate_subscripts(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2), 1) - 1 AS pos FROM pages), n AS (SELECT page_id, trim(title) AS title, 'https://site.example' || url AS url, pos FROM m)
SELECT page_id, pos::INT AS pos, url, replace(title, '&amp;', '&') AS title FROM n WHERE pos < 10 AND title <> ''""")
def x12_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", 'href="/', 'href="https://site.example/').alias("html"))
    return X.search_results(pages)


_RESULT = Rows("results", "page_id bigint,html string", [(1, '<a class="r" href="//d.example/l/?uddg=https%3A%2F%2Fa.example%2Fq%3D1&amp;r=2"><b>A &amp; B</b></a><a href="ftp://x">no</a><a href="https://c.example"> </a><a href="https://d.example">D</a>')]).over(page_id="c_custkey * 100 + page_id")


@query("x12_search_results", "SELECT c_custkey * 100 + 1 AS page_id, v.* FROM customer CROSS JOIN (VALUES (0, 'https://a.example/q=1', 'A & B'), (3, 'https://d.example', 'D')) v(pos, url, title)")
def x12(spark, sf):
    return X.search_results(_RESULT.frame(spark, sf))


_WORDS = Rows("words", "line bigint,x bigint,word string", [(1, 1, "1"), (1, 2, "First"), (1, 3, "name"), (1, 4, "2"), (1, 5, "Last"), (2, 1, "Address"), (2, 2, "12a"), (2, 3, "City")]).over(line="c_custkey * 100 + line", word="CASE WHEN c_custkey % 3 = 1 AND x = 3 THEN c_mktsegment ELSE word END")


@query("x13_segments", f"WITH {_WORDS.cte}, m AS (SELECT *, sum(CASE WHEN regexp_matches(word, '^([a-h]|[0-9]{{1,2}}[a-z]?)$') THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY x)::BIGINT AS seg FROM words) SELECT line, seg, string_agg(word, ' ' ORDER BY x) AS text FROM m GROUP BY 1, 2")
def x13(spark, sf):
    return X.segments(_WORDS.frame(spark, sf))


@query("x14_ocr_lines", "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line FROM conversations) SELECT conv_id, count(*) AS n_lines, max(length(line)) AS longest FROM l GROUP BY conv_id")
def x14(spark, sf):
    """Nested blocks flattened to lines; conversations, turns and sentences stand for blocks."""
    each = table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", r"\. ")).alias("line"))
    return each.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


_LABELS = Rows("lab", "line bigint,s string,x double,y double,w double,h double", [(1, "Name:", 100.0, 50.0, 80.0, 20.0), (2, "A long sentence that is not a label at all and goes on.", 0.0, 90.0, 300.0, 20.0), (3, "City", 100.0, 130.0, 60.0, 18.0), (4, "name", 10.0, 150.0, 50.0, 18.0)]).over(line="c_custkey * 100 + line", s="CASE WHEN c_custkey % 3 = 1 THEN c_nationkey || s ELSE s END")


@query("x15_detected_fields", f"WITH {_LABELS.cte}, f AS (SELECT line, lower(rtrim(s, ':')) AS key, (x + w + 8) * 0.5 AS fx, 400 - (y + h) * 0.5 AS fy FROM lab WHERE length(s) <= 40 AND NOT s LIKE '%.'), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS k FROM f) SELECT key, fx, fy FROM r WHERE k = 1")
def x15(spark, sf):
    """A label line gives a box to its right, pixels to points (half) and y turned; the first of a key."""
    rows = _LABELS.frame(spark, sf).where("length(s) <= 40 AND NOT s LIKE '%.'").select("line", F.lower(F.rtrim(F.col("s"), F.lit(":"))).alias("key"), ((F.col("x") + F.col("w") + 8) * 0.5).alias("fx"), (400 - (F.col("y") + F.col("h")) * 0.5).alias("fy"))
    return rows.groupBy("key").agg(F.min_by(F.struct("fx", "fy"), "line").alias("r")).select("key", "r.*")


_EDU = Rows("edu", "id bigint,v string", [(1, "B.Tech, Computer Science, IIT, 2010, GPA 8.1"), (2, "MS, Physics, State University, 2012"), (3, "PhD, 2016, MIT Institute"), (4, "High School, 2006")]).over(id="c_custkey * 100 + id", v="CASE WHEN c_custkey % 3 = 1 THEN v || ', ' || c_mktsegment ELSE v END")


@query("f31_education", f"WITH {_EDU.cte}, t AS (SELECT id, trim(unnest(string_split(v, ','))) AS t, generate_subscripts(string_split(v, ','), 1) AS pos FROM edu), k AS (SELECT id, pos, t, CASE WHEN regexp_matches(t, '(?i)gpa') THEN 'gpa' WHEN regexp_matches(t, '^(19|20)[0-9]{{2}}$') THEN 'year' WHEN regexp_matches(t, '(?i)universit|institut|college|^(iit|mit)\\b') THEN 'school' WHEN regexp_matches(t, '(?i)^(b|m)\\.?(tech|sc?|a)\\b|ph\\.?d|high school') THEN 'degree' ELSE 'field' END AS kind FROM t) SELECT id, kind, arg_min(t, pos) AS value FROM k GROUP BY 1, 2")
def f31(spark, sf):
    t = F.col("t")
    kind = F.when(t.rlike("(?i)gpa"), "gpa").when(t.rlike("^(19|20)[0-9]{2}$"), "year").when(t.rlike(r"(?i)universit|institut|college|^(iit|mit)\b"), "school").when(t.rlike(r"(?i)^(b|m)\.?(tech|sc?|a)\b|ph\.?d|high school"), "degree").otherwise("field")
    tokens = _EDU.frame(spark, sf).select("id", F.posexplode(F.split("v", ",")).alias("pos", "t")).withColumn("t", F.trim("t"))
    return tokens.groupBy("id", kind.alias("kind")).agg(F.min_by("t", "pos").alias("value"))


@query("w7_education_rank", f"WITH {_EDU.cte} SELECT id, row_number() OVER (PARTITION BY id % 2 ORDER BY CASE WHEN v LIKE 'PhD%' THEN 5 WHEN v LIKE 'M%' THEN 4 WHEN v LIKE 'B%' THEN 3 WHEN v LIKE 'High%' THEN 1 ELSE 2 END DESC, id) AS place FROM edu")
def w7(spark, sf):
    """The highest level of each person first; the two persons of the fixture are told apart by id."""
    from pyspark.sql import Window

    level = F.when(F.col("v").rlike("^PhD"), 5).when(F.col("v").rlike("^M"), 4).when(F.col("v").rlike("^B"), 3).when(F.col("v").rlike("^High"), 1).otherwise(2)
    return _EDU.frame(spark, sf).select("id", F.row_number().over(Window.partitionBy(F.col("id") % 2).orderBy(F.desc(level), "id")).cast("long").alias("place"))


@query("w6_date_ranks", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS z FROM orders) SELECT o_custkey, max(o_orderkey) FILTER (WHERE a = 1) AS oldest, max(o_orderkey) FILTER (WHERE z = 1) AS latest FROM r GROUP BY 1")
def w6(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oldest"), F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("latest"))


@query("o6_longest_prefix", "WITH p(p) AS (VALUES ('Customer'), ('Customer#0000000'), ('Customer#00000001')), m AS (SELECT c_custkey, p, row_number() OVER (PARTITION BY c_custkey ORDER BY length(p) DESC) AS k FROM customer JOIN p ON starts_with(c_name, p)) SELECT c_custkey, p AS prefix FROM m WHERE k = 1")
def o6(spark, sf):
    prefixes = spark.createDataFrame([("Customer",), ("Customer#0000000",), ("Customer#00000001",)], "p string")
    met = table(spark, sf, "customer").select("c_custkey", "c_name").join(F.broadcast(prefixes), F.expr("startswith(c_name, p)"))
    return met.groupBy("c_custkey").agg(F.max_by("p", F.length("p")).alias("prefix"))
