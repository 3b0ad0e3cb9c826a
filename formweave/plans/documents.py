"""Documents as sources: OOXML, HTML forms, frames, result pages; benchmark scores."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query
from formweave.sources import forms as H
from formweave.sources import office as O
from formweave.sources.messages import FramedSource, framed_messages
from formweave.sources.shared import new_folder


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_docx(title: str, rows: list[list[str]]) -> bytes:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows)
    return _zip({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>{escape(title)}</w:t></w:r></w:p><w:tbl>{body}</w:tbl></w:body></w:document>"})


def make_xlsx(sheet: str, shared: list[str], cells: list[tuple[str, str, str]]) -> bytes:
    """Cells (place, kind, value): s of shared strings by number, i inline, n a number; the sheet's part has a name of its own."""
    kinds = {"s": lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>', "i": lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>', "n": lambda r, v: f'<c r="{r}"><v>{v}</v></c>'}
    body = "".join(kinds[k](r, v) for r, k, v in cells)
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r9"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="styles.xml"/><Relationship Id="r9" Target="worksheets/s7.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {_S}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in shared)}</sst>",
            "xl/worksheets/s7.xml": f"<worksheet {_S}><sheetData><row>{body}</row></sheetData></worksheet>",
        }
    )


def _packed(df, make):
    """(path, content) as the binaryFile source gives them: a file for each row, made in tasks."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([make(r) for r in b.itertuples(index=False)], columns=["path", "content"])

    return df.mapInPandas(run, "path string, content binary")


def books(spark, sf):
    """A spreadsheet for each part: labels with a value right of them, or without one."""

    def make(p):
        cells = [("A1", "s", "0"), ("B1", "s", "1"), ("A2", "i", "Size"), ("A3", "s", "2"), ("AA3", "n", str(p.p_partkey))]
        return f"{p.p_partkey}.xlsx", make_xlsx(p.p_brand, ["Name", p.p_name, p.p_type], cells + ([("B2", "n", str(p.p_size))] if p.p_size % 2 else []))

    return _packed(table(spark, sf, "part"), make)


def letters(spark, sf):
    """A text document for each customer: a title and a table with empty cells to fill."""

    def make(c):
        return f"{c.c_custkey}.docx", make_docx(c.c_name, [["Name", ""], ["Segment", c.c_mktsegment], ["Zip", "", "Phone", "" if c.c_nationkey % 2 else "555"]])

    return _packed(table(spark, sf, "customer"), make)


_LETTERS_SQL = """w AS (SELECT c_custkey || '.docx' AS doc, unnest([{'tbl': -1, 'row': 0, 'col': 0, 'text': c_name}, {'tbl': 0, 'row': 0, 'col': 0, 'text': 'Name'}, {'tbl': 0, 'row': 0, 'col': 1, 'text': ''},
{'tbl': 0, 'row': 1, 'col': 0, 'text': 'Segment'}, {'tbl': 0, 'row': 1, 'col': 1, 'text': c_mktsegment}, {'tbl': 0, 'row': 2, 'col': 0, 'text': 'Zip'}, {'tbl': 0, 'row': 2, 'col': 1, 'text': ''}, {'tbl': 0, 'row': 2, 'col': 2, 'text': 'Phone'},
{'tbl': 0, 'row': 2, 'col': 3, 'text': CASE WHEN c_nationkey % 2 = 0 THEN '555' ELSE '' END}], recursive := true) FROM customer)"""
_BOOKS_SQL = """x AS (SELECT p_partkey || '.xlsx' AS doc, p_brand AS sheet, unnest([{'row': 1, 'col': 0, 'text': 'Name'}, {'row': 1, 'col': 1, 'text': p_name}, {'row': 2, 'col': 0, 'text': 'Size'}, {'row': 2, 'col': 1, 'text': CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END},
{'row': 3, 'col': 0, 'text': p_type}, {'row': 3, 'col': 26, 'text': p_partkey::VARCHAR}], recursive := true) FROM part), y AS (SELECT * FROM x WHERE text <> '')"""


@query("s10_docx_cells", f"WITH {_LETTERS_SQL} SELECT doc, tbl, \"row\", col, text FROM w")
def s10(spark, sf):
    return O.document_cells(letters(spark, sf))


@query("j24_docx_next_empty", f"WITH {_LETTERS_SQL}, n AS (SELECT *, lead(text) OVER r AS nt, lead(col) OVER r AS nc FROM w WINDOW r AS (PARTITION BY doc, tbl, \"row\" ORDER BY col)) SELECT doc, tbl, \"row\", text AS label, nc AS col FROM n WHERE trim(text) <> '' AND nt = ''")
def j24(spark, sf):
    return O.next_empty_cell(O.document_cells(letters(spark, sf)))


@query("s11_xlsx_cells", f"WITH {_BOOKS_SQL} SELECT doc, sheet, \"row\", col, text FROM y")
def s11(spark, sf):
    return O.workbook_cells(books(spark, sf))


@query("j23_xlsx_neighbour", f"WITH {_BOOKS_SQL} SELECT a.doc, a.sheet, lower(a.text) AS label, CASE WHEN b.doc IS NULL THEN a.\"row\" ELSE a.\"row\" + 1 END AS \"row\", CASE WHEN b.doc IS NULL THEN a.col + 1 ELSE a.col END AS col FROM y a LEFT JOIN y b ON b.doc = a.doc AND b.\"row\" = a.\"row\" AND b.col = a.col + 1 WHERE lower(a.text) IN ('name', 'size')")
def j23(spark, sf):
    """Where the values of two labels go, in every book."""
    labels = spark.createDataFrame([("name",), ("size",)], "label string")
    return O.neighbour_cell(O.workbook_cells(books(spark, sf)), labels)


#: A form for each customer: captions for and around controls, named elements, lists, sets, a chooser, and a search box of the page.
_FORM = (
    "'<nav><input aria-label=\"Search\" value=\"shoes\"></nav><form><label for=\"a\">First name *</label><input id=\"a\" name=\"fn\" value=\"' || c_name || '\"><label>City <input name=\"city\"></label>'",
    "'<input type=\"hidden\" name=\"x\" value=\"1\"><b id=\"q1\">Current <i>employer</i></b><input required aria-labelledby=\"q1\" id=\"input-24\" value=\"' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '\">'",
    "'<input type=\"email\" placeholder=\"E-mail\" aria-required=\"true\"><select aria-label=\"Country\"><option value=\"\">Select...<option value=\"N' || c_nationkey || '\"' || CASE WHEN c_nationkey % 2 = 0 THEN ' selected' ELSE '' END || '>Nation</select>'",
    "'<fieldset><legend>Are you over 18?</legend><label><input type=radio name=age value=1' || CASE WHEN c_custkey % 3 = 0 THEN ' checked' ELSE '' END || '> Yes</label><label><input type=radio name=age value=0' || CASE WHEN c_custkey % 3 = 1 THEN ' checked' ELSE '' END || '> No</label></fieldset>'",
    "'<div role=\"group\" aria-label=\"Languages\"><label><input type=checkbox name=\"lang[]\" checked>English</label><label><input type=checkbox name=\"lang[]\"' || CASE WHEN c_custkey % 2 = 0 THEN ' checked' ELSE '' END || '>German</label></div>'",
    "'<label for=\"t\">Phone</label><input type=\"tel\" id=\"t\" value=\"+9' || (c_nationkey % 10) || '\"><b id=\"st\">State</b><div role=\"combobox\" aria-labelledby=\"st\"><span class=\"x-single-value\">Goa</span><input></div><input type=\"password\" name=\"pw\" value=\"secret\"></form>'",
)


def form_pages(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(" || ".join(_FORM)).alias("html"))


_ROWS = """SELECT c_custkey, unnest([{'pos': 0, 'kind': 'text', 'label': 'Search', 'question': '', 'value': 'shoes', 'chosen': true, 'required': false, 'chrome': true}, {'pos': 1, 'kind': 'text', 'label': 'First name *', 'question': '', 'value': c_name, 'chosen': true, 'required': true, 'chrome': false},
{'pos': 2, 'kind': 'text', 'label': 'City', 'question': '', 'value': '', 'chosen': false, 'required': false, 'chrome': false}, {'pos': 3, 'kind': 'text', 'label': 'Current employer', 'question': '', 'value': CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, 'chosen': c_custkey % 2 = 0, 'required': true, 'chrome': false},
{'pos': 4, 'kind': 'email', 'label': 'E-mail', 'question': '', 'value': '', 'chosen': false, 'required': true, 'chrome': false}, {'pos': 5, 'kind': 'select', 'label': 'Country', 'question': '', 'value': CASE WHEN c_nationkey % 2 = 0 THEN 'N' || c_nationkey ELSE '' END, 'chosen': c_nationkey % 2 = 0, 'required': false, 'chrome': false},
{'pos': 6, 'kind': 'radio', 'label': 'Yes', 'question': 'Are you over 18?', 'value': 'Yes', 'chosen': c_custkey % 3 = 0, 'required': false, 'chrome': false}, {'pos': 7, 'kind': 'radio', 'label': 'No', 'question': 'Are you over 18?', 'value': 'No', 'chosen': c_custkey % 3 = 1, 'required': false, 'chrome': false},
{'pos': 8, 'kind': 'checkbox', 'label': 'English', 'question': 'Languages', 'value': 'English', 'chosen': true, 'required': false, 'chrome': false}, {'pos': 9, 'kind': 'checkbox', 'label': 'German', 'question': 'Languages', 'value': 'German', 'chosen': c_custkey % 2 = 0, 'required': false, 'chrome': false},
{'pos': 10, 'kind': 'tel', 'label': 'Phone', 'question': '', 'value': '+9' || (c_nationkey % 10), 'chosen': false, 'required': false, 'chrome': false}, {'pos': 11, 'kind': 'chooser', 'label': 'State', 'question': '', 'value': 'Goa', 'chosen': true, 'required': false, 'chrome': false},
{'pos': 12, 'kind': 'password', 'label': 'pw', 'question': '', 'value': 'secret', 'chosen': true, 'required': false, 'chrome': false}], recursive := true) FROM customer"""


@query("s13_html_fields", _ROWS)
def s13(spark, sf):
    return H.form_controls(form_pages(spark, sf), "c_custkey", "html").drop("name")


@query("x17_typed_values", f"WITH r AS ({_ROWS}), g AS (SELECT *, CASE WHEN kind IN ('radio', 'checkbox') THEN question ELSE label END AS asked FROM r WHERE NOT chrome AND kind <> 'password' AND (chosen OR kind = 'tel')) SELECT c_custkey, trim(asked, ' *') AS label, string_agg(value, ', ' ORDER BY pos) AS value FROM g GROUP BY c_custkey, asked")
def x17(spark, sf):
    found = H.typed_values(H.form_controls(form_pages(spark, sf), "c_custkey", "html"), "c_custkey")
    return found.select("c_custkey", F.rtrim(F.col("label"), F.lit(" *")).alias("label"), "value")


@query("x18_a9_fill_assessment", f"WITH r AS ({_ROWS}), g AS (SELECT c_custkey, bool_or(chosen) AS f, bool_or(CASE kind WHEN 'radio' THEN true WHEN 'checkbox' THEN false ELSE required END) AS r FROM r GROUP BY c_custkey, CASE WHEN question <> '' THEN question ELSE pos::VARCHAR END) SELECT c_custkey, count(*) AS total, count(*) FILTER (WHERE f) AS filled, count(*) FILTER (WHERE r) AS required, count(*) FILTER (WHERE r AND f) AS required_filled, count(*) FILTER (WHERE r AND NOT f) AS missed FROM g GROUP BY c_custkey")
def x18(spark, sf):
    """Controls once a set; `missed` are the required ones that are empty."""
    return H.assess(H.form_controls(form_pages(spark, sf), "c_custkey", "html"), "c_custkey")


@query("s14_frames", "SELECT c_custkey, c_name || '|' || c_mktsegment AS payload FROM customer")
def s14(spark, sf):
    """Messages of whole `customer` written to framed files and read back, with the key that each begins with."""
    spark.dataSource.register(FramedSource)
    folder = new_folder(spark, "frames")
    payload = F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").cast("binary")
    table(spark, sf, "customer").select(payload.alias("payload")).write.format("framed").mode("append").save(folder)
    text = F.col("payload").cast("string")
    found = spark.read.format("framed").load(folder)
    return found.select(F.substring_index(text, "|", 1).cast("long").alias("c_custkey"), F.expr("substring(cast(payload AS string), instr(cast(payload AS string), '|') + 1)").alias("payload"))


@query("s14_frames_of_files", "SELECT c_custkey::VARCHAR AS doc, generate_series AS pos, CASE generate_series WHEN 0 THEN c_name ELSE c_mktsegment END AS payload FROM customer, generate_series(0, 1)")
def s14_files(spark, sf):
    """Two messages in the content of a file for each customer."""
    @F.pandas_udf("binary")
    def packed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([O.frame(x.encode()) + O.frame(y.encode()) for x, y in zip(a, b, strict=True)])

    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), packed("c_name", "c_mktsegment").alias("content"))
    return framed_messages(files).withColumn("payload", F.col("payload").cast("string"))


@query("s9_catalog_endpoints", "SELECT '/v1/catalog/' || p_partkey AS route, p_name AS body FROM part UNION ALL SELECT '/v1/catalog', count(*)::VARCHAR FROM part UNION ALL SELECT '/health', 'ok'")
def s9(spark, sf):
    """What each public route answers: an entry by its id, the size of the list, health."""
    part = table(spark, sf, "part")
    entries = part.select(F.concat(F.lit("/v1/catalog/"), "p_partkey").alias("route"), F.col("p_name").alias("body"))
    size = part.agg(F.count(F.lit(1)).cast("string").alias("body")).select(F.lit("/v1/catalog").alias("route"), "body")
    return entries.unionByName(size).unionByName(spark.createDataFrame([("/health", "ok")], "route string, body string"))


@query("p1_summary", "SELECT p_partkey AS id, p_name AS name, p_brand AS tag FROM part")
def p1(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("tag"))


@query("p2_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 9) ORDER BY p_partkey LIMIT 1")
def p2(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    wanted = part.where("p_partkey = 9").select("p_name")
    return part.join(wanted, "p_name", "left_semi").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


@query("s7_bounded_fetch", "SELECT page_id FROM pages WHERE strlen(html) <= 4000")
def s7(spark, sf):
    return table(spark, sf, "pages").where(F.octet_length("html") <= 4000).select("page_id")


_TRUTH = Rows("truth", "form_id string,ord bigint,kind string,pattern string,expect string", [("f1", 1, "id", "name", "Ann"), ("f1", 2, "id_re", "^dob", "01/02/1990"), ("f1", 3, "tip_re", "city", None), ("f1", 4, "id", "absent", "x"), ("f2", 1, "id_re", "zip", "12345"), ("f2", 2, "id", "blank", None)]).over(form_id="form_id || '-' || c_custkey")
_FIELDS = Rows("fields", "form_id string,id string,tip string,value string", [("f1", "name", "", "ann"), ("f1", "dob1", "", "1990"), ("f1", "c", "city of birth", "Rome"), ("f2", "zip", "", None), ("f2", "blank", "", None), ("f2", "zip4", "", "12345")]).over(form_id="form_id || '-' || c_custkey", value="CASE WHEN c_custkey % 3 = 1 THEN value || ' ' || c_nationkey ELSE value END")
_JOINED = f"WITH {_TRUTH.cte}, {_FIELDS.cte}, m AS (SELECT truth.form_id, ord, kind, pattern, expect, id, value FROM truth JOIN fields ON truth.form_id = fields.form_id AND CASE kind WHEN 'id' THEN id = pattern WHEN 'id_re' THEN regexp_matches(id, pattern) ELSE regexp_matches(tip, pattern) END)"


def located(spark, sf):
    on = F.expr("CASE kind WHEN 'id' THEN id = pattern WHEN 'id_re' THEN rlike(id, pattern) ELSE rlike(tip, pattern) END")
    f = _FIELDS.frame(spark, sf)
    t = _TRUTH.frame(spark, sf)
    return t.join(f, (t.form_id == f.form_id) & on).select(t.form_id, "ord", "kind", "pattern", "expect", "id", "value")


@query("j22_locators", f"{_JOINED} SELECT form_id, ord, id FROM m")
def j22(spark, sf):
    return located(spark, sf).select("form_id", "ord", "id")


_SCORES_SQL = f"""{_JOINED}, s AS (SELECT form_id, count(*) FILTER (WHERE expect IS NOT NULL AND lower(value) = lower(expect)) AS tp, count(*) FILTER (WHERE expect IS NOT NULL AND value IS NOT NULL AND lower(value) <> lower(expect)) AS wrong, count(*) FILTER (WHERE expect IS NOT NULL AND value IS NULL) AS miss, count(*) FILTER (WHERE expect IS NULL AND value IS NULL) AS kept, count(*) FILTER (WHERE expect IS NULL) AS blanks FROM m GROUP BY 1)
SELECT form_id, tp, wrong, miss, round(tp / nullif(tp + wrong, 0), 6) AS precision_, round(tp / nullif(tp + wrong + miss, 0), 6) AS recall, round(kept / nullif(blanks, 0), 6) AS blank_ok FROM s"""


@query("a5_accuracy", _SCORES_SQL)
def a5(spark, sf):
    """True, wrong and missed fills, and blanks kept; a rate without a denominator is null."""
    want, got = F.col("expect").isNotNull(), F.col("value").isNotNull()
    same = F.coalesce(F.lower("value") == F.lower("expect"), F.lit(False))
    s = located(spark, sf).groupBy("form_id").agg(F.count_if(want & same).alias("tp"), F.count_if(want & got & ~same).alias("wrong"), F.count_if(want & ~got).alias("miss"), F.count_if(~want & ~got).alias("kept"), F.count_if(~want).alias("blanks"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.select("form_id", "tp", "wrong", "miss", rate(F.col("tp"), F.col("tp") + F.col("wrong")).alias("precision_"), rate(F.col("tp"), F.col("tp") + F.col("wrong") + F.col("miss")).alias("recall"), rate(F.col("kept"), F.col("blanks")).alias("blank_ok"))


@query("a5_labels_score", "WITH p AS (SELECT l.doc_id, quality = 0 AS bad, regexp_matches(text, '[#*$%&]{3}| \\| |!! ') AS said FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT count(*) FILTER (WHERE bad AND said) AS tp, count(*) FILTER (WHERE NOT bad AND said) AS wrong, count(*) FILTER (WHERE bad AND NOT said) AS miss FROM p")
def a5_labels(spark, sf):
    p = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("quality") == 0).alias("bad"), F.col("text").rlike(r"[#*$%&]{3}| \| |!! ").alias("said"))
    return p.agg(F.count_if(F.col("bad") & F.col("said")).alias("tp"), F.count_if(~F.col("bad") & F.col("said")).alias("wrong"), F.count_if(F.col("bad") & ~F.col("said")).alias("miss"))


@query("a6_coverage", f"WITH {_FIELDS.cte} SELECT count(DISTINCT value) AS n FROM fields")
def a6(spark, sf):
    return _FIELDS.frame(spark, sf).agg(F.countDistinct("value").alias("n"))


@query("a7_macro_average", f"SELECT round(avg(precision_), 6) AS precision_, round(avg(recall), 6) AS recall, count(recall) AS forms FROM ({_SCORES_SQL})")
def a7(spark, sf):
    """Means over the forms that have a rate."""
    return a5(spark, sf).agg(F.round(F.avg("precision_"), 6).alias("precision_"), F.round(F.avg("recall"), 6).alias("recall"), F.count("recall").alias("forms"))


@query("a8_form_kinds", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) FILTER (WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') / count(*) > 0.3 THEN 'tooltip' ELSE 'plain' END AS kind FROM orders GROUP BY 1")
def a8(spark, sf):
    """Fields with a tooltip over 30 % make a form of the tooltip kind; high priorities stand for tooltips."""
    tip = F.count_if(F.col("o_orderpriority").rlike("^[12]")) / F.count(F.lit(1))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.when(tip > 0.3, "tooltip").otherwise("plain").alias("kind"))


@query("a15_distinct_labels", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def a15(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("a18_loop_totals", "SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'view') AS filled, count(*) FILTER (WHERE event_type = 'purchase') AS saved, arg_max(event_type, event_id) AS stop FROM events GROUP BY 1")
def a18(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("event_type") == "view").alias("filled"), F.count_if(F.col("event_type") == "purchase").alias("saved"), F.max_by("event_type", "event_id").alias("stop"))


@query("a19_checkbox_groups", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS chosen FROM orders GROUP BY 1")
def a19(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("o_orderstatus"))), ",").alias("chosen"))


@query("a20_multi_values", "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS answer FROM lineitem GROUP BY 1")
def a20(spark, sf):
    """The flags of an order's lines, of which there are few, as one answer."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flags"))))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: p.flags), "; ").alias("answer"))
