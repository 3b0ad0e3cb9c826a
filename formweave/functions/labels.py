"""Labelled values of document lines, machine-readable zones and licence barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.dates import full_year

#: Label words of document fields; the first group that fits names the key, "full" is a whole name.
LABELS = (
    (("first name", "given name", "forename", "given"), "first_name"),
    (("middle name", "middle"), "middle_name"),
    (("last name", "surname", "family name"), "last_name"),
    (("full name", "name"), "full"),
    (("salutation", "title", "prefix"), "salutation"),
    (("gender", "sex"), "gender"),
    (("email", "e-mail", "e mail", "email address", "mail"), "email_address"),
    (("mobile", "cell", "cell phone", "mobile number", "cellphone"), "cell_phone"),
    (("home phone", "landline", "residence phone"), "home_phone"),
    (("phone", "telephone", "tel", "contact", "contact number", "phone number"), "cell_phone"),
    (("date of birth", "dob", "d.o.b", "birth date", "born", "birthday"), "date_of_birth"),
    (("address line 1", "address 1", "address", "addr", "street", "residential address"), "address_1"),
    (("address line 2", "address 2", "apartment", "apt", "suite", "landmark"), "address_2"),
    (("city", "town"), "city"),
    (("state", "province", "region"), "state"),
    (("zip", "zip code", "postal code", "pincode", "pin code", "postcode", "pin"), "zip"),
    (("country",), "country"),
    (("nationality", "citizenship"), "nationality"),
    (("passport", "passport no", "passport number"), "passport_no"),
)
#: What the desktop knows besides: plural given names, and fields of cards.
DESKTOP = (
    (("given names", "forenames"), "full"),
    (("license no", "licence no", "license number", "licence number", "dl no", "dl number", "license", "licence"), "license_no"),
    (("id no", "id number", "identification no", "identity no"), "id_no"),
    (("expires", "expiry", "expiration", "expiry date", "valid until", "valid thru", "exp"), "expiry_date"),
    (("issued", "issue date", "date of issue"), "issue_date"),
)
#: Labels before which a line that packs several pairs is split.
PACKED = ("name", "first name", "middle name", "last name", "dob", "date of birth", "address", "city", "town", "state", "province", "zip", "zip code", "postal code", "country", "nationality", "sex", "gender", "phone", "mobile", "email")
#: 'Label: value' or 'Label - value', else two or more spaces between them.
SEPARATED, SPACED = r"^(.{2,30}?)\s*[:\-–—]\s*(.+)$", r"^([A-Za-z][A-Za-z .]{1,28}?)\s{2,}(.+)$"


def label_rules(groups: tuple) -> list[tuple[str, bool, int, str]]:
    """(alias, whole, ord, key): `whole` aliases are those without their spaces, which only a whole label can be."""
    return [(a.replace(" ", "") if whole else a, whole, i, key) for i, (aliases, key) in enumerate(groups) for a in aliases for whole in (False, True)]


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), r"\s+", " "))


def _segments(docs: DataFrame, packed: bool) -> DataFrame:
    """(doc_id, pos, line): non-blank lines, with `packed` cut before the known labels that they hold."""
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("row", "line"))
    pieces = F.split("line", r"(?i)\s+(?=(?:" + "|".join(PACKED) + r")\s*[:\-]\s)") if packed else F.array("line")
    each = each.select("doc_id", "row", F.posexplode(pieces).alias("part", "line"))
    return each.select("doc_id", F.struct("row", "part").alias("pos"), F.trim("line").alias("line")).where("line <> ''")


def _resolved(pairs: DataFrame, groups: tuple = LABELS) -> DataFrame:
    """(doc_id, pos, line, key, value): pairs (doc_id, pos, line, label, value) whose label is an alias or ends in one. The endings
    of a label meet the aliases by equality; of several the first group counts."""
    rules = pairs.sparkSession.createDataFrame(label_rules(groups), "alias string, whole boolean, ord int, key string").distinct()
    words = F.split("label", " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    each = pairs.withColumn("alias", F.explode(ends)).join(F.broadcast(rules), "alias").where("NOT whole OR alias = label")
    return each.groupBy("doc_id", "pos").agg(F.min_by(F.struct("line", "key", "value"), "ord").alias("r")).select("doc_id", "pos", "r.*")


def _named(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, key, value): whole names as first, middle and last name."""
    p = F.split("value", r"\s+")
    part = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    n = F.size(p)
    parts = F.array(
        part("first_name", F.get(p, F.lit(0))),
        part("middle_name", F.when(n > 2, F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), " "))),
        part("last_name", F.when(n > 1, F.element_at(p, -1))),
    )
    each = F.when(F.col("key") == "full", parts).otherwise(F.array(F.struct("key", "value")))
    return rows.select("doc_id", "pos", F.explode(each).alias("r")).select("doc_id", "pos", "r.*").where("value <> ''")


def _pairs(segments: DataFrame) -> DataFrame:
    a = F.col("line").rlike(SEPARATED)
    found = lambda k: F.when(a, F.regexp_extract("line", SEPARATED, k)).otherwise(F.regexp_extract("line", SPACED, k))
    return segments.select("doc_id", "pos", "line", _normal(found(1)).alias("label"), F.trim(found(2)).alias("value")).where("value <> ''")


def label_values(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value): the labelled values of lines; the first of a key stays. Lines are split before known labels, also
    within a line's first label, so that 'Last name: Lee' counts as 'name: Lee', a whole name of one word."""
    rows = _named(_resolved(_pairs(_segments(docs, True))))
    return rows.groupBy("doc_id", "key").agg(F.min_by("value", "pos").alias("value"))


def mrz(docs: DataFrame) -> DataFrame:
    """Fields of the machine-readable zones of travel documents, by position: passports (two lines of 44), cards (three of 30,
    two of 36), else what two signatures recover anywhere. Check digits are not verified; documents without a zone
    give no row."""
    upper = F.split(F.upper("text"), r"\r?\n")
    zone = F.filter(F.transform(upper, lambda x: F.regexp_replace(x, "[^A-Z0-9<]", "")), lambda x: F.length(x).between(28, 46) & F.contains(x, F.lit("<")))
    loose = F.transform(F.split(F.upper("text"), "\n"), lambda x: F.regexp_replace(x, "[^A-Z0-9<]", ""))
    one = docs.select("doc_id", zone.alias("z"), loose.alias("j"), F.col("text").rlike("(?i)passport|passeport|pasaporte").alias("travel"))

    def first(lines: Column, test) -> Column:
        return F.get(F.filter(lines, test), F.lit(0))

    plain_name = lambda x: F.contains(x, F.lit("<<")) & ~x.rlike("[0-9]")
    sized = lambda lo, hi: F.filter("z", lambda x: F.length(x).between(lo, hi))
    numbers = "^[A-Z0-9<]{9}%s[A-Z<]{3}[0-9]{6}"
    one = one.withColumn("p1", first(F.col("z"), lambda x: (F.length(x) >= 40) & x.rlike("^P[A-Z<]") & F.contains(x, F.lit("<<"))))
    one = one.withColumn("p2", first(F.col("z"), lambda x: (F.length(x) >= 40) & (x != F.col("p1")) & x.rlike(numbers % "[0-9]?")))
    one = one.withColumns({"t1": sized(28, 32), "t2": sized(34, 38)})
    one = one.withColumns(
        {
            "name1": F.coalesce(first(F.col("t1"), plain_name), F.get("t1", F.lit(2))),
            "card1": F.coalesce(first(F.col("t1"), lambda x: x.rlike("^[A-Z<]{2}[A-Z]{3}[0-9]")), F.get("t1", F.lit(0))),
            "data1": first(F.col("t1"), lambda x: x.rlike("^[0-9]{7}[MF<]")),
            "name2": F.coalesce(first(F.col("t2"), plain_name), F.get("t2", F.lit(0))),
        }
    )
    one = one.withColumn("data2", F.coalesce(first(F.col("t2"), lambda x: (x != F.col("name2")) & x.rlike(numbers % "[0-9]")), F.get("t2", F.lit(1))))
    named, dated = "<([A-Z]{3})([A-Z]{2,})<<([A-Z][A-Z<]+)", "([0-9]{6,9})[<A-Z0-9]{0,2}([A-Z]{3})([0-9]{6})[0-9]?([MFX<])([0-9]{6})"
    one = one.withColumns({"jn": first(F.col("j"), lambda x: x.rlike(named)), "jd": first(F.col("j"), lambda x: x.rlike(dated))})
    cut = lambda c, at, n: F.substring(c, at, n)

    def fields(form: str, name: Column, number: Column, nation: Column, birth: Column, sex: Column, expiry: Column) -> Column:
        return F.struct(F.lit(form).alias("form"), name.alias("name"), number.alias("number"), nation.alias("nation"), birth.alias("birth"), sex.alias("sex"), expiry.alias("expiry"))

    def two_lines(form: str, name: str, data: str) -> Column:
        return fields(form, F.substring(name, 6, 50), cut(data, 1, 9), cut(data, 11, 3), cut(data, 14, 6), cut(data, 21, 1), cut(data, 22, 6))

    jd = lambda k: F.regexp_extract("jd", dated, k)
    card = fields("card", F.col("name1"), cut("card1", 6, 9), cut("data1", 16, 3), cut("data1", 1, 6), cut("data1", 8, 1), cut("data1", 9, 6))
    either = fields("lenient", F.concat(F.regexp_extract("jn", named, 2), F.lit("<<"), F.regexp_extract("jn", named, 3)), jd(1), F.coalesce(jd(2), F.regexp_extract("jn", named, 1)), jd(3), jd(4), jd(5))
    chosen = F.when(F.col("p1").isNotNull() & F.col("p2").isNotNull(), two_lines("passport", "p1", "p2"))
    chosen = chosen.when(~F.col("travel") & (F.size("t1") >= 3), card).when(~F.col("travel") & (F.size("t2") >= 2), two_lines("small card", "name2", "data2"))
    chosen = chosen.when(F.col("jn").isNotNull() | F.col("jd").isNotNull(), either)
    found = one.select("doc_id", chosen.alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")
    part = lambda k: F.trim(F.translate(F.regexp_replace(F.get(F.split("name", "<<"), F.lit(k)), "[<CLKX]{3,}[A-Z]*$", ""), "<", " "))
    given = F.filter(F.split(part(1), r"\s+"), lambda w: F.length(w) > 1)
    known = lambda c: F.nullif(c, F.lit(""))

    def date(c: str, pivot: int) -> Column:
        year = full_year(F.substring(c, 1, 2), pivot).cast("string")
        return F.when(F.col(c).rlike("^[0-9]{6}$"), F.concat_ws("/", F.substring(c, 3, 2), F.substring(c, 5, 2), year))

    number, nation = known(F.translate("number", "<", "")), F.translate("nation", "<", "")
    passport = F.col("form").isin("passport", "lenient")
    return found.select(
        "doc_id",
        "form",
        known(part(0)).alias("last_name"),
        F.get(given, F.lit(0)).alias("first_name"),
        known(F.array_join(F.slice(given, 2, 20), " ")).alias("middle_name"),
        F.when(passport, number).alias("passport_no"),
        F.when(~passport, number).alias("id_number"),
        F.when(nation.rlike("^[A-Z]{3}$"), nation).alias("nationality"),
        date("birth", 30).alias("date_of_birth"),
        F.when(F.col("sex").isin("M", "F"), F.col("sex")).alias("gender"),
        date("expiry", 69).alias("passport_expiry_date"),
    )


def desktop_values(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value): machine-readable zone first, then labelled lines, then lines that begin with a known label and one
    space, the longest label first; the first of a key stays."""
    zone = mrz(docs).drop("form")
    keys = zone.columns[1:]
    held = zone.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys))).alias("r"))
    at = lambda stage, row: F.struct(F.lit(stage).alias("stage"), row.alias("row")).alias("at")
    held = held.select("doc_id", at(0, F.lit(0)), "r.*").where("value IS NOT NULL")
    lines = _segments(docs, False)
    matched = _resolved(_pairs(lines), LABELS + DESKTOP)
    open_lines = lines.join(matched.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").withColumn("label", _normal(F.col("line")))
    aliases = [(a, i, key) for i, (group, key) in enumerate(LABELS + DESKTOP) for a in group]
    rules = docs.sparkSession.createDataFrame(aliases, "alias string, ord int, key string")
    words = F.split("label", " ")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(4))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    begun = open_lines.withColumn("alias", F.explode(starts)).join(F.broadcast(rules), "alias")
    begun = begun.groupBy("doc_id", "pos").agg(F.max_by(F.struct("line", "label", "alias", "key"), F.struct(F.length("alias"), -F.col("ord"))).alias("r")).select("doc_id", "pos", "r.*")
    rest = F.expr("substring(line, instr(lower(line), alias) + length(alias))")
    begun = begun.where("alias <> label").select("doc_id", "pos", "key", F.trim(F.regexp_replace(rest, r"^[\s:.\-–—]+", "")).alias("value"))
    rows = _named(matched.select("doc_id", "pos", "key", "value").unionByName(begun))
    rows = held.unionByName(rows.select("doc_id", at(1, F.col("pos.row")), "key", "value"))
    return rows.groupBy("doc_id", "key").agg(F.min_by("value", "at").alias("value"))


#: Element codes of licence barcodes; of several for one key the first that is held counts.
AAMVA = (
    ("DCS", "last_name"),
    ("DAB", "last_name"),
    ("DAC", "first_name"),
    ("DCT", "first_name"),
    ("DAD", "middle_name"),
    ("DAG", "address_1"),
    ("DAH", "address_2"),
    ("DAI", "city"),
    ("DAJ", "state"),
    ("DAK", "zip"),
    ("DCG", "country"),
    ("DAQ", "license_number"),
    ("DBC", "gender"),
    ("DBB", "date_of_birth"),
    ("DBA", "dl_expiry_date"),
    ("DBD", "dl_issue_date"),
)


def aamva(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) of licence barcodes; dates of the US are MMDDYYYY, of Canada YYYYMMDD. Older ones hold the whole name
    in one element, which counts where neither first nor last name is held."""
    raw = lambda code: F.trim(F.regexp_extract("text", rf"(?:^|[\n\r])(?:DL|ID)?{code}([^\n\r]*)", 1))
    pairs = [(key, raw(code)) for code, key in AAMVA]
    no_name = F.concat(*(raw(c) for c in ("DCS", "DAB", "DAC", "DCT"))) == ""
    packed = F.split(raw("DAA"), ",")
    rest = F.array_join(F.slice(packed, 3, 20), " ")
    pairs += [(k, F.when(no_name, F.trim(v))) for k, v in (("last_name", F.get(packed, F.lit(0))), ("first_name", F.get(packed, F.lit(1))), ("middle_name", rest))]
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(pairs)))
    rows = docs.select("doc_id", F.upper(raw("DCG")).contains("CAN").alias("can"), F.explode(each).alias("p")).select("doc_id", "can", "p.*")
    digits, zipped = F.regexp_replace("value", "[^0-9]", ""), F.regexp_replace("value", r"\s", "")
    us, ca = ("^(..)(..)(....)$", "$1/$2/$3"), ("^(....)(..)(..)$", "$2/$3/$1")
    dated = F.when(F.length(digits) == 8, F.when(F.col("can"), F.regexp_replace(digits, *map(F.lit, ca))).otherwise(F.regexp_replace(digits, *map(F.lit, us))))
    post = F.when(zipped.rlike("^[0-9]{5}0000$"), F.left(zipped, F.lit(5))).otherwise(F.regexp_replace(zipped, "^([0-9]{5})([0-9]{4})$", "$1-$2"))
    value = F.when(F.col("key").contains("date"), dated).when(F.col("key") == "zip", post).when(F.col("key") == "gender", F.when(F.col("value") == "1", "M").when(F.col("value") == "2", "F")).otherwise(F.trim(F.regexp_replace("value", ",+$", "")))
    rows = rows.select("doc_id", "key", "ord", value.alias("value")).where("value <> ''")
    return rows.groupBy("doc_id", "key").agg(F.min_by("value", "ord").alias("value"))
