"""Laws of the form resolver: the order of its ways, and claims."""

from pyspark.sql import functions as F

from formweave.operators import resolver as R
from formweave.plans.resolver import KINDS, PHRASES

VAULT = [
    (1, "full_name", "Li Wei Chen"), (2, "address_line_1", "1 High St"), (3, "city", "Town"), (4, "dateOfBirth", "06/30/1990"),
    (5, "linkedin_profile", "in/li"), (6, "氏名", "陳"), (7, "生年月日", "1990"), (8, "Employee ID", "E7"), (9, "country", "Utopia"),
    (10, "address", ""), (11, "mobile", "555"), (12, "name in chinese", "李"),
]


#: Labels of a form, or (label, name, max_length), with the values and sources that the stored keys above give.
CASES = [
    (["Full Name", "Surname", "First name"], [("Li Wei Chen", "own"), ("Chen", "atom"), ("Li", "atom")]),
    (["Maiden name", "Preferred name"], [(None, "alternate"), (None, "alternate")]),
    (["Chinese name", "Arabic name"], [("李", "script"), (None, "script")]),
    (["氏名", "生年月日", "電話番号"], [("陳", "own"), ("1990", "own"), (None, "none")]),
    (["Employee ID", ("", "employee_id", None)], [("E7", "own"), ("E7", "own")]),
    (["HKID Checking Digit", ("Last", "HKIDCheckingDigit[0]", 1)], [(None, "office"), (None, "office")]),
    (["Please share a link to your LinkedIn profile", "Comments"], [("in/li", "prompt"), (None, "prompt")]),
    (["Mailing address"], [("1 High St, Town, Utopia", "composite")]),
    (["Mailing address", "Address"], [(None, "qualified"), ("1 High St, Town, Utopia", "composite")]),
    (["Address", "City", "Country"], [("1 High St", "composite"), ("Town", "own"), ("Utopia", "own")]),
    (["Apartment", "Phone extension"], [(None, "second_line"), (None, "atom")]),
    (["Age", ("", "date_of_birth", None), "Date signed", "Phone", "Nationality"], [("33", "atom"), ("06/30/1990", "atom"), ("06/29/2024", "atom"), ("555", "atom"), ("Utopia", "atom")]),
    ([("First name", None, 1), "Surname initial", ("Full Name", None, 1)], [("L", "atom"), ("C", "atom"), ("L", "own")]),
    ([None, "", "Text 17"], [(None, "none")] * 3),
]


def resolve(spark, forms, vault=VAULT, **more):
    """For each form its (value, source) by position; all forms in one run."""
    rows = [(1, k, i, *(x if isinstance(x, tuple) else (x, None, None))) for k, labels in enumerate(forms) for i, x in enumerate(labels)]
    fields = spark.createDataFrame(rows, "owner long, form long, pos long, label string, name string, max_length int")
    held = spark.createDataFrame([(1, *x) for x in vault], "owner long, ord long, key string, value string")
    got = {(r.form, r.pos): (r.value, r.source) for r in R.resolve_forms(fields, held, PHRASES.frame(spark), F.lit("2024-06-29").cast("date"), **more).collect()}
    return [[got[k, i] for i in range(len(labels))] for k, labels in enumerate(forms)]


def test_ways(spark):
    assert resolve(spark, [labels for labels, _ in CASES]) == [want for _, want in CASES]


def test_composite_leaves_out_what_others_claim(spark):
    parts = [(1, "given", "Ann"), (2, "middle", "Bea"), (3, "family", "Cox")]
    got = resolve(spark, [["Full Name"], ["Full Name", "Surname"], ["Given and middle names", "Given name", "Middle name"]], parts)
    assert got == [[("Ann Bea Cox", "composite")], [("Ann Bea", "composite"), ("Cox", "atom")], [("Ann", "composite"), ("Ann", "atom"), ("Bea", "atom")]]


def test_education_goes_by_level_and_never_to_a_concept(spark):
    taught = spark.createDataFrame([(1, "master", 4, "degree", "MS"), (1, "master", 4, "school", "Big"), (1, "bachelor", 3, "school", "Small")], "owner long, level string, rank int, kind string, value string")
    got = resolve(spark, [["University", "Bachelor university", "Graduation year", "Doctorate university"]], education=taught, kinds=KINDS.frame(spark))
    assert got == [[("Big", "education"), ("Small", "education"), (None, "education"), ("Big", "education")]]


def test_owners_do_not_mix_and_empty_tables(spark):
    fields = spark.createDataFrame([(1, 1, 1, "Surname", None, None), (2, 1, 1, "Surname", None, None), (None, 1, 1, "Surname", None, None)], "owner long, form long, pos long, label string, name string, max_length int")
    held = spark.createDataFrame([(1, 1, "surname", "A"), (2, 1, "surname", "B"), (None, 1, "surname", "C")], "owner long, ord long, key string, value string")
    run = lambda f, v: {r.owner: r.value for r in R.resolve_forms(f, v, PHRASES.frame(spark), F.current_date()).collect()}
    assert run(fields, held) == {1: "A", 2: "B", None: None}
    assert run(fields, held.limit(0)) == {1: None, 2: None, None: None}
    assert run(fields.limit(0), held) == {}
