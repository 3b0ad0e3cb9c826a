"""Unlabelled cards: stages, noise, and texts that are none."""

from formweave.functions.cards import card_values

TEXTS = [
    "DRIVER LICENSE CLASS C\n1 MYSORE\n2 ANNA MARIA LONGNAME\n8 42 OAK ST\nWAKE FOREST, NC27587\nDOB 01/15/85\nEXP: 12/31/2030 ISS 06/01/22",
    "SMITH\nJANE ANN\n12 HIGH ROAD\nBOSTON, MA 02101\n1/2/1990 3/4/2020 5/6/2031",
    "noise 1 ROBERTS x\n- 2 PETER JOHN q",
    "JOHN Q PUBLIC",
    "OAK STREET\nINS, TX 1",
    None,
    "",
    "just words in a line",
]


def test_cards(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in card_values(docs, 2026).collect()}
    assert got[0] == ("MYSORE", "ANNA", "MARIA LONGNAME", "42 OAK ST", "WAKE FOREST", "NC", "27587", "01/15/85", "12/31/2030", "06/01/22")
    assert got[1] == ("SMITH", "JANE", "ANN", "12 HIGH ROAD", "BOSTON", "MA", "02101", "1/2/1990", "5/6/2031", "3/4/2020")
    assert got[2][:3] == ("ROBERTS", "PETER", "JOHN")
    assert got[3] == (None,) * 10  # a line with a single letter is no candidate
    assert all(x is None for k in (5, 6, 7) for x in got[k])
    assert got[4][4] is None and got[4][0] is None


def test_numbers_of_streets_are_no_codes(spark):
    """Five digits before a street are not the code, and longer ones are not cut."""
    card = "SMITH\nANNA MARIA\n8 {} OAK ROAD\nSPRINGFIELD, IL 60007\nDOB 01/15/1985"
    docs = spark.createDataFrame([(n, card.format(n)) for n in (9, 99, 9_999, 10_000, 99_999, 100_000, 1_234_567)] + [(1, "12345 OAK ST"), (2, "only 12345")], "doc_id long, text string")
    got = {r.doc_id: (r.street, r.zip) for r in card_values(docs, 2026).collect()}
    assert got == {n: (f"{n} OAK ROAD" if n > 9 else None, "60007") for n in (9, 99, 9_999, 10_000, 99_999, 100_000, 1_234_567)} | {1: ("12345 OAK ST", None), 2: (None, "12345")}
