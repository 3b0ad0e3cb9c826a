"""Laws and edge cases of the record operators."""

import pytest
from pyspark.sql import functions as F

from formweave.functions import text as X
from formweave.functions import tokens
from formweave.functions.translit import to_script
from formweave.operators import reconcile as rec
from formweave.operators import store
from formweave.sources import office
from formweave.streaming import machines


def vault(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, updated_at long")


def test_sync_converges_and_loses_nothing(spark):
    a, b = vault(spark, [("x", "1", 5), ("y", "2", 5), ("z", "3", 1)]), vault(spark, [("x", "9", 5), ("y", "8", 4), ("w", "7", 2)])
    plan = rec.reconcile(a, b, ["key"])
    left = store.upsert(a, plan.where("direction = 'to_local'").drop("direction"), ["key"], "updated_at")
    right = store.upsert(b, plan.where("direction = 'to_remote'").drop("direction"), ["key"], "updated_at")
    got, want = (dict((r.key, r.value) for r in df.collect()) for df in (left, right))
    assert got == want == {"x": "9", "y": "2", "z": "3", "w": "7"}
    assert rec.reconcile(left, right, ["key"]).count() == 0


def test_migration_needs_an_unlocked_vault(spark):
    a, b = vault(spark, [("x", "1", 5)]), vault(spark, [("x", "", 5)])
    assert rec.migration_plan(a, b, ["key"]).count() == 1
    assert rec.migration_plan(a, b, ["key"], unlocked=False).count() == 0
    assert rec.migration_plan(a, b, ["key"], migrated=True).count() == 0


@pytest.mark.parametrize("label", ["पूरा नाम", "全名 (Full Name)", "Date of expiry", "Número", "الاسم الكامل"])
def test_keys_are_idempotent_in_every_script(spark, label):
    key = lambda x: spark.range(1).select(X.key_of_label(F.lit(x)).alias("k")).first().k
    assert key(label) and key(key(label)) == key(label)


def test_empty_vault(spark):
    points = spark.createDataFrame([], "profile_id long, key string, value string")
    assert store.vault(points).count() == store.field_counts(points).count() == 0


def test_transliteration():
    assert to_script("Anna 12", "hi") == "अन्न १२"
    assert to_script("Shchuka Jy", "ru") == "щука йы" and to_script("dhaal", "ar") == "ذاال" and to_script("dii uu", "hi") == "दी ऊ"
    assert to_script("Anna", "zh") == "Anna" and to_script(None, "ru") is None


def test_frames_refuse_what_is_cut():
    raw = office.frame(b"ab") + office.frame(b"")
    assert office.frames(raw) == [b"ab", b""]
    for bad in (raw[:-1], raw[:3], b"\xff\xff\xff\xff"):
        with pytest.raises(ValueError):
            office.frames(bad)


def test_an_invalid_event_changes_nothing():
    state = {"state": "Draft", "parties": frozenset("ab"), "consented": frozenset(), "signed": frozenset()}
    assert machines.step(state, "sign", "a") == (state, False)
    done = state | {"state": "FullyExecuted"}
    assert machines.step(done, "withdraw", None) == (done, False)


def test_stream_and_batch_agree(spark, tmp_path):
    from formweave.plans.state import _EVENTS, _PARTIES

    batch = {tuple(r) for r in machines.fold_transactions(_EVENTS.specimens(spark), _PARTIES.specimens(spark)).collect()}
    members = _PARTIES.specimens(spark).groupBy("txn_id").agg(F.array_join(F.array_sort(F.collect_set("party")), ",").alias("parties"))
    rows = _EVENTS.specimens(spark).join(members, "txn_id").select("txn_id", "seq", "action", F.coalesce("party", F.lit("")).alias("party"), "parties")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = machines.stream_transactions(stream, 2).writeStream.outputMode("update").format("memory").queryName("txn_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("txn_states").collect()} == batch


def test_zones_of_all_forms(spark):
    """The specimens of the standard: passport, card of three lines, card of two, and one whose first letter was misread."""
    from formweave.functions.labels import mrz
    from formweave.plans.extraction import _MRZ

    got = {r.doc_id: r for r in mrz(_MRZ.specimens(spark)).collect()}
    assert {k: r.form for k, r in got.items()} == {1: "passport", 3: "card", 4: "small card", 6: "lenient"}
    assert {(r.last_name, r.first_name, r.middle_name, r.date_of_birth, r.gender, r.passport_expiry_date) for r in got.values()} == {("ERIKSSON", "ANNA", "MARIA", "08/12/1974", "F", "04/15/2012")}
    assert [got[k].passport_no or got[k].id_number for k in (1, 3, 4, 6)] == ["L898902C3", "D23145890", "D23145890", "898902361"]


def test_desktop_values(spark):
    from formweave.functions.labels import desktop_values

    rows = [(1, "SURNAME ERIKSEN\nGiven Names Anna Maria\nID No: 12\nDOB"), (2, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10\nSurname: Other\nCity: Nice"), (3, None), (4, "")]
    got = {(r.doc_id, r.key): r.value for r in desktop_values(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"last_name": "ERIKSEN", "first_name": "Anna", "id_no": "12"}
    assert (got[2, "last_name"], got[2, "city"], got[2, "passport_no"]) == ("ERIKSSON", "Nice", "L898902C3") and max(k[0] for k in got) == 2


def test_initials_stay_one_letter(spark):
    """As in SQL: Java's capital of some letters is several."""
    want = {"ßtraße": "ẞ", "1 é": "É", "ŉ": "ŉ", "ﬁ": "ﬁ", "ᾳ": "ᾼ", "ǆ": "Ǆ", "12": "", None: None}
    rows = spark.createDataFrame([(x,) for x in want], "t string")
    assert {r.t: r.i for r in rows.select("t", X.initial(F.col("t")).alias("i")).collect()} == want


def test_equal_secrets_are_derived_once(spark, monkeypatch):
    """Repeated pairs of password and salt share one derivation; every row has its key."""
    import hashlib

    seen, derive = spark.sparkContext.accumulator(0), tokens.pbkdf2

    def counted(p, s, n):
        tick = F.udf(lambda x: (seen.add(1), x)[1], "string")
        return derive(tick(p), s, n)

    monkeypatch.setattr(tokens, "pbkdf2", counted)
    rows = spark.range(600).selectExpr("id", "'p' || id % 3 AS p", "'s' || id % 2 AS s")
    got = {r.id: r.key for r in tokens.derived_keys(rows, 2).collect()}
    assert got == {i: hashlib.pbkdf2_hmac("sha256", f"p{i % 3}".encode(), f"s{i % 2}".encode(), 2, 32).hex() for i in range(600)}
    assert seen.value == 6
