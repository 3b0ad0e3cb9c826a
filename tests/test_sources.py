"""Framed files, spreadsheets as files, form controls, and the declared store."""

import pytest
from pyspark.sql import functions as F

from formweave.plans.documents import make_docx, make_xlsx
from formweave.sources import forms, messages, office
from formweave.sources.store import Store, sync_available


def payloads(df):
    return sorted(bytes(r.payload) for r in df.collect())


def test_framed_files(spark, tmp_path):
    spark.dataSource.register(messages.FramedSource)
    folder, some = str(tmp_path / "f"), [b"", b"a", b"\x00\xff" * 9, b"b" * 100_000]
    write = lambda rows: spark.createDataFrame([(x,) for x in rows], "payload binary").repartition(2).write.format("framed").mode("append").save(folder)
    write(some)
    read = spark.read.format("framed").load(folder)
    assert payloads(read) == sorted(some) and read.schema.names == ["file", "pos", "payload"]
    stream = lambda: spark.readStream.format("framed").load(folder).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    for more in ([], [b"later"]):
        if more:
            write(more)
        q = stream().start()
        q.processAllAvailable()
        q.stop()
        some = some + more
        assert payloads(spark.read.parquet(str(tmp_path / "o"))) == sorted(some)  # each file once, after a restart too
    files = spark.read.format("binaryFile").load(folder)
    assert payloads(messages.framed_messages(files)) == sorted(some)


@pytest.mark.parametrize("bad", [b"\x01\x00", b"\x05\x00\x00\x00abc", b"\xff\xff\xff\xff"])
def test_broken_frames(tmp_path, bad):
    (tmp_path / "x.frames").write_bytes(office.frame(b"fine") + bad)
    rows = messages.FramedReader(str(tmp_path)).read(messages.FilePartition(str(tmp_path), "x.frames"))
    assert next(rows)[2] == b"fine"
    with pytest.raises(ValueError):
        next(rows)


def test_office_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(make_xlsx("A & B", ["Name", "<Ann>"], [("A1", "s", "0"), ("B1", "s", "1"), ("ZZ9", "n", "7"), ("C2", "i", "")]))
    (tmp_path / "b.xlsx").write_bytes(make_xlsx("B", [], []))
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    cells = office.workbook_cells(files)
    assert sorted(map(tuple, cells.collect())) == [("a.xlsx", "A & B", 1, 0, "Name"), ("a.xlsx", "A & B", 1, 1, "<Ann>"), ("a.xlsx", "A & B", 9, 701, "7")]
    labels = spark.createDataFrame([("name",)], "label string")
    assert [tuple(r) for r in office.neighbour_cell(cells, labels).collect()] == [("a.xlsx", "A & B", "name", 2, 0)]
    assert office.workbook_cells(files.limit(0)).collect() == []
    assert office.docx_cells(make_docx("T", [["x", ""]])) == [(-1, 0, 0, "T"), (0, 0, 0, "x"), (0, 0, 1, "")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("<input disabled value=1><input type=hidden><input type=file>", []),
        ('<label for=a>City: <b>home</b></label><input id=a value=" Rome ">', [("text", "City: home", "", "Rome", True, False, False)]),
        ('<label>Pay <select><option>Select...<option selected>Card</select></label>', [("select", "Pay", "", "Card", True, False, False)]),
        ('<select aria-label="Gender Select ... Male"><option>x<option>y</select>', [("select", "Gender", "", "", False, False, False)]),
        ('<textarea placeholder="Why *">so\n it</textarea>', [("textarea", "Why *", "", "so it", True, True, False)]),
        ('<div class="x-template"><template shadowrootmode="open"><input name=inner value=1></template></div>', [("text", "inner", "", "1", True, False, False)]),
        ('<header><input name=q value=1></header>', [("text", "q", "", "1", True, False, True)]),
        ('<div class="react-select"><input><div class="react-select__single-value">EmailEmail</div></div>', [("chooser", "", "", "Email", True, False, False)]),
        ('<div role=combobox aria-label=State>Select One</div>', [("chooser", "State", "", "", False, False, False)]),
        ('<div><h3>Over 18?</h3><label><input type=radio name=r checked>Yes</label></div>', [("radio", "Yes", "Over 18?", "Yes", True, False, False)]),
    ],
)
def test_controls(html, want):
    assert [(k, label, q, v, c, r, ch) for _, k, _, label, q, v, c, r, ch in forms.controls(html)] == want


def test_store_migrates_by_adding(spark, tmp_path):
    folder = "file://" + str(tmp_path / "s")
    store = Store.open(spark, folder, "id long, v string, at long", ["id"], "at")
    assert store.read().collect() == []
    store.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long"))
    for _ in range(2):
        store = Store.open(spark, folder, "id long, v string, at long, tag string", ["id"], "at")
        assert store._latest()[0] == 2  # the second time changes nothing
    store.upsert(spark.createDataFrame([("t", 9, 2, "c")], "tag string, at long, id long, v string"))
    want = [(1, "a", 1, None), (2, "c", 9, "t")]
    assert sorted(map(tuple, store.read().collect())) == want
    store.compact()
    assert store.vacuum() == 2 and sorted(map(tuple, store.read().collect())) == want
    with pytest.raises(ValueError):
        Store.open(spark, folder, "id string", ["id"], "at")
    with pytest.raises(FileExistsError):
        store._commit(store._latest()[0], store._latest()[1])


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = lambda df: df.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    store = Store.open(spark, "file://" + str(tmp_path / "s"), rows(events).schema, ["user_id", "event_type"], "at")
    stream = rows(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = sync_available(stream, store, "q", str(tmp_path / "cp"))
    want = rows(events).groupBy("user_id", "event_type").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count()
    parts = store._latest()[1].parts
    assert len(parts) == 3 and not store.upsert(rows(events), "q", 2) and store._latest()[1].parts == parts
    sync_available(stream, store, "q", str(tmp_path / "cp2"))  # a lost checkpoint replays all batches
    assert store._latest()[1].parts == parts
