"""The run as a whole, and the steps that it is made of."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chorale.operators import announcements, grouping, identity, media, report
from chorale.plans import flows
from chorale.sources import config, exports, sinks
from chorale.streaming import ingest

SCHEMA = "conversation_id int, date timestamp_ntz, sender string, message string, media string, data_holder string, original_order long"
ONE, TWO = "a first text of some length", "an answer\nin two lines"
THREE = "an answer\nin two lines: with a colon"


def _minute(m):
    return datetime(2022, 5, 13, 16, m)


@pytest.fixture(scope="module")
def two_chats(spark):
    """Two exports of one conversation; the second calls people otherwise and has one message more."""
    rows = []
    for holder, first, second in (("h1", "ann", "bob"), ("h2", "A. Nn", "+31 6 1234")):
        said = [("", 'ann created group "X"' if holder == "h1" else 'A. Nn created group "X"'), (first, ONE), (second, TWO), (second, THREE)]
        said += [(second, "one more of the second")] if holder == "h2" else []
        rows += [(1, _minute(20 + k), s, m, "", holder, k) for k, (s, m) in enumerate(said)]
    return spark.createDataFrame(rows, SCHEMA)


CONTACTS = [("ann", "h1", "ann"), ("ann", "h2", "A. Nn"), ("bob", "h1", "bob"), ("bob", "h2", "+31 6 1234")]


@pytest.fixture(scope="module")
def contacts(spark):
    return spark.createDataFrame(CONTACTS, "canonical string, data_holder string, label string")


def _book(spark, rows=()):
    return spark.createDataFrame(list(rows), "number string, name string")


def test_merge_of_two_chats(spark, two_chats, contacts):
    start, end = F.expr("timestamp_ntz'2022-05-01 00:00:00'"), F.expr("timestamp_ntz'2022-06-01 00:00:00'")
    got = flows.reconcile(two_chats, contacts, _book(spark), start=start, end=end).orderBy("position").collect()
    assert [r["sender"] for r in got] == ["", "ann", "bob", "bob", "bob"]
    assert [r["sources"] for r in got] == ["h1,h2"] * 4 + ["h2"]
    assert got[0]["message"] == "ann heeft de groep 'X' aangemaakt" and [r["message"] for r in got[1:4]] == [ONE, TWO, THREE]
    assert not any(r["unknown_order"] for r in got)
    assert list(got[0].asDict()) == flows.MERGED


def test_windows_of_exports_and_of_the_conversation(spark, two_chats, contacts):
    chats = spark.createDataFrame([(1, "h1", _minute(20), _minute(23)), (1, "h2", None, None)], "conversation_id int, data_holder string, start timestamp_ntz, end timestamp_ntz")
    got = flows.reconcile(two_chats, contacts, _book(spark), chats=chats, start=F.lit(_minute(20)).cast("timestamp_ntz"), end=F.lit(_minute(23)).cast("timestamp_ntz")).orderBy("position").collect()
    assert [(r["sources"], r["date"].minute) for r in got] == [("h1,h2", 21), ("h1,h2", 22), ("h2", 23)]
    none = flows.reconcile(two_chats.limit(0), contacts, _book(spark))
    assert none.columns == flows.MERGED and none.count() == 0


def test_labels_meet_by_what_they_say(spark, two_chats):
    found, book = flows.resolve(two_chats)
    assert {(r["canonical"], r["data_holder"], r["label"]) for r in found.collect()} == {("A. Nn", "h1", "ann"), ("A. Nn", "h2", "A. Nn"), ("bob", "h1", "bob"), ("bob", "h2", "+31 6 1234")}
    assert [tuple(r) for r in book.collect()] == [(1, "+3161234", "bob")]
    got = flows.reconcile(two_chats, found, book).orderBy("position").collect()
    assert [r["sender"] for r in got] == ["", "A. Nn", "bob", "bob", "bob"] and got[0]["sources"] == "h1,h2"


def test_announced_names_meet_only_if_every_holder_has_it_once(spark):
    rows = [(1, _minute(1), "", "ann added bo", "", "h1", 0), (1, _minute(1), "", "A. added Bob B", "", "h2", 0), (1, _minute(2), "", "x left", "", "h1", 1), (1, _minute(2), "", "y left", "", "h1", 2)]
    groups = announcements.label_groups(announcements.extract(spark.createDataFrame(rows, SCHEMA)))
    by_group = {}
    for r in groups.collect():
        by_group.setdefault(r["group_id"], set()).add((r["data_holder"], r["label"]))
    assert sorted(map(sorted, by_group.values())) == [[("h1", "ann"), ("h2", "A.")], [("h1", "bo"), ("h2", "Bob B")]]


def test_chat_groups(spark, two_chats):
    files = two_chats.withColumn("file", F.col("data_holder")).withColumn("message", F.concat("message", F.lit(" and thirty characters more of it")))
    other = files.limit(1).withColumn("file", F.lit("alone"))
    deleted = files.withColumn("message", F.lit("This message was deleted")).withColumn("file", F.concat(F.lit("d"), "data_holder"))
    got = grouping.chat_groups(files.unionByName(other).unionByName(deleted))
    assert {tuple(r) for r in got.collect()} == {("h1", "h1"), ("h2", "h1"), ("alone", "alone"), ("dh1", "dh1"), ("dh2", "dh2")}


def test_names(spark):
    members = spark.createDataFrame([(1, "h", "Jan  Van Der Berg"), (1, "h", "+31612345678901234567890"), (2, "h", "Jan"), (3, "h", "c:/a/very/long/path.txt"), (3, "h", "Al")], "component int, data_holder string, label string")
    manual = spark.createDataFrame([("Jan", "Jan van der Berg")], "Name_from string, Name_to string")
    paths = spark.createDataFrame([("c:/a/very/long/path.txt",)], "path string")
    names = identity.canonical_names(members, manual=manual, paths=paths)
    assert {tuple(r) for r in names.collect()} == {(1, "Jan van der Berg"), (2, "Jan van der Berg"), (3, "Al")}
    assert identity.contacts(members, names).groupBy("canonical").count().where("canonical like 'Jan%'").first()["count"] == 3


def test_canonical_attachments(spark):
    rows = [(1, "d1/a.jpg", "m"), (1, "d2/a.jpg", "m"), (1, "d3/a.jpg", "m"), (1, "d1/b.jpg", "m"), (1, "gone.jpg", "m"), (1, "<Media weggelaten>", "m"), (1, "", "text"), (2, "d3/a.jpg", "m")]
    messages = spark.createDataFrame(rows, "conversation_id int, media string, message string")
    digests = spark.createDataFrame([("d1/a.jpg", "x"), ("d2/a.jpg", "x"), ("d3/a.jpg", "y"), ("d1/b.jpg", "z")], "path string, hash string")
    got = {(r["conversation_id"], r["media"], r["message"], r["media_to"], r["hash"]) for r in media.canonical_attachments(messages, digests).collect()}
    assert got == {
        (1, "d2/a.jpg", "<bijgevoegd: a_1.jpg>", "d2/a_1.jpg", "x"), (1, "d3/a.jpg", "<bijgevoegd: a_2.jpg>", "d3/a_2.jpg", "y"), (1, "d1/b.jpg", "<bijgevoegd: b.jpg>", "", "z"),
        (1, "gone.jpg", "<bijgevoegd: gone.jpg>", "", None), (1, "<Media weggelaten>", "<Media weggelaten>", "", None), (1, "", "text", "", None), (2, "d3/a.jpg", "<bijgevoegd: a.jpg>", "", "y"),
    }


def test_anonymised_frame(spark, two_chats):
    people = identity.participants(two_chats)
    assert {(r["participant"], r["pseudonym"]) for r in people.collect()} == {("h1", "Functionaris 1"), ("h2", "Functionaris 2"), ("ann", "Deelnemer 1"), ("A. Nn", "Deelnemer 2"), ("bob", "Deelnemer 3"), ("+31 6 1234", "Deelnemer 4")}
    shown = two_chats.withColumn("media", F.when(F.col("message") == ONE, F.concat("data_holder", F.lit("/x/photo.v1.jpg"))).when(F.col("message") == TWO, "E:\\\\other\\\\f.opus").otherwise(""))
    chats = spark.createDataFrame([(1, "h1/x/chat.txt", "h1")], "conversation_id int, file string, data_holder string")
    got = identity.anonymise(shown, people, chats)
    assert got.columns == shown.columns
    rows = {(r["data_holder"], r["original_order"]): r for r in got.collect()}
    assert rows["Functionaris 1", 0]["message"] == 'Deelnemer 1 created group "X"' and rows["Functionaris 1", 0]["sender"] == ""
    assert rows["Functionaris 1", 1]["media"].startswith("Functionaris 1/bijlage_") and rows["Functionaris 2", 1]["media"].startswith("Ander gesprek/bijlage_")
    assert all(r["media"] == "" or r["media"].endswith((".jpg", ".opus")) for r in rows.values())


def test_conversation_names(spark):
    people = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "conversation_id int, canonical string")
    topics = spark.createDataFrame([(2, "Talk: X"), (4, "Y")], "conversation_id int, topic string")
    got = {tuple(r) for r in identity.conversation_names(people, topics, "Talk: ").collect()}
    assert got == {(1, "a - b", "Talk: a - b"), (2, "X", "Talk: X"), (3, "", "Talk: "), (4, "Y", "Talk: Y")}


def test_report(spark):
    merged = spark.createDataFrame([(_minute(1), "d/a.jpg"), (_minute(2), "d/a.jpg"), (_minute(3), ""), (_minute(4), "<Media weggelaten>")], "date timestamp_ntz, media string")
    files = spark.createDataFrame([("d/a.jpg", "d/a.jpg", True, False), ("e/a.jpg", "d/a.jpg", False, True), ("d/q.jpg", "d/q.jpg", True, False)], "path_self string, path_other string, chosen_location boolean, external_location boolean")
    got = {(r["name"], tuple(p["path_self"] for p in r["places"])) for r in report.attachments(merged, files).collect()}
    assert got == {("a.jpg", ("d/a.jpg", "e/a.jpg")), (None, ("d/q.jpg",))}
    assert tuple(report.attachment_counts(merged, files).first()) == (2, 2)
    overview = spark.createDataFrame([("h", 5), ("k", 1)], "data_holder string, n_messages long")
    chats = spark.createDataFrame([("h", "01-01-2024", "02-01-2024"), ("z", None, None)], "data_holder string, start_date string, end_date string")
    assert [tuple(r) for r in report.selection(overview, chats).collect()] == [("h", 5, "01-01-2024", "02-01-2024")]
    counts = spark.createDataFrame([("h", 2, 9)], "data_holder string, n_media_after long, n_messages long")
    assert {tuple(r) for r in report.statistics(counts, overview).collect()} == {("h", 2, 5), ("k", None, 1)}
    assert report.media_after(counts).first()[0] == 2 and report.media_after(counts.limit(0)).first()[0] == 0


BODY = "5/13/22, 16:21 - Ann: hello\n5/13/22, 16:22 - Bo: bye"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Ann" / "e1").mkdir(parents=True)
    (tmp_path / "Ann" / "e1" / "chat.txt").write_text(BODY)
    (tmp_path / "Ann" / "e1" / "bad.txt").write_bytes(b"\xff\xfe\xff")
    for name, members in (("ok.zip", {"a.jpg": "1", "_chat.txt": BODY}), ("iMessage 1.zip", {"x.txt": "no"}), ("empty.zip", {"a.jpg": "1"})):
        with zipfile.ZipFile(tmp_path / "Ann" / name, "w") as z:
            for n, text in members.items():
                z.writestr(n, text)
    (tmp_path / "Ann" / "broken.zip").write_text("no archive")
    return tmp_path


def _short(rows, at):
    return {(r["file"].split(str(at))[-1].lstrip("/"), r["body"], r["error"] is None) for r in rows}


def test_reading_exports(spark, folder):
    got = exports.read_exports(spark, str(folder))
    assert _short(got.collect(), folder) == {("Ann/e1/chat.txt", BODY, True), ("Ann/e1/bad.txt", None, False), ("Ann/ok.zip", BODY, True), ("Ann/empty.zip", None, False), ("Ann/broken.zip", None, False)}
    assert exports.errors(got).count() == 3
    holders = {tuple(r) for r in got.where("body is not null").select(exports.data_holder(F.col("file"))).collect()}
    assert holders == {("Ann",)}


def test_reading_listed_exports(spark, folder):
    chats = spark.createDataFrame([(f"{folder}/Ann/ok.zip.zip", True), (f"{folder}/Ann/e1/chat.txt", None), (f"{folder}/Ann/broken.zip", False), (f"{folder}/gone.txt", True)], "file string, load boolean")
    got = exports.read_listed(spark, chats).collect()
    assert _short(got, folder) == {("Ann/ok.zip.zip", BODY, True), ("Ann/e1/chat.txt", BODY, True), ("gone.txt", None, False)}
    assert exports.read_listed(spark, chats.where("not load")).count() == 0
    listed = spark.createDataFrame([("a", "f1"), ("b", "f2")], "file string, datetime_format string")
    assert [tuple(r) for r in exports.unread(listed, listed.where("file = 'a'")).collect()] == [("b", "f2")]


def test_digests_of_files_and_members(spark, folder):
    found = exports.file_digests(spark, str(folder))
    paths = {r["path"].split(str(folder))[-1].lstrip("/"): (r["parent"].split(str(folder))[-1].lstrip("/"), r["hash"]) for r in found.collect()}
    assert "Ann/ok.zip/a.jpg" in paths and paths["Ann/ok.zip/a.jpg"][0] == "Ann/ok.zip" and "Ann/empty.zip/a.jpg" not in paths and "Ann/ok.zip/_chat.txt" not in paths
    assert exports.new_digests(found, found).count() == 0 and exports.new_digests(found.where("path like '%.zip'"), found).count() == len(paths) - 4


def test_text_and_csv(spark, tmp_path):
    merged = spark.createDataFrame([(1, 1, _minute(2), "", "note"), (1, 0, _minute(1), "a", "x\ny")], "conversation_id int, position long, date timestamp_ntz, sender string, message string")
    sinks.write_text(merged, f"{tmp_path}/t")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t" / "conversation_id=1").glob("*.txt")))
    assert text == "13-05-2022 16:01 - a: x\ny\n13-05-2022 16:02 - note\n"
    sinks.write_csv(merged, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True, multiLine=True).count() == 2


def test_configurations(spark):
    chats = spark.createDataFrame([(1, "f1.txt", "android", True, "h1"), (1, "f2.zip", "iphone", True, "h2")], "conversation_id int, file string, phone_os string, load boolean, data_holder string")
    contacts = spark.createDataFrame([(1, "ann", "h1", "ann"), (1, "ann", "h2", "A.")], "conversation_id int, canonical string, data_holder string, label string")
    book = spark.createDataFrame([(1, "+316", "ann")], "conversation_id int, number string, name string")
    names = spark.createDataFrame([(1, "Één groep", "Talk Één groep")], "conversation_id int, topic string, name string")
    row = config.conversation_configs(chats, contacts, book, names).first()
    made = json.loads(row["config"])
    assert row["file_name"] == "config_1_een-groep.json" and made["conversation_name"] == "Talk Één groep"
    assert made["mapping"] == {"ann": [["h1", "ann"], ["h2", "A."]]} and made["phone_book"] == {"+316": "ann"} and made["files"]["f2.zip"]["phone_os"] == "iphone"
    assert [tuple(r) for r in config.labelled_chats(spark.createDataFrame([("b",), ("a",)], "file string")).collect()] == [("a", "Chat 000", True), ("b", "Chat 001", True)]
    messages = spark.createDataFrame([("f", 0, _minute(1), "a", "x", ""), ("f", 1, _minute(2), "", "y", "")], "file string, original_order long, date timestamp_ntz, sender string, message string, media string")
    assert {tuple(r) for r in config.messages_from_json(config.messages_to_json(messages)).collect()} == {tuple(r) for r in messages.collect()}


def test_new_exports_as_they_arrive(spark, folder, tmp_path):
    target, checkpoint = f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    root = str(folder / "Ann")
    ingest.ingest(spark, root, target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == 4
    (folder / "Ann" / "e1" / "later.txt").write_text(BODY)
    for _ in range(2):
        ingest.ingest(spark, root, target, checkpoint).awaitTermination()
        assert spark.read.parquet(target).count() == 6
