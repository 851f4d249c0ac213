from datetime import date, datetime

from chorale.operators import mapping, media, report
from chorale.sources import config


def test_config_round_trip(spark, tmp_path):
    given = {"start_date": date(2019, 12, 1), "conversation_name": "x”", "files": {"a/b/c.txt": {"phone_os": "android", "load": True, "data_holder": "A"}}, "mapping": {"A": {("B", "al"), ("A",)}}, "phone_book": {"+31": "A"}}
    config.save_config(given, str(tmp_path / "c.json"))
    read = config.load_config(str(tmp_path / "c.json"))
    assert read == {**given, "start_date": "01-12-2019"}
    assert config.load_config("c.txt") is None
    chats, contacts, book = config.tables(spark, read)
    assert chats.select("file", "load", "end_date").collect() == [("a/b/c.txt", True, None)]
    assert contacts.collect() == [("A", "B", "al")] and book.collect() == [("+31", "A")]
    assert [t.count() for t in config.tables(spark, {})] == [0, 0, 0]


def test_chat_entries(spark):
    messages = spark.createDataFrame([("f", datetime(2022, 5, 1, 9)), ("f", datetime(2022, 5, 2, 23))], "file string, date timestamp_ntz")
    entries = config.chat_entries(messages, spark.createDataFrame([("f", "A"), ("g", "B")], "file string, data_holder string"))
    built = config.build_config("n", entries)
    assert built["files"] == {"f": {"start_date": "01-05-2022", "end_date": "03-05-2022", "data_holder": "A"}, "g": {"start_date": None, "end_date": None, "data_holder": "B"}}


def test_groups(spark):
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 9)], "group_id string, member long")
    found = spark.createDataFrame([("a", 7), ("a", 2), ("c", None)], "group_id string, member long")
    assert {tuple(r) for r in mapping.merge_groups(known, found).collect()} == {(1, 1), (2, 1), (7, 1), (5, 5)}
    labels = spark.createDataFrame([("h", "x"), ("k", "y"), (None, "z")], "data_holder string, label string")
    renamed = mapping.rename_holders(labels, spark.createDataFrame([("h", "n2"), ("h", "n1")], "old_name string, new_name string"))
    assert {tuple(r) for r in renamed.collect()} == {("n1", "x"), ("k", "y"), (None, "z")}
    m = spark.createDataFrame([("P", [("c1", "a")]), ("O", [("c1", "a"), ("c2", "b")])], "canonical string, members array<struct<data_holder:string,label:string>>")
    assert {tuple(r) for r in mapping.inverse(m).collect()} == {("c1", "a", "O"), ("c2", "b", "O")}


def test_files(spark):
    chats = spark.createDataFrame([("r/x/c.txt", True), ("r/y.zip", True), ("r/z/c.txt", False)], "file string, load boolean")
    inside = media.included_directories(chats)
    assert {r[0] for r in inside.collect()} == {"r/x", "r/y.zip"}
    files = spark.createDataFrame([("r/x/1.jpg", "r/x", "h"), ("r/z/1.jpg", "r/z", "h"), ("r/z/2.jpg", "r/z", "i")], "path string, parent string, hash string")
    got = media.file_table(files, inside, media.canonical_by_digest(files)).select("path_self", "chosen_location", "external_location")
    assert {tuple(r) for r in got.collect()} == {("r/x/1.jpg", False, False), ("r/z/1.jpg", True, True)}


def test_timeline(spark):
    row = (datetime(2024, 1, 1), datetime(2024, 1, 3, 12), datetime(2024, 1, 5), datetime(2024, 1, 4), None)
    got = report.timeline(spark.createDataFrame([row[:4]], "first_date timestamp_ntz, start_selection timestamp_ntz, end_selection timestamp_ntz, last_date timestamp_ntz")).first()
    assert (got["pre_selection"], got["selection"], got["post_selection"]) == (2, 1, -1)
