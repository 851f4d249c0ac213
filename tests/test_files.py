import zipfile

from chorale.functions.names import slug, slugs
from chorale.sources import copies, sheets


def test_slugs(spark):
    cases = {"  Één Grôep!  ": "een-groep", "a - b -- c": "a-b-c", "_x_": "x", "…": "", "a_b": "a_b", "a ! b": "a-b"}
    assert {k: slug(k) for k in cases} == cases
    df = spark.createDataFrame([("É b",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(slugs("n")).collect()] == ["e-b", None, ""]


def test_sheets(spark, tmp_path):
    rows = [("Name_from", "Name_to"), ("a & b", "<c>"), ("d", None), ("d", " e ")]
    assert sheets.read_sheet(sheets.write_sheet(list(rows[0]), rows[1:])) == [list(r) for r in rows]
    (tmp_path / "m.xlsx").write_bytes(sheets.write_sheet(list(rows[0]), rows[1:]))
    assert {tuple(r) for r in sheets.manual_names(spark, str(tmp_path / "m.xlsx")).collect()} == {("a & b", "<c>"), ("d", " e ")}
    assert sheets.manual_names(spark, str(tmp_path / "none.xlsx")).count() == 0


def test_workbooks(spark):
    merged = spark.createDataFrame([(1, 2, "c\n"), (1, 0, "é"), (1, 1, None), (2, 0, "x")], "conversation_id long, position long, message string")
    books = {(r[0], r[1]): sheets.read_sheet(bytes(r[2])) for r in sheets.workbooks(merged, ["message"], rows=2).collect()}
    assert books == {("1", 0): [["message"], ["\\xe9"], [None]], ("1", 1): [["message"], ["c\\n"]], ("2", 0): [["message"], ["x"]]}
    assert sheets.workbooks(merged.limit(0), ["message"]).count() == 0


def test_copies(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("a.jpg", "one")
        z.writestr("card 7.vcf", "two")
    (tmp_path / "b.jpg").write_text("three")
    at = str(tmp_path)
    given = [(f"{at}/e.zip/a.jpg", ""), (f"{at}/e.zip.zip/card.vcf", None), (f"{at}/b.jpg", f"{at}/b_1.jpg"), (f"{at}/none.jpg", ""), (f"{at}/gone.zip/a.jpg", ""), (copies.OMITTED, ""), ("", ""), (None, None)]
    plan = copies.copy_plan(spark.createDataFrame(given + given[:1], "media string, media_to string"))
    got = {r["media"].removeprefix(at): (r["target"], r["outcome"]) for r in copies.copy_media(plan, f"{at}/out").collect()}
    assert got == {"/e.zip/a.jpg": ("a.jpg", "copied"), "/e.zip.zip/card.vcf": ("card.vcf", "substituted"), "/b.jpg": ("b_1.jpg", "copied"), "/none.jpg": ("none.jpg", "missing"), "/gone.zip/a.jpg": ("a.jpg", "missing")}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.jpg": "one", "card.vcf": "two", "b_1.jpg": "three"}
