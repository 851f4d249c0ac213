import random

import pytest
from pyspark.sql import functions as F

from chorale.functions import joins
from chorale.operators import align, announcements, graph, order, overlap, parsing

EDGES = [(30, 12), (12, 45), (45, 30), (17, 61), (90, 61), (33, 33), (None, 12), (8, None)]


def test_components(spark):
    got = graph.connected_components(spark.createDataFrame(EDGES, "src long, dst long")).collect()
    assert {(r[0], r[1]) for r in got} == {(12, 12), (30, 12), (45, 12), (17, 17), (61, 17), (90, 17), (33, 33)}


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_overlap(spark):
    rows = [("x", "a"), ("x", "b"), ("x", "b"), ("y", "b"), ("z", "c"), (None, "b"), ("x", None)]
    got = overlap.overlap_scores(spark.createDataFrame(rows, "l string, e string"), "l", "e").collect()
    assert [tuple(r) for r in got] == [("x", "y", 1, 1.0)]


def test_votes_and_repair():
    assert order.compare({"a": 1, "b": 2}, {"a": 2, "b": 3}) == -1
    assert order.compare({"a": 1, "b": 2}, {"a": 2, "b": 1}) == 0
    assert order.compare({"a": 5}, {"b": 3}) == 1
    assert order.compare({"a": 5, "b": 2}, {"a": 5, "b": 1}) == 0  # an equal order votes against
    assert order.repair([{"a": 0, "b": 3}, {"a": 1}, {"b": 4}]) == [{"a": 3, "b": 3}, {"a": 4}, {"b": 4}]


BODY = "5/13/22, 16:21 - Ann created group \"X\"\n5/13/22, 16:22 - Ann: hello\nworld: more\n5/13/22, 16:23 - Bo: a.jpg (file attached)\n5/13/22, 16:24 - Bo: x end-to-end x\n5/13/22, 16:25 - Bo: bye"


def test_parsing(spark):
    lined = parsing.lines(spark.createDataFrame([("f/c.txt", BODY)], "file string, body string"))
    chats = parsing.infer_formats(lined)
    row = chats.first()
    assert (row["phone_os"], row["datetime_format"], row["datetime_certain"]) == ("android", "M/d/yy, H:m", True)
    from pyspark.sql import functions as F

    got = parsing.messages(lined, chats.withColumn("data_holder", F.lit("h"))).orderBy("original_order").collect()
    assert [(r["original_order"], r["sender"], r["message"], r["media"]) for r in got] == [
        (0, "", 'Ann created group "X"', ""),
        (1, "Ann", "hello\nworld: more", ""),
        (2, "Bo", "a.jpg (file attached)", "f/a.jpg"),
        (4, "Bo", "bye", ""),
    ]


def _lift(rows):
    """Repair by its definition: every value of a column at least as high rises, row after row."""
    now = [dict(r) for r in rows]
    for r in now:
        top = max(r.values(), default=0)
        for h in r:
            if (diff := top - r[h]) > 0:
                least = r[h]
                for other in now:
                    if h in other and other[h] >= least:
                        other[h] += diff
    return now


def test_repair_and_standings_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        rows = [{h: rng.randint(0, 12) for h in "abc" if rng.random() < 0.6} for _ in range(rng.randint(1, 12))]
        assert order.repair(rows) == _lift(rows)
        want = [sum(order.compare(a, b) for b in rows) for a in rows]
        assert order.standings(rows).tolist() == want == order.standings(rows, block=2).tolist()


def test_order_of_minutes_with_several_rows(spark):
    m = "timestamp_ntz'2024-01-01 10:00:00'"
    rows = [("x", "s", "one", {"A": 1, "B": 2, "C": 3}), ("x", "s", "two", {"A": 2, "B": 3, "C": 1}), ("x", "s", "three", {"A": 3, "B": 1, "C": 2}), ("x", "s", "four", {"A": 4, "B": 4}), ("x", "t", "zero", {"C": 0}), ("y", "s", None, {"A": 0})]
    aligned = spark.createDataFrame(rows, "conversation_id string, sender string, message_media string, orders map<string,long>").withColumn("date", F.expr(m)).withColumn("sources", F.lit("A"))
    got = order.order_rows(aligned).orderBy("conversation_id", "position").collect()
    by = {r["message_media"]: r for r in got}
    assert [r["position"] for r in got] == [0, 1, 2, 3, 4, 0]
    assert got[0]["message_media"] == "zero" and got[4]["message_media"] == "four" and not by[None]["unknown_order"]
    assert order.order_rows(aligned.limit(0)).count() == 0


def _overlap_edges(sets, threshold):
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > threshold}


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9])
def test_links_have_the_components_of_all_pairs(spark, threshold):
    rng = random.Random(9)
    sets = {f"l{i:02d}": {"common"} | {f"e{rng.randint(0, 60)}" for _ in range(rng.choice([0, 1, 3, 12]))} for i in range(60)}
    edges = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s] + [(None, "x"), ("l00", None)], "l string, e string")
    got = overlap.links(edges, "l", "e", threshold).collect()
    all_pairs = _overlap_edges(sets, threshold)
    assert {tuple(sorted((r["src"], r["dst"]))) for r in got} <= all_pairs

    def roots(pairs):
        root = {k: k for k in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots([tuple(r) for r in got]) == roots(all_pairs)


def test_attachments_of_long_and_mixed_messages(spark):
    long = "x " * 50_000
    cases = {
        "a.jpg (file attached)": "f/a.jpg", "b.pdf (bestand bijgevoegd)\nwith a caption": "f/b.pdf", "<bijgevoegd: 0-c.opus>": "f/0-c.opus", "text <bijgevoegd: 0-c.opus>": "f/0-c.opus",
        "<bijgevoegd: no ending.>": "", "<Media omitted>": parsing.NO_MEDIA, "x <Media weggelaten>": parsing.NO_MEDIA, " (file attached)": parsing.NO_MEDIA, "plain": "", long: "",
        "first\nd e.jpg (file attached)": "f/d e.jpg", long + "(file attached)": "f/" + long.strip(), "g (file attached)\n<bijgevoegd: h.jpg>": "f/g", "i <bijgevoegd: j.jpg> (file attached)": "f/i <bijgevoegd: j.jpg>",
    }
    rows = spark.createDataFrame([(m, "f/c.txt") for m in cases], "message string, file string")
    assert {r[0]: r[1] for r in rows.select("message", parsing.media(F.col("message"), F.col("file"))).collect()} == cases


def test_canonical_sentences_are_filled_at_once(spark):
    rows = [('{name} created group "{admin}"', "h", ""), ("Bo left", "h", "Bo"), ("x" * 100_000, "h", ""), (None, "h", "")]
    told = announcements.extract(spark.createDataFrame(rows, "message string, data_holder string, sender string"), sender="sender")
    assert [r[0] for r in told.select(announcements.canonical()).collect()] == ["{name} heeft de groep '{admin}' aangemaakt", None, None, None]


def test_announcements(spark):
    rows = [("you added Bo", "h"), ('Ann created group "X"', "h"), ("nothing", "h"), ("Bo left", "h")]
    got = announcements.extract(spark.createDataFrame(rows, "message string, data_holder string")).collect()
    assert [(r["rule"], r["admin"], r["name"], r["to_topic"]) for r in got] == [(6, "h", "Bo", None), (3, "Ann", None, "X"), (None, None, None, None), (11, None, "Bo", None)]


def test_align(spark):
    rows = [(1, None, "s", "m", "A", 3), (1, None, "s", "m", "A", 2), (1, None, "s", "m", "B", 0), (1, None, "s", None, "B", 1)]
    got = align.align(spark.createDataFrame(rows, "conversation_id long, date timestamp_ntz, sender string, message_media string, data_holder string, original_order long")).collect()
    assert {(r["message_media"], r["sources"]): r["orders"] for r in got} == {("m", "A,B"): {"A": 2, "B": 0}, (None, "B"): {"B": 1}}


def test_entry_has_queries():
    import __spark_entry__ as e

    assert "export_full_outer_merge" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_of_stars_and_chains(spark):
    """Hot middles of stars, joined to each other and to a chain, against a plain search."""
    edges = [(1000, k) for k in range(1001, 2600)] + [(3000, k) for k in range(3001, 3700)] + [(2599, 3001)] + [(5000 + k, 5001 + k) for k in range(40)] + [(7, 8), (8, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in list(root)}


def test_join_totals(spark):
    rows = spark.createDataFrame([(k % 3 if k < 30 else 9, k) for k in range(900)] + [(None, 1)], "u long, v long")
    totals = rows.groupBy("u").agg(F.count("*").alias("n"))
    got = joins.join_totals(rows, totals, "u", "n", 901, hot_keys=10, least_hot=20).collect()
    assert len(got) == 900 and {(r["u"], r["n"]) for r in got} == {(0, 10), (1, 10), (2, 10), (9, 870)}


@pytest.mark.parametrize("at_once", [0, 150, 10**6])
def test_components_settled_at_once_are_those_of_the_rounds(spark, at_once):
    rng = random.Random(8)
    pairs = [*((k, k + 1) for k in range(80)), *((200, 201 + k) for k in range(60)), *((rng.randint(300, 500), rng.randint(300, 500)) for _ in range(70)), (600, 600), (None, 5), (-7, 600)]
    low = {x: x for a, b in pairs if a is not None for x in (a, b)}
    while any(low[a] != low[b] for a, b in pairs if a is not None):
        for a, b in pairs:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = graph.connected_components(spark.createDataFrame(pairs, "src int, dst int"), at_once=at_once)
    assert got.schema["component"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect())) == sorted(low.items())


def test_components_of_few_edges_take_few_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("few", "components of a chain of forty")
    assert graph.connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")).where("component = 0").count() == 41
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few")) <= 8


def _shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_links_shuffle_no_long_elements(spark):
    rng = random.Random(4)
    rows = [(d, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4000))) for d in range(200)]
    rows += [(d + 1, e) for d, e in rows[:100:2]]
    sets = spark.createDataFrame(rows, "l long, e string").repartition(4).cache()
    sets.count()
    before = _shuffled(spark)
    got = {(r["src"], r["dst"]) for r in overlap.links(sets, "l", "e", 0.4).collect()}
    assert {tuple(sorted(x)) for x in got} == {(d, d + 1) for d in range(0, 100, 2)}
    assert _shuffled(spark) - before < 200_000


def test_links_propose_no_pairs_that_only_share_a_common_element(spark):
    """A set of two shares both elements or is not over half, so the common one is not looked up."""
    rows = [(d, e) for d in range(300) for e in ("common", f"own{d}")] + [(d, "with 0") for d in (0, 400)] + [(400, "common")]
    sets = spark.createDataFrame(rows, "l long, e string")
    assert [tuple(r) for r in overlap.links(sets, "l", "e", 0.5).collect()] == [(400, 0)]
    rows = overlap._ranked(sets, "l", "e").collect()
    assert {(r["label"], r["n"], len(r["all"])) for r in rows} == {(0, 3, 2), (400, 2, 2), *((d, 2, 1) for d in range(1, 300))}


@pytest.mark.parametrize("limits", [{}, {"block": 2, "block_sets": 2}])
def test_overlap_scores_against_brute_force(spark, limits):
    rng = random.Random(6)
    sets = {d: frozenset(rng.choices("abcdefgh", k=rng.randint(1, 4))) | {f"own{d}x{k}" for k in range(rng.choice([0, 0, 1, 3]))} for d in range(60)}
    want = sorted((a, b, len(x & y), round(len(x & y) / min(len(x), len(y)), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y)
    rows = spark.createDataFrame([(d, e) for d, x in sets.items() for e in x], "l long, e string")
    assert sorted(map(tuple, overlap.overlap_scores(rows, "l", "e", 6, **limits).collect())) == want


def test_overlap_scores_shuffle_no_pairs(spark):
    rows = spark.createDataFrame([(d, e) for d in range(1500) for e in ("common", f"own{d}")], "l long, e string")
    before = _shuffled(spark)
    assert overlap.overlap_scores(rows, "l", "e").where("common = 1 and score = 0.5").count() == 1500 * 1499 // 2
    assert _shuffled(spark) - before < 500_000


def test_overlap_scores_shuffle_a_pair_of_classes_once(spark):
    """Every set is a class of its own here, and all share the common element."""
    rows = spark.createDataFrame([(d, e) for d in range(600) for e in ("common", f"p{d // 2}", f"q{(d + 1) // 2}")], "l long, e string")
    sc = spark.sparkContext

    def records():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = records()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        got = overlap.overlap_scores(rows, "l", "e").groupBy("common").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in got} == {(2, 599), (1, 600 * 599 // 2 - 599)}
    assert records() - before < 1.5 * (600 * 599 // 2)
