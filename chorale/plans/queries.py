"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chorale.functions.names import slugs
from chorale.operators import align, announcements, graph, grouping, identity, mapping, media, order, overlap, parsing, report
from chorale.plans import flows
from chorale.sources import copies, sheets, sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partial exports of every conversation, derived from its turns."""
    turns = table(spark, sf_dir, "conversations")
    holders = F.explode(F.array(*[F.struct(F.lit(h).alias("data_holder"), F.lit(k).alias("k")) for k, h in enumerate("ABC")])).alias("e")
    rows = turns.select("*", holders).where((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("e.k")) % 5 != 0)
    date = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)")
    return rows.select(
        F.col("conv_id").alias("conversation_id"), date.alias("date"), F.col("role").alias("sender"), F.col("text").alias("message"),
        F.lit("").alias("media"), F.col("e.data_holder").alias("data_holder"), F.col("turn").cast("long").alias("original_order"),
        align.message_media(F.lit(""), F.col("text")).alias("message_media"),
    )


EXPORTS_SQL = """
    SELECT conv_id AS conversation_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS date, role AS sender,
           text AS message, '' AS media, h AS data_holder, CAST(turn AS BIGINT) AS original_order, nullif(text, '') AS message_media
    FROM conversations, (VALUES ('A', 0), ('B', 1), ('C', 2)) AS x(h, k) WHERE (conv_id * 7 + turn * 3 + k) % 5 <> 0"""
ALIGNED_SQL = f"""
    WITH e AS ({EXPORTS_SQL}),
    f AS (SELECT conversation_id, date, sender, message_media, data_holder, min(original_order) AS o FROM e GROUP BY ALL),
    a AS (SELECT conversation_id, date, sender, message_media, string_agg(data_holder, ',' ORDER BY data_holder) AS sources,
                 max(o) FILTER (data_holder = 'A') AS order_a, max(o) FILTER (data_holder = 'B') AS order_b, max(o) FILTER (data_holder = 'C') AS order_c
          FROM f GROUP BY ALL)"""

LINES_SQL = "SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 30"
SCORES_SQL = f"""
    WITH s AS ({LINES_SQL}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.line = y.line AND x.doc_id < y.doc_id GROUP BY ALL),
    scores AS (SELECT a, b, common, common / least(p.n, q.n) AS score FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") >= 30)


def _line_scores(spark, sf_dir, decimals=None):
    return overlap.overlap_scores(_long_lines(spark, sf_dir), "doc_id", "line", decimals)


@query(SCORES_SQL + " SELECT a, b, common, round(score, 6) AS score FROM scores")
def doc_line_overlap(spark, sf_dir):
    return _line_scores(spark, sf_dir, 6)


@query(SCORES_SQL.replace("WITH s", "WITH RECURSIVE s") + """,
    e AS (SELECT a, b FROM scores WHERE score > 0.5 UNION SELECT b, a FROM scores WHERE score > 0.5),
    r(node, low) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node)
    SELECT node, min(low) AS component FROM r GROUP BY node""")  # fmt: skip
def doc_line_overlap_components(spark, sf_dir):
    return graph.connected_components(overlap.links(_long_lines(spark, sf_dir), "doc_id", "line", 0.5))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def exact_text_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("group_id"), F.col("doc_id").alias("member"))
    return graph.connected_components(mapping.star_edges(docs)).select(F.col("node").alias("doc_id"), "component")


@query(f"SELECT conversation_id, data_holder, count(*) AS n, count(DISTINCT message) AS n_distinct FROM ({EXPORTS_SQL}) GROUP BY ALL")
def export_distinct(spark, sf_dir):
    return exports(spark, sf_dir).groupBy("conversation_id", "data_holder").agg(F.count("*").alias("n"), F.countDistinct("message").alias("n_distinct"))


@query(ALIGNED_SQL + " SELECT * FROM a")
def export_full_outer_merge(spark, sf_dir):
    a = align.align(exports(spark, sf_dir))
    orders = [F.try_element_at("orders", F.lit(h)).alias(f"order_{h.lower()}") for h in "ABC"]
    return a.select("conversation_id", "date", "sender", "message_media", "sources", *orders)


@query(ALIGNED_SQL + ", m AS (SELECT conversation_id, message_media, arg_min(message, (data_holder, original_order)) AS message FROM e GROUP BY ALL) SELECT a.conversation_id, date, sender, sources, message FROM a LEFT JOIN m ON a.conversation_id = m.conversation_id AND a.message_media IS NOT DISTINCT FROM m.message_media")
def merge_first_match(spark, sf_dir):
    e = exports(spark, sf_dir)
    return align.first_match(align.align(e), e, ["message"]).select("conversation_id", "date", "sender", "sources", "message")


@query(ALIGNED_SQL + """, o AS (SELECT conversation_id, date, sender, coalesce(order_c, order_b, order_a) AS n FROM a),
    w AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY date, sender) AS pos FROM o),
    x AS (SELECT conversation_id, pos, n, coalesce(n - lag(n) OVER p, 0) < 0 OR coalesce(n - lead(n) OVER p, 0) > 0 AS any_out_of_order,
                 count(*) OVER (PARTITION BY conversation_id, n) > 1 AS no_unique_order FROM w WINDOW p AS (PARTITION BY conversation_id ORDER BY pos))
    SELECT conversation_id, pos, n, any_out_of_order, no_unique_order, any_out_of_order OR no_unique_order AS unknown_order FROM x""")  # fmt: skip
def merge_order_flags(spark, sf_dir):
    a = align.align(exports(spark, sf_dir))
    n = F.coalesce(*[F.try_element_at("orders", F.lit(h)) for h in "CBA"])
    a = a.select("conversation_id", n.alias("n"), F.row_number().over(W.partitionBy("conversation_id").orderBy("date", "sender")).cast("long").alias("pos"))
    return align.order_flags(a, ["conversation_id"], "pos", "n").select("conversation_id", "pos", "n", "any_out_of_order", "no_unique_order", "unknown_order")


OWN_SQL = EXPORTS_SQL.replace("CAST(turn AS BIGINT) AS original_order", "row_number() OVER (PARTITION BY conv_id, h ORDER BY turn) - 1 AS original_order")
_top = "greatest(coalesce(p.order_a + {r}sa, -1), coalesce(p.order_b + {r}sb, -1), coalesce(p.order_c + {r}sc, -1))"


@query("WITH RECURSIVE" + ALIGNED_SQL.replace(EXPORTS_SQL, OWN_SQL).split("WITH", 1)[1] + f""",
    p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY date) - 1 AS position FROM a),
    r(conversation_id, position, top, sa, sb, sc) AS (
        SELECT conversation_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p WHERE position = 0
        UNION ALL SELECT p.conversation_id, p.position, {_top.format(r="r.")}, coalesce({_top.format(r="r.")} - p.order_a, r.sa), coalesce({_top.format(r="r.")} - p.order_b, r.sb), coalesce({_top.format(r="r.")} - p.order_c, r.sc)
        FROM r JOIN p ON p.conversation_id = r.conversation_id AND p.position = r.position + 1)
    SELECT p.conversation_id, date, sender, message_media, sources, p.position, top AS order_number, false AS any_out_of_order,
           count(*) OVER (PARTITION BY p.conversation_id, top) > 1 AS no_unique_order, count(*) OVER (PARTITION BY p.conversation_id, top) > 1 AS unknown_order
    FROM p JOIN r ON r.conversation_id = p.conversation_id AND r.position = p.position""")  # fmt: skip
def order_repair(spark, sf_dir):
    """Holders number the rows they have, so those who lack some lag behind until their orders are repaired."""
    e = exports(spark, sf_dir)
    own = F.row_number().over(W.partitionBy("conversation_id", "data_holder").orderBy("original_order")) - 1
    return order.order_rows(align.align(e.withColumn("original_order", own.cast("long"))))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def file_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "date")
    return align.file_window(e, F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id", F.col("date").alias("ts"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def conv_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "date")
    return align.conversation_window(e, F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id", F.col("date").alias("ts"))


def _event_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("data_holder"), F.col("ts").alias("date"), F.when(F.col("event_type") == "purchase", "file").otherwise("").alias("media"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("sender"))


@query("""SELECT user_id AS data_holder, count(*) FILTER (event_type = 'purchase') AS n_media_before, count(*) FILTER (event_type <> 'purchase') AS n_text_before,
    count(*) FILTER (event_type = 'purchase' AND ts > TIMESTAMP '2024-01-10 00:00:00') AS n_media_after,
    count(*) FILTER (event_type <> 'purchase' AND ts > TIMESTAMP '2024-01-10 00:00:00') AS n_text_after FROM events GROUP BY user_id""")  # fmt: skip
def before_after_counts(spark, sf_dir):
    return report.before_after(_event_messages(spark, sf_dir), F.col("date") > F.expr("timestamp_ntz'2024-01-10 00:00:00'"))


@query("""SELECT user_id AS data_holder, count(*) AS n_messages, count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS n_text,
    count(*) FILTER (event_type = 'purchase') AS n_media, count(*) FILTER (event_type = 'click') AS n_announcements, min(ts) AS first_date, max(ts) AS last_date
    FROM events GROUP BY user_id""")  # fmt: skip
def holder_overview(spark, sf_dir):
    return report.holder_overview(_event_messages(spark, sf_dir))


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.concat(F.lit("IMG-"), (F.col("doc_id") % 50).cast("string"), F.lit(".jpg")).alias("name"), F.sha2("text", 256).alias("hash"))


@query("SELECT 'IMG-' || (doc_id % 50) || '.jpg' AS name, count(DISTINCT sha256(text)) AS n_hashes FROM documents GROUP BY ALL")
def collision_counts(spark, sf_dir):
    return media.collisions(_files(spark, sf_dir), "name", "hash")


@query("""WITH f AS (SELECT doc_id, source, 'IMG-' || (doc_id % 50) || '.jpg' AS name, sha256(text) AS hash FROM documents),
    s AS (SELECT name FROM f GROUP BY name HAVING count(DISTINCT hash) > 1),
    k AS (SELECT source, name, hash, dense_rank() OVER (PARTITION BY source ORDER BY hash) AS k FROM (SELECT DISTINCT source, name, hash FROM f WHERE name IN (SELECT name FROM s)))
    SELECT doc_id, CASE WHEN k IS NULL THEN f.name ELSE replace(f.name, '.jpg', '_' || k || '.jpg') END AS new_name FROM f LEFT JOIN k USING (source, name, hash)""")  # fmt: skip
def collision_rename(spark, sf_dir):
    return media.rename_collisions(_files(spark, sf_dir), "source", "name", "hash").select("doc_id", "new_name")


@query("SELECT sha256(text) AS hash, max(doc_id) AS canonical FROM documents GROUP BY ALL")
def canonical_by_digest(spark, sf_dir):
    return media.canonical_by_digest(_files(spark, sf_dir), "doc_id")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def digest_semi(spark, sf_dir):
    f = _files(spark, sf_dir).select("doc_id", "hash")
    return f.join(f.groupBy("hash").count().where("count > 1"), "hash", "left_semi").select("doc_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def digest_anti(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents"), "text", "left_anti").select("item_id")


@query("SELECT event_id, strftime(ts, '%-d-%-m-%Y %-H:%-M') AS raw, date_trunc('minute', ts) AS date FROM events")
def parse_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "d-M-yyyy H:m").alias("raw"))
    return e.withColumn("date", parsing.parse_date(F.col("raw"), F.lit("d-M-yyyy H:m")))


@query("""SELECT c_custkey, c_name || ' heeft ' || n_name || ' toegevoegd' AS message, c_name AS admin, n_name AS name, CAST(4 AS INTEGER) AS rule
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")  # fmt: skip
def announce_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.concat("c_name", F.lit(" heeft "), "n_name", F.lit(" toegevoegd")).alias("message"), F.lit("X").alias("data_holder"))
    return announcements.extract(rows).select("c_custkey", "message", "admin", "name", "rule")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'contact ' || c_nationkey ELSE c_name END AS label
    FROM customer""")  # fmt: skip
def label_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"), F.lit("H").alias("data_holder"), "c_nationkey")
    contacts = rows.where("c_custkey % 3 = 0").select("data_holder", "label", F.concat(F.lit("contact "), F.col("c_nationkey").cast("string")).alias("canonical"))
    book = spark.createDataFrame([("+31600000000", "nobody")], "number string, name string")
    return identity.apply_labels(rows, contacts, book, "label").select("c_custkey", "label")


@query("SELECT '+' || c_nationkey || '00' AS number, min(c_name) AS name FROM customer GROUP BY ALL")
def phone_book(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("+"), F.col("c_nationkey").cast("string"), F.lit(" 00")).alias("label"), F.col("c_name").alias("canonical"))
    return identity.phone_book(rows)


@query("""SELECT c_nationkey AS component, regexp_replace(trim(arg_min(c_mktsegment, (-length(regexp_replace(c_mktsegment, '[\\d+\\s]', '', 'g')), c_mktsegment))), '\\s+', ' ', 'g') AS canonical
    FROM customer GROUP BY ALL""")  # fmt: skip
def longest_name(spark, sf_dir):
    return identity.canonical_names(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("component"), F.col("c_mktsegment").alias("label")))


@query("""SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN role || ' ' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE role END AS unique_holder
    FROM conversations""")  # fmt: skip
def holder_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", "conv_id", "role").alias("holder"))
    return identity.holder_suffixes(rows, "holder", "turn").select("conv_id", "turn", F.substring_index("unique_holder", "|", -1).alias("unique_holder"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role <> '' GROUP BY ALL)
    SELECT conv_id, role, 'Deelnemer ' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first, role) AS pseudonym FROM f""")  # fmt: skip
def pseudonymise(spark, sf_dir):
    return identity.pseudonyms(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS topic FROM events GROUP BY user_id")
def topic_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("ts").alias("date"), F.col("event_type").alias("to_topic"))
    return announcements.latest_topic(e).select(F.col("conversation_id").alias("user_id"), "topic")


@query("SELECT conv_id, turn, CASE WHEN (turn + 1) % 3 = turn % 2 THEN turn % 2 ELSE turn % 3 END AS mode FROM conversations")
def row_mode(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    values = F.array(F.col("turn") % 3, F.col("turn") % 2, (F.col("turn") + 1) % 3)
    return c.select("conv_id", "turn", align.row_mode(values).alias("mode"))


@query(f"SELECT conversation_id, data_holder, original_order, strftime(date, '%d-%m-%Y %H:%M') || ' - ' || CASE WHEN sender <> '' THEN sender || ': ' ELSE '' END || coalesce(message, '') AS line FROM ({EXPORTS_SQL})")
def render_txt(spark, sf_dir):
    return exports(spark, sf_dir).select("conversation_id", "data_holder", "original_order", sinks.rendered().alias("line"))


@query(f"SELECT conversation_id, data_holder, original_order, CASE WHEN lower(sender) IN ('u', 'uw', 'you', 'your', 'user') THEN data_holder ELSE sender END AS sender FROM ({EXPORTS_SQL})")
def self_reference(spark, sf_dir):
    said = F.when(F.col("sender") == "user", "You").otherwise(F.col("sender"))
    return exports(spark, sf_dir).select("conversation_id", "data_holder", "original_order", announcements.replace_self(said, F.col("data_holder")).alias("sender"))


@query(f"""WITH t AS (SELECT data_holder || '/' || conversation_id AS file, data_holder, date, sender, original_order AS turn, conversation_id,
        regexp_replace(regexp_replace(regexp_replace(message, '\\r\\n?', chr(10), 'g'), '[\\x{{200e}}\\x{{202a}}\\x{{a0}}\\x{{202c}}\\x{{feff}}]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS message FROM ({EXPORTS_SQL}) WHERE message IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn) - 1 AS original_order FROM t)
    SELECT file, data_holder, date, sender, message, original_order, '' AS media FROM n WHERE NOT contains(message, 'end-to-end')""")  # fmt: skip
def export_segments(spark, sf_dir):
    """Writes each export's rows as text, then infers its format and reads the messages back."""
    e = exports(spark, sf_dir).where("message is not null")
    line = F.concat(F.date_format("date", "d-M-yyyy HH:mm"), F.lit(" - "), "sender", F.lit(": "), F.col("message"))
    rows = e.groupBy("conversation_id", "data_holder").agg(F.array_sort(F.collect_list(F.struct("original_order", line.alias("line")))).alias("rows"))
    files = rows.select(F.concat_ws("/", F.col("data_holder"), F.col("conversation_id").cast("string")).alias("file"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("body"))
    lined = parsing.lines(files)
    chats = parsing.infer_formats(lined).withColumn("data_holder", F.substring_index("file", "/", 1))
    return parsing.messages(lined, chats)


@query("""WITH s AS (SELECT user_id, min(ts) AS first_date, max(ts) AS last_date FROM events GROUP BY user_id)
    SELECT user_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(first_date)) / 86400000000) AS BIGINT) AS pre_selection,
    CAST(10 AS BIGINT) AS selection, CAST(floor((epoch_us(last_date) - epoch_us(TIMESTAMP '2024-01-20 00:00:00')) / 86400000000) AS BIGINT) AS post_selection FROM s""")  # fmt: skip
def timeline_days(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_date"), F.max("ts").alias("last_date"))
    spans = spans.withColumn("start_selection", F.expr("timestamp_ntz'2024-01-10 00:00:00'")).withColumn("end_selection", F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return report.timeline(spans).select("user_id", "pre_selection", "selection", "post_selection")


@query("""WITH f AS (SELECT source || '/' || doc_id AS path, source AS parent, sha256(text) AS hash FROM documents),
    d AS (SELECT DISTINCT source AS parent FROM documents WHERE source <= (SELECT min(source) FROM documents)),
    k AS (SELECT hash, max(path) AS canonical FROM f GROUP BY hash)
    SELECT path AS path_self, hash, canonical AS path_other, path = canonical AS chosen_location, parent NOT IN (SELECT parent FROM d) AS external_location
    FROM f JOIN k USING (hash) WHERE hash IN (SELECT hash FROM f WHERE parent IN (SELECT parent FROM d))""")  # fmt: skip
def file_locations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("parent"), F.sha2("text", 256).alias("hash"))
    chosen = d.agg(F.min("source").alias("parent"))
    return media.file_table(files, chosen, media.canonical_by_digest(files)).drop("parent")


@query("""SELECT source, doc_id, 'bijlage_' || row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR) || '.jpg') || '.jpg' AS new_name FROM documents""")
def anonymous_attachments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return media.anonymous_names(d, "source").select("source", F.regexp_replace("path", r"\.jpg$", "").cast("long").alias("doc_id"), "new_name")


@query("""WITH RECURSIVE g AS (SELECT 'r' || n_regionkey AS g, n_nationkey AS m FROM nation UNION ALL SELECT 's' || s_nationkey % 2, s_nationkey FROM supplier),
    e AS (SELECT DISTINCT x.m AS a, y.m AS b FROM g x JOIN g y USING (g)),
    r(node, low) AS (SELECT DISTINCT m, m FROM g UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node)
    SELECT node AS member, min(low) AS component FROM r GROUP BY node""")  # fmt: skip
def merged_groups(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("group_id"), F.col("n_nationkey").alias("member"))
    found = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_nationkey") % 2).cast("string")).alias("group_id"), F.col("s_nationkey").alias("member"))
    return mapping.merge_groups(known, found)


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand || ' é!'), '[^a-z0-9_\\s-]', '', 'g') || 'e', '[-\\s]+', '-', 'g'), '-_') AS slug FROM part""")
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slugs(F.concat("p_name", F.lit(" #"), "p_brand", F.lit(" é!"))).alias("slug"))


def _attached(spark, sf_dir):
    """Turns whose text says that a file is attached, in one of the ways exports have."""
    n = F.col("turn").cast("string")
    said = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("IMG-"), n, F.lit(".jpg (file attached)")))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit("IMG-"), n, F.lit(".jpg (bestand bijgevoegd)")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("<bijgevoegd: 0-"), n, F.lit(".opus>")))
        .when(F.col("turn") % 5 == 3, F.lit("<Media omitted>"))
        .otherwise(F.lit("hello"))
    )
    file = F.concat(F.lit("in/c"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 2 == 0, ".zip").otherwise("/chat.txt"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.media(said, file).alias("media"))


ATTACHED_SQL = """SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN '<Media weggelaten>' WHEN 4 THEN ''
    ELSE 'in/c' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '.zip' ELSE '' END || '/' || CASE turn % 5 WHEN 2 THEN '0-' || turn || '.opus' ELSE 'IMG-' || turn || '.jpg' END END AS media FROM conversations"""


@query(ATTACHED_SQL)
def attachment_extract(spark, sf_dir):
    return _attached(spark, sf_dir)


@query(f"""SELECT DISTINCT media, nullif(regexp_extract(media, '^(.*?\\.zip)/', 1), '') AS archive, nullif(regexp_extract(media, '^.*?\\.zip/(.+)$', 1), '') AS member,
    regexp_replace(media, '^.*/', '') AS target FROM ({ATTACHED_SQL}) WHERE media NOT IN ('', '<Media weggelaten>')""")  # fmt: skip
def media_copy_plan(spark, sf_dir):
    return copies.copy_plan(_attached(spark, sf_dir).withColumn("media_to", F.lit("")))


@query(f"""SELECT conversation_id, data_holder, count(*) AS n_before, count(*) FILTER (date > TIMESTAMP '2024-01-02 00:00:00' AND date <= TIMESTAMP '2024-03-01 00:00:00') AS n_after
    FROM ({EXPORTS_SQL}) GROUP BY ALL""")  # fmt: skip
def source_totals(spark, sf_dir):
    inside = F.expr("date > timestamp_ntz'2024-01-02 00:00:00' AND date <= timestamp_ntz'2024-03-01 00:00:00'")
    return report.totals(exports(spark, sf_dir), inside, "conversation_id", "data_holder")


@query(f"""WITH s AS (SELECT DISTINCT data_holder || '/' || sender AS label, message AS m FROM ({EXPORTS_SQL}) WHERE length(message) >= 10 AND media = ''),
    n AS (SELECT label, count(*) AS n FROM s GROUP BY label)
    SELECT a.label AS a, b.label AS b, count(*) AS common, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS score
    FROM s a JOIN s b USING (m) JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label WHERE a.label < b.label GROUP BY ALL""")  # fmt: skip
def author_overlap(spark, sf_dir):
    said = exports(spark, sf_dir).where((F.length("message") >= 10) & (F.col("media") == ""))
    scores = overlap.overlap_scores(said.select(F.concat_ws("/", "data_holder", "sender").alias("label"), "message"), "label", "message")
    return scores.select("a", "b", "common", F.round("score", 6).alias("score"))


@query(f"SELECT conversation_id || '/' || data_holder AS conversation_id, CAST(0 AS INT) AS part, count(*) AS n_rows FROM ({EXPORTS_SQL}) GROUP BY ALL")
def workbook_rows(spark, sf_dir):
    """Writes each holder's export of a conversation as a workbook and counts the rows that the workbook has."""
    rows = exports(spark, sf_dir).withColumn("conversation_id", F.concat_ws("/", F.col("conversation_id").cast("string"), "data_holder"))
    books = sheets.workbooks(rows, ["date", "sender", "message"], position="original_order")

    def count(batches):
        for pdf in batches:
            yield pdf[["conversation_id", "part"]].assign(n_rows=[len(sheets.read_sheet(c)) - 1 for c in pdf["content"]])

    return books.mapInPandas(count, "conversation_id string, part int, n_rows long")


CHAT_SCORES_SQL = f"""
    m AS (SELECT *, conversation_id || '/' || data_holder AS file FROM ({EXPORTS_SQL})),
    s AS (SELECT DISTINCT file AS label, strftime(date, '%d-%m-%Y %H:%M') || message AS element FROM m WHERE length(message) >= 30 AND sender <> ''),
    n AS (SELECT label, count(*) AS n FROM s GROUP BY label),
    c AS (SELECT x.label AS a, y.label AS b, count(*) AS common FROM s x JOIN s y ON x.element = y.element AND x.label <> y.label GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n p ON a = p.label JOIN n q ON b = q.label WHERE common / least(p.n, q.n) > 0.1)"""


@query(f"""WITH RECURSIVE {CHAT_SCORES_SQL},
    r(node, low) AS (SELECT DISTINCT file, file FROM m UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node)
    SELECT node AS file, min(low) AS component FROM r GROUP BY node""")  # fmt: skip
def chat_groups(spark, sf_dir):
    rows = exports(spark, sf_dir).withColumn("file", F.concat_ws("/", F.col("conversation_id").cast("string"), "data_holder"))
    return grouping.chat_groups(rows)


@query(f"""WITH RECURSIVE m AS ({EXPORTS_SQL}),
    s AS (SELECT DISTINCT conversation_id AS c, data_holder AS h, sender AS l, message AS element FROM m WHERE length(message) >= 10 AND sender <> ''),
    n AS (SELECT c, h, l, count(*) AS n FROM s GROUP BY ALL),
    k AS (SELECT x.c, x.h AS ha, x.l AS la, y.h AS hb, y.l AS lb, count(*) AS common FROM s x JOIN s y ON x.c = y.c AND x.element = y.element AND (x.h, x.l) <> (y.h, y.l) GROUP BY ALL),
    e AS (SELECT k.* FROM k JOIN n p ON k.c = p.c AND ha = p.h AND la = p.l JOIN n q ON k.c = q.c AND hb = q.h AND lb = q.l WHERE common / least(p.n, q.n) > 0.5),
    r(c, h, l, low) AS (SELECT DISTINCT conversation_id, data_holder, sender, data_holder || chr(1) || sender FROM m WHERE sender <> ''
        UNION SELECT r.c, e.hb, e.lb, r.low FROM r JOIN e ON e.c = r.c AND e.ha = r.h AND e.la = r.l)
    SELECT c AS conversation_id, h AS data_holder, l AS label,
           '{{"conversation_id":' || c || ',"data_holder":"' || split_part(min(low), chr(1), 1) || '","label":"' || split_part(min(low), chr(1), 2) || '"}}' AS component
    FROM r GROUP BY c, h, l""")  # fmt: skip
def author_groups(spark, sf_dir):
    return grouping.author_groups(exports(spark, sf_dir))


#: A sentence for each rule: what is said of customer a, nation n and topics t and f, and which of them the rule finds.
SAID = [
    ("{a} heeft deze groep aangemaakt", "a"),
    ('{a} heeft de groep "{t}" aangemaakt', "at"),
    ('{a} created group "{t}"', "at"),
    ("{a} heeft {n} toegevoegd", "an"),
    ("{n} neemt deel via {a} uitnodiging", "an"),
    ("{a} added {n}", "an"),
    ("{a} heeft {n} verwijderd", "an"),
    ("{n} is toegevoegd", "n"),
    ("{n} is deelnemer geworden via de uitnodigingslink van deze groep", "n"),
    ("{n} heeft de groep verlaten", "n"),
    ("{n} left", "n"),
    ("{n} is verwijderd", "n"),
    ("{a} heeft de groepsafbeelding gewijzigd", "a"),
    ("{a} bent nu een beheerder", "a"),
    ('{a} heeft het onderwerp gewijzigd naar "{t}"', "at"),
    ('{a} heeft het onderwerp gewijzigd van "{f}" naar "{t}"', "atf"),
    ("{a} heeft het onderwerp gewijzigd", "a"),
    ("{n} joined using {a} invite", "an"),
    ("{n} heeft berichten met vervaldatum ingeschakeld. Nieuwe berichten verdwijnen na 7 dagen uit deze chat.", "nd"),
    ("{n} heeft berichten met vervaldatum uitgeschakeld.", "n"),
    ("{n} heeft een nieuw telefoonnummer. Tik om een bericht te sturen of om het nieuwe nummer toe te voegen.", "n"),
]
PARTS_SQL = {"a": "a", "n": "n", "t": "t", "f": "f", "admin": "a", "name": "n", "to_topic": "t", "from_topic": "f", "duration": "'7 dagen'"}


def _filled_sql(sentence: str) -> str:
    return " || ".join(PARTS_SQL[x[1:-1]] if x.startswith("{") else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{\w+\})", sentence) if x)


def _said_sql(value: Callable[[int], str | None]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k in range(1, 22) if (v := value(k)) is not None) + " END"


SPOKEN_SQL = """SELECT c_custkey, c_custkey % 21 + 1 AS k, c_name AS a, n_name AS n, 'topic ' || c_custkey AS t, 'from ' || c_nationkey AS f
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _spoken(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", (F.col("c_custkey") % 21 + 1).alias("k"), F.col("c_name").alias("a"), F.col("n_name").alias("n"), F.concat(F.lit("topic "), F.col("c_custkey").cast("string")).alias("t"), F.concat(F.lit("from "), F.col("c_nationkey").cast("string")).alias("f"))
    said = F.coalesce(*[F.when(F.col("k") == k, F.concat(*[F.col(x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", sentence) if x])) for k, (sentence, _) in enumerate(SAID, 1)])
    return rows.select("c_custkey", said.alias("message"), F.lit("H").alias("data_holder"))


@query(f"""SELECT c_custkey, {_said_sql(lambda k: _filled_sql(SAID[k - 1][0]))} AS message, CAST(k AS INT) AS rule,
    {_said_sql(lambda k: "a" if "a" in SAID[k - 1][1] else None)} AS admin, {_said_sql(lambda k: "n" if "n" in SAID[k - 1][1] else None)} AS name,
    {_said_sql(lambda k: "t" if "t" in SAID[k - 1][1] else None)} AS to_topic, {_said_sql(lambda k: "f" if "f" in SAID[k - 1][1] else None)} AS from_topic,
    CASE k WHEN 19 THEN '7 dagen' END AS duration, k NOT IN (14, 19, 20, 21) AS use_for_mapping,
    {_said_sql(lambda k: _filled_sql(announcements.RULES[k - 1].sentence))} AS canonical FROM ({SPOKEN_SQL})""")  # fmt: skip
def announce_rules(spark, sf_dir):
    told = announcements.extract(_spoken(spark, sf_dir))
    return told.select("c_custkey", "message", "rule", "admin", "name", "to_topic", "from_topic", "duration", "use_for_mapping", announcements.canonical().alias("canonical"))


@query("""WITH t AS (SELECT p_partkey % 7 AS conversation_id, p_size AS minute, 'H' || p_partkey % 3 AS data_holder, p_brand AS label FROM part),
    once AS (SELECT conversation_id, minute FROM t GROUP BY ALL HAVING count(*) = count(DISTINCT data_holder))
    SELECT DISTINCT conversation_id, minute, data_holder, label FROM t JOIN once USING (conversation_id, minute)""")  # fmt: skip
def announced_labels(spark, sf_dir):
    """Labels that stand for one contact, as every holder has the announcement once."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("conversation_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, p_size, 0)").alias("date"), F.concat(F.lit("H"), (F.col("p_partkey") % 3).cast("string")).alias("data_holder"), F.concat("p_brand", F.lit(" left")).alias("message"), "p_size")
    told = announcements.extract(rows)
    minutes = told.select("conversation_id", F.sha2(F.concat_ws("|", "conversation_id", F.col("date").cast("string"), "template", F.lit("name")), 256).alias("group_id"), F.col("p_size").alias("minute")).distinct()
    return announcements.label_groups(told).join(minutes, ["conversation_id", "group_id"]).select("conversation_id", "minute", "data_holder", "label")


WINDOW = ("2024-01-01 06:00:00", "2024-03-01 00:00:00")


@query(ALIGNED_SQL + f""", m AS (SELECT conversation_id, message_media, arg_min(message, (data_holder, original_order)) AS message FROM e GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY date) - 1 AS position FROM a)
    SELECT p.conversation_id, position, date, sender, coalesce(message, '') AS message, '' AS media, sources, false AS unknown_order, '' AS media_to, CAST(NULL AS VARCHAR) AS hash
    FROM p LEFT JOIN m ON p.conversation_id = m.conversation_id AND p.message_media IS NOT DISTINCT FROM m.message_media
    WHERE date > TIMESTAMP '{WINDOW[0]}' AND date <= TIMESTAMP '{WINDOW[1]}'""")  # fmt: skip
def reconcile(spark, sf_dir):
    """Exports whose holders call people by labels of their own, brought back to one table."""
    e = exports(spark, sf_dir).withColumn("message", F.coalesce("message", F.lit("")))
    label = F.when(F.col("data_holder") == "B", F.concat("sender", F.lit(" (B)"))).when(F.col("data_holder") == "C", F.concat(F.lit("+31 "), F.length("sender").cast("string"))).otherwise(F.col("sender"))
    roles = e.select("sender").distinct()
    contacts = roles.select(F.col("sender").alias("canonical"), F.lit("B").alias("data_holder"), F.concat("sender", F.lit(" (B)")).alias("label"))
    book = roles.select(F.concat(F.lit("+31"), F.length("sender").cast("string")).alias("number"), F.col("sender").alias("name"))
    start, end = (F.expr(f"timestamp_ntz'{x}'") for x in WINDOW)
    return flows.reconcile(e.withColumn("sender", label).drop("message_media"), contacts, book, start=start, end=end)
