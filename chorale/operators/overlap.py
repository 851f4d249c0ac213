"""Overlap coefficients of sets, by an inverted index instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chorale.functions.joins import join_totals
from chorale.functions.storage import materialize


def overlap_scores(elements: DataFrame, label: str, element: str, decimals: int | None = None, block: int = 200, block_sets: int = 1_000) -> DataFrame:
    """a, b, common, score of every two labels (a < b) that share an element.

    The score is the size of the intersection over the smaller set's size, rounded where ``decimals``
    is given. Labels that share the same elements with others are a class. The classes of an element
    meet in pairs of blocks of ``block_sets``, and what they share with the class of the lower number
    is sent to where that is as lists of numbers and counted there, once for all their labels. Only
    then labels are paired, in blocks of about ``block`` of a class, each class pair carrying the
    smaller one's labels to the larger one's. So pairs of labels are made where they are returned; none
    is shuffled. The few rows that become many pairs are dealt to as many tasks as exchanges have, as
    by their bytes they would go to a handful.
    """
    spark = elements.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = materialize(_ranked(elements, label, element), "ranked")
    classes = ranked.groupBy("all").agg(F.count("*").alias("m"))
    classes = materialize(classes.withColumn("class", _number("m")), "classes")
    member = join_totals(ranked, classes, "all", "m", ranked.count())
    member = member.select("class", _dealt("label", _blocks(F.col("m"), block)).alias("part"), "n", "label")
    blocks = materialize(member.groupBy("class", "part", "n").agg(F.collect_list("label").alias("labels")), "blocks")
    held = classes.select("class", F.explode("all").alias("element")).groupBy("element").agg(F.sort_array(F.collect_list("class")).alias("held"))
    last = _blocks(F.size("held"), block_sets) - 1
    cells = held.select("held", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i")).select("held", "i", F.explode(F.sequence("i", "last")).alias("j"))
    cells = cells.select(F.slice("held", F.col("i") * block_sets + 1, block_sets).alias("mine"), F.slice("held", F.col("j") * block_sets + 1, block_sets).alias("others"), (F.col("i") == F.col("j")).alias("own")).repartition(tasks)
    lists = cells.select("others", "own", F.posexplode("mine").alias("at", "x"))
    lists = lists.select("x", F.when(F.col("own"), F.slice("others", F.col("at") + 1, block_sets)).otherwise(F.col("others")).alias("ys"))
    pairs = lists.repartition(tasks, "x").select("x", F.explode("ys").alias("y")).groupBy("x", "y").agg(F.count("*").alias("common"))
    large = classes.where(F.col("m") > block).select(F.col("class").alias("y"), _blocks(F.col("m"), block).alias("parts"))  # one in ``block`` labels at most
    pairs = pairs.join(F.broadcast(large), "y", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine = blocks.select(F.col("class").alias("x"), F.col("n").alias("nx"), F.col("labels").alias("labels_x"))
    pairs = pairs.join(mine.hint("shuffle_hash"), "x").select("y", "part", (F.col("x") == F.col("y")).alias("same"), "common", "nx", "labels_x")
    others = blocks.select(F.col("class").alias("y"), "part", F.col("n").alias("ny"), F.col("labels").alias("labels_y"))
    pairs = pairs.join(others.hint("shuffle_hash"), ["y", "part"])
    score = F.col("common") / F.least("nx", "ny")
    scored = pairs.select("same", "labels_x", "labels_y", "common", (score if decimals is None else F.round(score, decimals)).alias("score"))
    scored = scored.select("same", F.explode("labels_x").alias("x"), "labels_y", "common", "score").select("same", "x", F.explode("labels_y").alias("y"), "common", "score")
    return scored.where("not same or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "score")


def _number(rows: str) -> Column:
    """A number for each row, the higher the higher ``rows`` is; rows over 4,095 count as that many."""
    return F.shiftleft(F.least(F.col(rows), F.lit(4_095)), 51).bitwiseOR(F.monotonically_increasing_id())


def _blocks(rows: Column, block: int) -> Column:
    return F.ceil(rows / block).cast("int")


def _dealt(key: str, blocks: Column) -> Column:
    """The block of a key, by a hash with a word of its own, as exchanges deal rows by the plain one."""
    return F.pmod(F.xxhash64(F.lit("block"), key), blocks).cast("int")


def linked(scores: DataFrame, threshold: float) -> DataFrame:
    """Edges src, dst of pairs whose score is over the threshold."""
    return scores.where(F.col("score") > threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def links(elements: DataFrame, label: str, element: str, threshold: float) -> DataFrame:
    """Edges src, dst whose components are those of all pairs of labels with a score over the threshold.

    Labels of equal sets are tied to their lowest, which alone is compared. A set of n elements that
    scores over the threshold with one as large or larger shares some number of elements with it, the
    least k of which k / n is over the threshold, so at least one of its n - k + 1 rarest: only those
    are looked up among the others' elements, and each candidate is verified on the whole sets. A very
    common element is among the rarest of few sets, so the pairs of those that only share it are never
    made. Elements of one set alone count among the rarest and for n, but are not kept.
    """
    ranked = materialize(_ranked(elements, label, element), "ranked")
    closed = ranked.where(F.col("n") == F.size("all"))  # others have an element of their own, so no equal set
    lowest = closed.groupBy("all").agg(F.min("label").alias("src"), F.count("*").alias("copies"))
    tied = join_totals(closed, lowest, "all", "copies", ranked.count())
    copies = tied.where(F.col("label") != F.col("src")).select("src", F.col("label").alias("dst"))
    single = ranked.where(F.col("n") > F.size("all")).unionByName(tied.where(F.col("label") == F.col("src")).select("label", "n", "all"))
    single = materialize(single, "sets")
    under = F.floor(threshold * F.col("n"))
    under = under - (under / F.col("n") > threshold).cast("int")  # as many common elements do not reach over the threshold
    rare = F.slice("all", 1, F.greatest(F.lit(0), F.size("all") - under).cast("int"))
    a = single.select(F.col("label").alias("a"), F.col("n").alias("na"), F.explode(rare).alias("element"))
    b = single.select(F.col("label").alias("b"), F.col("n").alias("nb"), F.explode("all").alias("element"))
    candidates = a.join(b, "element").where((F.col("nb") > F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("b") > F.col("a"))).select("a", "b").distinct()
    whole = candidates.join(single.select(F.col("label").alias("a"), F.col("all").alias("ea"), "n"), "a").join(single.select(F.col("label").alias("b"), F.col("all").alias("eb")), "b")
    found = whole.where(F.size(F.array_intersect("ea", "eb")) / F.col("n") > threshold)
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(copies)


def _ranked(elements: DataFrame, label: str, element: str) -> DataFrame:
    """label, n, all: of every set that shares an element with another, its size and its shared elements, rarest first.

    Shared elements are numbers. Strings are told apart by 128 bits of their SHA-256, so that long
    ones are neither shuffled nor written.
    """
    name = F.col(element)
    if isinstance(elements.schema[element].dataType, StringType):
        name = F.unhex(F.substring(F.sha2(name.cast("binary"), 256), 1, 32))
    sets = elements.select(F.col(label).alias("label"), name.alias("element")).where("label is not null and element is not null").distinct()
    sets = materialize(sets, "elements")
    shared = sets.groupBy("element").agg(F.count("*").alias("df")).where("df > 1").withColumn("number", F.monotonically_increasing_id())
    shared = materialize(shared, "shared")
    held = join_totals(sets, shared, "element", "df", sets.count())
    held = held.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("df", "number"))).alias("ranked"))
    held = held.select("label", F.transform("ranked", lambda x: x["number"]).alias("all"))
    return sets.groupBy("label").agg(F.count("*").alias("n")).join(held, "label").select("label", "n", "all")
