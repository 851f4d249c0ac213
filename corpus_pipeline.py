"""A training corpus in stages, each of which reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.shipping import ship
from chorale.functions.storage import materialize
from chorale.llm import near_join, packing, quality, toxicity
from chorale.llm.queries import table, tokenizer_path

#: The learned stages and the similarity join have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of this stage's documents, takes for clean.

    A row is judged by its own text alone, so rows of null or repeated ids and repeated rows stay or
    go one by one. Null and empty texts have the score of the bias; words of long texts count once.
    Equal texts fare alike. Without labels of both classes every text has that class's label, and
    without any all are kept. All columns pass through; an empty table stays empty.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null, empty and short texts fail the base rules; texts of any length are read whole. Rows are
    judged one by one, whatever their ids, and equal texts fare alike. Without labels only the base
    rules decide. All columns pass through; an empty table stays empty.
    """
    ship(spark)
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.kept(F.col("text"), rules))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents, one row: that of the lowest id, null ids last, then the first.

    Rows are told apart by number, so those of null or repeated ids each stay unless their texts are
    linked. Null and empty texts are copies of each other. All columns pass through, whatever their
    names; an empty table stays empty.
    """
    ship(spark)
    row = near_join.row_name(docs.columns)
    rows = near_join.numbered(docs, row)
    classes = near_join.near_join(rows, id_col=row, n=5, similarity=0.8, row_col=row).select(row, "class_id")
    ids = rows.select(F.col(row).alias("class_row"), "doc_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("class_row").alias("row"))
    least = ids.join(classes, ids["class_row"] == classes[row]).groupBy("class_id").agg(F.min(order).alias("least"))
    return rows.join(least.select(F.col("least.row").alias(row)), row, "left_semi").drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens.

    A null or empty text is one piece of one token; long ones are cut. Repeated rows are packed as
    often as they occur, null ids too; columns other than id and text are not read; an empty table
    gives no rows.
    """
    ship(spark)
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_copies),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
