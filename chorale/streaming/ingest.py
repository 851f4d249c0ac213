"""New exports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chorale.operators import parsing
from chorale.sources import exports


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the messages of exports that are new below ``root`` to the table at ``target``, then stops.

    The file source remembers in ``checkpoint`` what it has read. Formats are inferred export by
    export, so a batch needs nothing of the batches before; a batch that runs again replaces its own
    part of the table, ``batch=N``, and leaves no message twice.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,zip}").load(root)

    def append(batch: DataFrame, number: int) -> None:
        lined = parsing.lines(exports._read(batch).where("body is not null"))
        chats = parsing.infer_formats(lined)
        messages = parsing.messages(lined, chats.withColumn("data_holder", exports.data_holder(chats["file"])))
        messages.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
