"""Screen a stream of passages against held-out texts: stateless stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variora.functions.text import dedup_key, shingles
from variora.operators.screening import contamination_index, hashed_index, met
from variora.storage import materialise


def clean_stream(passages: DataFrame, held_out: DataFrame, key: str, text: str = "text", n: int = 8) -> DataFrame:
    """(key, shingle) of the passages' shingles that the held-out texts have: what a batch's
    passages are dropped or flagged by. Any number of held-out shingles will do: a batch's
    shingles are joined with them by hash, in the plan that their size asks for."""
    own = passages.select(key, F.explode(shingles(dedup_key(F.col(text)), n)).alias("shingle"))
    return own.join(contamination_index(held_out, text, n), "shingle", "left_semi").select(key, "shingle")


def flag_batches(passages: DataFrame, held_out: DataFrame, path: str, checkpoint: str, key: str, text: str = "text", n: int = 8):
    """Start a query that appends every batch to ``path`` with ``contaminated`` added. ``key``
    tells a batch's passages apart. The held-out texts are indexed once, before the first batch;
    a batch of few large files is spread over all cores and met with the index by hashes."""
    index = materialise(hashed_index(held_out, text, n), "stream-index")
    hashes = materialise(index.select("h").distinct(), "stream-hashes")

    def write(batch: DataFrame, number: int) -> None:
        spread = batch.select(key, text).repartition(batch.sparkSession.sparkContext.defaultParallelism)
        hits = met(spread, index, hashes, key, text, n).select(F.col(key).alias("_hit"))
        flagged = batch.join(hits, batch[key] == hits["_hit"], "left").withColumn("contaminated", F.col("_hit").isNotNull()).drop("_hit")
        flagged.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
