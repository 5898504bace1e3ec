"""Sharding by a global prefix sum of byte sizes.

Rows are range-partitioned by id, each partition gives one total, the running sum of
the totals gives each partition its place, and the targets ``total * k / n_shards`` cut
the line of bytes into contiguous shards. A row goes where its middle byte lies, so a
shard misses its target by less than one row at each end. Only ids, sizes and checksums
are shuffled, never texts; only the totals, one row for each partition, and the first
row of each shard are broadcast.

Null texts count as empty. Null ids come first. Rows with equal ids are ordered by
checksum and size; rows equal in all three are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import quoted, settled

#: Bytes added to the size of each text.
ROW_BYTES = 8


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def contiguous_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): slot counts the rows of a shard from 0, in order of id."""
    rows = docs.select(
        F.col(quoted(id_col)).alias("_id"),
        byte_size(F.col(quoted(text_col))).alias("size"),
        F.crc32(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["_id", "text_crc32", "size"]
    placed = settled(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy("seq")
    lined = (
        placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "part")
        .select(
            *order,
            (F.col("rows_before") + F.col("nth") - 1).alias("row"),
            # twice the place of the row's middle byte, in exact decimals
            F.expr(
                f"cast(floor((2 * (bytes_before + upto) - size) * cast({n_shards} as decimal(10, 0)) / (2 * all_bytes)) as int)"
            ).alias("shard"),
        )
    )
    firsts = lined.groupBy("shard").agg(F.min("row").alias("first_row"))
    return lined.join(F.broadcast(firsts), "shard").select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
