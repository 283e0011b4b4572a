"""Sharding by proportional stratified interleaving (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_ranks, hash01, write_table

#: Buckets a source is ranked in; a source with a third of all rows is spread over all of them.
RANK_BITS = 12


def interleave(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Deal rows into shards whose mixture of sources matches the corpus.

    Rows of each source are put in a seeded random order; row r of n gets the
    fractional rank (r + phase) / n with a phase seeded by the source; all rows
    are sorted by it and cut into `n_shards` runs of equal count (at most one
    row apart).  Both ranks are exact and are counted in hash buckets, so no
    source is ever gathered in one task.

    Returns (id, size, text_crc32, source, shard, slot); `size` is the text's
    UTF-8 bytes plus 1 and `slot` counts from 0 without gaps in each shard.
    A null text has size 1 and the checksum of the empty text; a null source
    is a source of its own; equal rows are kept, all of them; an empty table
    gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slim = slim.withColumn("_g", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")))
    slim = slim.withColumn("_h", F.xxhash64(F.lit(seed), "id", "size", "text_crc32"))  # one id may be that of many rows
    slim = write_table(slim.withColumn("_b", F.shiftrightunsigned("_h", 64 - RANK_BITS)), "shard-rows")
    within = bucket_ranks(slim, ["_g"], "_b", ["_h", "id", "size", "text_crc32"], "_r", "_n")
    phase = hash01(F.lit(seed), F.col("_g"))
    within = within.withColumn("_f", (F.col("_r") + phase) / F.col("_n"))
    within = within.select(
        "id", "source", "size", "text_crc32", "_g", "_r", "_f",
        F.least(F.floor(F.col("_f") * (1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).alias("_b"),
    )
    within = write_table(within, "shard-ranks")
    placed = bucket_ranks(within, [], "_b", ["_f", "_g", "_r"], "_pos", "_all")
    shard = F.expr(f"(_pos * {n_shards}) div _all")
    return placed.withColumn("shard", shard).select(
        "id",
        "size",
        "text_crc32",
        "source",
        F.col("shard").cast("int").alias("shard"),
        (F.col("_pos") - F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as one folder per shard, sorted by slot.  Ids must be unique and not null.

    Columns `shard` and `slot` of `docs` are replaced.
    """
    keyed = docs.drop("shard", "slot").join(placed.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    keyed.repartition("shard", F.pmod(F.col("slot"), F.lit(64))).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 7 under the law `rows`."""
    placed = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
