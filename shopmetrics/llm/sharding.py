"""Proportional stratified interleaving into shards (operator 4). DataFrame functions only.

Rows of each source are put in a seeded order; a row's fractional rank is its place in
that order over the size of its source. Sorted by fractional rank, every stretch of
rows holds the sources in the proportion of the whole, so equal cuts give shards
that all match the mixture, with row counts at most one apart.

No source and no stretch is ranked in one task: places are counted per bucket of the
order (a fixed number of hash or rank ranges), buckets get running offsets, and
only rows of one bucket are numbered together. Texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialize

BUCKETS = 4096
ROW_BYTES = 16


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: its place from 0 in the order (bucket, *order*) of its group, and ``name_of``: the group's size."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "bucket-counts")
    upto = Window.partitionBy(*group).orderBy(bucket) if group else Window.partitionBy(F.lit(0)).orderBy(bucket)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(*group, bucket, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_of"))
    own = Window.partitionBy(*group, bucket).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(own))
    return placed.join(offsets, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_before", "_place")


def stratified_shards(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "0",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``text_crc32``, ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in its shard).

    Order within a source: md5 of seed and id. Null ids read as an empty id, null sources
    are one source, null texts have size 16 and checksum 0. Ties (one id several times)
    are put in order by size and checksum; rows equal in all of these are alike, so
    whichever comes first the result is the same. Fewer rows than shards: the
    shards that get one are spread out, the rest is empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
        F.col(source_col).alias("source"),
        (F.length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("_mix"),
    )
    rows = materialize(rows, "shard-rows")
    order = ["_mix", "id", "size", "text_crc32"]
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_mix", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
    ranked = _numbered(rows, ["_source"], "_bucket", order, "rank").drop("_bucket")
    share = (F.lit(2) * F.col("rank") + F.lit(1)).cast("double") / (F.lit(2) * F.col("rank_of")).cast("double")
    ranked = ranked.withColumn("_share", share).withColumn("_bucket", F.floor(F.col("_share") * buckets).cast("int"))
    ranked = materialize(ranked, "shard-ranks")
    placed = _numbered(ranked, [], "_bucket", ["_share", "_mix", "_source", "id", "size", "text_crc32"], "place")
    return placed.select("id", "source", "size", "text_crc32", *cut("place", "place_of", n_shards)).withColumnRenamed("id", id_col)


def cut(place: str, total: str, n_shards: int) -> list[Column]:
    """Equal cuts: shard k begins at place ceil(k * total / n_shards)."""
    shard = F.expr(f"({place} * {n_shards}) div {total}")
    begin = F.expr(f"((({place} * {n_shards}) div {total}) * {total} + {n_shards} - 1) div {n_shards}")
    return [shard.cast("int").alias("shard"), (F.col(place) - begin).cast("long").alias("slot")]
