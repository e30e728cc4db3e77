"""Exact dedup by deterministic block naming (operator 9). DataFrame functions only.

A text is normalised, cut into blocks of a fixed number of bytes, and the distinct
blocks are sorted into integer names. Adjacent names are paired, the distinct
pairs sorted into new names, and so on until one name is left: the identity.
Two texts have one identity if and only if they are equal; no hash decides it.

The block texts are shuffled once, combined per map task first, so a block that a
third of all rows hold arrives once per task. To look its name up, a block is sent
as a 64-bit checksum alone; a checksum that two different blocks share is found
when the names are made, and its blocks are looked up by content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import discard, free_name, materialize, row_key

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space. (A single space is such a run already, and is not matched.)"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _names(symbols: DataFrame, cols: list[str], level: int) -> DataFrame:
    """Each distinct symbol once, with an integer: its place in the sorted symbols of its partition.

    Written before use, so that all readers see the same names. The level is in the
    low six bits, which keeps the names of different levels apart.
    """
    named = symbols.groupBy(*cols).agg(F.count(F.lit(1)).alias("uses")).sortWithinPartitions(*cols)
    return named.withColumn("name", F.monotonically_increasing_id() * F.lit(64) + F.lit(level))


def text_identities(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, checksum_bits: int = 64
) -> DataFrame:
    """One row per input row: ``id``, ``text_sha256`` (of the normalised text), ``key`` (see ``row_key``), ``identity``, ``copies``.

    Rows that repeat both id and text come as one row with ``copies`` > 1. Null text is the
    empty text; a null id is an id of its own. Other columns of ``df`` are not read, so their
    names may clash with anything. An empty table gives an empty result. ``checksum_bits``
    below 64 makes checksums clash, which changes the cost, not the result.
    """
    body = F.col("_t").cast("binary")
    docs = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("_t"))
    blocks = docs.select(
        "id",
        F.sha2(body, 256).alias("text_sha256"),
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("_t") / F.lit(block_bytes)).cast("int") - 1, F.lit(0))),
            lambda i: F.substring(body, i * block_bytes + 1, F.lit(block_bytes)),
        ).alias("blocks"),
    )
    blocks = blocks.select("id", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    checksum = F.xxhash64("block")
    if checksum_bits < 64:
        checksum = F.shiftrightunsigned(checksum, 64 - checksum_bits)
    blocks = blocks.withColumn("checksum", checksum).withColumn("key", row_key(F.col("id"), F.col("text_sha256")))
    keyed = materialize(blocks, "blocks")  # texts are normalised and hashed once; later readers leave the blocks' bytes out

    names = materialize(_names(keyed.select("checksum", "block"), ["checksum", "block"], 0).select("checksum", "name"), "block-names")
    by_checksum = names.groupBy("checksum").agg(F.count(F.lit(1)).alias("owners"), F.min("name").alias("name"))
    by_checksum = materialize(by_checksum, "block-checksums")
    clear = by_checksum.where("owners = 1").select("checksum", "name")
    parts = keyed.select("key", "id", "text_sha256", "n", "at", "checksum").join(clear, "checksum").drop("checksum")
    shared = by_checksum.where("owners > 1").select("checksum")
    if not shared.isEmpty():
        meant = keyed.join(shared, "checksum", "left_semi")
        own = materialize(_names(meant, ["checksum", "block"], 63).select("checksum", "block", "name"), "block-names-by-content")
        parts = parts.unionByName(meant.join(own, ["checksum", "block"]).drop("checksum", "block"))
    parts = materialize(parts, "block-parts")
    discard(keyed)  # as large as the texts, and not read again

    done = parts.where("n = 1").select("key", "id", "text_sha256", "name")
    finished, level = [done], 0
    parts = parts.where("n > 1")
    longest = parts.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level += 1
        half = F.floor(F.col("at") / 2).cast("int")
        pairs = parts.groupBy("key", half.alias("at")).agg(
            F.max("id").alias("id"),
            F.max("text_sha256").alias("text_sha256"),
            F.max("n").alias("n"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
            F.max("copies").alias("copies") if "copies" in parts.columns else F.count(F.when(F.col("at") % 2 == 0, 1)).alias("copies"),
        )
        pairs = materialize(pairs, f"block-pairs-{level}")
        own = materialize(_names(pairs, ["left", "right"], level).select("left", "right", "name"), f"pair-names-{level}")
        parts = pairs.join(own, ["left", "right"]).select(
            "key", "id", "text_sha256", F.ceil(F.col("n") / 2).cast("int").alias("n"), "at", "name", "copies"
        )
        parts = materialize(parts, f"block-parts-{level}")
        finished.append(parts.where("n = 1").select("key", "id", "text_sha256", "name", "copies"))
        parts = parts.where("n > 1")
        longest = (longest + 1) // 2
    single = finished[0].groupBy("key").agg(
        F.max("id").alias("id"), F.max("text_sha256").alias("text_sha256"), F.max("name").alias("name"), F.count(F.lit(1)).alias("copies")
    )
    out = single
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("name", "identity")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, checksum_bits: int = 64) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the smallest id stays; null ids come last (if all are
    null, ``keep_id`` is null and one of them stays). Rows that repeat both id and text
    count each in ``group_size``; one of them can stay.
    """
    rows = materialize(text_identities(df, id_col, text_col, block_bytes, checksum_bits), "text-identities")
    groups = rows.groupBy("identity").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups, "identity-groups")
    out = rows.join(groups, "identity").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id"))).alias("_first"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    )
    return out.select(id_col, "keep_id", "group_size", (F.col("_first") & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def keep_first_of_equals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns; exact repeats of a row that stays leave one.

    Null and empty texts are equal texts, of which one row stays. An empty table stays empty. No column name clashes.
    """
    # One key for the join and for exact repeats, so that texts are shuffled once for both.
    key = free_name(df, "key")
    marks = exact_dedup(df, id_col, text_col).where("kept").select(row_key(F.col(id_col), F.col("text_sha256")).alias(key))
    marks = materialize(marks.distinct(), "kept-texts")
    mine = df.withColumn(key, row_key(F.col(id_col), F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    # The marks grow with the corpus, so they are not broadcast at any size.
    return mine.join(marks.hint("merge"), key, "left_semi").dropDuplicates([key]).select(*df.columns)
