"""Benchmark decontamination with a hash set of test n-grams (operator 10). DataFrame functions only.

Each window of 13 consecutive benchmark words has one rare word as its anchor (its longest).
The set of anchors is tested against every word of every document inside the scan;
where it hits, the words around are compared with the windows that have this anchor,
so a hit is verified word by word. Only hits leave the scan's tasks.

The set and the windows are broadcast. Their number is checked first: a benchmark with
more than ``max_windows`` windows is split into hash slices of about that many,
each scanned in its own pass, with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ascii_lower, free_name, materialize, row_key

WINDOW = 13
MAX_WINDOWS = 100_000
# Fixed value: what is not a word. The word pattern after lower-casing is
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; A-Z are letters here because they are lower-cased later.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in order, in their own case; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item``, ``window`` (lower-cased words joined by a space), ``len``, ``anchor``, ``shift`` (of the anchor in the window).

    An item shorter than a window, but not empty, is one window. A null item id reads as the text ``null``.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words_of(ascii_lower(F.col(text_col))).alias("w")
    ).where(F.size("w") > 0)
    cut = items.select(
        "item",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, F.lit(window)))
        ).alias("w"),
    ).distinct()
    rare = F.array_max(F.transform("w", lambda w, i: F.struct(F.length(w).alias("l"), (-i).alias("i"), F.lower(w).alias("a"))))
    return cut.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len"), rare.alias("r")).select(
        "item", "window", "len", F.col("r.a").alias("anchor"), (-F.col("r.i")).alias("shift")
    )


def _key(id_col: str, text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return row_key(F.col(id_col), F.concat_ws("/", F.xxhash64(text), F.octet_length(text)))


def _near_anchors(docs: DataFrame, anchors: list[str], window: int) -> DataFrame:
    """Where a word of a document is an anchor: its place, and the words around it."""
    if anchors:
        listed = ", ".join("'" + a + "'" for a in anchors)  # a word holds no quote and no backslash
        places = F.expr(f"filter(transform(_w, (w, i) -> if(lower(w) IN ({listed}), i, -1)), i -> i >= 0)")
    else:
        places = F.array().cast("array<int>")
    before = lambda p: F.least(p, F.lit(window - 1))
    near = F.transform(
        "_at",
        lambda p: F.struct(
            p.alias("at"),
            before(p).alias("before"),
            F.lower(F.element_at("_w", p + 1)).alias("anchor"),
            F.slice("_w", p - before(p) + 1, F.lit(2 * window - 1)).alias("near"),
        ),
    )
    return docs.withColumn("_at", places).withColumn("_near", near)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``key`` and ``runs`` (word places: from, to).

    A word inside any occurrence of a window is hit; contaminated: n_hit > 0 and share * n_hit >= n_words.
    Null text has no words. Rows that repeat id and text are judged once and returned as often as
    they occur. An empty benchmark hits nothing; an empty table gives an empty result. Other
    columns are not read.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    slices = max(1, math.ceil(windows.count() / max_windows))
    docs = df.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("_w"))
    out = None
    for k in range(slices):
        own = windows.where(F.pmod(F.hash("item", "window"), F.lit(slices)) == k)
        found = _near_anchors(docs, sorted(r[0] for r in own.select("anchor").distinct().collect()), window)
        # One row for the document itself, with c null, and one for each place.
        found = found.select("id", "key", F.size("_w").alias("n_words"), F.explode(F.concat(F.array(F.lit(None)), F.col("_near"))).alias("c"))
        first = F.col("c.before") - F.col("shift") + 1
        same = ascii_lower(F.array_join(F.slice("c.near", F.greatest(first, F.lit(1)), F.col("len")), " "))
        at = F.col("c.at") - F.col("shift")
        hit = (first >= 1) & (same == F.col("window"))
        hits = found.join(F.broadcast(own), F.col("c.anchor") == F.col("anchor"), "left").select(
            "id",
            "key",
            "n_words",
            F.when(F.col("c").isNull() & F.lit(k == 0), 1).alias("row"),
            F.when(hit, F.struct(at.alias("from"), (at + F.col("len")).alias("to"))).alias("run"),
            F.when(hit, F.col("item")).alias("item"),
        )
        hits = hits.where("row is not null or run is not null")
        out = hits if out is None else out.unionByName(hits)
    judged = out.groupBy("key").agg(
        F.max("id").alias("id"),
        F.count("row").alias("_copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.array_sort(F.collect_set("item")).alias("_items"),
    )
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(r["to"] - F.greatest(r["from"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], r["to"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    judged = judged.withColumn("n_hit", covered).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "key",
        "runs",
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **rule) -> DataFrame:
    """``df`` without its contaminated documents, or (``remove="spans"``) with the hit words taken out of their texts.

    With spans, a contaminated text becomes its remaining words joined by one space; other rows stay as they are.
    Null texts stay; repeated rows go or stay together; an empty table stays empty. No column name clashes.
    """
    key, runs = free_name(df, "item_key"), free_name(df, "item_runs")
    found = contamination(df, benchmark, id_col, text_col, **rule).where("contaminated")
    found = materialize(found.select(F.col("key").alias(key), F.col("runs").alias(runs)).dropDuplicates([key]), "contaminated")
    keyed = df.withColumn(key, _key(id_col, text_col))
    if remove == "documents":
        return keyed.join(found, key, "left_anti").select(*df.columns)
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove}")
    places = F.transform(words_of(F.col(text_col)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    left = F.filter(places, lambda x: ~F.exists(runs, lambda r: (x["i"] >= r["from"]) & (x["i"] < r["to"])))
    cut = F.array_join(F.transform(left, lambda x: x["w"]), " ")
    return keyed.join(found, key, "left").withColumn(text_col, F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(cut)).select(*df.columns)
