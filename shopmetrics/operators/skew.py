"""Joins of rows to one row per key where a few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 10_000  # counters of the frequency sketch
MOST_HEAVY = 100
NOWHERE = 1000


def heavy_keys(facts: DataFrame, key: str, share: float = 0.005) -> dict[str, int]:
    """Keys that may hold at least ``share`` of the rows with a key, and how many parts to spread each over.

    A frequency sketch with ``TRACKED`` counters, merged over tasks, overcounts a key by at most a few 1 / ``TRACKED`` of the rows,
    so at a share well above that none is missed. At most ``MOST_HEAVY`` keys come to the driver. A key gets a part for
    each half of ``share`` that it holds.
    """
    row = facts.where(F.col(key).isNotNull()).agg(F.count(key).alias("rows"), F.expr(f"approx_top_k(`{key}`, {MOST_HEAVY}, {TRACKED})").alias("top")).first()
    return {t["item"]: max(2, -(-2 * t["count"] // max(1, int(share * row["rows"])))) for t in row["top"] or [] if t["count"] >= share * row["rows"]}


def spread_join(facts: DataFrame, ones: DataFrame, key: str, spread_by: str, heavy: dict[str, int] | None = None, how: str = "inner") -> DataFrame:
    """``facts`` joined to ``ones`` on ``key`` (inner or left), the rows of heavy keys dealt over several parts.

    The rows of a heavy key are told apart by a hash of ``spread_by``; its row in ``ones`` is repeated for each part. The result is that
    of the plain join; NULL keys match nothing. Which keys are heavy is found by ``heavy_keys`` unless given, and
    only moves rows between tasks.
    """
    heavy = heavy_keys(facts, key) if heavy is None else heavy
    if not heavy:
        return facts.join(ones, key, how)
    part = next(n for n in (f"part{k or ''}" for k in range(len(facts.columns) + len(ones.columns) + 1)) if n not in (*facts.columns, *ones.columns))
    parts = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])[F.col(key)]
    # Rows without a key match nothing; a left join keeps them, and they may go anywhere.
    dealt = facts.withColumn(part, F.coalesce(F.pmod(F.xxhash64(spread_by), F.when(F.col(key).isNull(), NOWHERE).otherwise(parts)).cast("int"), F.lit(0)))
    repeated = ones.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts - 1, F.lit(0)).cast("int"))))
    return dealt.join(repeated, [key, part], how).drop(part)
