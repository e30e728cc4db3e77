"""N-gram Jaccard join by a blocked sparse product of documents by n-grams (operator 6).

The rows of the incidence matrix are the distinct n-gram sets of the documents, its columns the n-grams
(64-bit hashes). Sizes bound what can pass: two sets of at most u n-grams that reach the threshold differ in at most
D(u) n-grams. The columns are therefore cut into a few more than D(u) hash blocks for each band of sizes; a pair that
passes is equal in one block at least. Rows that meet in a whole block, directly or over others, are a family, and
only rows of one family are multiplied: a block of the product takes a family (or two chunks of a large one), and the
overlaps are accumulated over all their n-grams. A single common n-gram, line or passage makes no family.

A block hands on only the links that connect its rows, not all pairs that pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .frames import discard, free_name, materialize, row_key, shuffle_width, utf8_view
from .wordhash import SKETCH, least_agreeing, minwise, mix, pieces, shingle_hashes, word_hashes

FLUSH = 1_000_000
BROADCAST_ROWS = 1_000_000  # of 8 bytes
BLOCK_BYTES = 16 << 20
MISS = 1e-9  # chance that the sketches of a pair that passes rule it out
MOST_TESTS = 50_000_000  # of sketches in one slice of a bucket
SLICE_ROWS = 1_000_000  # of a bucket's rows, tested together
PIECE = 1 << 20
TESTS_AT_ONCE = 1 << 16
BANDS = np.arange(60).reshape(10, 6)
BANDS = np.concatenate([BANDS, BANDS.reshape(6, 10).T])  # places of a sketch, six to a band


def most_different(sizes: int, percent: int) -> int:
    """In how many n-grams two sets of ``sizes`` together differ at most if 100 * overlap >= percent * union."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=65536)
def cuts_of(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(context, blocks, slack) that a set of this size takes part in.

    Bands of sizes are so wide that a partner is in the same or an adjacent band. Partners of a band meet in its
    context; partners of two adjacent bands, which are both near the bound between them, in the bound's.
    """
    first = 1
    while True:
        last = max(first, first * max(130, 10_000 // percent + 1) // 100)
        if size <= last:
            break
        first = last + 1
    found = [(2 * last, 2 * last)]
    if size * 100 >= percent * (last + 1):
        found.append((2 * last + 1, last + last * 100 // percent))
    if first > 1 and (first - 1) * 100 >= percent * size:
        found.append((2 * first - 1, first - 1 + (first - 1) * 100 // percent))
    out = []
    for context, sizes in found:
        if differ := most_different(sizes, percent):  # else only equal sets meet, and they are one row already
            empty = (differ + 1) * 1.3 * np.exp(-0.85 * (100 + percent) / (2 * (100 - percent)))  # blocks that are empty by chance
            slack = 1 + int(empty + 3 * empty**0.5)
            out.append((context, differ + 1 + slack, slack))
    return tuple(out)


def _cut(grams: np.ndarray, blocks: int, slack: int, context: int, again: bool = True) -> list[np.ndarray]:
    """Signatures of the blocks of one set.

    Two sets that pass agree in more than ``slack`` blocks, so one with at most that many empty blocks needs no
    signature for these. One with more gives each empty block the signatures of a second cut, by another hash, in the
    empty block's context.
    """
    place = grams if again else np.sort(mix(grams + np.uint64(0x2545F4914F6CDD1D)))
    edges = np.searchsorted(((place >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), np.arange(blocks + 1))
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(place ^ np.uint64(0x6A09E667F3BCC909)), out=total[1:])
    number = np.arange(blocks, dtype=np.uint64) + np.uint64(1)
    own = mix(total[edges[1:]] - total[edges[:-1]] + mix(number * np.uint64(0xBB67AE8584CAA73B) + np.uint64(context)))
    empty = edges[1:] == edges[:-1]
    out = [own[~empty]]
    if empty.sum() > slack:
        for inner in own[empty].tolist():
            out += _cut(grams, blocks, slack, inner, False) if again else [np.array([inner], np.uint64)]
    return out


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """Block signatures of one sorted set of n-grams; two sets that can pass share one at least, or are equal."""
    out = [np.empty(0, np.uint64)]
    for context, blocks, slack in cuts_of(len(grams), percent):
        out += _cut(grams, blocks, slack, int(mix(np.array([context], np.uint64))[0]))
    return np.concatenate(out)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, n-gram sets) of a batch, a piece at a time."""
    data, offsets = utf8_view(column)
    for first, last in pieces(offsets, PIECE):
        words, at = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, shingle_hashes(words, at, width)


def set_key(grams: np.ndarray) -> int:
    """64-bit identity of a set; 0 for the empty set only."""
    if not len(grams):
        return 0
    h = mix(np.array([mix(grams ^ np.uint64(0x3C6EF372FE94F82B)).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64))
    return int(h.view(np.int64)[0]) or 1


def packed_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Four bits of each minwise token of non-empty sets, 16 tokens to a word."""
    nibbles = (minwise(sets) & np.uint64(15)).reshape(len(sets), SKETCH // 16, 16)
    return (nibbles << np.arange(0, 64, 4, dtype=np.uint64)).sum(2, dtype=np.uint64)


def band_signatures(sketches: np.ndarray) -> np.ndarray:
    """Signatures of the bands of each sketch, a row for each."""
    nibbles = ((sketches[:, :, None] >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15)).reshape(len(sketches), SKETCH)
    value = (nibbles[:, BANDS] << np.arange(0, 24, 4, dtype=np.uint64)).sum(2, dtype=np.uint64)
    return mix(value ^ mix(np.arange(1, len(BANDS) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave it open that two sets pass."""
    chance = percent / 100
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    return SKETCH - differ >= least_agreeing(chance + (1 - chance) / 16, MISS)


def alike_rows(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """``alike`` of the rows ``a`` with the rows ``b``, some at a time, as the sketches of all of them would fill the memory."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), TESTS_AT_ONCE):
        own = slice(at, at + TESTS_AT_ONCE)
        out[own] = alike(sketches[a[own]], sketches[b[own]], percent)
    return out


def tested_meetings(group: np.ndarray, row: np.ndarray, sketches: np.ndarray, percent: int, most: int = MOST_TESTS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect, within each group, all rows whose sketches are alike (not all such pairs).

    ``group`` is sorted. In each round one row of every group is held against the whole group, for all groups at once. The
    first one's star is the group's main part; a later star that touches it joins it. Rows outside the main part are
    each held against all, so two rows that stay apart have been tested. Past ``most`` tests the groups that are
    left are connected untested, which only makes a family larger.
    """
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    row = row[np.repeat(size > 1, size)]
    group = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    main, held = np.zeros(len(group), bool), np.zeros(len(group), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    tests = 0
    while (~main & ~held).any():
        live = np.zeros(group[-1] + 1, bool)
        live[group[~main & ~held]] = True
        stay = live[group]
        group, row, main, held = group[stay], row[stay], main[stay], held[stay]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(group)))
        if tests > most:
            found.append((np.repeat(row[begin], size), row))
            break
        open_rows = np.flatnonzero(~main & ~held)
        pivots = open_rows[np.append(True, group[open_rows][1:] != group[open_rows][:-1])]
        pivot = np.repeat(row[pivots], size)
        near = alike_rows(sketches, pivot, row, percent)
        found.append((pivot[near], row[near]))
        touches = np.logical_or.reduceat(near & main, begin) if tests else np.ones(len(begin), bool)
        main |= near & np.repeat(touches, size)
        held[pivots] = True
        tests += len(row)
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def group_slices(both: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Sorted words (32 bits of group, 32 of row) in slices of about ``rows``; a group is never cut, so a larger one is a slice of its own."""
    at, low = 0, np.uint64(2**32 - 1)
    while at < len(both):
        last = at + rows
        if last < len(both):
            last = int(np.searchsorted(both, both[last] & ~low))
            if last <= at:
                last = int(np.searchsorted(both, both[at] | low, "right"))
        yield both[at:last]
        at = last


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches, if ``label`` was that and the rows ``a`` are linked with the rows ``b`` now."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def band_buckets(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the first band that the sketches of the rows ``a`` and ``b`` have in common; -1 if they have none."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), TESTS_AT_ONCE // len(BANDS)):
        own = slice(at, at + TESTS_AT_ONCE // len(BANDS))
        bands = band_signatures(sketches[a[own]])
        same = bands == band_signatures(sketches[b[own]])
        first = bands[np.arange(len(bands)), same.argmax(1)] % np.uint64(buckets)
        out[own] = np.where(same.any(1), first.astype(np.int64), -1)
    return out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[bytes, ...]]]:
    """The parts (signatures, keys, how many of each, sketches) of each bucket."""
    parts: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            parts.setdefault(row["bucket"], []).append((row["sig"], row["key"], row["many"], row["sketch"]))
    return parts


def shared_rows(both: np.ndarray) -> np.ndarray:
    """Of sorted words (see ``group_slices``) each once, without groups of one row."""
    both = both[np.append(True, both[1:] != both[:-1])]
    same = (both[1:] ^ both[:-1]) <= np.uint64(2**32 - 1)
    return both[np.append(same, False) | np.append(False, same)]


def bucket_links(both: np.ndarray, sketches: np.ndarray, percent: int, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Few links between the rows of a bucket, which with those of all other buckets connect what ``tested_meetings`` does.

    Near copies meet in most buckets, and each would hand their pair on. The bands of a set's sketch are among its
    signatures, so rows whose sketches are alike and have a band in common are connected in the bucket of the first such
    band, and the other buckets leave the pair out. What connects the rows of a band there has that band in common, or an
    earlier one too, so this ends at a bucket that hands a link on. Each bucket hands on a forest of its own pairs, which
    leans on no other bucket, and one of the pairs without a common band, between rows that are still apart after those
    with one. ``both`` are sorted words of signature and row (see ``group_slices``).
    """
    every = np.arange(len(sketches))
    own = banded = met = every
    for part in map(shared_rows, group_slices(both, SLICE_ROWS)):
        a, b = tested_meetings(part >> np.uint64(32), (part & np.uint64(2**32 - 1)).astype(np.int64), sketches, percent, MOST_TESTS)
        at = band_buckets(sketches, a, b, buckets)
        at[~alike_rows(sketches, a, b, percent)] = bucket  # connected untested
        mine, with_band = at == bucket, at >= 0
        own, banded, met = joined(own, a[mine], b[mine]), joined(banded, a[with_band], b[with_band]), joined(met, a, b)
    new = np.flatnonzero(own != every)
    apart = np.flatnonzero((banded == every) & (met != every))
    return np.concatenate([own[new], met[apart]]), np.concatenate([new, apart])


def product_links(sets: list[np.ndarray], percent: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows marked ``left`` and rows marked ``right`` that connect them (a spanning forest of all these links).

    A row of the product document x n-gram by n-gram x document is accumulated from the postings of the row's n-grams;
    entries that the sizes of the two rows rule out, or that fall short of the threshold, are discarded.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    order = order[right[row[order]]]  # postings hold the rows on the right only
    posting = row[order]
    first = np.searchsorted(column[order], np.arange(int(column.max()) + 2))
    begin = np.cumsum(size) - size
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for k in np.flatnonzero(left).tolist():
        own = column[begin[k] : begin[k] + size[k]]
        n = first[own + 1] - first[own]
        overlap = np.bincount(posting[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
        passes = right & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
        passes &= 100 * overlap >= percent * (size + size[k] - overlap)
        for other in np.flatnonzero(passes).tolist():
            if (x := root(k)) != (y := root(other)):
                parent[max(x, y)] = min(x, y)
                links.append((k, other))
    return links


def _multiplied(members: DataFrame, percent: int, buckets: int, most_bytes: int) -> DataFrame:
    """Links (a, b) within families: members (family, key, grams) in, links that connect all that are linked out.

    A family of at most ``most_bytes`` of n-grams is one block. A larger one is cut into bands of sizes, so wide that a
    partner is in the same or an adjacent band, and each band into chunks of about ``most_bytes``; each pair of chunks of
    one band or of two adjacent ones is a block, so that no task holds more than two chunks.
    """
    width = math.log(100 / percent) * 1.001  # a partner is at most one band away
    sized = members.withColumn("size_band", F.floor(F.log(F.length("grams") / 8) / width).cast("int"))
    bands = materialize(sized.groupBy("family", "size_band").agg(F.sum(F.length("grams")).alias("bytes"), F.count(F.lit(1)).alias("rows")), "family-bands")
    of_family = Window.partitionBy("family").orderBy("size_band")  # a row for each band, few in any family
    whole = F.sum("bytes").over(Window.partitionBy("family")) <= most_bytes

    def beside(step: int, name: str) -> Column:
        """The same of the adjacent band below or above; 0 if that band is empty."""
        other = F.lag if step < 0 else F.lead
        return F.when(other("size_band").over(of_family) == F.col("size_band") + step, other(name).over(of_family)).otherwise(0)

    plan = bands.withColumn("whole", whole).withColumn("chunks", F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("bytes") / most_bytes)).cast("int"))
    plan = plan.withColumns({f"{name}_{side}": F.when(F.col("whole"), 0).otherwise(beside(step, name)) for name in ("chunks", "rows") for side, step in (("below", -1), ("above", 1))})
    plan = plan.where("whole or rows + rows_below + rows_above > 1")
    plan = plan.select("family", "size_band", F.when(F.col("whole"), 0).otherwise(F.col("size_band")).alias("band"), "chunks", "chunks_below", "chunks_above")
    dealt = sized.join(materialize(plan, "family-chunks"), ["family", "size_band"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))

    def each(chunks: str, block) -> Column:
        return F.transform(F.when(F.col(chunks) > 0, F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)).otherwise(F.array().cast("array<int>")), block)

    def block(low: Column, step: int, i: Column, j: Column) -> Column:
        """Chunk ``i`` of the band ``low`` by chunk ``j`` of the same band (step 0) or of the one above (1)."""
        return F.struct(low.cast("int").alias("low"), F.lit(step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    band, chunk = F.col("band"), F.col("chunk")
    blocks = F.concat(
        each("chunks", lambda k: block(band, 0, F.least(k, chunk), F.greatest(k, chunk))),
        each("chunks_above", lambda k: block(band, 1, chunk, k)),
        each("chunks_below", lambda k: block(band - 1, 1, k, chunk)),
    )
    dealt = dealt.select("family", "key", "grams", "band", "chunk", F.explode(blocks).alias("b")).select("family", "b.*", "key", "grams", "band", "chunk")
    dealt = dealt.repartition(buckets, "family", "low", "step", "i", "j").sortWithinPartitions("family", "low", "step", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (_, low, step, i, j), own in groupby(rows, key=lambda r: (r["family"], r["low"], r["step"], r["i"], r["j"])):
            own = list(own)
            left = np.array([r["band"] == low and r["chunk"] == i for r in own])
            right = np.array([r["band"] == low + step and r["chunk"] == j for r in own])
            found = product_links([np.frombuffer(r["grams"], np.uint64) for r in own], percent, left, right)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([own[f[k]]["key"] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, block_bytes: int = BLOCK_BYTES, by_row: bool = False, sketches: bool = False) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``key`` (of its set).

    Two rows link when 100 * overlap >= percent * union of their sets of distinct word runs of ``width``; a text with
    fewer words is one run; a null text, or one without words, is empty and links with nothing, so it is its own
    component. Equal sets always link. Null ids count as larger than any other; a component of null ids only has a null
    component_id. An empty table gives an empty result. Other columns are not read. Sets and n-grams are told apart
    by 64-bit hashes.

    ``by_row`` adds ``component``, the number of the component itself (null without words), as components of repeated or
    null ids can have one component_id, and ``row``, a digest of id and text (see ``row_digest``).

    With ``sketches``, sets that share a block meet only if their sketches (64 minwise tokens of 4 bits) leave a link open, which
    a pair that passes fails with a probability under ``MISS``. At low thresholds a block holds few n-grams, and texts that share
    passages would otherwise chain into families that grow with the corpus.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = shuffle_width(spark)
    digest = ["row"] if by_row else []

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_key(s), len(s)) for _, sets in _sets(batch.column(1), width) for s in sets]
            out = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, ["id", "key", "n", *digest])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        drawn: dict[int, bytes] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, key = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            bucket = (sig % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((key, bucket))
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                # Each set's key once, with the number of its signatures that follow.
                first = np.flatnonzero(np.append(True, key[own][1:] != key[own][:-1]))
                many = np.diff(np.append(first, len(own)))
                parts = (sig[own] >> np.uint64(32)).astype("u4").tobytes(), key[own][first].tobytes(), many.astype("u4").tobytes()
                parts += (b"".join(drawn[k] for k in key[own][first].tolist()) if sketches else b"",)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["bucket", "sig", "key", "many", "sketch"])
            drawn.clear()

        for batch in batches:
            for _, sets in _sets(batch.column(1), width):
                full = [s for s in sets if len(s)] if sketches else []
                own = packed_sketches(full) if full else np.empty((0, SKETCH // 16), np.uint64)
                own = zip(own, band_signatures(own))
                for s in sets:
                    key = set_key(s)
                    sketch, bands = next(own) if sketches and len(s) else (None, None)
                    if len(s) and key not in seen:
                        seen.add(key)
                        if sketches:
                            drawn[key] = sketch.tobytes()
                        if len(seen) > FLUSH:
                            seen.clear()
                        sig = signatures(s, percent)
                        if sketches:
                            sig = np.append(sig, bands)
                        held.append((sig, np.full(len(sig), key, np.int64)))
                        n += len(sig)
                        if n > FLUSH:
                            yield from flush()
                            n = 0
        if n:
            yield from flush()

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the sets of a partition's buckets that share a signature: each with the first of them; with sketches, see ``bucket_links``."""
        parts = by_bucket(batches)
        for bucket in sorted(parts):
            own = parts.pop(bucket)
            sig, key, many = (np.frombuffer(b"".join(p[k] for p in own), t) for k, t in enumerate(("u4", "i8", "u4")))
            if sketches:
                names, one, number = np.unique(key, return_index=True, return_inverse=True)
                drawn = np.frombuffer(b"".join(p[3] for p in own), np.uint64).reshape(-1, SKETCH // 16)[one]
                both = sig.astype(np.uint64)
                del own, sig  # a bucket's signatures are large
                both <<= np.uint64(32)
                both |= np.repeat(number.astype(np.uint64), many)
                both.sort()
                a, b = bucket_links(both, drawn, percent, bucket, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])
                continue
            key = np.repeat(key, many)
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            pivot = np.repeat(key[first], np.diff(np.append(first, len(sig))))
            order = np.lexsort((key, pivot))
            pivot, key = pivot[order], key[order]
            new = np.append(True, (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])) & (pivot != key)
            yield pa.RecordBatch.from_arrays([pa.array(pivot[new]), pa.array(key[new])], ["a", "b"])

    told = rows.withColumn("row", row_digest(F.col("id"), F.col("text"))) if by_row else rows
    docs = materialize(told.mapInArrow(keys, f"id {kind}, key long, n long" + ", row binary" * by_row), "set-keys")
    dealt = rows.select("id", "text").mapInArrow(blocks, "bucket int, sig binary, key binary, many binary, sketch binary").repartitionById(buckets, F.col("bucket"))
    meant = materialize(dealt.mapInArrow(meetings, "a long, b long").distinct(), "meetings")
    families = materialize(connected_components(meant).withColumnRenamed("node", "key").withColumnRenamed("component", "family"), "families")

    # One document stands for each set of a family; its n-grams are fetched once.
    standing = docs.join(families.select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    standing = materialize(standing, "standing")
    chosen = standing.select(F.col("id").alias("standing")).distinct()
    if standing.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    picked = rows.join(chosen, F.col("id").eqNullSafe(F.col("standing")), "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "grams"]
                )

    sets = picked.mapInArrow(grams, "key long, grams binary").join(families, "key").dropDuplicates(["key"])
    sets = materialize(sets, "gram-sets")
    links = materialize(_multiplied(sets, percent, buckets, block_bytes), "links")
    discard(sets)
    found = connected_components(links)

    classes = docs.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    classes = classes.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    classes = materialize(classes, "classes")
    names = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component-names")
    numbers = ["component"] if by_row else []
    of_class = materialize(classes.join(names, "component").select("key", "component_id", *numbers), "class-components")
    linked = docs.where("n > 0").join(of_class, "key").select("id", "n", "component_id", "key", *numbers, *digest)
    alone = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "key", *[F.lit(None).cast("long").alias(c) for c in numbers], *digest)
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles").withColumnRenamed("id", id_col)


def row_digest(id_col: Column, text: Column) -> Column:
    """16 bytes that tell rows of another id or text apart; never null."""
    whole = F.coalesce(F.sha2(text.cast("string").cast("binary"), 256), F.lit(""))
    return F.substring(F.unhex(F.sha2(row_key(id_col, whole).cast("binary"), 256)), 1, 16)


def keep_first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group of near copies, all columns; texts without words stay.

    The row with the smallest id stays (null ids last); of several with that id, the one whose n-gram set, then text, has
    the smallest hash. Rows are told apart by id and text, so rows of other groups that have the same id, or none
    either, stay. Exact repeats of a row that stays leave one.
    """
    groups = near_groups(df, id_col, text_col, width, percent, by_row=True, sketches=True).where("n_shingles > 0")
    # Equal texts are in one group, so a row's digest is of one group only.
    key = free_name(df, "row_key")
    keyed = groups.withColumn(key, F.col("row")).groupBy(key)
    keyed = keyed.agg(F.max("component").alias("component"), F.max(id_col).alias("id"), F.max("key").alias("set"), F.count(F.lit(1)).alias("copies"))
    keyed = materialize(keyed, "near-rows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "set", key, "copies")
    first = materialize(keyed.groupBy("component").agg(F.min(order).alias("first")).select(f"first.{key}", "first.copies"), "first-rows")
    gone = materialize(keyed.join(first, key, "left_anti").select(key), "near-copies")
    # The rows that go grow with the corpus, so they are not broadcast at any size.
    stay = df.withColumn(key, row_digest(F.col(id_col), F.col(text_col))).join(gone.hint("merge"), key, "left_anti")
    repeated = materialize(first.where("copies > 1").select(key), "repeated-rows")
    if not repeated.isEmpty():
        once = stay.join(repeated, key, "left_semi").dropDuplicates([key])
        stay = stay.join(repeated, key, "left_anti").unionByName(once)
    return stay.select(*df.columns)
