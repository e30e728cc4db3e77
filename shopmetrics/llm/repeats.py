"""Suffix-array dedup: maximal repeats of at least ``least`` bytes, anywhere in the corpus (operator 2).

A suffix array of all suffixes would move many times the corpus. Here only suffixes that begin at an anchor
are kept: the byte whose ANCHOR-byte string has the smallest hash in some window of ``least`` bytes. Two equal windows have
the same anchor, so each repeat of ``least`` bytes is found from an anchor in it, and its text around the anchor
(at most ``least`` bytes to the right, ``least`` - ANCHOR to the left) is all that has to be compared.

Suffixes are dealt by the hash of their first ANCHOR bytes. Those whose surroundings are equal count as one; they are
repeats as they are. Where different surroundings share a beginning, an enhanced suffix array is built: suffixes in
order, common prefixes of neighbours, and a stack scan over these gives the tree of common-prefix intervals.
In each interval the left contexts are put in order too: where they differ is how far its members extend to the
left, and members that reach ``least`` bytes together are a repeat group, with all its occurrences.

A beginning with very many different surroundings (a line that very many texts hold, shorter than a repeat) is not one
task's work: its suffixes are dealt anew by each whole string of ``least`` bytes around them, of which equal ones are
repeats without further comparison. Equal suffixes are combined in each map task before they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize, shuffle_width, utf8_view
from .wordhash import mix, pieces, powers

ANCHOR = 50
PIECE = 1 << 19
FLUSH = 400_000
MANY = 512  # different surroundings of one beginning that are compared in one tree

_ROWS = "kind int, bucket int, n int, data binary, size long, row long, first long, last long, at long, key long, many boolean"
SUFFIXES, SPAN, NEED, WINDOWS = range(4)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i : i + width] for each i where that fits."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return total, inverse


def string_hashes(total: np.ndarray, inverse: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of data[first:last], by prefix sums."""
    return mix((total[last] - total[first]) * inverse[first] ^ (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(offsets: np.ndarray, grams: np.ndarray, least: int) -> np.ndarray:
    """Bytes that are the anchor of some window, in order. ``grams``: hash of the ANCHOR bytes from each byte on."""
    n = int(offsets[-1])
    width = least - ANCHOR + 1
    if n < least:
        return np.empty(0, np.int64)
    smallest = _sliding(grams, width, np.minimum)  # of the window that begins here
    ends = np.repeat(offsets[1:], np.diff(offsets))
    fits = np.arange(n - least + 1) + least <= ends[: n - least + 1]
    smallest = np.where(fits, smallest[: len(fits)], np.uint64(0))
    largest = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    return np.flatnonzero((largest == grams[: len(largest)]) & (largest > 0))


def _binary(*arrays: np.ndarray) -> tuple[bytes, int]:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return pa.Codec("zstd").compress(raw, asbytes=True), len(raw)


def _unpacked(rows: list[dict], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The packed columns of several rows, one after the other."""
    cols: list[list[np.ndarray]] = [[] for _ in kinds]
    for r in rows:
        raw, at = pa.Codec("zstd").decompress(r["data"], r["size"], asbytes=True), 0
        for col, kind in zip(cols, kinds):
            size = r["n"] * np.dtype(kind).itemsize
            col.append(np.frombuffer(raw, kind, r["n"], at))
            at += size
    return [np.concatenate(c) for c in cols]


def _out(rows: int, **columns) -> pa.RecordBatch:
    arrays, names = [], []
    for name, kind in (("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("size", pa.int64()), *((c, pa.int64()) for c in ("row", "first", "last", "at", "key")), ("many", pa.bool_())):
        value = columns.get(name)
        if value is None:
            arrays.append(pa.nulls(rows, kind))
        elif isinstance(value, (int, bytes)):
            arrays.append(pa.array([value] * rows, kind))
        else:
            arrays.append(pa.array(value, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _spans(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans, joined where those of a row touch."""
    if not len(row):
        return
    order = np.lexsort((last, first, row))
    row, first, last = row[order], first[order].astype(np.int64), last[order].astype(np.int64)
    begins = np.append(True, row[1:] != row[:-1])
    # Ends that have been reached so far in the row: rows are set apart by a large step.
    step = (np.cumsum(begins) - 1) * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + step)
    new = np.append(True, first[1:] + step[1:] > reach[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(row)) - 1
    yield _out(len(at), kind=SPAN, row=row[at], first=first[at], last=(reach - step)[ends])


def _deal(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            data, size = _binary(*(c[own] for c in columns))
            yield _out(1, kind=kind, bucket=int(bucket[own[0]]), n=len(own), data=data, size=size)


def _combined(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the hashes; in that order, where a new value begins, and how many have it."""
    order = np.lexsort(hashes[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        new[1:] |= h[order][1:] != h[order][:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


_SUFFIX = ("u8", "u8", "i8", "i8", "u1", "u1", "u1")  # key, surroundings, row, at, left, right, is one of several


def _find_suffixes(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, around, row, at, left, right = (np.concatenate([h[k] for h in held]) for k in range(6))
            held.clear()
            order, first, size = _combined([key, around])
            several = np.repeat(size > 1, size)
            own = order[several]
            yield from _spans(row[own], at[own] - left[own], at[own] + right[own])
            own = order[first]
            columns = [key[own], around[own], row[own], at[own], left[own].astype("u1"), right[own].astype("u1"), (size > 1).astype("u1")]
            yield from _deal(SUFFIXES, (key[own] % np.uint64(buckets)).astype(np.int64), columns)

        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, offsets = utf8_view(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if len(own) < least:
                    continue
                total, inverse = prefix_sums(own)
                place = np.arange(len(own) - ANCHOR + 1)
                grams = string_hashes(total, inverse, place, place + ANCHOR)
                at = anchors(bounds, grams, least)
                if not len(at):
                    continue
                text = np.searchsorted(bounds, at, "right") - 1
                left = np.minimum(at - bounds[text], least - ANCHOR)
                right = np.minimum(bounds[text + 1] - at, least)
                around = string_hashes(total, inverse, at - left, at + right) ^ left.astype(np.uint64)
                held.append([grams[at], around, rows[a + text], at - bounds[text], left, right])
                n += len(at)
                if n > FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], passing: tuple[int, ...]) -> Iterator[tuple[int, list[dict]] | pa.RecordBatch]:
    """Batches of rows that pass as they are, then the packed rows of each bucket and kind."""
    parts: dict[tuple[int, int], list[dict]] = {}
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        if len(own := np.flatnonzero(np.isin(kinds, passing))):
            yield batch.take(pa.array(own))
        for r in batch.take(pa.array(np.flatnonzero(~np.isin(kinds, passing)))).select(["kind", "bucket", "n", "data", "size"]).to_pylist():
            parts.setdefault((r["kind"], r["bucket"]), []).append(r)
    for kind, bucket in sorted(parts):
        yield kind, parts.pop((kind, bucket))


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of a bucket: equal surroundings are spans; of a beginning with different ones, each is needed with its text."""
    for found in _by_bucket(batches, (SPAN,)):
        if isinstance(found, pa.RecordBatch):
            yield found
            continue
        key, around, row, at, left, right, several = _unpacked(found[1], _SUFFIX)
        order, first, size = _combined([key, around])
        whole = (np.add.reduceat(several[order].astype(np.int64), first) > 0) | (size > 1)
        own = order[np.repeat(whole, size)]
        yield from _spans(row[own], at[own] - left[own].astype(np.int64), at[own] + right[own].astype(np.int64))
        own = order[first]  # one of each class, in order of key
        start = np.flatnonzero(np.append(True, key[own][1:] != key[own][:-1]))
        classes = np.diff(np.append(start, len(own)))
        single = np.add.reduceat((~whole).astype(np.int64), start)
        needed = np.repeat((classes > 1) & (single > 0), classes)
        many = np.repeat(classes > MANY, classes)
        some = own[needed]
        if len(some):
            yield _out(len(some), kind=NEED, row=row[some], at=at[some], key=key[some].view(np.int64), many=many[needed])


def _fetch_surroundings(least: int, buckets: int):
    """Texts with the places that are needed of them: surroundings, packed by beginning, or all strings of ``least`` bytes around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple] = []
        wide: list[tuple] = []
        n = w = 0

        def flush_near() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([x[0] for x in near])
            bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            columns = [np.concatenate([x[k] for x in near]) for k in range(5)]
            text = np.concatenate([x[5] for x in near])
            near.clear()
            yield from _deal(SUFFIXES, bucket, [*columns, text.view(f"V{text.shape[1]}").ravel()])

        def flush_wide() -> Iterator[pa.RecordBatch]:
            h, row, at = (np.concatenate([x[k] for x in wide]) for k in range(3))
            wide.clear()
            order, first, size = _combined([h, row, at])  # a string that two anchors hold counts once
            once = order[first]
            h, row, at = h[once], row[once], at[once]
            order, first, size = _combined([h])
            own = order[np.repeat(size > 1, size)]
            yield from _spans(row[own], at[own], at[own] + least)
            own = order[first]
            yield from _deal(WINDOWS, (h[own] % np.uint64(buckets)).astype(np.int64), [h[own], row[own], at[own], (size > 1).astype("u1")])

        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for k, (row, needs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = data[offsets[k] : offsets[k + 1]]
                at, key, many = (np.array([x[c] for x in needs]) for c in ("at", "key", "many"))
                left, right = np.minimum(at, least - ANCHOR), np.minimum(len(text) - at, least)
                own = np.flatnonzero(~many)
                if len(own):
                    col = np.arange(2 * least - ANCHOR) - (least - ANCHOR)
                    place = at[own][:, None] + col
                    inside = (place >= 0) & (place < len(text))
                    around = np.where(inside, text[np.clip(place, 0, len(text) - 1)], 0).astype(np.uint8)
                    near.append((key[own], np.full(len(own), row), at[own], left[own].astype("u1"), right[own].astype("u1"), around))
                    n += len(own)
                if many.any():
                    total, inverse = prefix_sums(text)
                    begin = np.unique(np.concatenate([np.arange(a - x, a + y - least + 1) for a, x, y in zip(at[many], left[many], right[many])]))
                    wide.append((string_hashes(total, inverse, begin, begin + least), np.full(len(begin), row), begin))
                    w += len(begin)
                if n > 50_000:
                    yield from flush_near()
                    n = 0
                if w > FLUSH:
                    yield from flush_wide()
                    w = 0
        if n:
            yield from flush_near()
        if w:
            yield from flush_wide()

    return run


def _common(one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows, at most ``most``."""
    differ = one != two
    return np.minimum(np.where(differ.any(1), differ.argmax(1), one.shape[1]), most)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of a suffix array, by a stack scan of its neighbours' common prefixes."""
    stack = [(0, 0)]
    for place, depth in enumerate([*common, 0], 1):
        first = place - 1
        while stack[-1][0] > depth:
            deep, first = stack.pop()
            yield deep, first, place - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def extents(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of one group, how far its repeats of ``least`` bytes reach to the left and to the right (0 where it has none).

    ``left`` holds the bytes before the anchor backwards.
    """
    n = len(left)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.array(sorted(range(n), key=lambda k: right[k, : right_size[k]].tobytes()))
    common = _common(right[order[1:]], right[order[:-1]], np.minimum(right_size[order[1:]], right_size[order[:-1]]))
    words = [left[k, : left_size[k]].tobytes() for k in range(n)]
    for depth, first, last in intervals(common.tolist()):
        members = order[first : last + 1]
        if depth + int(np.sort(left_size[members])[-2]) < least:
            continue
        by_left = np.array(sorted(members.tolist(), key=words.__getitem__))
        same = _common(left[by_left[1:]], left[by_left[:-1]], np.minimum(left_size[by_left[1:]], left_size[by_left[:-1]]))
        # Neighbours in order share most; where all members had the same bytes to the left, the group would not be maximal there.
        reach = np.maximum(np.append(same, 0), np.append(0, same))
        hit = reach + depth >= least
        own = by_left[hit]
        far_left[own] = np.maximum(far_left[own], reach[hit])
        far_right[own] = np.maximum(far_right[own], depth)
    return far_left, far_right


def _scan_trees(least: int):
    span = 2 * least - ANCHOR
    kinds = ("i8", "i8", "i8", "u1", "u1", f"V{span}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches, (SPAN,)):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            if found[0] == WINDOWS:
                h, row, at, several = _unpacked(found[1], ("u8", "i8", "i8", "u1"))
                order, first, size = _combined([h])
                whole = (np.add.reduceat(several[order].astype(np.int64), first) > 0) | (size > 1)
                own = order[np.repeat(whole, size)]
                yield from _spans(row[own], at[own], at[own] + least)
                continue
            key, row, at, left, right, text = _unpacked(found[1], kinds)
            text = text.view(np.uint8).reshape(-1, span)
            left, right = left.astype(np.int64), right.astype(np.int64)
            order, first, size = _combined([key])
            before, after = text[:, least - ANCHOR - 1 :: -1], text[:, least - ANCHOR :]
            spans: list[tuple[np.ndarray, ...]] = []
            # Two suffixes are a tree of one interval; all of these at once.
            two = first[size == 2]
            for at_once in range(0, len(two), 20_000):
                a, b = order[two[at_once : at_once + 20_000]], order[two[at_once : at_once + 20_000] + 1]
                x = _common(before[a], before[b], np.minimum(left[a], left[b]))
                y = _common(after[a], after[b], np.minimum(right[a], right[b]))
                hit = x + y >= least
                for own in (a[hit], b[hit]):
                    spans.append((row[own], at[own] - x[hit], at[own] + y[hit]))
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                own = order[f : f + s]
                x, y = extents(before[own], left[own], after[own], right[own], least)
                hit = y > 0
                spans.append((row[own][hit], (at[own] - x)[hit], (at[own] + y)[hit]))
            if spans:
                yield from _spans(*(np.concatenate([s[k] for s in spans]) for k in range(3)))

    return run


def _to_buckets(found: DataFrame, buckets: int) -> DataFrame:
    """Packed rows to the tasks of their buckets; spans, which have none, by a hash of their row."""
    return found.repartitionById(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")))


def repeat_spans(df: DataFrame, text_col: str = "text", row_col: str = "row", least: int = 200) -> DataFrame:
    """``row``, ``first``, ``last``: stretches of UTF-8 bytes covered by strings of ``least`` bytes that begin elsewhere too. A stretch may come in overlapping parts."""
    spark = df.sparkSession
    if not ANCHOR < least <= 255:
        raise ValueError(f"least must be over {ANCHOR} and at most 255")
    buckets = max(8, shuffle_width(spark))
    rows = df.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    dealt = _to_buckets(rows.mapInArrow(_find_suffixes(least, buckets), _ROWS), buckets)
    found = materialize(dealt.mapInArrow(_sort_suffixes, _ROWS), "suffixes")
    needs = found.where(F.col("kind") == NEED).groupBy("row").agg(F.collect_list(F.struct("at", "key", "many")).alias("needs"))
    needs = materialize(needs, "needed-places")
    # What is needed grows with the corpus, so it is never broadcast: a sorted join, which can spill, at every size.
    some = rows.join(needs.hint("merge"), "row").select("row", "text", "needs")
    dealt = _to_buckets(some.mapInArrow(_fetch_surroundings(least, buckets), _ROWS), buckets)
    more = dealt.mapInArrow(_scan_trees(least), _ROWS)
    spans = found.where(F.col("kind") == SPAN).select("row", "first", "last")
    return spans.unionByName(more.where(F.col("kind") == SPAN).select("row", "first", "last"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (remaining bytes), ``spans`` (removed: first, last).

    Every byte is removed that a string of ``least`` bytes covers which begins anywhere else too, its own text included;
    strings are judged on the input. Null and empty texts, and texts shorter than ``least``, keep all. Repeated
    rows are repeats of each other. Null ids are ids like others. An empty table gives an empty result. Other columns are
    not read. Beginnings, surroundings and rows are told apart by 64-bit hashes.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeat_spans(rows, least=least).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = materialize(spans, "repeat-spans")
    joined = rows.join(spans.hint("merge"), "row", "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, sizes = [], [], []
            data, offsets = utf8_view(batch.column(1))
            for k, found in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                runs: list[list[int]] = []
                for s in found or ():
                    if runs and s["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["last"])
                    else:
                        runs.append([s["first"], s["last"]])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                gone.append([{"first": a, "last": b} for a, b in runs])
                sizes.append((len(raw), len(raw) - len(kept[-1]), len(runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)), pa.array(kept, pa.binary()), pa.array(gone, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first:long,last:long>>").withColumnRenamed("id", id_col)
