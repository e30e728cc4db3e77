"""Token-id sequences in training order as fixed-stride binary shards (operator 3).

The token ids of a partition's texts, one text after the other, are cut into sequences of a fixed length, so only the
last sequence of a partition is padded; which text a stretch of a sequence is from is listed beside. A sequence has a number (its
place in the input), and a keyed Feistel network permutes the numbers: an even-bit block
cipher over the smallest power of four that holds them all, applied again while the result falls
outside (cycle-walking), which makes it a bijection of 0..N-1. The permuted number is the global
slot. Sequences are dealt to range partitions of slots, of one or several shards each, and written in order of slot with a fixed
stride, so slot s is record s mod R of shard s div R (R records a shard), at a known byte of a known file: a reader goes
through files in sequence and resumes anywhere by arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import urlparse
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import MAX_VOCABULARY_BYTES, BytePairs, _coder
from .frames import materialize, shuffle_width, utf8_view
from .wordhash import pieces

SEQUENCE = 512
PER_SHARD = 65_536
ROUNDS = 6
PIECE_BYTES = 4 << 20
ZSTD_LEVEL = 6  # ids of two bytes: a quarter less than at level 1


class SlotPermutation:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def _round(self, right: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return right << np.uint64(self.half) | left

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while len(again := np.flatnonzero(out >= np.uint64(self.n))):
            out[again] = self._once(out[again], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The inverse: the halves change places at the end, so the same network with keys in reverse undoes it."""
        return self._walk(slot, self.keys[::-1])


def utf8_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level token ids: a text's UTF-8 bytes, as unsigned 8-bit integers. (A tokenizer's ids can be given instead, as an array of any integer type.)"""
    return data, offsets


def bpe_ids(spark: SparkSession, vocabulary: str) -> tuple[Callable, str]:
    """An encoder to ids of a byte-level BPE vocabulary (a path on the driver), and the type of its ids: u2 if all fit, else u4."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    wide = "<u2" if len(BytePairs(spec).token_size) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(spec)

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coder, ids, n = _coder(shared.value), [np.empty(0, wide)], [np.zeros(1, np.int64)]
        for first, last in pieces(offsets, PIECE_BYTES):
            own, at = coder.encode_bytes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            ids.append(own.astype(wide))
            n.append(np.diff(at))
        return np.concatenate(ids), np.cumsum(np.concatenate(n))

    return encode, wide


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it that a folder of spark.checkpoint.dir stands for."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_training_order(
    df: DataFrame,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    per_shard: int = PER_SHARD,
    key: str = "0",
    encode: Callable = utf8_ids,
    dtype: str = "u1",
) -> DataFrame:
    """Write the shards below ``out_dir``; one row per stretch of a text in a sequence.

    Its columns: ``slot``, ``shard`` and ``record`` of the sequence, id, ``first`` (the stretch's first token in the text),
    ``at`` (its place in the record), ``n_tokens``, ``crc32`` (of the whole record).

    A record is ``length`` ids, little-endian; the last one of a partition of the input is padded with 0. Null and empty texts
    have no stretch. Repeated rows have stretches of their own; ids may be null and of any plain type; other
    columns are not read, so their names may clash. No token at all gives no file. ``dtype`` is the type of the ids that ``encode`` gives.

    Texts are encoded once: their ids are written packed to the shared folder, and counted and dealt from there. A sequence's
    number is its partition's begin and its place in it, both written beside the ids.

    On the way to its shard, a batch's share of a shard travels as one compressed row. A task writes a range of shards, one
    after the other, each to a file of a name of its own that is moved to its place when whole, so a task that runs again writes the same
    bytes again. A task holds a shard's ``per_shard`` records, and on the way there the ids of a piece of texts or of one longer text.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    piece_bytes, width = PIECE_BYTES, shuffle_width(df.sparkSession)

    def lists(columns: list, types: list[pa.DataType]) -> list[pa.Array]:
        """One row of lists."""
        return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, t)) for c, t in zip(columns, types)]

    def zipped(ids: np.ndarray) -> list[pa.Array]:
        raw = ids.tobytes()
        return [pa.array([len(raw)], pa.int64()), pa.array([pa.Codec("zstd", ZSTD_LEVEL).compress(raw, asbytes=True)], pa.binary())]

    def unzipped(size: int, packed: bytes) -> np.ndarray:
        return np.frombuffer(pa.Codec("zstd").decompress(packed, size, asbytes=True), dtype)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece of a batch as one row of whole sequences: their ids, the stretches in them, and the number of the first one in the partition.

        What is over goes to the next piece; the last row of a partition has what is left.
        """
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        # What is over: its ids, and id, first token and size of its stretches.
        rest, names, first, sizes = np.empty(0, dtype), pa.array([], id_type), np.empty(0, np.int64), np.empty(0, np.int64)

        def row(n: int, names: pa.Array, first: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            told = lists([names, first, sizes], [id_type, pa.int64(), pa.int64()])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), *told, *zipped(ids)],
                ["part", "number", "n", "id", "first", "sizes", "size", "ids"],
            )

        for batch in batches:
            data, at = utf8_view(batch.column(1))
            for a, b in pieces(at, piece_bytes):
                ids, offsets = encode(data[at[a] : at[b]], at[a : b + 1] - at[a])
                some = np.flatnonzero(np.diff(offsets))
                rest = np.concatenate([rest, ids.astype(dtype, copy=False)])
                names = pa.concat_arrays([names, batch.column(0).take(pa.array(a + some)).cast(id_type)])
                first = np.append(first, np.zeros(len(some), np.int64))
                sizes = np.append(sizes, np.diff(offsets)[some])
                n = len(rest) // length
                if not n:
                    continue
                ends = np.cumsum(sizes)
                whole = int(np.searchsorted(ends, n * length, "left"))  # the stretch in which the last whole sequence ends
                over = int(ends[whole]) - n * length
                cut = sizes[: whole + 1].copy()
                cut[-1] -= over
                yield row(n, names.slice(0, whole + 1), first[: whole + 1], cut, rest[: n * length])
                number += n
                if over:
                    first = np.append(first[whole] + cut[-1], first[whole + 1 :])
                    sizes = np.append(over, sizes[whole + 1 :])
                else:
                    whole, first, sizes = whole + 1, first[whole + 1 :], sizes[whole + 1 :]
                rest, names = rest[n * length :].copy(), names.slice(whole)
        if len(rest):
            yield row(1, names, first, sizes, rest)

    packed = materialize(rows.mapInArrow(encoded, f"part int, number long, n long, id array<{kind}>, first array<long>, sizes array<long>, size long, ids binary"), "training-ids")
    per_part = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number for each partition of the input
    total, before = 0, {}
    for part in sorted(per_part):
        before[part], total = total, total + per_part[part]
    order = SlotPermutation(total, key)
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, width)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole sequences of a piece, dealt to their shards: slots, sizes and numbers of stretches, then the stretches, then the ids."""
        for piece in (batch.slice(k, 1) for batch in batches for k in range(len(batch))):
            part, number, n, names, first, sizes, size, ids = piece.columns
            ids = unzipped(size[0].as_py(), ids[0].as_py())
            names, first, edges = names.flatten(), first.flatten().to_numpy(), np.append(0, np.cumsum(sizes.flatten().to_numpy()))
            number, n = before[part[0].as_py()] + number[0].as_py(), n[0].as_py()
            starts = np.union1d(edges[:-1], np.arange(n) * length)  # of stretches that end where their text or sequence does
            of = np.searchsorted(edges, starts, "right") - 1
            first = first[of] + starts - edges[of]
            sizes = np.diff(np.append(starts, len(ids)))
            begin = np.searchsorted(starts, np.arange(n + 1) * length)
            slot = order.slot(np.arange(number, number + n))
            by_slot = np.argsort(slot)
            for own in np.split(by_slot, np.flatnonzero(np.diff(slot[by_slot] // per_shard)) + 1):
                told = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in own])
                raw = np.concatenate([ids[k * length : (k + 1) * length] for k in own])
                whole = np.minimum(length, len(ids) - own * length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot[own[0]] // per_shard], pa.int32()), *lists([slot[own], whole, begin[own + 1] - begin[own], first[told], sizes[told], names.take(pa.array(of[told]))], [pa.int64()] * 5 + [id_type]), *zipped(raw)],
                    ["shard", "slot", "whole", "stretches", "first", "n", "id", "size", "ids"],
                )

    cut = packed.mapInArrow(sequences, f"shard int, slot array<long>, whole array<long>, stretches array<long>, first array<long>, n array<long>, id array<{kind}>, size long, ids binary")
    place = F.floor(F.col("shard").cast("long") * tasks / shards).cast("int")
    dealt = cut.repartitionById(tasks, place).sortWithinPartitions("shard")

    def write_shard(shard: int, parts: list[dict]) -> pa.RecordBatch:
        store, folder = open_store(out_dir)
        store.create_dir(folder, recursive=True)
        slot, whole, stretches, first, n = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in ("slot", "whole", "stretches", "first", "n"))
        names = pa.array([i for p in parts for i in p["id"]], id_type)
        ids = np.concatenate([unzipped(p["size"], p["ids"]) for p in parts])
        begin, told = np.cumsum(whole) - whole, np.cumsum(stretches) - stretches
        by_slot = np.argsort(slot)
        name, checks = f"{folder}/.{shard:05d}-{uuid4().hex}", []
        with store.open_output_stream(name) as f:
            for k in by_slot.tolist():
                record = np.zeros(length, dtype)
                record[: whole[k]] = ids[begin[k] : begin[k] + whole[k]]
                checks.append(crc32(record.tobytes()))
                f.write(record.tobytes())
        store.move(name, f"{folder}/shard-{shard:05d}.bin")
        of = np.concatenate([np.arange(told[k], told[k] + stretches[k]) for k in by_slot])
        slots = np.repeat(slot[by_slot], stretches[by_slot])
        at = (np.cumsum(n) - n)[of] - np.repeat(begin[by_slot], stretches[by_slot])
        return pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.full(len(slots), shard, np.int32)), pa.array(slots - shard * per_shard), names.take(pa.array(of)), pa.array(first[of]), pa.array(at), pa.array(n[of]), pa.array(np.repeat(checks, stretches[by_slot]), pa.int64())],
            ["slot", "shard", "record", "id", "first", "at", "n_tokens", "crc32"],
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for shard, parts in groupby(rows, key=lambda r: r["shard"]):
            yield write_shard(shard, list(parts))

    written = dealt.mapInArrow(write, f"slot long, shard int, record long, id {kind}, first long, at long, n_tokens long, crc32 long")
    return materialize(written, "training-order").withColumnRenamed("id", id_col)


def read_slots(out_dir: str, first: int, n: int, per_shard: int = PER_SHARD, length: int = SEQUENCE, dtype: str = "u1") -> Iterator[np.ndarray]:
    """Sequences from a slot on, by arithmetic on file and byte; padding is left in."""
    store, folder = open_store(out_dir)
    stride = length * np.dtype(dtype).itemsize
    for slot in range(first, first + n):
        with store.open_input_file(f"{folder}/shard-{slot // per_shard:05d}.bin") as f:
            f.seek(slot % per_shard * stride)
            yield np.frombuffer(f.read(stride), dtype)
