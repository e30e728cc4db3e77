"""LM scoring with an interpolated modified Kneser-Ney bigram model (operator 8).

Counting runs in Spark: each task counts its words and word pairs by 64-bit hash and deals sorted, packed
arrays to buckets of the hash; a bucket's task merges them. From the merged counts come the discounts
(by counts of counts), the pairs' counts, the contexts' totals and back-off weights, and the words' continuation
probabilities. They are stored as sorted hash arrays in files below the shared folder, one file a bucket
and kind. Scoring tasks map the files into memory and look their batch's distinct words and pairs up in order of
hash, so pages are read in sequence and shared between workers of a machine.

p(w | v) = max(0, c(vw) - D(c(vw))) / c(v) + g(v) p1(w);
p1(w) = max(0, N(*w) - D1(N(*w))) / N(**) + g1 / (V + 1), where N(*w) counts the words seen before w,
g(v) and g1 hold what the discounts took, and V + 1 leaves a place for unknown words.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import scratch_path, shuffle_width, utf8_view
from .training_order import open_store
from .wordhash import mix, pieces, word_hashes

END = np.uint64(0x5851F42D4C957F2D)  # hash of the end of a text
BEGIN = np.uint64(0x14057B7EF767814F)  # of its begin, a context only
PAIR = np.uint64(0xA0761D6478BD642F)
SPREAD = 4  # a context's pairs are dealt to so many buckets, so that no word's followers meet in one task
FLUSH = 4_000_000
PIECE = 4 << 20


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch with one END after each text; where each text begins; the hash before each token (BEGIN at a text's begin)."""
    words, at = word_hashes(data, offsets)
    rows = len(offsets) - 1
    out = np.empty(len(words) + rows, np.uint64)
    ends = at[1:] + np.arange(rows)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = words
    begin = np.append(0, ends + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begin[:-1]] = BEGIN
    return out, begin, before


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * PAIR + (word ^ (word >> np.uint64(31))))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _squeezed(array: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unsqueezed(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), kind)


def _pack(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, packed arrays) for each bucket; arrays that are in order stay so within it."""
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            yield int(bucket[own[0]]), *(_squeezed(a[own]) for a in arrays)


@dataclass
class Model:
    """Where the files are, and the few numbers that all tokens share."""

    folder: str
    buckets: int
    files: dict[tuple[int, int], str] = field(default_factory=dict)  # (kind, bucket) -> name
    tokens: int = 0  # N
    types: int = 0  # V
    pair_discounts: tuple[float, ...] = (0.0, 0.5, 0.75, 0.9)
    word_discounts: tuple[float, ...] = (0.0, 0.5, 0.75, 0.9)
    pair_types: int = 0  # N(**)
    left_over: float = 0.0  # g1 * N(**): what the word discounts took


def discounts(tally: np.ndarray) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts (for counts 0, 1, 2, 3 and more) from how many counts are 1, 2, 3 and 4; middling ones where one is missing."""
    n1, n2, n3, n4 = (int(x) for x in tally[1:5])
    if not (n1 and n2 and n3 and n4):
        return 0.0, 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return 0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


# Kinds of rows and files. A file holds the number of keys, the sorted keys, then the values.
WORDS, PAIRS, CONTEXTS, FOLLOWED = range(4)
_FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("n", pa.binary()), ("name", pa.string())]
_SCHEMA = "kind int, bucket int, keys binary, more binary, n binary, name string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """Rows of one kind and bucket together; they come sorted."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (kind, bucket), own in groupby(rows, key=lambda r: (r["kind"], r["bucket"])):
        yield kind, bucket, list(own)


def _joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.concatenate([_unsqueezed(r[column], kind) for r in rows])


def train(texts: DataFrame, text_col: str = "text", folder: str | None = None) -> Model:
    """Count all texts and store the model below ``folder`` (default: a new one below spark.checkpoint.dir). Null texts are empty.

    A task that runs again writes files of new names, and only the names that the job returns are used.
    """
    spark = texts.sparkSession
    buckets = max(8, shuffle_width(spark))
    folder = folder or scratch_path(spark, "kneser-ney")
    rows = texts.select(F.col(text_col).cast("string").alias("text"))

    def save(kind: int, bucket: int, keys: np.ndarray, *values: np.ndarray) -> str:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"{('words', 'pairs', 'contexts', 'followed')[kind]}-{bucket:05d}-{uuid4().hex}"
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(np.array([len(keys)], np.int64).tobytes())
            for array in (keys, *values):
                f.write(np.ascontiguousarray(array).tobytes())
        return name

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            before, word = (np.concatenate([k[j] for k in kept]) for j in (0, 1))
            kept.clear()
            own, n = _sums(word, np.ones(len(word), np.int64))
            for bucket, keys, many in _pack(own % np.uint64(buckets), own, n):
                yield _batch([(WORDS, bucket, keys, b"", many, "")])
            order = np.lexsort((word, before))
            before, word = before[order], word[order]
            first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])))
            n = np.diff(np.append(first, len(word)))
            before, word = before[first], word[first]
            for bucket, keys, more, many in _pack(pair_bucket(before, word, buckets), before, word, n.astype("u4")):
                yield _batch([(PAIRS, bucket, keys, more, many, "")])

        for batch in batches:
            data, offsets = utf8_view(batch.column(0))
            for first, last in pieces(offsets):
                word, _, before = tokens_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                kept.append((before, word))
                held += len(word)
                if held > FLUSH:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and pairs: sum and store; pass on their names with counts of counts, and what contexts and followed words gather."""
        for kind, bucket, own in _groups(batches):
            if kind == WORDS:
                keys, n = _sums(_joined(own, "keys", "u8"), _joined(own, "n", "i8"))
                yield _batch([(WORDS, bucket, b"", b"", np.array([len(keys), n.sum()], np.int64).tobytes(), save(WORDS, bucket, keys, n))])
                continue
            before, word, n = _joined(own, "keys", "u8"), _joined(own, "more", "u8"), _joined(own, "n", "u4").astype(np.int64)
            own.clear()
            order = np.lexsort((word, before))
            before, word, n = before[order], word[order], n[order]
            first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])))
            before, word, n = before[first], word[first], np.add.reduceat(n, first)
            key = pair_hash(before, word)
            order = np.argsort(key)
            large = n[order] >= 255  # a byte for each count, and the few large ones apart
            tail = (np.array([large.sum()], np.int64), key[order][large], n[order][large])
            name = save(PAIRS, bucket, key[order], np.minimum(n[order], 255).astype("u1"), *(a.view("u1") for a in tail))
            yield _batch([(PAIRS, bucket, b"", b"", np.bincount(np.minimum(n, 5), minlength=6).astype(np.int64).tobytes(), name)])
            first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)]
            keys = before[first]
            for to, k, many in _pack(keys % np.uint64(buckets), keys, np.stack(sums, axis=1)):
                yield _batch([(CONTEXTS, to, k, b"", many, "")])
            keys, n = _sums(word, np.ones(len(word), np.int64))
            for to, k, many in _pack(keys % np.uint64(buckets), keys, n):
                yield _batch([(FOLLOWED, to, k, b"", many, "")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts and followed words: sum and store. Names pass."""
        for kind, bucket, own in _groups(batches):
            if kind in (WORDS, PAIRS):
                yield _batch([tuple(r[n] for n, _ in _FIELDS) for r in own])
            elif kind == CONTEXTS:
                keys, which = np.unique(_joined(own, "keys", "u8"), return_inverse=True)
                sums = [np.bincount(which, c).astype(np.int64) for c in _joined(own, "n", "i8").reshape(-1, 4).T]
                yield _batch([(kind, bucket, b"", b"", b"", save(kind, bucket, keys, sums[0], *(c.astype("u4") for c in sums[1:])))])
            else:
                keys, n = _sums(_joined(own, "keys", "u8"), _joined(own, "n", "i8"))
                tally = np.append(np.bincount(np.minimum(n, 5), minlength=6), n.sum()).astype(np.int64)
                yield _batch([(kind, bucket, b"", b"", tally.tobytes(), save(kind, bucket, keys, n.astype("u4")))])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(2 * buckets, F.col("kind") % 2 * buckets + F.col("bucket")).sortWithinPartitions("kind", "bucket")

    out = dealt(dealt(rows.mapInArrow(count, _SCHEMA)).mapInArrow(merge, _SCHEMA)).mapInArrow(finish, _SCHEMA)
    model, pairs, words = Model(folder, buckets), np.zeros(6, np.int64), np.zeros(7, np.int64)
    for r in out.collect():  # a name and some numbers for each bucket and kind
        model.files[r["kind"], r["bucket"]] = r["name"]
        numbers = np.frombuffer(r["n"], np.int64)
        if r["kind"] == WORDS:
            model.types, model.tokens = model.types + int(numbers[0]), model.tokens + int(numbers[1])
        elif r["kind"] == PAIRS:
            pairs += numbers
        elif r["kind"] == FOLLOWED:
            words += numbers
    model.pair_discounts, model.word_discounts, model.pair_types = discounts(pairs), discounts(words), int(words[6])
    several = [words[1], words[2], words[3] + words[4] + words[5]]
    model.left_over = float(sum(d * n for d, n in zip(model.word_discounts[1:], several)))
    return model


class Arrays:
    """The model's files as memory maps, opened on first use and kept by the worker."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

    def _path(self, name: str) -> str:
        store, path = open_store(self.model.folder)
        if isinstance(store, pafs.LocalFileSystem):
            return f"{path}/{name}"
        own = f"{tempfile.gettempdir()}/{name}"  # a store that cannot be mapped is copied once per worker's machine
        if not os.path.exists(own):
            with store.open_input_stream(f"{path}/{name}") as f, open(f"{own}.{uuid4().hex}", "wb") as to:
                shutil.copyfileobj(f, to)
            os.replace(to.name, own)
        return own

    def arrays(self, kind: int, bucket: int) -> tuple[np.ndarray, ...]:
        if (kind, bucket) not in self.open:
            name = self.model.files.get((kind, bucket))
            if name is None:
                self.open[kind, bucket] = ()
            else:
                raw = np.memmap(self._path(name), np.uint8, "r")
                n = int(raw[:8].view(np.int64)[0])
                keys, rest = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n :]
                if kind == PAIRS:
                    tail = rest[n:].tobytes()
                    large = int(np.frombuffer(tail[:8], np.int64)[0])
                    self.open[kind, bucket] = keys, rest[:n], np.frombuffer(tail[8 : 8 + 8 * large], np.uint64), np.frombuffer(tail[8 + 8 * large :], np.int64)
                else:
                    values, at = [], 0
                    for wide in {WORDS: (8,), CONTEXTS: (8, 4, 4, 4), FOLLOWED: (4,)}[kind]:
                        values.append(rest[at : at + wide * n].view(f"i{wide}" if wide == 8 else "u4"))
                        at += wide * n
                    self.open[kind, bucket] = keys, *values
        return self.open[kind, bucket]

    def look(self, kind: int, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The values of keys (one row each; 0 for a key that the model lacks), looked up in order of hash."""
        out = np.zeros((len(keys), 4 if kind == CONTEXTS else 1), np.int64)
        order = np.lexsort((keys, bucket))
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if not len(own) or not (found := self.arrays(kind, int(bucket[own[0]]))):
                continue
            at = np.minimum(np.searchsorted(found[0], keys[own]), len(found[0]) - 1)
            hit = found[0][at] == keys[own]
            at, own = at[hit], own[hit]
            if kind == PAIRS:
                n = found[1][at].astype(np.int64)
                large = n == 255
                n[large] = found[3][np.searchsorted(found[2], keys[own[large]])]
                out[own, 0] = n
            else:
                for k, values in enumerate(found[1:]):
                    out[own, k] = values[at]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score."""
        model = self.model
        word, begin, before = tokens_of(data, offsets)
        of_bucket = np.uint64(model.buckets)
        own, which = np.unique(word, return_inverse=True)
        bucket = (own % of_bucket).astype(np.int64)
        c = self.look(WORDS, own, bucket)[:, 0]
        base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[which]
        known = (c > 0)[which]
        n = self.look(FOLLOWED, own, bucket)[:, 0]
        pairs = max(1, model.pair_types)
        low = np.maximum(0.0, n - np.array(model.word_discounts)[np.minimum(n, 3)]) / pairs
        left = model.left_over / pairs if model.pair_types else 1.0
        low = (low + left / (model.types + 1))[which]
        contexts, at = np.unique(before, return_inverse=True)
        sums = self.look(CONTEXTS, contexts, (contexts % of_bucket).astype(np.int64))
        total = sums[:, 0].astype(np.float64)
        back = np.where(total > 0, (sums[:, 1:] * np.array(model.pair_discounts)[1:]).sum(1) / np.maximum(total, 1.0), 1.0)[at]
        total = np.maximum(total, 1.0)[at]
        keys, first, at = np.unique(pair_hash(before, word), return_index=True, return_inverse=True)
        n = self.look(PAIRS, keys, pair_bucket(before[first], word[first], model.buckets))[:, 0]
        n = (n - np.array(model.pair_discounts)[np.minimum(n, 3)])[at]
        p = np.log10(np.maximum(n, 0.0) / total + back * low)
        per_text = [np.add.reduceat(x, begin[:-1]) for x in (known.astype(np.int64), base, p)]
        return np.diff(begin), *per_text


def pair_bucket(before: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """A context's pairs are in SPREAD buckets at most."""
    return mix(before ^ (word % np.uint64(SPREAD))) % np.uint64(buckets)


_OPEN: dict[str, Arrays] = {}


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    Scores are log10 probabilities of the whole text with its end. Null and empty texts are the end alone. With a
    model of no text at all every token has the same probability. Repeated rows are scored each, null ids stay
    null, an empty table gives an empty result; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if own.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[own.folder] = Arrays(own)
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for first, last in pieces(offsets, PIECE):
                n, known, base, p = _OPEN[own.folder].score(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), own.tokens)), pa.array(base), pa.array(p), pa.array(10.0 ** (-p / n))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
