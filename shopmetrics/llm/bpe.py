"""Byte-level BPE encoding and decoding with contiguous rank arrays (operator 1).

A short word is a row of an array of parts, beside a row of the ranks of its adjacent
pairs. The smallest rank is looked for, the boundary there is deleted, the ranks of the
two neighbouring pairs are refreshed, until no pair has a rank. All new words of a
batch go through these steps together. A long word keeps its pairs in a heap instead,
which gives the same parts.

Texts are split into words on their UTF-8 bytes, a batch at a time. Equal words (by a
64-bit hash with their length) are encoded once per batch and remembered per worker up
to a fixed number. The vocabulary (a few MB, checked) is read once on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import utf8_view
from .wordhash import mix, pieces, powers

SHORT = 32
MAX_VOCABULARY_BYTES = 64 << 20
REMEMBERED = 400_000
PIECE_BYTES = 1 << 20
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    # Surrogates are no characters of a text; a stand-in keeps the places right.
    text = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            kinds[m.start() : m.end()] = kind
    return kinds


def word_starts(data: np.ndarray, segments: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mask of the bytes where a word begins, by the split rule of byte-level vocabularies.

    A word is a run of letters, of numbers or of other characters, with one space before it;
    an English contraction; or white space, of which the last character is left to what follows
    (as its space, or else as a word of its own). No word crosses a segment's begin.
    """
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[segments] = True
    place = np.arange(n)
    cls = kinds[data]
    lead = place
    if (data >= 0x80).any():
        is_lead = (data & 0xC0) != 0x80
        lead = np.maximum.accumulate(np.where(is_lead, place, 0))
        wide = np.flatnonzero(data >= 0xC0)
        b = [data[np.minimum(wide + k, n - 1)].astype(np.int64) & 0x3F for k in range(4)]
        first = data[wide].astype(np.int64)
        code = np.where(
            first < 0xE0,
            (first & 0x1F) << 6 | b[1],
            np.where(first < 0xF0, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]),
        )
        cls[wide] = kinds[np.minimum(code, 0x10FFFF)]
        cls = cls[lead]
    change = begins[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    change[0] = True
    runs = np.flatnonzero(change)
    after = np.append(runs[1:], n)
    kind = cls[runs]
    start = np.zeros(n + 1, bool)
    spaces = kind == SPACE
    start[runs[spaces]] = True
    followed = spaces & ~begins[after] & (after < n)
    start[lead[after[followed] - 1]] = True
    solid = runs[~spaces]
    joined = (solid > 0) & ~begins[solid] & (data[solid - 1] == 32)
    start[solid[~joined]] = True
    # Contractions: a lone apostrophe that no space precedes, then s, t, m, d or re, ve, ll.
    mark = solid[~joined]
    mark = mark[(data[mark] == 39) & (mark + 1 < n)]
    if len(mark):
        one, two = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        same = ~begins[mark + 1]
        short = same & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        more = same & (mark + 2 < n) & ~begins[np.minimum(mark + 2, n)]
        long = more & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return start[:n]


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        token = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, k in vocab.items():
            token[k] = bytes(alphabet[c] for c in text)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for text, k in self.special.items():
            token[k] = text
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_size = np.fromiter(map(len, token), np.int64, len(token))
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.byte_id = np.full(256, -1, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.kinds = character_classes()
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_at = np.empty(0, np.int64)
        self.known_size = np.empty(0, np.int64)
        self.store = np.empty(0, np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for a pair that never merges or lacks a part (-1)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.ranks[at], NONE)

    def encode_short(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of 1 to SHORT bytes, all at once: their ids one after the other, and how many each has."""
        width = int(size.max())
        col = np.arange(width)
        parts = np.full((len(begin), width + 1), -1, np.int32)
        own = col < size[:, None]
        parts[:, :width][own] = self.byte_id[data[(begin[:, None] + col)[own]]]
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        done = np.empty((len(begin), width), np.int32)
        live = np.arange(len(begin))
        while len(live):
            row = np.arange(len(live))
            at = ranks.argmin(1)
            low = ranks[row, at]
            go = low != NONE
            if not go.all():
                done[live[~go]] = parts[~go, :-1]
                live, parts, ranks, at, low = live[go], parts[go], ranks[go], at[go], low[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            # Delete the boundary after part ``at``: all that follows moves one to the left.
            stay = col < (at + 1)[:, None]
            parts[:, :-1] = np.where(stay, parts[:, :-1], parts[:, 1:])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(stay[:, :-1], ranks[:, :-1], ranks[:, 1:])
            ranks[:, -1] = NONE
            new = self.made[low]
            parts[row, at] = new
            left = np.maximum(at - 1, 0)
            both = self.rank_of(np.concatenate([new, np.where(at > 0, parts[row, left], -1)]), np.concatenate([parts[row, at + 1], new]))
            ranks[row, left] = np.where(at > 0, both[len(row) :], ranks[row, left])
            ranks[row, at] = both[: len(row)]
        kept = done >= 0
        return done[kept], kept.sum(1)

    def encode_long(self, word: bytes) -> list[int]:
        """One word of any length; pairs wait in a heap by rank, then place."""
        parts = self.byte_id[np.frombuffer(word, np.uint8)]
        first = self.rank_of(parts[:-1], parts[1:])
        ids, n = parts.tolist(), len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(first[k]), int(k), ids[k], ids[k + 1]) for k in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= n or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = int(self.made[rank]), -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := self.pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def learn(self, data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Encode distinct new words and remember them."""
        order = np.argsort(size, kind="stable")
        hashes, begin, size = hashes[order], begin[order], size[order]
        ids, counts = [], []
        at = 0
        while at < len(size) and size[at] <= SHORT:  # words of like sizes together, some thousands at a time
            last = int(np.searchsorted(size, max(size[at] + 3, 4), "right"))
            last = min(last, at + 20_000, int(np.searchsorted(size, SHORT, "right")))
            flat, n = self.encode_short(data, begin[at:last], size[at:last])
            ids.append(flat)
            counts.append(n)
            at = last
        for b, s in zip(begin[at:].tolist(), size[at:].tolist()):
            ids.append(np.array(self.encode_long(data[b : b + s].tobytes()), np.int32))
            counts.append(np.array([len(ids[-1])]))
        n = np.concatenate(counts).astype(np.int64)
        where = len(self.store) + np.cumsum(n) - n
        self.store = np.concatenate([self.store, *ids])
        all_hashes = np.concatenate([self.known, hashes])
        order = np.argsort(all_hashes, kind="stable")
        self.known = all_hashes[order]
        self.known_at = np.concatenate([self.known_at, where])[order]
        self.known_size = np.concatenate([self.known_size, n])[order]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts as one byte array with their begins -> all ids, and where each text's ids begin."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        found = []  # special tokens: begin, end, id
        raw = data.tobytes() if self.special else b""
        for text, k in self.special.items():
            at = raw.find(text)
            while at >= 0:
                inside = int(np.searchsorted(offsets, at, "right"))
                if inside < len(offsets) and at + len(text) <= offsets[inside]:
                    found.append((at, at + len(text), k))
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        segments = np.append(offsets, [x for f in found for x in f[:2]]).astype(np.int64)
        start = word_starts(data, segments, self.kinds)
        for a, b, _ in found:
            start[a + 1 : b] = False
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(data)))
        power, inverse = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        hashes = mix((total[begin + size] - total[begin]) * inverse[begin] ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, own)
        new = (at >= len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != own) if len(self.known) else np.ones(len(own), bool)
        if new.any():
            self.learn(data, own[new], begin[first[new]], size[first[new]])
            at = np.searchsorted(self.known, own)
        where, n = self.known_at[at][which], self.known_size[at][which]
        if found:  # a special token is one id, put after the remembered ones
            ids = self.store
            self_at = np.searchsorted(begin, [f[0] for f in found])
            where[self_at], n[self_at] = len(ids) + np.arange(len(found)), 1
            ids = np.concatenate([ids, np.array([f[2] for f in found], np.int32)])
        else:
            ids = self.store
        ends = np.cumsum(n)
        out = ids[np.repeat(where - (ends - n), n) + np.arange(int(ends[-1]))].astype(np.uint32)
        return out, np.append(0, ends)[np.searchsorted(begin, offsets)]

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts and their begins -> bytes and their begins."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.token_bytes[np.repeat(self.token_at[ids] - (ends - size), size) + np.arange(total)]
        return out, np.append(0, ends)[offsets]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_bytes(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_bytes(np.array(ids, np.int64), np.array([0, len(ids)]))
        return out.tobytes().decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def _coder(spec: str) -> BytePairs:
    """One coder per worker and vocabulary."""
    name = hashlib.sha1(spec.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = BytePairs(spec)
    return _LOADED[name]


def _binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(kind)


def _decoded(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes as texts; bytes that are no UTF-8 (from ids that no text gave) become replacement characters."""
    try:
        return _binary(data, offsets, pa.string())
    except pa.ArrowInvalid:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())


def encode_and_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``decoded`` (of these ids).

    ``vocabulary``: path of a byte-level BPE vocabulary on the driver. Special tokens' strings in a text
    become their ids; none is added. Null and empty texts have no tokens and decode to the empty text.
    Repeated rows are encoded each, null ids stay null, an empty table gives an empty result; other
    columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(spec)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for first, last in pieces(offsets, PIECE_BYTES):
                at = offsets[first : last + 1] - offsets[first]
                ids, ids_at = coder.encode_bytes(data[offsets[first] : offsets[last]], at)
                back, back_at = coder.decode_bytes(ids, ids_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(ids_at), pa.int64()),
                        _binary(ids.astype("<u4"), ids_at * 4, pa.binary()),
                        _decoded(back, back_at),
                    ],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
