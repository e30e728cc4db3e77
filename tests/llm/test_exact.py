"""Operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics import session
from shopmetrics.llm import block_naming, bpe, decontaminate, kneser_ney, ngram_join, repeats, sharding, training_order, url_reputation
from shopmetrics.llm.catalog import vocabulary_path
from tests.llm.conftest import SPECIAL

sha = lambda b: hashlib.sha256(b).hexdigest()


def some_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 220))) for _ in range(n // 3)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(n // 3, 2 * n // 3):  # near copies, and copies that differ in white space or case
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "  ", " \n"]).join(t)))
    for k in range(2 * n // 3, n):  # passages that texts share
        a, b = rng.choice(base), rng.choice(base)
        rows.append((k, a[rng.randint(0, 50) :] + " " + rng.choice(words) + " " + b[: rng.randint(0, 900)]))
    rows += [(1000 + k, t) for k, t in enumerate(SPECIAL)]
    return rows + [rows[3], rows[3], (None, "a b c d"), (None, None), (5, "another text under a used id")]


ROWS = some_rows()


# op1


def test_bpe_is_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(vocabulary_path())
    theirs.no_truncation()
    theirs.no_padding()
    rng = random.Random(4)
    pool = [*"abcABC  \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u180e\u200b\u2028\u3000\ufeff'\"12²½Ⅷ٣éß中か🙂\u0301_-.,!<|>", "<|endoftext|>", "'s", "'re", "'ll", " '", "''", "the ", "aaaaaaaa"]
    rows = ROWS + [(5000 + k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 50)))) for k in range(1500)] + [(9000, "ab" * 400), (9001, "é" * 90)]
    got = bpe.encode_and_decode(docs(rows), vocabulary_path()).collect()
    want = Counter()
    for i, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), theirs.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want


def test_bpe_decodes_ids_that_no_text_gave():
    with open(vocabulary_path(), encoding="utf-8") as f:
        coder = bpe.BytePairs(f.read())
    assert coder.decode(coder.encode("\U0002A6D6")[:1]) == "\ufffd"
    assert coder.decode([]) == "" and coder.decode(coder.encode("<|endoftext|>")) == "<|endoftext|>"


# op2


def removed(texts, least):
    seen = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("many", [512, 2])
def test_repeats_are_brute_force(docs, monkeypatch, many):
    rng = random.Random(9)
    line = "".join(rng.choice("abc ") for _ in range(150))  # shorter than a repeat, in many texts
    rows = ROWS + [(2000 + k, "".join(rng.choice("abcd") for _ in range(90)) + line + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 200)))) for k in range(40)]
    rows += [(3000, "z" * 700), (3001, ("xy" * 130) + "q" + ("xy" * 130))]
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([(t or "").encode() for _, t in rows], 200)))
    buckets = repeats._sort_suffixes.__globals__
    monkeypatch.setitem(buckets, "MANY", many)
    # Workers read the package that was sent along, so the low limit is tried on the functions themselves.
    if many == 2:
        got = in_process(rows, 200)
        assert Counter(got) == want
    else:
        out = repeats.remove_repeats(docs(rows)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want


def test_repeats_broadcast_nothing(docs):
    plan = repeats.remove_repeats(docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeat_spans_are_dealt_evenly(ready):
    def spans(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            yield from repeats._spans(row, np.zeros(len(row), np.int64), np.full(len(row), 300))

    found = ready.range(4000, numPartitions=3).mapInArrow(spans, repeats._ROWS)
    parts = Counter(r.p for r in repeats._to_buckets(found, 8).selectExpr("spark_partition_id() as p").collect())
    assert sum(parts.values()) == 4000 and len(parts) == 8 and max(parts.values()) < 2 * 500


def in_process(rows, least):
    """The four steps of the operator on batches, without Spark between them."""
    import pyarrow as pa

    texts = [t or "" for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(texts)], ["row", "text"])
    found = list(repeats._sort_suffixes(repeats._find_suffixes(least, 4)(iter([batch]))))
    needs: dict = {}
    for b in found:
        for r in b.to_pylist():
            if r["kind"] == repeats.NEED:
                needs.setdefault(r["row"], []).append({"at": r["at"], "key": r["key"], "many": r["many"]})
    assert any(n["many"] for v in needs.values() for n in v)
    own = sorted(needs)
    kind = pa.list_(pa.struct([("at", pa.int64()), ("key", pa.int64()), ("many", pa.bool_())]))
    some = pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([texts[k] for k in own]), pa.array([needs[k] for k in own], kind)], ["row", "text", "needs"])
    more = list(repeats._scan_trees(least)(repeats._fetch_surroundings(least, 4)(iter([some]))))
    gone = [np.zeros(len(t.encode()) + 1, bool) for t in texts]
    for b in found + more:
        for r in b.to_pylist():
            if r["kind"] == repeats.SPAN:
                gone[r["row"]][r["first"] : r["last"]] = True
    for (i, t), g in zip(rows, gone):
        raw = (t or "").encode()
        yield i, len(raw), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]), bytes(b for b, x in zip(raw, g) if not x)


def test_intervals_of_a_suffix_array():
    words = sorted(["banana"[k:] for k in range(6)])  # a ana anana banana na nana
    common = [1, 3, 0, 0, 2]
    found = {(words[f][:d], f, t) for d, f, t in repeats.intervals(common)}
    assert found == {("ana", 1, 2), ("a", 0, 2), ("na", 4, 5)}


# op3


def texts_read_back(out, folder, per_shard, length, dtype="u1"):
    """Each text's ids from the files, by its parts; checks that the parts of a record fill it without gaps."""
    records, parts = {}, {}
    for r in out:
        records.setdefault(r.slot, []).append(r)
    for slot, own in records.items():
        (ids,) = training_order.read_slots(folder, slot, 1, per_shard, length, dtype)
        own.sort(key=lambda r: r.at)
        assert [r.at for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        assert {(r.shard, r.record, r.crc32) for r in own} == {(*divmod(slot, per_shard), zlib.crc32(ids.tobytes()))}
        assert not ids[own[-1].at + own[-1].n_tokens :].any()
        for r in own:
            parts.setdefault(r.doc_id, []).append((r.first, ids[r.at : r.at + r.n_tokens]))
    filled = [sum(r.n_tokens for r in own) for own in records.values()]
    return {i: np.concatenate([x for _, x in sorted(p, key=lambda q: q[0])]) for i, p in parts.items()}, filled


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_training_order_round_trip(docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(training_order, "PIECE_BYTES", most)  # small pieces: a record goes on from piece to piece
    rows = [(k, t) for k, (_, t) in enumerate(ROWS)]
    frame = docs(rows).coalesce(2)
    out = training_order.write_training_order(frame, str(tmp_path / "o"), length=64, per_shard=50, key="k").collect()
    back, filled = texts_read_back(out, str(tmp_path / "o"), 50, 64)
    assert {k: x.tobytes() for k, x in back.items()} == {k: t.encode() for k, t in rows if t}
    # Only the last record of a partition is padded.
    assert sum(n < 64 for n in filled) <= 2 and sum(filled) == sum(len((t or "").encode()) for _, t in rows)
    assert sorted({r.slot for r in out}) == list(range(len(filled)))
    assert [r.slot for r in sorted(out, key=lambda r: (r.doc_id, r.first))] != sorted(r.slot for r in out)


def test_training_order_of_repeated_rows_and_null_ids(docs, tmp_path):
    rows = [(1, "ab" * 40), (1, "ab" * 40), (None, "cd" * 9), (None, None), (2, "")]
    out = training_order.write_training_order(docs(rows), str(tmp_path / "o"), length=16, per_shard=3).collect()
    assert Counter(r.doc_id for r in out if r.first == 0) == {1: 2, None: 1}
    assert sum(r.n_tokens for r in out) == 178


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_training_order_ids_of_any_type(ready, tmp_path, kind):
    frame = ready.createDataFrame([(7, "some text"), (8, "more")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    out = training_order.write_training_order(frame, str(tmp_path / "o"), length=4)
    assert dict(out.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
    assert {str(r.doc_id) for r in out.collect()} == {"7", "8"}


def test_training_order_of_nothing(ready, tmp_path):
    out = training_order.write_training_order(ready.createDataFrame([], "doc_id long, text string"), str(tmp_path / "o"))
    assert out.collect() == [] and not (tmp_path / "o").exists()


def test_training_order_tasks_write_several_shards(docs, ready, tmp_path):
    width = ready.conf.get("spark.sql.shuffle.partitions")
    ready.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = [(k, t) for k, (_, t) in enumerate(ROWS)]
        out = training_order.write_training_order(docs(rows), str(tmp_path / "o"), length=64, per_shard=20).collect()
    finally:
        ready.conf.set("spark.sql.shuffle.partitions", width)
    assert len({r.shard for r in out}) > 4
    assert {k: x.tobytes() for k, x in texts_read_back(out, str(tmp_path / "o"), 20, 64)[0].items()} == {k: t.encode() for k, t in rows if t}


def test_training_order_holds_the_vocabulary_ids(ready, docs, tmp_path, monkeypatch):
    from shopmetrics.llm import catalog

    rows = [(k, t) for k, (_, t) in enumerate(ROWS)]
    monkeypatch.setattr(catalog, "read_table", lambda *_: docs(rows))
    monkeypatch.setattr(catalog, "scratch_path", lambda *_: str(tmp_path / "o"))
    out = catalog.op3_training_order(ready, "").collect()
    with open(vocabulary_path(), encoding="utf-8") as f:
        coder = bpe.BytePairs(f.read())
    dtype = "<u2" if len(coder.token_size) <= 1 << 16 else "<u4"
    back, _ = texts_read_back(out, str(tmp_path / "o"), training_order.PER_SHARD, training_order.SEQUENCE, dtype)
    assert {k: x.tolist() for k, x in back.items()} == {k: coder.encode(t) for k, t in rows if t}


def feistel(x, n, key):
    """The slot of a number, one integer at a time."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, wide = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = x >> half, x & low
        for r in range(training_order.ROUNDS):
            k = int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")
            h = (right ^ k) * 0x9E3779B97F4A7C15 & wide
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & wide
            left, right = right, left ^ (h ^ h >> 32) & low
        x = right << half | left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_bijection(n):
    order = training_order.SlotPermutation(n, "key")
    slots = order.slot(np.arange(n))
    assert slots.tolist() == [feistel(x, n, "key") for x in range(n)]
    assert sorted(slots.tolist()) == list(range(n))
    assert order.number(slots).tolist() == list(range(n))
    assert n < 1000 or (training_order.SlotPermutation(n, "other").slot(np.arange(n)) != slots).any()


# op4


def test_shards_match_the_mixture(docs):
    rng = random.Random(2)
    rows = [(k, f"text {k}", "en", "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])) for k in range(997)] + [(3, "text 3", "en", "a")] * 2 + [(None, None, "en", None)]
    out = sharding.stratified_shards(docs(rows), 10, buckets=16).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    whole, n = Counter(r.source for r in out), len(out)
    for s in sizes:
        for source, count in Counter(r.source for r in out if r.shard == s).items():
            assert abs(count - whole[source] / n * sizes[s]) <= 3
    text = {k: t for k, t, *_ in rows}
    assert all(r.size == 16 + len((text[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in out)
    # The place by definition: rank within the source, then all by fractional rank.
    mix = lambda r: hashlib.md5(f"0:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    by_source: dict = {}
    for r in sorted(rows, key=lambda r: (mix(r), r[0] is not None, r[0] or 0)):
        by_source.setdefault(r[3], []).append(r)
    ranked = sorted(((2 * k + 1) / (2 * len(rs)), mix(r), "s" + r[3] if r[3] else "", r[0] or 0, r) for rs in by_source.values() for k, r in enumerate(rs))
    want = Counter((r[0], place * 10 // n) for place, (*_, r) in enumerate(ranked))
    assert Counter((r.doc_id, r.shard) for r in out) == want


# op5


def test_urls_and_rules(ready):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = {
        "HTTP://WWW.Example.COM/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "x://net/es/1": ("net", "/es/1", "net/es/"),
        "x://a.net?/es/": ("a.net", "", None),
        "https://com": ("com", "", None),
        "no scheme/en": ("", "", None),
        None: ("", "", None),
        "": ("", "", None),
    }
    pages = ready.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, host int, n int")
    labels = ready.createDataFrame([(4, 1), (4, 1), (6, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = url_reputation.judge_urls(pages, labels, rules).collect()
    assert {list(urls)[r.page_id]: (r.host, r.path, r.rule) for r in got} == urls
    assert all(r.verdict in ("allow", "block") for r in got)
    said = {list(urls)[r.page_id]: r.verdict for r in got}
    assert said["https://m.example.com/en/"] == "block" and said["https://notexample.com/en/"] == "allow"
    assert url_reputation.judge_urls(pages.limit(0), labels, rules).count() == 0
    assert url_reputation.judge_urls(pages, labels.limit(0), rules).count() == len(urls)


def test_good_hosts_rank_above_bad_ones(ready):
    hosts = [("a.good.org", 200, 190), ("b.good.org", 0, 0), ("a.bad.org", 200, 10), ("b.bad.org", 0, 0), ("c.bad.org", 2, 2)]
    out = {r.host: r.bound for r in url_reputation.host_bounds(ready.createDataFrame(hosts, "host string, n long, k long")).collect()}
    assert out["a.good.org"] > out["b.good.org"] > out["b.bad.org"]
    assert out["c.bad.org"] < out["a.good.org"] and out["a.bad.org"] < out["c.bad.org"]


# op6


def grams(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    least = [i for i, _ in rows]
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                name[root(a)] = root(b)
    members: dict = {}
    for k in range(len(rows)):
        members.setdefault(root(k), []).append(least[k])
    small = lambda ids: min((i for i in ids if i is not None), default=None)
    return Counter((i, len(s), small(members[root(k)])) for k, (i, s) in enumerate(zip(least, sets)))


@pytest.mark.parametrize("width, percent, block_bytes", [(3, 90, 8 << 20), (5, 80, 3000), (1, 50, 8 << 20)])
def test_near_groups_are_brute_force(docs, width, percent, block_bytes):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 4000]
    out = ngram_join.near_groups(docs(rows), width=width, percent=percent, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == groups(rows, width, percent)


@pytest.mark.parametrize("width, percent", [(5, 80), (1, 50)])
def test_near_groups_with_sketches_are_brute_force(docs, width, percent):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 4000]
    out = ngram_join.near_groups(docs(rows), width=width, percent=percent, sketches=True).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == groups(rows, width, percent)


@pytest.mark.parametrize("most, at_once", [(10**9, 1 << 16), (10**9, 7), (60, 7)])
def test_rows_that_stay_apart_were_tested(most, at_once, monkeypatch):
    monkeypatch.setattr(ngram_join, "TESTS_AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (4, 4)).astype(np.uint64)
    sketches = base[rng.integers(0, 4, 90)].copy()
    for k in range(90):  # change some of the 64 places
        for _ in range(rng.integers(0, 30)):
            sketches[k, rng.integers(4)] ^= np.uint64(int(rng.integers(1, 16)) << (4 * int(rng.integers(16))))
    group = np.sort(rng.integers(0, 6, 200))
    row = np.concatenate([rng.choice(90, (group == g).sum(), replace=False) for g in range(6)])
    a, b = ngram_join.tested_meetings(group, row, sketches, 80, most)
    label = list(range(90))
    for x, y in zip(a.tolist(), b.tolist()):
        assert x < y
        label = [label[x] if v == label[y] else v for v in label]
    for g in range(6):
        own = row[group == g]
        for x in own:
            near = ngram_join.alike(np.repeat(sketches[x][None], len(own), 0), sketches[own], 80)
            assert all(label[x] == label[y] for y in own[near])
    if most > 1000:
        assert all(ngram_join.alike(sketches[x][None], sketches[y][None], 80)[0] for x, y in zip(a, b))
    assert all(len(v) == 0 for v in ngram_join.tested_meetings(np.empty(0, np.int64), np.empty(0, np.int64), sketches, 80))


def test_slices_keep_groups_whole():
    group = np.sort(np.random.default_rng(2).choice(np.append(np.arange(40), 2**32 - 1), 500)).astype(np.uint64)
    both = np.sort((group << np.uint64(32)) | np.arange(500, dtype=np.uint64))
    for rows in (1, 7, 60, 499, 500, 1000):
        own = list(ngram_join.group_slices(both, rows))
        assert np.array_equal(np.concatenate(own), both) and all(len(x) for x in own)
        ends = [{int(v) >> 32 for v in x} for x in own]
        assert sum(map(len, ends)) == len(set().union(*ends))
        assert all(len(x) <= rows or len(e) == 1 for x, e in zip(own, ends))
    assert not list(ngram_join.group_slices(both[:0], 5))


@pytest.mark.parametrize("most, slice_rows, buckets", [(10**9, 10**6, 1), (10**9, 10**6, 12), (10**9, 100, 51), (300, 100, 12)])
def test_buckets_together_connect_what_meets(most, slice_rows, buckets, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_TESTS", most)
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ngram_join, "TESTS_AT_ONCE", 500)
    rng = np.random.default_rng(11)
    sketches = rng.integers(0, 2**63, (20, 4)).astype(np.uint64)[rng.integers(0, 20, 200)]
    sketches[:60] = sketches[0]  # a large family
    for k in range(200):
        for _ in range(rng.integers(0, 24)):
            sketches[k, rng.integers(4)] ^= np.uint64(int(rng.integers(1, 16)) << (4 * int(rng.integers(16))))
    meant = [(int(ngram_join.mix(np.array([g], np.uint64))[0]), k) for g in range(400) for k in rng.choice(200, 30, replace=False)]
    meant += [(int(g), k) for k, own in enumerate(ngram_join.band_signatures(sketches)) for g in own]
    meant += [(int(ngram_join.mix(np.array([1000 + k % 3], np.uint64))[0]), k) for k in range(60)]
    sig, row = np.array([m[0] for m in meant], np.uint64), np.array([m[1] for m in meant])
    plain, found, met = np.arange(200), [], []
    for bucket in range(buckets):
        own = sig % np.uint64(buckets) == bucket
        both = np.sort(((sig[own] >> np.uint64(32)) << np.uint64(32)) | row[own].astype(np.uint64))
        found.append(ngram_join.bucket_links(np.repeat(both, 2), sketches, 80, bucket, buckets))
        both = np.unique(both)
        met.append(ngram_join.tested_meetings(both >> np.uint64(32), (both & np.uint64(2**32 - 1)).astype(np.int64), sketches, 80))
    for a, b in met:
        plain = ngram_join.joined(plain, a, b)
    label = np.arange(200)
    for a, b in found:
        label = ngram_join.joined(label, a, b)
    assert np.array_equal(label[plain], label)  # nothing that meets is apart
    if most > 1000:
        assert np.array_equal(label, plain)
        assert buckets == 1 or 4 * sum(len(a) for a, _ in found) < sum(len(a) for a, _ in met)  # a pair is not handed on by every bucket


def test_joined_rows():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (50, 20), (50, 60), (300, 299)):
        a, b = (np.arange(m), np.arange(m) + 1) if m == 299 else rng.integers(0, n, (2, m))
        name = list(range(n))
        for x, y in zip(a.tolist(), b.tolist()):
            name = [min(name[x], name[y]) if v in (name[x], name[y]) else v for v in name]
        half = ngram_join.joined(np.arange(n), a[: m // 2], b[: m // 2])
        assert ngram_join.joined(half, a[m // 2 :], b[m // 2 :]).tolist() == name


def test_near_copies_go_by_row(docs):
    a, b, c, d, e, z, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcdezo")
    rows = [(1, a), (None, a + " tail"), (None, z), (3, b), (5, b + " tail"), (5, other)]  # an id that a near copy shares with a text of its own
    rows += [(7, c), (7, c + " tail"), (None, d), (None, d + " tail"), (9, e), (9, e), (10, e), (None, None), (None, None), (11, "")]
    frame = docs(rows)
    out = ngram_join.keep_first_of_groups(frame)
    assert out.columns == frame.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept.total() == 10
    one_of = lambda i, t: kept[i, t] + kept[i, t + " tail"] == 1
    assert one_of(7, c) and one_of(None, d)
    rest = Counter({k: n for k, n in kept.items() if (k[1] or "")[:2] not in ("c0", "d0")})
    assert rest == Counter({(1, a): 1, (None, z): 1, (3, b): 1, (5, other): 1, (9, e): 1, (None, None): 2, (11, ""): 1})


def test_passing_sets_share_a_signature():
    rng = np.random.default_rng(5)
    tried = 0
    while tried < 2000:
        percent, n = int(rng.choice([60, 80, 90])), int(rng.integers(1, 90))
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64))
        rng.shuffle(pool)
        a = np.sort(pool[:n])
        b = np.unique(np.concatenate([rng.permutation(a)[: n - int(rng.integers(0, n // 4 + 1))], pool[n : n + int(rng.integers(0, n // 6 + 2))]]))
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        if both == union or 100 * both < percent * union:
            continue
        tried += 1
        assert len(np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)))


# op8


def test_kneser_ney(docs):
    rows = ROWS
    model = kneser_ney.train(docs([r for r in rows if r[0] is None or r[0] % 3]))
    out = kneser_ney.score(docs(rows), model).collect()
    cut = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]
    train = [cut(t) for i, t in rows if i is None or i % 3]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<", *t], t))
    of = lambda counts: kneser_ney.discounts(np.bincount(np.minimum(list(counts.values()), 5), minlength=6))
    before = Counter(w for _, w in pairs)
    d, e = of(pairs), of(before)
    total, took = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        took[a] += d[min(k, 3)]
    left = sum(e[min(k, 3)] for k in before.values()) / len(pairs)

    def p(a, w):
        low = max(0, before[w] - e[min(before[w], 3)]) / len(pairs) + left / (v + 1)
        k = pairs[a, w]
        return low if not total[a] else max(0, k - d[min(k, 3)]) / total[a] + took[a] / total[a] * low

    want: dict = {}
    for i, t in rows:
        t = cut(t)
        want.setdefault(i, []).append((len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), sum(math.log10(p(a, w)) for a, w in zip(["<", *t], t))))
    got: dict = {}
    for r in out:
        assert r.train_tokens == n
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-7)
    # Probabilities after a context sum to 1 with the place of unknown words.
    assert abs(sum(p(train[0][0], w) for w in c) + p(train[0][0], "unseen") - 1) < 1e-9


def test_language_model_of_nothing(docs):
    model = kneser_ney.train(docs(ROWS).limit(0))
    out = kneser_ney.score(docs([(1, "a b"), (2, None)]), model).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in out) == [(1, 3, 0), (2, 1, 0)]
    assert kneser_ney.score(docs(ROWS).limit(0), model).count() == 0


# op9


@pytest.mark.parametrize("block_bytes, bits", [(4096, 64), (16, 64), (16, 3)])
def test_exact_dedup(docs, block_bytes, bits):
    rows = ROWS + [(7000, "a\x0b b "), (6999, "a\n\nb "), (6998, "a\u00a0b ")]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 6000]
    body = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    members: dict = {}
    for (i, _), t in zip(rows, body):
        members.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in members.items()}
    want, once = Counter(), set()
    for (i, _), t in zip(rows, body):
        kept = i == keep[t] and (i, t) not in once
        once.add((i, t))
        want[i, keep[t], len(members[t]), kept, sha(t.encode())] += 1
    out = block_naming.exact_dedup(docs(rows), block_bytes=block_bytes, checksum_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want


def test_exact_dedup_keeps_rows_whole(docs):
    frame = docs(ROWS)
    out = block_naming.keep_first_of_equals(frame)
    assert out.columns == frame.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in ROWS})
    assert block_naming.exact_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup_leaves_no_written_texts(docs, ready, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(session, "_scratch_root", lambda spark: str(tmp_path / "a scratch%20folder"))
    for frame in (docs(ROWS), docs(ROWS).limit(0)):
        out = block_naming.exact_dedup(frame, checksum_bits=bits)
        assert not list(tmp_path.glob("*/blocks-*")) and list(tmp_path.glob("*/block-parts-*"))
        assert out.count() == frame.count()
    with pytest.raises(ValueError):
        outside = str(tmp_path / "kept" / "table")
        ready.range(3).write.parquet(outside)
        session.discard(ready.read.parquet(outside))
    assert ready.read.parquet(outside).count() == 3


# op10


def hits(rows, items, width=13):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows: dict = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + width]), set()).add("null" if i is None else str(i))
    out = Counter()
    for i, t in rows:
        w = cut(t)
        gone, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    gone |= set(range(k, k + n))
                    found |= own
        out[i, len(w), len(gone), len(found), sha(",".join(sorted(found)).encode()), bool(gone) and 20 * len(gone) >= len(w)] += 1
    return out


@pytest.mark.parametrize("max_windows", [100_000, 20])
def test_contamination(docs, ready, max_windows):
    texts = [t for _, t in ROWS if t and 300 < len(t) < 2000]
    items = [(k, t[20:400]) for k, t in enumerate(texts[:6])] + [(50, "a"), (51, "Edé, ZZZ"), (52, ""), (53, None), (None, texts[7][:200]), (0, texts[8][:300])]
    rows = ROWS + [(8000, "ZZZ edé zzz É"), (8001, "EDÉ zzz"), (8002, texts[0][20:400].upper().replace("É", "é")), (8003, "! ".join(texts[1][20:390].split()))]
    bench = ready.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs(rows), bench, max_windows=max_windows).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == hits(rows, items)


def test_decontaminate_removes_documents_or_spans(docs, ready):
    item = " ".join(f"w{k}" for k in range(15))
    bench = ready.createDataFrame([(1, item)], "item_id long, text string")
    frame = docs([(1, f"before {item} after"), (2, "clean text"), (3, None)])
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, bench, remove="spans").collect()}
    assert cut == {1: "before after", 2: "clean text", 3: None}
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == 3
    assert decontaminate.decontaminate(frame.limit(0), bench).count() == 0
