"""Near copies by chosen-path trees over word shingles (operator 11).

Each document's shingle set is embedded in ``SKETCH`` minwise tokens. A node of a tree is a group of documents. It
branches by ``PICKS`` tokens chosen anew for the node: a document goes to the child of each token's value, so two documents of
similarity s share a child with 1 - (1 - s)^PICKS. Documents alone in a node leave the tree. A small node is compared
exhaustively: first its sketches (one byte a token), then the full sets of those whose sketches do not rule out a link.
A large node branches on. A large node of which one child keeps most of the rows is of documents that are alike, and branching
on would only copy it: its full sets are compared in blocks instead, spread over tasks.

``TREES`` independent trees are grown. With 6 trees of 2 picks a pair at 0.85 misses all first-level children with probability
0.15^12 < 1e-9, and is lost in all trees that go deeper with less than 1e-8 (a tree whose picks all branch on keeps a pair with
0.968); the sketches of a pair rule it out wrongly with less than ``MISS``.

Only the connection counts, so pairs that are connected already are not compared: within a node, once one component holds
the most rows, only the rows outside it are held against all. The first tree's candidates are verified before the others',
which are mostly of one component by then and go. Nodes are narrow rows (a key and a sketch); shingles are
fetched for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import materialize, shuffle_width, utf8_view
from .ngram_join import set_key
from .wordhash import SKETCH, least_agreeing, minwise, mix, pieces, shingle_hashes, word_hashes

TREES, PICKS = 6, 2
MISS = 1e-9
LEAF_ROWS, LEAF_GRAMS = 256, 1 << 20
BLOCK_ROWS, BLOCK_GRAMS = 512, 1 << 21
HUBS = 4  # of a chunk
ALIKE = 0.7  # of a node's rows in one child
DEEPEST = 8  # a node still large there is compared in blocks
BROADCAST_ROWS = 1_000_000  # of 8 bytes


def candidates(sketches: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """A number for each row of a node; rows that may link, directly or over others, have the same."""
    label = np.arange(len(sizes))
    least = least_agreeing(percent / 100, MISS)
    for k in range(len(sizes)):
        near = (sketches[k:] == sketches[k]).sum(1) >= least
        near &= 100 * np.minimum(sizes[k:], sizes[k]) >= percent * np.maximum(sizes[k:], sizes[k])
        for other in np.unique(label[k:][near]).tolist():
            if other != label[k]:
                label[label == other] = label[k]
    return label


class Product:
    """Overlaps of one row with all rows of a group of sets, from the postings of its shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        self.begin = np.cumsum(self.size) - self.size
        _, self.column, self.often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.posting = np.repeat(np.arange(len(sets)), self.size)[np.argsort(self.column, kind="stable")]
        self.first = np.cumsum(self.often) - self.often

    def linked(self, k: int) -> np.ndarray:
        own = self.column[self.begin[k] : self.begin[k] + self.size[k]]
        n = self.often[own]
        overlap = np.bincount(self.posting[np.repeat(self.first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(self.size))
        return 100 * overlap >= self.percent * (self.size + self.size[k] - overlap)

    def central(self) -> np.ndarray:
        """How common the shingles of each row are in the group."""
        return np.add.reduceat(self.often[self.column], self.begin) / self.size


def connect(sets: list[np.ndarray], label: np.ndarray, percent: int, rows: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all rows that are linked, beyond what ``label`` connects already (a forest).

    Two rows that stay apart have been compared: every row outside the largest component is held against all. With
    ``rows`` these rows, and no others, are held against all.
    """
    product = Product(sets, percent)
    label = np.unique(label, return_inverse=True)[1]
    links = []

    def hold(k: int) -> None:
        for other in np.flatnonzero(product.linked(k) & (label != label[k])).tolist():
            if label[other] != label[k]:
                label[label == label[other]] = label[k]
                links.append((k, other))

    if rows is not None:
        for k in rows.tolist():
            hold(k)
        return links
    order = np.argsort(-product.central(), kind="stable")
    held = np.zeros(len(sets), bool)
    for _ in range(len(sets)):
        sizes = np.bincount(label)
        main = sizes.argmax()
        open_rows = order[~held[order] & ((label[order] != main) | (sizes[main] == 1))]
        if not len(open_rows):
            break
        held[open_rows[0]] = True
        hold(int(open_rows[0]))
    return links


def _sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    data, offsets = utf8_view(column)
    for first, last in pieces(offsets, 1 << 20):
        words, at = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield shingle_hashes(words, at, width)


LINKS = "a long, b long"


def _links(keys: list[int], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys[f[k]] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, own in groupby(rows, key=lambda r: tuple(r[c] for c in by)):
        yield list(own)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each path of rows sorted by path; paths of one row are left out."""
    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        path = batch.column("path").to_numpy()
        at = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()]
        for first, last in zip(at, at[1:]):
            if last - first > 1:
                yield batch.slice(first, last - first)
        rest = batch.slice(at[-1])
    if rest is not None and len(rest) > 1:
        yield rest


def _dealt(df: DataFrame, by: list[str], buckets: int) -> DataFrame:
    return df.repartition(buckets, *by).sortWithinPartitions(*by, "key")


class _Sizes:
    """How large a node and a block may be."""

    def __init__(self, leaf_rows: int, leaf_grams: int, block_rows: int, block_grams: int):
        self.leaf_rows, self.leaf_grams, self.block_rows, self.block_grams = leaf_rows, leaf_grams, block_rows, block_grams

    def small(self) -> Column:
        return (F.col("rows") <= self.leaf_rows) & (F.col("grams") <= self.leaf_grams)


MEMBER = ["tree", "path", "key", "n", "sketch"]


def grow(members: DataFrame, percent: int, sizes: _Sizes) -> DataFrame:
    """members (tree, path, key, n, sketch) of first-level nodes -> (tree, path, key, n) of groups to verify.

    A level costs one count of its nodes, which is also that of how its parents' rows were split; the small nodes of all
    levels are compared in one step.
    """
    buckets = shuffle_width(members.sparkSession)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _nodes(batches):
            sketches = np.frombuffer(b"".join(own.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            label = candidates(sketches, own.column("n").to_numpy(), percent)
            stay = np.flatnonzero(np.bincount(label)[label] > 1)
            if len(stay):
                names = mix(own.column("path").to_numpy().view(np.uint64) ^ mix(label.astype(np.uint64) + np.uint64(1))).view(np.int64)
                tree, key, n = (own.column(c).take(pa.array(stay)) for c in ("tree", "key", "n"))
                yield pa.RecordBatch.from_arrays([tree, pa.array(names[stay]), key, n], ["tree", "path", "key", "n"])

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The children of large nodes, each row in PICKS of them."""
        for batch in batches:
            if len(batch):
                path = batch.column("path").to_numpy().view(np.uint64)
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
                for pick in range(PICKS):
                    choice = mix(path ^ np.uint64((pick + 1) << 56))
                    token = sketch[np.arange(len(path)), (choice % np.uint64(SKETCH)).astype(np.int64)]
                    child = mix(choice ^ (token.astype(np.uint64) + np.uint64(1))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("rows"), batch.column("tree"), pa.array(child), batch.column("key"), batch.column("n"), batch.column("sketch")], ["parent", "rows", *MEMBER])

    found, small = [], []
    level = 1
    large = members.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > sizes.leaf_rows)
    large = materialize(large, "large-nodes")
    while not large.isEmpty():
        small.append(members.join(large, "path", "left_anti"))
        inside = members.join(large, "path").select("rows", *MEMBER)
        if level == DEEPEST:
            found.append(inside)
            break
        inside = materialize(inside, "large-members")
        children = materialize(inside.mapInArrow(branch, "parent long, rows long, tree int, path long, key long, n long, sketch binary"), "children")
        nodes = children.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("stay"), F.max("rows").alias("rows"))
        most = F.col("stay") >= ALIKE * F.col("rows")
        nodes = materialize(nodes.where(most | (F.col("stay") > sizes.leaf_rows)), "large-children")
        alike = nodes.where(most).select("parent")
        found.append(inside.join(alike.withColumnRenamed("parent", "path"), "path", "left_semi"))
        members = children.join(alike, "parent", "left_anti").select(*MEMBER)
        large = nodes.where(F.col("stay") > sizes.leaf_rows).join(alike, "parent", "left_anti").select("path", F.col("stay").alias("rows"))
        level += 1
    else:
        small.append(members)
    compared = small[0].select(*MEMBER)
    for more in small[1:]:
        compared = compared.unionByName(more.select(*MEMBER))
    out = _dealt(compared, ["path"], buckets).mapInArrow(leaf, "tree int, path long, key long, n long")
    for groups in found:
        out = out.unionByName(groups.select("tree", "path", "key", "n"))
    return materialize(out, "groups")


class _Verify:
    """Exact comparison of groups on full sets."""

    def __init__(self, sets: DataFrame, percent: int, sizes: _Sizes):
        self.sets, self.percent, self.sizes = sets, percent, sizes
        self.block_rows, self.block_grams = sizes.block_rows, sizes.block_grams
        self.buckets = shuffle_width(sets.sparkSession)

    def links(self, members: DataFrame, labelled: bool = False) -> DataFrame:
        """members (path, key, n, label) -> links; groups that are connected already, or have the members of another group, go.

        With ``labelled`` the labels are of what earlier links connect, so no hubs are looked for.
        """
        groups = members.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"), F.expr("bit_xor(xxhash64(key))").alias("mark"), (F.min("label") != F.max("label")).alias("apart"))
        groups = groups.where("rows > 1 AND apart").groupBy("rows", "mark", "grams").agg(F.min("path").alias("path"))
        groups = materialize(groups, "groups-once")
        out = self.leaves(members.join(groups.where(self.sizes.small()).select("path"), "path"))
        chunks = F.greatest(F.ceil(F.col("grams") / self.block_grams), F.ceil(F.col("rows") / self.block_rows)).cast("int")
        large = groups.where(~self.sizes.small()).select("path", chunks.alias("chunks"))
        if not large.isEmpty():
            out = out.unionByName(self.blocks(members.join(large, "path").select("path", "chunks", "key", "label"), labelled))
        return materialize(out, "links")

    def leaves(self, members: DataFrame) -> DataFrame:
        """members (path, key, label) of small groups -> links."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in _groups(batches, ["path"]):
                found = connect([np.frombuffer(r["grams"], np.uint64) for r in own], np.array([r["label"] for r in own]), percent)
                if found:
                    yield _links([r["key"] for r in own], found)

        return _dealt(members.select("path", "key", "label").join(self.sets, "key"), ["path"], self.buckets).mapInArrow(run, LINKS)

    def blocks(self, members: DataFrame, labelled: bool) -> DataFrame:
        """members (path, chunks, key, label) of large nodes of documents that are alike -> links.

        Unless labelled already, the most central rows of every chunk of a node are held against all its rows; then those
        outside the node's largest component, in blocks.
        """
        percent, hubs_of_chunk = self.percent, HUBS
        dealt = members.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        dealt = materialize(dealt.select("path", "chunk", "chunks", "key", "label").join(self.sets, "key"), "alike-chunks")

        def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in _groups(batches, ["path", "chunk"]):
                score = Product([np.frombuffer(r["grams"], np.uint64) for r in own], percent).central()
                best = [own[k] for k in np.argsort(-score, kind="stable")[:hubs_of_chunk].tolist()]
                names = ["path", "chunks", "key", "label", "grams"]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in best], t) for c, t in zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])], names)

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in _groups(batches, ["path", "part", "chunk"]):
                rows = np.flatnonzero([r["row"] for r in own])
                if len(rows):
                    label = np.array([r["label"] for r in own])
                    found = connect([np.frombuffer(r["grams"], np.uint64) for r in own], label, percent, rows)
                    if found:
                        yield _links([r["key"] for r in own], found)

        block = ["path", "part", "chunk", "key", "label", "grams", "row"]
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        links, again = None, dealt
        if not labelled:
            hubs = _dealt(dealt, ["path", "chunk"], self.buckets).mapInArrow(central, "path long, chunks int, key long, label long, grams binary")
            hubs = hubs.withColumn("chunk", each("chunks")).withColumn("row", F.lit(True)).withColumn("part", F.lit(0))
            plain = dealt.withColumn("row", F.lit(False)).withColumn("part", F.lit(0))
            links = materialize(_dealt(hubs.select(*block).unionByName(plain.select(*block)), ["path", "part", "chunk"], self.buckets).mapInArrow(held, LINKS), "hub-links")
            known = connected_components(links, distinct=False)
            again = dealt.drop("label").join(known.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
            again = materialize(again, "alike-labels")
        often = again.groupBy("path", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("grams") / 8).alias("grams"))
        most = often.groupBy("path").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.sum("grams").alias("all"), F.max_by("grams", F.struct("rows", "label")).alias("in_main"), F.sum("rows").alias("every"), F.max("rows").alias("of_main"))
        most = materialize(most.select("path", "main", F.greatest(F.ceil((F.col("all") - F.col("in_main")) / self.block_grams), F.ceil((F.col("every") - F.col("of_main")) / self.block_rows)).cast("int").alias("parts")).where("parts > 0"), "open-parts")
        outside = again.join(most, "path").where("label <> main").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
        outside = outside.withColumn("chunk", each("chunks")).withColumn("row", F.lit(True))
        all_rows = again.join(most.select("path", "parts"), "path").withColumn("part", each("parts")).withColumn("row", F.lit(False))
        more = _dealt(outside.select(*block).unionByName(all_rows.select(*block)), ["path", "part", "chunk"], self.buckets).mapInArrow(held, LINKS)
        return more if links is None else links.unionByName(more)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, trees: int = TREES, leaf_rows: int = LEAF_ROWS, leaf_grams: int = LEAF_GRAMS, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (it is its own).

    Two rows link when 100 * overlap >= percent * union of their sets of distinct word runs of ``width``; a text with
    fewer words is one run; a null text, or one without words, is empty and links with nothing, so it is its own
    component. Equal sets always link. Null ids count as larger than any other; a component of null ids only has a null
    component_id, and its rows are kept, as all rows that repeat the smallest id are. An empty table gives an empty result. Other columns are
    not read. Sets and shingles are told apart by 64-bit hashes. A task holds the shingles of one text (about 30 bytes for a byte) at a time, or a node.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    picks = trees * PICKS

    sizes = _Sizes(leaf_rows, leaf_grams, block_rows, block_grams)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, paths, sketches = [], [], [], []
            for sets in _sets(batch.column(1), width):
                full = [s for s in sets if len(s)]
                tokens = minwise(full) if full else np.empty((0, SKETCH), np.uint64)
                own = iter(zip(tokens[:, :picks].view(np.int64).tolist(), (tokens & np.uint64(255)).astype(np.uint8)))
                keys += [set_key(s) for s in sets]
                counts += [len(s) for s in sets]
                for s in sets:
                    path, sketch = next(own) if len(s) else (None, None)
                    paths.append(path)
                    sketches.append(None if sketch is None else sketch.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "key", "n", "paths", "sketch"])

    docs = materialize(rows.mapInArrow(read, f"id {kind}, key long, n long, paths array<long>, sketch binary"), "shingle-sets")
    classes = docs.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max(F.struct("paths", "sketch")).alias("own"))
    classes = materialize(classes.select("key", "least", "n", "own.paths", "own.sketch"), "set-classes")
    entries = classes.select("key", "n", "sketch", F.posexplode("paths").alias("pick", "path"))
    members = entries.select(F.expr(f"pick div {PICKS}").cast("int").alias("tree"), "path", "key", "n", "sketch")
    groups = grow(members, percent, sizes)

    # One document stands for each set of a group; its shingles are fetched once.
    needed = materialize(groups.select("key").distinct().join(classes.select("key", "least"), "key"), "standing")
    chosen = needed.select(F.col("least").alias("standing"))
    if needed.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    picked = rows.join(chosen, F.col("id").eqNullSafe(F.col("standing")), "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "grams"])

    sets = picked.mapInArrow(fetch, "key long, grams binary").join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"])
    verify = _Verify(materialize(sets, "shingles"), percent, sizes)

    links = verify.links(groups.where("tree = 0").select("path", "key", "n", F.col("key").alias("label")))
    known = connected_components(links, distinct=False).withColumnRenamed("node", "key")
    if trees > 1:
        later = groups.where("tree > 0").join(known, "key", "left").select("path", "key", "n", F.coalesce("component", "key").alias("label"))
        links = links.unionByName(verify.links(later, labelled=True))
        known = connected_components(links, distinct=False).withColumnRenamed("node", "key")

    named = classes.select("key", "least").join(known, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    named = materialize(named, "class-components")
    of_class = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component_id")
    linked = docs.where("n > 0").join(of_class, "key").select("id", "n", "component_id")
    alone = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    found = linked.unionByName(alone)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
