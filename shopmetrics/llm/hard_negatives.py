"""Hard negatives by cover trees over norm-augmented vectors (operator 13).

Every candidate gets one more component, which brings all to the norm M of the longest one; an anchor gets 0 there. So
inner products stay, and a candidate p within the angle r of a node's point c, which is at the angle t from the anchor
q, has |q| M cos(t + r) <= <q, p> <= |q| M cos(t - r). A node of the cover tree is a point, its children cover what is
below it within half its radius, and it keeps the radius that it really covers.

The top level is a net of a bounded sample, farthest point first; every row joins its nearest centre, and the angle of
a cell is measured over all its rows. Cells are of one label, and cut into chunks of ``CELL`` rows; a task builds the
tree of a chunk and answers the anchors sent to it, the best nodes first. An anchor is sent only to cells that can hold
something inside its windows. Scores are exact integers, and nothing is left out, so recall is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialize

CELL = 2048
MOST_CENTRES = 256
SAMPLE = 2048
QUERIES_AT_ONCE = 8192
SALTS = 16
LEAVES = 8  # so few points below a node hang directly on it
EXACT = 2.0**52  # whole numbers below are exact as doubles, their sums too
SLACK = 1e-6  # of an angle, for rounding
LEAST, MOST = -(2**63), 2**63 - 1  # of a score


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Rows of doubles; a shorter vector is filled up with zeros."""
    rows = [np.frombuffer(v, np.float64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _fit(vector: np.ndarray, width: int) -> np.ndarray:
    return vector[:width] if len(vector) >= width else np.append(vector, np.zeros(width - len(vector)))


def _angles(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Angles between the rows of two matrices, both brought to the norm ``most``."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    lift = [np.sqrt(np.maximum(0.0, most**2 - (m**2).sum(1))) for m in (a, b)]
    return np.arccos(np.clip((a @ b.T + np.outer(*lift)) / max(most**2, 1e-300), -1.0, 1.0))


class CoverTree:
    """Node k: its point, the angle that it covers, its children ``child[first[k]:first[k + 1]]``; ``fresh`` where no node above has that point."""

    def __init__(self, points: np.ndarray, most: float):
        self.points, self.most = points, most
        apart = _angles(points, points, most)
        point, radius, fresh, below = [0], [0.0], [True], [[]]
        todo = [(0, np.arange(1, len(points)))]

        def add(parent: int, p: int, new: bool, members: np.ndarray) -> None:
            below[parent].append(len(point))
            point.append(p)
            fresh.append(new)
            radius.append(0.0)
            below.append([])
            if len(members):
                todo.append((len(point) - 1, members))

        while todo:
            node, members = todo.pop()
            centre = point[node]
            away = apart[centre, members] if len(members) else np.zeros(1)
            radius[node] = float(away.max())
            if len(members) <= LEAVES or radius[node] <= SLACK:
                for p in members.tolist():
                    add(node, p, True, members[:0])
                continue
            scale = radius[node] / 2
            near, far = members[away <= scale], members[away > scale]
            if len(near):
                add(node, centre, False, near)
            while len(far):
                inside = apart[far[0], far] <= scale
                inside[0] = False
                add(node, int(far[0]), True, far[inside])
                inside[0] = True
                far = far[~inside]
        self.point, self.radius, self.fresh = np.array(point), np.array(radius), np.array(fresh)
        self.first = np.concatenate(([0], np.cumsum([len(b) for b in below])))
        self.child = np.array([c for b in below for c in b], np.int64)

    def _scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.points[rows] @ query
        whole = [int(x) for x in query]
        found = [sum(int(x) * y for x, y in zip(self.points[r], whole)) for r in rows]
        return np.array([max(LEAST, min(MOST, s)) for s in found] + [0], object)[:-1]

    def search(self, query: np.ndarray, windows: list[tuple[float, float, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high, k) of hundredfold scores: points and scores, among them all that are in its first k, ties included."""
        query = _fit(query, self.points.shape[1])
        length = float(np.sqrt((query**2).sum())) * self.most
        exact = 100 * length < EXACT
        seen, known = [np.zeros(1, np.int64)], [self._scores(np.zeros(1, np.int64), query, exact)]
        least = [low for low, _, _ in windows]

        def note(rows: np.ndarray, scores: np.ndarray) -> None:
            seen.append(rows)
            known.append(scores)
            if not len(scores):
                return
            for k, (low, high, most) in enumerate(windows):
                inside = 100 * scores
                inside = inside[(inside >= least[k]) & (inside <= high)]
                if len(inside):
                    best[k] = np.sort(np.concatenate([best[k], inside]))[-most:]
                    if len(best[k]) == most:
                        least[k] = max(low, best[k][0])

        best = [np.zeros(0, known[0].dtype) for _ in windows]
        note(seen.pop(), known.pop())
        nodes = np.zeros(1, np.int64)
        up, down = np.full(1, np.inf), np.full(1, -np.inf)
        some = 16
        while len(nodes):
            useful = np.zeros(len(nodes), bool)
            for k, (_, high, _) in enumerate(windows):
                useful |= (up >= least[k]) & (down <= high)
            nodes, up, down = nodes[useful], up[useful], down[useful]
            if not len(nodes):
                break
            rank = np.argsort(-up, kind="stable")
            take, rest = nodes[rank[:some]], rank[some:]
            some *= 2
            n = self.first[take + 1] - self.first[take]
            child = self.child[np.repeat(self.first[take] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            scores = self._scores(self.point[child], query, exact)
            fresh = self.fresh[child]
            note(self.point[child][fresh], scores[fresh])
            inner = self.first[child + 1] > self.first[child]
            angle = np.arccos(np.clip(scores[inner].astype(float) / max(length, 1e-300), -1.0, 1.0))
            reach = self.radius[child[inner]] + SLACK
            nodes = np.append(nodes[rest], child[inner])
            up = np.append(up[rest], np.maximum(100.0 * LEAST, 100 * length * (np.cos(np.maximum(0.0, angle - reach)) + 1e-9)))
            down = np.append(down[rest], 100 * length * (np.cos(np.minimum(np.pi, angle + reach)) - 1e-9))
        rows, scores = np.concatenate(seen), np.concatenate(known)
        out = []
        for k, (_, high, _) in enumerate(windows):
            own = (100 * scores >= least[k]) & (100 * scores <= high)
            out.append((rows[own], scores[own]))
        return out


def whole_vectors(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, anchor: Column) -> DataFrame:
    """at, vec_id, label, vec (doubles ``floor(scale * x)``), norm, anchor of the rows that take part."""
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3)
            values = pc.fill_null(x.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale) + 0.0  # no negative zero: equal vectors are equal bytes
            bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            fine = bad[bounds[1:]] == bad[bounds[:-1]]
            mask = pc.and_(pa.array(fine), pc.and_(pc.is_valid(x), pc.is_valid(batch.column(2))))
            vec = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            norm = [float(np.sqrt((values[a:b] ** 2).sum())) if ok else 0.0 for a, b, ok in zip(bounds[:-1], bounds[1:], fine)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(vec, pa.binary()), pa.array(norm, pa.float64()), batch.column(4)], ["at", "vec_id", "label", "vec", "norm", "anchor"])
            yield out.filter(mask)

    return rows.where("label IS NOT NULL AND x IS NOT NULL").mapInArrow(pack, "at long, vec_id long, label long, vec binary, norm double, anchor boolean")


def _net(vectors: list[bytes], centres: int, most: float) -> np.ndarray:
    """Centres of a sample, each the farthest from those before it."""
    points = _matrix(vectors)
    chosen = [0]
    away = _angles(points, points[:1], most)[:, 0]
    while len(chosen) < centres and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _angles(points, points[chosen[-1:]], most)[:, 0])
    return points[chosen]


_FOUND = "qid string, mark long, score long, vec_id long, at long"


def _answer(most: float, label_is_own: bool, k: int, low: int, high: int):
    """The work of one chunk: its tree, and the anchors sent to it."""

    def work(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(points) and len(queries):
            tree = CoverTree(_matrix(points.column("vec").to_pylist()), most)
            ids = points.column("ids").to_pylist()
            for query in queries.select(["qid", "qvec", "marks"]).to_pylist():
                marks = query["marks"]
                windows = [(-np.inf if mark is None else 100 * mark, np.inf, k) for mark in marks] if label_is_own else [(low * mark, high * mark, k) for mark in marks]
                for mark, (rows, scores) in zip(marks, tree.search(np.frombuffer(query["qvec"], np.float64), windows)):
                    best = sorted((-int(s), c["vec_id"] is None, c["vec_id"] or 0, c["at"]) for r, s in zip(rows.tolist(), scores.tolist()) for c in ids[r])
                    out += [(query["qid"], None if label_is_own else mark, -s, None if no_id else vec_id, at) for s, no_id, vec_id, at in best[:k]]
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])], ["qid", "mark", "score", "vec_id", "at"])

    return work


KEY = ["label", "centre", "chunk", "slice"]


def mine(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cell: int = CELL, most_centres: int = MOST_CENTRES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of ``floor(scale * x)``; higher ones come first, ties by smaller id (null last), then by place
    in the table. An anchor's positives are its first ``positives`` other rows of its label; the negatives of a pair are the
    first ``negatives`` rows of other labels with low * positive score <= 100 * score <= high * positive score. A row with a null
    label or vector, or a null or non-finite component (after scaling too), takes no part. A shorter vector counts as filled
    up with zeros. A null id is no anchor unless ``anchor`` says so; repeated rows are rows of their own. An empty table, or one without anchors,
    gives an empty result. Other columns are not read. A score beyond 64 bits counts as the largest or smallest of 64 bits.

    Copies of a vector under one label are one point with its first ``positives`` + 1 rows, as no anchor can have more of them.
    """
    keep = max(positives + 1, negatives)
    rows = materialize(whole_vectors(df, id_col, label_col, vector_col, scale, anchor), "vectors")
    first = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("at")]
    copies = rows.withColumn("n", F.row_number().over(Window.partitionBy("label", "vec").orderBy(*first))).where(F.col("n") <= keep)
    points = copies.groupBy("label", "vec").agg(F.collect_list(F.struct("vec_id", "at")).alias("ids"), F.max("norm").alias("norm"))
    points = materialize(points, "points")
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.approx_count_distinct("label").alias("labels")).first()
    most = float(size.most or 0.0) * (1 + 1e-12)
    centres = max(1, min(most_centres, -(-size.n // (cell * max(1, size.labels)))))
    sample = points.orderBy(F.xxhash64("vec"), "vec", "label").limit(SAMPLE if centres > 1 else 1).select("vec").collect()
    net = _net([r.vec for r in sample], centres, most) if sample else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                angle = _angles(_matrix(batch.column("vec").to_pylist()), net, most)
                near = angle.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("vec"), batch.column("ids"), pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(near)), near])], ["label", "vec", "ids", "centre", "angle"])

    placed = points.select("label", "vec", "ids").mapInArrow(assign, "label long, vec binary, ids array<struct<vec_id:long,at:long>>, centre int, angle double")
    placed = materialize(placed, "placed-points")
    cells = placed.groupBy("label", "centre").agg(F.max("angle").alias("reach"), F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("chunks"))
    cells = materialize(cells, "cells")

    qid = F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), "vec"))
    asked = materialize(rows.where("anchor").select("at", "vec_id", qid.alias("qid"), F.col("label").alias("own"), F.col("vec").alias("qvec"), "norm"), "anchors")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An anchor's angles to all centres."""
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch.column("qvec").to_pylist())
                vectors, wide = (np.pad(m, ((0, 0), (0, max(net.shape[1], vectors.shape[1]) - m.shape[1]))) for m in (vectors, net))
                length = np.maximum(np.sqrt((vectors**2).sum(1)) * most, 1e-300)
                angle = np.arccos(np.clip(vectors @ wide.T / length[:, None], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(angle), pa.list_(pa.float64()))], [*batch.schema.names, "angles"])

    queries = asked.groupBy("qid", "own", "qvec").agg(F.max("norm").alias("norm"))
    queries = materialize(queries.mapInArrow(measure, "qid string, own long, qvec binary, norm double, angles array<double>"), "queries")
    slices = max(1, -(-queries.count() // QUERIES_AT_ONCE))

    angle = F.element_at("angles", F.col("centre") + 1)
    length = 100 * F.col("norm") * F.lit(most)
    up = F.greatest(F.lit(100.0 * LEAST), length * (F.cos(F.greatest(F.lit(0.0), angle - F.col("reach") - SLACK)) + 1e-9))
    down = length * (F.cos(F.least(F.lit(np.pi), angle + F.col("reach") + SLACK)) - 1e-9)

    def search(routes: DataFrame, label_is_own: bool, k: int) -> DataFrame:
        """routes: qid, qvec, marks, label, centre, chunks; the first k of every window in every chunk."""
        sent = routes.select("qid", "qvec", "marks", "label", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        sent = sent.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
        dealt = placed.join(cells.select("label", "centre", "chunks"), ["label", "centre"])
        dealt = dealt.select("label", "centre", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "vec", "ids")
        return dealt.groupBy(*KEY).cogroup(sent.groupBy(*KEY)).applyInArrow(_answer(most, label_is_own, k, low, high), _FOUND)

    def firsts(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = [F.desc("score"), F.col("vec_id").isNull(), F.col("vec_id"), F.col("at")]
        return found.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= k)

    own = queries.join(cells.withColumnRenamed("label", "own"), "own").select("qid", "qvec", F.col("own").alias("label"), "centre", "chunks", up.alias("up"))
    no_mark = F.array(F.lit(None).cast("long")).alias("marks")
    if len(net) == 1:
        found = search(own.withColumn("marks", no_mark), True, positives + 1)
    else:  # the most promising cell first; then those that can better its last score
        own = materialize(own.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("up"), "centre"))), "own-cells")
        seed = materialize(search(own.where("n = 1").withColumn("marks", no_mark), True, positives + 1), "first-positives")
        floor = seed.groupBy("qid").agg(F.when(F.count(F.lit(1)) > positives, F.min("score")).alias("floor"))
        rest = own.where("n > 1").join(floor, "qid").where(F.col("floor").isNull() | (F.col("up") >= 100 * F.col("floor").cast("double")))
        found = seed.unionByName(search(rest.withColumn("marks", F.array("floor")), True, positives + 1))
    near = firsts(found, ["qid"], positives + 1)
    near = materialize(near.select("qid", "score", "vec_id", "at", "n"), "positives")

    marks = near.where("score >= 0").groupBy("qid").agg(F.sort_array(F.collect_set("score")).alias("marks"))
    wide = queries.join(marks, "qid").withColumn("salt", F.pmod(F.xxhash64("qid"), F.lit(SALTS)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(net) - 1))).alias("centre"))
    spread = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    routes = wide.join(spread, ["centre", "salt"]).where(F.col("label") != F.col("own"))
    routes = routes.where((up >= low * F.element_at("marks", 1).cast("double")) & (down <= high * F.element_at("marks", -1).cast("double")))
    hard = firsts(search(routes, False, negatives), ["qid", "mark"], negatives)

    ranked = hard.groupBy("qid", "mark").agg(F.sort_array(F.collect_list(F.struct("n", F.col("vec_id").alias("id"), F.col("score").alias("s")))).alias("negatives"))
    pairs = near.join(ranked.withColumnRenamed("mark", "score"), ["qid", "score"], "left")
    pairs = pairs.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "at", "vec_id", "score", "negatives"))).alias("pairs"))
    others = F.slice(F.filter("pairs", lambda p: p["at"] != F.col("at")), 1, positives)
    out = asked.select("at", F.col("vec_id").alias("anchor_id"), "qid").join(pairs, "qid").select("anchor_id", F.explode(others).alias("p"))
    out = out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("h"))
    return out.select("anchor_id", "positive_id", F.col("h.n").cast("int").alias("rank"), F.col("h.id").alias("negative_id"), "positive_score", F.col("h.s").alias("negative_score"))
