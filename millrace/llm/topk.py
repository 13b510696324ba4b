"""Operator 8: exact top-k by inner product with an M-tree of metric pages, searched best first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common


@dataclass(frozen=True)
class Settings:
    """k: neighbours; scale: components become floor(scale * x); pivots: routing vectors on top of the tree, a bounded
    sample whose size does not follow the data; page: vectors of a leaf page; fanout: pivots that a fuller node is split
    by; deal: vectors of one node that a task splits, and of a block of pages; first: pages that queries visit before
    their reaches are looked at again; queries: queries of a block, which meet a page at once.
    """

    k: int = 5
    scale: int = 256
    pivots: int = 256
    page: int = 512
    fanout: int = 32
    deal: int = 50_000
    first: int = 8
    queries: int = 256


#: Part of the largest norm by which distances are compared with slack, far above their rounding.
_SLACK = 1e-6


def whole_vectors(table: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(scale * x), x as double, whole numbers held as doubles.

    Vectors that are null, empty, or hold a component that is null or, scaled, not finite are left out.
    """
    scaled = F.transform(F.col(embedding), lambda c: c.cast("double") * scale)
    good = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2^52 on doubles are whole; below, the long that floor() gives holds them.
    v = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    return table.filter(good & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


class Metric:
    """Inner products as distances: x gets one more component that brings it to the largest norm, a query gets 0 there.

    Then |q - x|^2 = |q|^2 + top - 2 <q, x>: nearest is largest product, and the triangle inequality holds.
    Vectors so large that squares would leave the doubles are scaled by 2^-``shift`` first, all of them alike;
    ``top`` is in that scale, and so are the scores that bounds are taken from (near()). What is far smaller
    than the largest then lies within the slack of everything: its bounds spare nothing, and lose nothing.
    """

    def __init__(self, top: float, shift: int = 0) -> None:
        self.top, self.shift, self.unit, self.slack = top, shift, 2.0**-shift, _SLACK * np.sqrt(top)

    @staticmethod
    def shift_of(most: float) -> int:
        """The shift for components of up to ``most``: none while squares and their sums are far from the end of the doubles."""
        return int(np.frexp(most)[1]) if most >= 2.0**400 else 0

    def extended(self, v: np.ndarray) -> np.ndarray:
        v = v * self.unit
        norm = np.einsum("ij,ij->i", v, v)
        return np.hstack([v, np.sqrt(np.maximum(self.top - norm, 0.0))[:, None]])

    def flat(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q * self.unit, np.zeros((len(q), 1))])

    def near(self, score: np.ndarray) -> np.ndarray:
        """Products as doubles in the scale of the bounds; they never change places."""
        if score.dtype != object:
            return score * (self.unit * self.unit)
        whole = 1 << 2 * self.shift
        return np.array([int(x) / whole for x in score], float)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(d, 0.0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance within which all products of ``score`` (see near()) or more lie; without a score everything lies within."""
        q = q * self.unit
        norm = np.einsum("ij,ij->i", q, q)
        d = np.sqrt(np.maximum(norm + self.top - 2 * np.where(np.isfinite(score), score, 0), 0.0))
        return np.where(np.isfinite(score) & np.isfinite(d), d + self.slack + _SLACK * np.sqrt(norm), np.inf)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of one query: in doubles while they are sure to be exact, else in Python's whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q)
    if most < 2**52:
        return x @ q
    own = [int(c) for c in q.tolist()]
    return np.array([sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in x.tolist()], object)


def _beyond(score: int) -> str | None:
    """Of a product beyond 64 bits, a text that sorts as the products do (of one sign); else null."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if score > 0 else f"{99_999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


@dataclass
class Tree:
    """Routing levels: top pivots over leaf pivots, which hold the distance to their parent; leaves' covering radii."""

    top: np.ndarray
    parent: np.ndarray
    leaves: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance to its pivot): down the nearest top pivot, then its nearest leaf."""
        up = Metric.distances(x, self.top).argmin(1)
        leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        for t in np.unique(up):
            own, rows = np.flatnonzero(self.parent == t), np.flatnonzero(up == t)
            d = Metric.distances(x[rows], self.leaves[own])
            leaf[rows], dist[rows] = own[d.argmin(1)], d.min(1)
        return leaf, dist


def build_tree(sample: np.ndarray) -> Tree:
    """Pivots from a sample: far-apart vectors on top, the rest under the nearest of them."""
    sample = np.unique(sample, axis=0)
    n_top = max(1, int(np.sqrt(len(sample))))
    chosen, near = [0], Metric.distances(sample, sample[:1])[:, 0]
    for _ in range(n_top - 1):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, Metric.distances(sample, sample[chosen[-1:]])[:, 0])
    top = sample[chosen]
    d = Metric.distances(sample, top)
    parent = d.argmin(1)
    return Tree(top, parent, sample, d[np.arange(len(sample)), parent], np.full(len(sample), -np.inf))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Page:
    """Entries by their distance to the page's pivot."""

    ids: np.ndarray
    dists: np.ndarray
    vectors: bytes

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.vectors).reshape(len(self.ids), -1)


class Asked:
    """Some queries (rows with q, vec_id, v and least, a score that each is sure to reach) with the k best that each has met."""

    def __init__(self, rows: list[dict], metric: Metric, k: int) -> None:
        self.metric, self.k, self.computed = metric, k, 0
        self.q, self.own, self.v = [r["q"] for r in rows], np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows])
        self.least = np.array([r["least"] for r in rows], float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in rows]
        self.flat, self.most = metric.flat(self.v), float(np.abs(self.v).max(initial=0)) * self.v.shape[1]

    def visit(self, page: Page, dq: np.ndarray, among: np.ndarray | None = None) -> None:
        """The queries meet the entries of a page at a distance from its pivot that the triangle inequality allows."""
        at = np.arange(len(self.q)) if among is None else among
        reach = self.metric.reach(self.v[at], self.least[at]) + self.metric.slack
        lo, hi = np.searchsorted(page.dists, dq[at] - reach, "left"), np.searchsorted(page.dists, dq[at] + reach, "right")
        at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
        if not len(at):
            return
        x = page.matrix()
        if self.most * float(np.abs(x).max(initial=0)) < 2**52:
            # Queries that are allowed about as many entries are multiplied together; all products are exact.
            order = np.argsort(hi - lo, kind="stable")
            for part in np.array_split(order, -(-len(order) // 64)):
                a, z = int(lo[part].min()), int(hi[part].max())
                scores = x[a:z] @ self.v[at[part]].T
                self.computed += scores.size
                good = (self.metric.near(scores) >= self.least[at[part]]) & (page.ids[a:z, None] != self.own[at[part]])
                for c in np.flatnonzero(good.any(0)).tolist():
                    rows = np.flatnonzero(good[:, c])
                    self._keep(int(at[part[c]]), scores[rows, c], page.ids[a:z][rows])
        else:
            for i, a, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                scores, ids = products(self.v[i], x[a:z]), page.ids[a:z]
                self.computed += len(ids)
                rows = np.flatnonzero((self.metric.near(scores) >= self.least[i]) & (ids != self.own[i]))
                if len(rows):
                    self._keep(i, scores[rows], ids[rows])

    def _keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > 4 * self.k and scores.dtype != object:
            first = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[first], ids[first]
        best = self.best[i] = sorted(self.best[i] + [(-int(s), n) for s, n in zip(scores.tolist(), ids.tolist(), strict=True)])[: self.k]
        if len(best) == self.k:
            self.least[i] = max(self.least[i], self._near(-best[-1][0]))

    def _near(self, score: int) -> float:
        return score / (1 << 2 * self.metric.shift)

    def sweep(self, block: pa.Table, tree: Tree, first: int) -> None:
        """All pages of a block within reach, by their bounds, ``first`` of them before the reaches are looked at again.

        From the routing pivots down, the stored distance to the parent spares
        the distances to nodes that it alone rules out.
        """
        reach = self.metric.reach(self.v, self.least) + self.metric.slack
        up, met = Metric.distances(self.flat, tree.top), {}

        def below(name: str, d_parent: np.ndarray, alive: np.ndarray, pivot: np.ndarray, radius: float, to_parent: float) -> tuple[np.ndarray, np.ndarray]:
            """(distances, whether within reach) of a node; distances are known where the parent is within reach and does not rule it out."""
            if name not in met:
                at = np.flatnonzero(alive & ~(np.abs(d_parent - to_parent) - radius > reach))
                d = np.full(len(self.q), np.inf)
                d[at] = Metric.distances(self.flat[at], pivot[None])[:, 0]
                met[name] = d, ~(d - radius > reach)
            return met[name]

        pages, names, ways = [], block.column("node").to_pylist(), block.column("way").to_pylist()
        everyone = np.ones(len(self.q), bool)
        for n, (name, way) in enumerate(zip(names, ways, strict=True)):
            parts = name.split(".")
            leaf = int(parts[0])
            radius = float(tree.radius[leaf])
            d, alive = below(parts[0], up[:, tree.parent[leaf]], everyone, tree.leaves[leaf], radius, float(tree.to_parent[leaf]))
            for level, node in enumerate(way or []):
                if not alive.any():
                    break
                radius = node["radius"]
                d, alive = below(".".join(parts[: level + 2]), d, alive, self.metric.extended(np.array([node["pivot"]]))[0], radius, node["to_parent"])
            if alive.any():
                pages.append((float((d[alive] - radius).min()), n, d, radius))
        pages.sort(key=lambda p: p[:2])
        for at in range(0, len(pages), first):
            reach = self.metric.reach(self.v, self.least) + self.metric.slack
            for _, n, d, radius in pages[at : at + first]:
                among = np.flatnonzero(np.isfinite(d) & ~(d - radius > reach))
                if len(among):
                    self.visit(Page(np.frombuffer(block.column("ids")[n].as_buffer(), np.int64), np.frombuffer(block.column("dists")[n].as_buffer()), block.column("vectors")[n].as_buffer()), d, among)

    def found(self) -> list[tuple]:
        """Rows (q, vec_id, score, near, beyond, nth)."""
        return [(q, i, min(max(-s, -(1 << 63)), (1 << 63) - 1), self._near(-s), _beyond(-s), n) for q, best in zip(self.q, self.best, strict=True) for n, (s, i) in enumerate(best)]


_FOUND = "q long, vec_id long, score long, near double, beyond string, nth int"
_WAY = "array<struct<pivot: array<double>, radius: double, to_parent: double>>"
#: Nodes whose ways are broadcast.
_WAYS = 20_000


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["q", "vec_id", "score", "near", "beyond", "nth"])


def _in_blocks(rows: DataFrame, n: int, name: str, *by: str) -> str:
    """Rows written to the shared folder by ranges of ``by``, a folder a block; returns the folder."""
    folder = common.new_path(rows.sparkSession, name)
    rows.repartitionByRange(max(1, n), *by).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(folder)
    return folder


def _block(folder: str, block: int, columns: list[str]) -> pa.Table:
    """A block as a table; one that no row was dealt to has no folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from .tokens import _fs

    store, base = _fs(f"{folder}/block={block}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet"))
    parts = [pq.read_table(f, filesystem=store, columns=columns, partitioning=None, use_threads=False, pre_buffer=False) for f in files]
    return pa.concat_tables(parts) if parts else pa.table({c: [] for c in columns})


def search(table: DataFrame, is_query: F.Column, settings: Settings = Settings(), computed: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k largest integer inner products, ties to the smaller vec_id.

    Candidates are all rows but those with the query's own vec_id. Vectors meet
    only vectors of their own length. Repeated rows are candidates, and ask, each
    for itself. Finite components of any size take part. A product beyond 64 bits
    is ranked as it is and returned as the nearest 64-bit number. Each length of
    vectors is searched by itself, one after the other. Other columns are ignored; an empty table gives no rows.

    The tree: vectors go down routing pivots (a bounded sample, broadcast); a node
    of more than a page is split by pivots of its own, level by level, until
    pages fit, so that every node has a pivot, a covering radius and the
    distance of its pivot to its parent's, and a page its entries by distance to
    its pivot. The search is best first, in steps that all queries take
    together: down to the page nearest to the query, which gives a score that
    it is sure to reach. Pages are written in blocks, and queries, those with near
    pages side by side, in blocks too; a task takes a block of queries through
    blocks of pages, over the nodes that lie within reach, where the stored
    distance to the parent spares the distances to nodes that it alone rules
    out; the pages found are visited in the order of their bounds, and every
    ``first`` pages the reaches are tightened. In a page only entries are
    multiplied whose stored distance the triangle inequality allows for some of
    the queries that it is multiplied with. All bounds are safe, so results are
    exact. What a query may meet is neither written nor shuffled, only the k best
    of each task, so disk follows vectors and queries and not their pairs.
    ``computed`` adds up the products that were computed.
    """
    spark = table.sparkSession
    given = common.cut(whole_vectors(table, settings.scale).withColumn("d", F.size("v")), "vectors")
    asking = common.cut(whole_vectors(table.filter(is_query), settings.scale).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v"), "queries")
    out = None
    for d in [r.d for r in given.select("d").distinct().orderBy("d").collect()]:
        got = _search(given.filter(F.col("d") == d).drop("d"), asking.filter(F.size("v") == d), settings, computed)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


_ENTRY = "node string, dist double, vec_id long, v array<double>"


def _split(entries: DataFrame, sizes: DataFrame, metric: Metric, settings: Settings, level: int) -> tuple[DataFrame, DataFrame]:
    """(entries, nodes) one level down: of the nodes with over a page of entries.

    A node's pivots are ``fanout`` of its entries, by hash; entries go to the
    nearest. They are dealt over tasks with a copy of the pivots each, so that
    no task holds a node. Where all pivots are equal, entries are dealt to pages in turn.
    """
    full = sizes.filter(F.col("n") > settings.page).select("node", "n")
    own = entries.join(common.small(full), "node")
    key = F.xxhash64("vec_id", F.lit(level))
    picked = own.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(key, "vec_id", "v"))).filter(F.col("rank") <= settings.fanout)
    heads = picked.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "v", "dist"))).alias("pivots"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pivots within the slack of each other part nothing."""
        for b in batches:
            pivots = [metric.extended(_matrix(x.values.field("v"))) for x in b.column("pivots")]
            alike = [bool(Metric.distances(x, x).max(initial=0) <= metric.slack) for x in pivots]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alike, pa.bool_())], [*b.schema.names, "alike"])

    heads = common.cut(heads.mapInArrow(told, "node string, n long, pivots array<struct<rank: int, v: array<double>, dist: double>>, alike boolean"), "pivots")
    parts = F.ceil(F.col("n") / settings.deal).cast("int")
    head_rows = heads.select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "n", "alike", "pivots.v", F.lit(None).cast("long").alias("vec_id"))
    entry_rows = own.select("node", F.pmod(F.xxhash64("vec_id", F.lit(7)), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "n", F.lit(False).alias("alike"), F.array("v").alias("v"), "vec_id")
    n_parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = head_rows.unionByName(entry_rows).repartition(n_parts, "node", "part").sortWithinPartitions("node", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, alike, n, met = np.zeros((0, 0)), False, 0, 0
        for b in batches:
            kinds, nodes, ids = b.column("kind").to_numpy(), b.column("node").to_pylist(), b.column("vec_id")
            vectors = b.column("v")
            edges = np.flatnonzero(np.concatenate([[True], (kinds[1:] == 0) | (kinds[:-1] == 0)])).tolist()
            for a, z in zip(edges, [*edges[1:], len(kinds)], strict=True):
                if not kinds[a]:
                    pivots, alike, n = metric.extended(_matrix(vectors[a].values)), b.column("alike")[a].as_py(), b.column("n")[a].as_py()
                    continue
                x = vectors.slice(a, z - a).flatten()
                d = Metric.distances(metric.extended(_matrix(x)), pivots)
                own_ids = ids.slice(a, z - a)
                child = (np.arange(met, met + z - a) % -(-n // settings.page)) if alike else d.argmin(1)
                met += z - a
                dist = d[:, 0] if alike else d.min(1)
                yield pa.RecordBatch.from_arrays([pa.array([f"{nodes[a]}.{c}" for c in child.tolist()], pa.string()), pa.array(dist), own_ids, x], ["node", "dist", "vec_id", "v"])

    children = common.cut(dealt.mapInArrow(run, _ENTRY), "entries")
    below = children.groupBy("node").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).withColumn("parent", F.regexp_replace("node", r"\.[0-9]+$", ""))
    place = F.when(F.col("alike"), F.lit(0)).otherwise(F.regexp_extract("node", r"([0-9]+)$", 1).cast("int"))
    pivot = F.get("pivots", place)
    nodes = below.join(common.small(heads.withColumnRenamed("node", "parent").drop("n")), "parent").select("node", "parent", "n", "radius", pivot["v"].alias("pivot"), pivot["dist"].alias("to_parent"))
    return children, common.cut(nodes, "nodes")


def _search(given: DataFrame, queries: DataFrame, settings: Settings, computed: Accumulator | None) -> DataFrame:
    spark, k = given.sparkSession, settings.k
    largest = lambda df: df.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    shift = Metric.shift_of(max(largest(given), largest(queries)))
    in_unit = lambda a, c: a + (c * 2.0**-shift) * (c * 2.0**-shift)
    top = given.agg(F.max(F.aggregate("v", F.lit(0.0), in_unit))).first()[0]
    metric = Metric(top, shift)
    # The sample is held by a hash of the id, so reruns agree.
    picked = given.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(settings.pivots).select("v").toArrow()
    tree = build_tree(metric.extended(_matrix(picked.column("v").combine_chunks())))
    shared = spark.sparkContext.broadcast(tree)

    def into_leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf, dist = shared.value.assign(metric.extended(_matrix(batch.column("v"))))
        return pa.RecordBatch.from_arrays([pa.array(list(map(str, leaf.tolist())), pa.string()), pa.array(dist), batch.column("vec_id"), batch.column("v")], ["node", "dist", "vec_id", "v"])

    # Levels: the entries of each, all its nodes with size and radius, and below the routing pivots a table of nodes.
    entries = common.cut(common.map_arrow(given, into_leaves, _ENTRY), "entries")
    sizes = common.cut(entries.groupBy("node").agg(F.count("*").alias("n"), F.max("dist").alias("radius")), "sizes")
    for r in sizes.collect():  # a row a routing pivot: bounded
        tree.radius[int(r.node)] = r.radius
    known = spark.sparkContext.broadcast(tree)
    levels, ready = [], []
    while True:
        fit = sizes.filter(F.col("n") <= settings.page).select("node")
        ready.append(entries.join(common.small(fit), "node"))
        if sizes.filter(F.col("n") > settings.page).limit(1).count() == 0:  # ends: pivots that are not alike part their node
            break
        entries, sizes = _split(entries, sizes, metric, settings, len(levels))
        levels.append(sizes)
    at_pages = ready[0]
    for more in ready[1:]:
        at_pages = at_pages.unionByName(more)
    def pack(page: pa.Table) -> pa.Table:
        dist = page.column("dist").to_numpy()
        order = np.argsort(dist, kind="stable")
        v = _matrix(page.column("v").combine_chunks())[order]
        return pa.table({"node": page.column("node")[:1], "dists": pa.array([dist[order].tobytes()], pa.binary()), "ids": pa.array([page.column("vec_id").to_numpy()[order].tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})

    # Pages lie in blocks of about ``deal`` vectors, each with the nodes on its way down from its routing pivot.
    ways, above = [], None
    for nodes in levels:
        own = nodes.select("node", "parent", F.array(F.struct("pivot", "radius", "to_parent")).alias("own"))
        above = own.select("node", F.col("own").alias("way")) if above is None else own.join(common.small(above.withColumnRenamed("node", "parent"), most=_WAYS), "parent").select("node", F.concat("way", "own").alias("way"))
        ways.append(above)
    n_blocks = -(-given.count() // settings.deal)
    packed = at_pages.groupBy("node").applyInArrow(pack, "node string, dists binary, ids binary, vectors binary")
    with_way = packed.withColumn("way", F.lit(None).cast(_WAY))
    if ways:
        with_way = packed.join(common.small(reduce(DataFrame.unionByName, ways), most=_WAYS), "node", "left")
    folder = _in_blocks(with_way, n_blocks, "pages", "node")
    pages = spark.read.schema(f"node string, dists binary, ids binary, vectors binary, way {_WAY}").parquet(folder)

    def routes(batch: pa.RecordBatch) -> pa.RecordBatch:
        """(q, node, dq): each query and the node under the routing pivots that is nearest."""
        t, flat = known.value, metric.flat(_matrix(batch.column("v")))
        d = Metric.distances(flat, t.leaves)
        d[:, np.isinf(t.radius)] = np.inf
        near = d.argmin(1)
        return pa.RecordBatch.from_arrays([batch.column("q"), pa.array([str(c) for c in near.tolist()], pa.string()), pa.array(d[np.arange(len(d)), near])], ["q", "node", "dq"])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Distances of queries to the pivots of nodes."""
        flat, pivot = metric.flat(_matrix(batch.column("v"))), metric.extended(_matrix(batch.column("pivot")))
        dq = np.sqrt(np.maximum(np.einsum("ij,ij->i", flat, flat) + np.einsum("ij,ij->i", pivot, pivot) - 2 * np.einsum("ij,ij->i", flat, pivot), 0))
        return pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(dq)], ["q", "node", "dq"])

    def nearest(asked: DataFrame) -> DataFrame:
        """(q, node, dq) of the page at the end of each query's way down the nearest nodes."""
        now = common.cut(common.map_arrow(asked.select("q", "v"), routes, "q long, node string, dq double"), "frontier")
        out = now
        for nodes in levels:
            below = nodes.select(F.col("parent").alias("node_up"), "node", "pivot")
            met = now.select("q", F.col("node").alias("node_up")).join(below, "node_up").join(common.small(asked.select("q", "v")), "q")
            now = common.map_arrow(met.select("q", "v", "node", "pivot"), measure, "q long, node string, dq double")
            now = common.cut(now.groupBy("q").agg(F.min_by(F.struct("node", "dq"), "dq").alias("x")).select("q", "x.*"), "frontier")
            out = out.unionByName(now)
        return out.join(common.small(pages.select("node")), "node", "left_semi").select("q", "node", "dq")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                page = Page(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dists"]), r["vectors"])
                asked = Asked(r["asked"], metric, k)
                asked.visit(page, np.array([a["dq"] for a in r["asked"]]))
                out += asked.found()
                if computed is not None:
                    computed.add(asked.computed)
            yield _found(out)

    def visits(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """What queries find in the pages of ``pairs`` (q, node, dq), one page a query: k rows a query at most."""
        held = pairs.join(common.small(asked.select("q", "vec_id", "v", "least")), "q").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(1 << 20)))
        count = held.groupBy("node").agg(F.count("*").alias("m"))
        blocks = held.join(common.small(count), "node").withColumn("block", F.col("block") % F.ceil(F.col("m") / settings.queries))
        met = blocks.groupBy("node", "block").agg(F.collect_list(F.struct("q", "vec_id", "v", "least", "dq")).alias("asked"))
        return met.join(pages.drop("way"), "node").select("ids", "dists", "vectors", "asked").mapInArrow(visit, _FOUND)

    by_rank = W.partitionBy("q").orderBy(F.desc("near"), F.desc("score"), F.desc("beyond"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query: the window drops the rest before the shuffle."""
        return found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k).select("q", "vec_id", "score", "near", "beyond", "rank")

    # Down to the nearest page: a score that each query is sure to reach.
    plain = queries.withColumn("least", F.lit(float("-inf")))
    plan = common.cut(nearest(plain), "plan")
    sure = best(visits(plan, plain)).filter(F.col("rank") == k).select("q", F.col("near").alias("sure"))
    asked = queries.join(common.small(common.cut(sure, "sure")), "q", "left").join(common.small(plan.select("q", "node")), "q", "left")
    asked = asked.select("q", "vec_id", "v", F.coalesce("sure", F.lit(float("-inf"))).alias("least"), "node")
    # Queries with near pages side by side, in blocks of their own; a task takes a block through a share of the blocks of pages.
    n_asking = -(-queries.count() // settings.queries)
    if not n_asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asking = _in_blocks(asked, n_asking, "asking", "node", "q")
    shares = min(n_blocks, max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_asking)))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.column("id").to_pylist()):
            rows = _block(asking, task // shares, ["q", "vec_id", "v", "least"]).to_pylist()
            if not rows:
                continue
            asked = Asked(rows, metric, k)
            for block in range(task % shares, n_blocks, shares):
                asked.sweep(_block(folder, block, ["node", "way", "dists", "ids", "vectors"]), known.value, settings.first)
            if computed is not None:
                computed.add(asked.computed)
            yield _found(asked.found())

    tasks = n_asking * shares
    found = best(spark.range(0, tasks, 1, min(tasks, 4096)).mapInArrow(sweep, _FOUND))
    return found.join(common.small(queries.select("q", F.col("vec_id").alias("query_id"))), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_nth(n: int) -> F.Column:
    return F.pmod(F.col("vec_id"), F.lit(n)) == 0
