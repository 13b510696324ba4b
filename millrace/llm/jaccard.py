"""Operator 9: n-gram Jaccard join by T-occurrence search with DivideSkip."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import mix, shingle_set


#: Bytes of text whose sets and hashes a task makes at once.
SLICE = 4 << 20
#: Shingles, about, whose bucket hashes one task sorts.
PART_SHINGLES = 4_000_000
#: Shingles that a task reads, and pairs of sets that it may meet, when the block pairs of large groups are dealt.
TASK_SHINGLES, TASK_PAIRS = 4_000_000, 128_000_000


@dataclass(frozen=True)
class Settings:
    """Shingles of ``k`` words; link at 100 * intersection >= percent * union; ``block`` and ``shingles``: sets, and shingles
    in them, that one search task indexes (about: sets are dealt by hash; a larger set has a block of its own size).
    """

    k: int = 4
    percent: int = 85
    block: int = 16_000
    shingles: int = 1_000_000


class Classes:
    """Size classes and the number of buckets that make the candidate groups complete.

    A linked pair has sizes a <= b <= 100 a / percent and differs in at most
    (100 - percent) (a + b) / (100 + percent) elements, so in d(a) at most. If
    sets are split into more than d buckets by hash, some bucket is equal in
    both. Class i holds sizes low[i] to low[i + 1] - 1; low grows so that a pair
    lies in one class or in two neighbouring ones, and is looked for in the
    lower one's buckets.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low = np.array(self.low)

    def of(self, n: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def differing(self, c: int) -> int:
        """Elements in which a pair may differ whose smaller set is in class c."""
        top = int(self.low[c + 1]) - 1
        return (100 - self.percent) * (top + top * 100 // self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray, c: int) -> np.ndarray:
        """Hashes of the buckets of set ``s`` in the scheme of class ``c``.

        Empty buckets, which many unlike sets share, are left out where enough
        others stay: with more than d buckets that hold something, one of these
        is untouched in any partner and stands in the partner's list as well.
        """
        d = self.differing(c)
        buckets = d + 1 + (2 + d // 32 if d else 0)
        bucket = ((s >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with s, which is sorted
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        found = bucket[starts]
        sums = np.add.reduceat(mix(s), starts)
        if len(found) <= d:
            missing = np.setdiff1d(np.arange(buckets, dtype=np.uint64), found)
            found, sums = np.concatenate([found, missing]), np.concatenate([sums, np.zeros(len(missing), np.uint64)])
        return mix(sums + mix(found * np.uint64(1009) + np.uint64(c + 1)))


def document_sets(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (128 bits of the whole set; null if empty) and node (48 of them): a row per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, full, node = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingle_set(t, k)
            n.append(len(s))
            full.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            node.append(_node(full[-1]) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(full, pa.binary()), pa.array(node, pa.int64())], ["doc_id", "text_hash", "n_shingles", "set_hash", "node"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return common.map_arrow(given, run, "doc_id long, text_hash long, n_shingles long, set_hash binary, node long", SLICE)


def _node(full: bytes) -> int:
    """48 bits of a set's hash. Sets that share them are placed together, which the search tells apart."""
    return int.from_bytes(full[:6], "little")


def pack_rows(sig: np.ndarray, node: np.ndarray, scheme: np.ndarray) -> bytes:
    """Bucket hashes by their low 48 bits, nodes and schemes in 14 bytes each; hashes that fall together only add candidates."""
    return b"".join([sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), node.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), scheme.astype("<u2").tobytes()])


def unpack_rows(packed: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack_rows() was given, of all parts one after the other."""
    n = [len(p) // 14 for p in packed]
    wide = np.zeros((2, sum(n), 8), np.uint8)
    scheme, at = np.empty(sum(n), np.uint16), 0
    for p, m in zip(packed, n, strict=True):
        b = np.frombuffer(p, np.uint8)
        wide[0, at : at + m, :6], wide[1, at : at + m, :6] = b[: 6 * m].reshape(m, 6), b[6 * m : 12 * m].reshape(m, 6)
        scheme[at : at + m] = b[12 * m :].view("<u2")
        at += m
    return wide[0].view("<u8")[:, 0], wide[1].view("<i8")[:, 0], scheme


def candidate_groups(docs: DataFrame, n_shingles: int, settings: Settings, text: str = "text") -> DataFrame:
    """(scheme, node, grp): sets that any linked partner is in one group with.

    Each set sends its bucket hashes; equal hashes tie sets of one scheme
    together, and what is tied is a group. Within a batch, sets that share a
    hash are tied at once and one of them goes on for all, so a hash that a
    third of all sets share comes to the shuffle once a batch.
    """
    classes = Classes(settings.percent)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nodes, schemes, sigs = [], [], []
        seen: set[bytes] = set()
        for t in batch.column("text").to_pylist():
            s = shingle_set(t, settings.k)
            if len(s) and (full := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                seen.add(full)
                node = _node(full)
                c = int(classes.of(len(s)))
                for scheme in (c, c - 1) if c else (c,):
                    g = classes.signatures(s, scheme)
                    sigs.append(g)
                    nodes.append(np.full(len(g), node))
                    schemes.append(np.full(len(g), scheme, np.uint16))
        if not sigs:
            return None
        sig, node, scheme = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(schemes)
        order = np.argsort(sig, kind="stable")
        sig, node, scheme = sig[order], node[order], scheme[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = node[first][np.cumsum(first) - 1]
        # A follower keeps only its tie to the leader: a hash of both, once.
        tie = (~first) & (node != lead)
        key = np.unique(np.stack([scheme[tie].astype(np.int64), node[tie], lead[tie]]), axis=1)
        tie_sig = mix(mix(key[1].view(np.uint64)) + mix(mix(key[2].view(np.uint64))) + key[0].view(np.uint64))
        sig, node = np.concatenate([sig[first], tie_sig, tie_sig]), np.concatenate([node[first], key[1], key[2]])
        scheme = np.concatenate([scheme[first], key[0].astype(np.uint16), key[0].astype(np.uint16)])
        part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        held = [(i, pack_rows(sig[order[a:z]], node[order[a:z]], scheme[order[a:z]])) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < z]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.binary())], ["part", "rows"])

    def ties(table: pa.Table) -> pa.Table:
        """Runs of equal hashes in one part: each later row is tied to the run's first."""
        sig, node, scheme = unpack_rows([r.as_buffer() for r in table.column("rows")])
        order = np.lexsort((node, sig))
        sig, node, scheme = sig[order], node[order], scheme[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = node[first][np.cumsum(first) - 1]
        tie = (~first) & (node != lead)
        # One row a tie: two near copies share most of their hashes.
        key = np.unique(np.stack([scheme[tie].astype(np.int64), node[tie], lead[tie]]), axis=1)
        del sig, node, scheme, order, first, lead, tie
        common.give_back()
        return pa.table({"scheme": pa.array(key[0].astype(np.int32)), "x": pa.array(key[1]), "y": pa.array(key[2])})

    # A part is what one task sorts, so their number follows the shingles; hashes are spread evenly over them.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 16, max(n, -(-n_shingles // PART_SHINGLES)))
    sent = common.map_arrow(docs.select(F.col(text).alias("text")), emit, "part int, rows binary", 2 * SLICE)
    met = sent.groupBy("part").applyInArrow(ties, "scheme int, x long, y long").distinct()
    # A node of the tie graph is a set in a scheme: its hash with the scheme mixed in.
    met = common.cut(met.select("scheme", "x", "y", F.xxhash64("scheme", "x").alias("a"), F.xxhash64("scheme", "y").alias("b")), "ties")
    members = met.selectExpr("scheme", "x AS node", "a AS id").unionByName(met.selectExpr("scheme", "y AS node", "b AS id")).distinct()
    return members.join(components(met.select("a", "b")).selectExpr("node AS id", "component AS grp"), "id").drop("id")


class Lists:
    """Inverted lists of a block of sets, and the T-occurrence search of one set in them."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.sizes, self.percent = sets, np.array([len(s) for s in sets]), percent
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")  # owners stay in order within a list
        self.owner = owner[order]
        flat = flat[order]
        del order, owner
        self.starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.keys = flat[self.starts]
        self.ends = np.append(self.starts[1:], len(flat))

    def search(self, s: np.ndarray, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, overlaps) of the block's sets past place ``after`` that link with ``s``.

        A partner shares at least T = ceil(percent |s| / 100) elements. Of the
        lists of s the L longest are put aside; the others are merged, and only
        sets with T - L or more occurrences there can reach T. For these the long
        lists are probed by binary search: list by list, the longest last, where
        who can't reach its own bound any more is let go; or, for a few
        candidates, all lists at once in the candidate's own sorted elements.
        """
        at = np.searchsorted(self.keys, s)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == s)]
        need = -(-self.percent * len(s) // 100)
        if len(at) < need:
            return _NONE
        length = self.ends[at] - self.starts[at]
        order = np.argsort(length, kind="stable")
        at = at[order]
        aside = self._aside(need, int(length.max()))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.concatenate([self.owner[a:b] for a, b in zip(self.starts[short].tolist(), self.ends[short].tolist(), strict=True)])
        merged = merged[merged > after]
        if not len(merged):
            return _NONE
        merged.sort()
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.append(first, len(merged)))
        places = merged[first]
        # The overlap a partner of this size needs for the link.
        bound = -(-self.percent * (len(s) + self.sizes[places]) // (100 + self.percent))
        sized = (100 * self.sizes[places] >= self.percent * len(s)) & (self.percent * self.sizes[places] <= 100 * len(s)) & (count + aside >= bound)
        places, count, bound = places[sized], count[sized], bound[sized]
        if len(places) <= len(long) // 8:
            probed = self.keys[long]
            count = count + np.array([np.count_nonzero(probed == t[np.minimum(np.searchsorted(t, probed), len(t) - 1)]) for t in (self.sets[p] for p in places.tolist())], np.int64)
            stay = count >= bound
            return places[stay], count[stay]
        for i, (a, b) in enumerate(zip(self.starts[long].tolist(), self.ends[long].tolist(), strict=True)):
            if not len(places):
                return _NONE
            probe = self.owner[a:b]
            hit = np.searchsorted(probe, places)
            count = count + (probe[np.minimum(hit, len(probe) - 1)] == places)
            stay = count + (len(long) - 1 - i) >= bound
            if not stay.all():
                places, count, bound = places[stay], count[stay], bound[stay]
        return places, count

    @staticmethod
    def _aside(need: int, longest: int) -> int:
        """How many lists DivideSkip puts aside: T / (mu log M + 1), but T - 1 at most."""
        return min(need - 1, int(need / (0.02 * math.log2(max(2, longest)) + 1)))


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search_block(left: list[tuple], right: list[tuple] | None, percent: int, scheme: int, classes: Classes) -> tuple[np.ndarray, ...]:
    """Links between sets (id, copies, set) of ``left`` and of ``right``, or among ``left``, whose smaller set is in class ``scheme``.

    Returns (id, smallest linked id in a forest, links with other documents): a row a set that has a link.
    """
    index = Lists([r[2] for r in left], percent)
    ids, copies, low = np.array([r[0] for r in left]), np.array([r[1] for r in left]), classes.of(index.sizes)
    queries = left if right is None else right
    degree: dict[int, int] = defaultdict(int)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    for q, (qid, qcopies, s) in enumerate(queries):
        places, _ = index.search(s, q if right is None else -1)
        c = int(classes.of(len(s)))
        places = places[np.minimum(low[places], c) == scheme]
        if not len(places):
            continue
        degree[qid] += int(copies[places].sum())
        for p in places.tolist():
            degree[int(ids[p])] += qcopies
        roots = {root(int(ids[p])) for p in places.tolist()} | {root(qid)}
        low_id = min(roots)
        for r in roots:
            parent[r] = low_id
    out = sorted(degree)
    return np.array(out, np.int64), np.array([root(x) for x in out], np.int64), np.array([degree[x] for x in out], np.int64)


def _views(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The sets of a binary column where they lie, without a copy."""
    for chunk in column.chunks:
        if len(chunk):
            _, offsets, data = chunk.buffers()
            ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 8
            flat = np.frombuffer(data, np.uint64, count=int(ends[-1]))
            yield from (flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def join(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links: a row per row of ``docs``.

    Documents whose sets are equal are one class; classes link where 100 *
    intersection >= percent * union; component_id is the smallest doc_id
    reachable, n_links the number of other documents linked with, class_id the
    smallest doc_id with an equal set. Steps:

    1. each text gives its set's size and 128-bit hash; classes by that hash;
    2. candidate_groups() brings any two linked sets into a common group (exact,
       see Classes); sets of no group link with none;
    3. in each group, a T-occurrence search with DivideSkip over the group's
       inverted lists finds all links. A group of more than ``block`` sets or
       ``shingles`` shingles is cut by hash into blocks, written once to the
       shared folder, and a task gets pairs of blocks and reads them: no list,
       group or hot shingle is ever whole in one task;
    4. a task returns a spanning forest of its verified links and the number of
       links per set, never the pairs; components() joins the forests.

    No text or word: set empty, n_shingles 0, linked with nothing, component_id
    its doc_id. Equal rows are linked as equal texts. Null doc_ids take part, but
    never name a component unless nothing else does. Very long texts take part
    whole. Other columns, whatever their names, are ignored; an empty table gives
    no rows.
    """
    sets = common.cut(document_sets(docs, settings.k, text), "sets")
    known = _placed(docs, sets, settings, text).select("set_hash", F.col("best.doc_id").alias("class_id"), F.col("component_best.doc_id").alias("component_id"), "copies", "links")
    # Rows without words have no set to look up; they join nothing and so stay out of the shuffle.
    empty = sets.filter("set_hash IS NULL").selectExpr("doc_id", "n_shingles", "doc_id AS component_id", "doc_id AS class_id", "0L AS n_links")
    out = sets.filter("set_hash IS NOT NULL").join(known, "set_hash")
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ).unionByName(empty)


def _placed(docs: DataFrame, sets: DataFrame, settings: Settings, text: str) -> DataFrame:
    """set_hash, copies, best, links and component_best of every class.

    best: the class's first row, by doc_id (nulls last) and text_hash;
    component_best: the first of the component.
    """
    first_row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    by_class = sets.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.min(first_row).alias("best"), F.count("*").alias("copies"))
    # Classes get numbers of their own, which no two share, however many there are; the written table keeps them.
    classes = common.cut(by_class.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_shingles = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    groups = common.cut(candidate_groups(docs, n_shingles, settings, text), "groups")
    links = common.cut(_links(docs, groups, classes, settings, text), "links")
    comps = components(links.selectExpr("cid AS a", "root AS b"))
    degree = links.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.join(comps.selectExpr("node AS cid", "component"), "cid", "left").join(degree, "cid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cid"))
    least = placed.groupBy("component").agg(F.min("best").alias("component_best"))
    return placed.join(least, "component")


def _links(docs: DataFrame, groups: DataFrame, classes: DataFrame, settings: Settings, text: str) -> DataFrame:
    """(cid, root, links) of all search tasks."""
    k, block = settings.k, settings.block
    members = classes.select("best.doc_id", "set_hash", "cid", "copies", "node", "n_shingles")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # a task hands on each set once, however often its text is repeated
        for batch in (part for b in batches for part in common.slices(b, SLICE)):
            data, full = [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, k)
                if len(s) and (h := xxhash.xxh3_128_digest(s.tobytes())) not in met:
                    met.add(h)
                    data.append(s.tobytes())
                    full.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary()), pa.array(data, pa.binary())], ["set_hash", "data"])
        common.give_back()

    def with_sets(placed: DataFrame) -> DataFrame:
        """``placed`` with cid, copies and set of each node: a text of each class, read again and hashed again, which is cheaper than storing all sets."""
        member = common.cut(members.join(placed.select("node").distinct(), "node", "left_semi"), "members")
        wanted = common.small(member.select(F.col("doc_id").alias("__id")).distinct())
        texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col(text).alias("text")).join(wanted, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").select("text")
        # An equal or null doc_id may hold other texts: the set's hash decides. Places are joined to hashes first, so sets move once, to their places.
        at = common.small(common.cut(member.select("set_hash", "cid", "copies", "node").join(placed, "node").drop("node"), "at"))
        # Of rows that are all alike, one is enough; the search leaves out what it has met.
        return common.bounded(texts).mapInArrow(build, "set_hash binary, data binary").join(at, "set_hash").drop("set_hash")

    # Blocks follow the shingles as well as the sets: what a task holds does not grow with the length of the texts.
    weighed = groups.join(common.small(members.select("node", "n_shingles").dropDuplicates(["node"])), "node")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / settings.shingles)).cast("int")
    large = common.cut(weighed.groupBy("scheme", "grp").agg(blocks.alias("blocks"), F.count("*").alias("sets"), F.sum("n_shingles").alias("n")).filter("blocks > 1"), "large")
    pairs, work = large.selectExpr("blocks * (blocks + 1D) / 2 AS p", f"greatest(n * (blocks + 1D) / {TASK_SHINGLES}, sets * (sets + 1D) / 2 / {TASK_PAIRS}) AS w").agg(F.sum("p"), F.sum("w")).first()
    size_classes = Classes(settings.percent)

    def links(scheme: int, left: list[tuple], right: list[tuple] | None) -> dict[str, pa.Array]:
        if not left or right == []:
            return {c: pa.array([], pa.int64()) for c in ("cid", "root", "links")}
        common.claim("search", lambda: None)  # the words that this worker remembers are of no use here
        return dict(zip(("cid", "root", "links"), map(pa.array, search_block(left, right, settings.percent, scheme, size_classes)), strict=True))

    def within(table: pa.Table) -> pa.Table:
        return pa.table(links(table.column("scheme")[0].as_py(), _rows(table), None))

    out = "cid long, root long, links long"
    fit = groups.join(common.small(large.select("scheme", "grp")), ["scheme", "grp"], "left_anti")
    found = with_sets(fit).groupBy("scheme", "grp").applyInArrow(within, out)
    if not pairs:
        return found

    # Sets of larger groups are written once, a folder a block; tasks get pairs of blocks and read them there, so no set is sent once a pair.
    folder = common.new_path(docs.sparkSession, "blocks")
    cut = groups.join(common.small(large.select("scheme", "grp", "blocks")), ["scheme", "grp"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    part = F.concat_ws("_", "scheme", "grp", "block").alias("part")
    with_sets(cut.select("node", part)).repartition("part").write.partitionBy("part").parquet(folder)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for scheme, grp, i, j in zip(*(b.column(c).to_pylist() for c in ("scheme", "grp", "i", "j")), strict=True):
                left, right = (_rows(_block(folder, f"{scheme}_{grp}_{x}")) if x is not None else None for x in (i, None if i == j else j))
                yield pa.RecordBatch.from_pydict(links(scheme, left, right))
        common.give_back()

    tasks = min(pairs, max(work, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = large.withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)")))
    return found.unionByName(dealt.select("scheme", "grp", "i", "j").repartition(math.ceil(tasks)).mapInArrow(across, out))


def _rows(table: pa.Table) -> list[tuple]:
    """(cid, copies, set) of the sets of a table, each once."""
    seen: set[int] = set()
    rows = zip(table.column("cid").to_pylist(), table.column("copies").to_pylist(), _views(table.column("data")), strict=True)
    return [r for r in rows if not (r[0] in seen or seen.add(r[0]))]


def _block(folder: str, part: str) -> pa.Table:
    """A block's sets from the shared folder; a block that no set was dealt to has no folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from .tokens import _fs

    store, base = _fs(f"{folder}/part={part}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet"))
    schema = pa.schema([("cid", pa.int64()), ("copies", pa.int64()), ("data", pa.binary())])
    return pa.concat_tables([schema.empty_table(), *(pq.read_table(f, filesystem=store, columns=schema.names, partitioning=None, use_threads=False, pre_buffer=False).cast(schema) for f in files)])


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each component, the first by doc_id (nulls last) and a hash of the text, with all columns of ``docs``.

    Documents without words all stay, repeated rows of them too; of repeated rows
    with words one stays. Columns keep their names, whatever these are; nulls and
    very long texts are as in join(); an empty table gives no rows.
    """
    sets = common.cut(document_sets(docs, settings.k), "sets")
    placed = _placed(docs, sets, settings, "text").filter("best = component_best")
    kept = common.cut(placed.groupBy(F.col("best.doc_id").alias("__id"), F.col("best.text_hash").alias("__hash")).agg((F.max("copies") > 1).alias("__more")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    worded = F.coalesce(F.col("__row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("__row.text") == F.col("__hash"))
    stay = rows.filter(worded).join(common.small(kept), same)
    # Only rows that may come again are dealt out to be told apart.
    once = stay.filter("NOT __more").select("__row.*")
    again = stay.filter("__more").groupBy("__id", "__hash").agg(F.first("__row").alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(rows.filter(~worded).select("__row.*"))
