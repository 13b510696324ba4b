"""Operator 12: benchmark decontamination by a Wu-Manber search for the benchmark's word windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mix

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Every byte that no word holds becomes a blank, A-Z become a-z: then bytes.split() gives the words.
_WORDS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """window: words of a window; block: words that the shift tables look at; piece: words of the pieces that longer items
    are cut into (all windows stay); held: words of the benchmark that a task holds at once; lane: places of a text that
    are searched one after the other, beside other lanes.
    """

    window: int = 10
    block: int = 3
    piece: int = 20_000
    held: int = 1_000_000
    lane: int = 512


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Search:
    """Wu-Manber over words for patterns of ``m`` words each, given by where they start in the flat array of an index.

    shift: by the hash of a block of words, how far a text's place can move on
    without passing the end of an occurrence; 0 where a pattern ends in a block
    of that hash. Patterns lie in buckets by the hash of their last block, and in
    a bucket by the hash of the words before; equal ones have one place.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, pieces: list[tuple[int, int]], m: int, block: int) -> None:
        self.m, self.block, self.flat = m, min(block, m), flat
        size = 1 << max(10, int(4 * len(flat)).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, m - self.block + 1, np.int16)
        for a, n in pieces:
            ends = np.arange(self.block - 1, n)  # of blocks in the piece
            slots = self._hash(flat, a + ends, self.block) & self.mask
            np.minimum.at(self.shift, slots, np.maximum(m - 1 - ends, 0).astype(np.int16))
        key = self._key(flat, starts + m - 1)
        order = np.argsort(key, kind="stable")
        self.key, at = key[order], starts[order]
        same = np.ones(len(at), bool)
        same[0] = False
        same[1:] = self.key[1:] == self.key[:-1]
        for k in range(m):
            same[1:] &= flat[at[1:] + k] == flat[at[:-1] + k]
        self.first = np.flatnonzero(~same)
        self.key, self.at = self.key[self.first], at[self.first]
        self.member = order  # patterns of place p: order[first[p] : first[p + 1]]
        self.last = np.append(self.first[1:], len(at))

    @staticmethod
    def _hash(ids: np.ndarray, ends: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
        """Of the ``n`` words that end ``skip`` words before ``ends``."""
        h = np.zeros(len(ends), np.uint64)
        for k in range(n - 1, -1, -1):
            h = mix(h * _ODD + ids[ends - skip - k].astype(np.uint64) + np.uint64(1))
        return h

    def _key(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bucket above, the other words below."""
        high = self._hash(ids, ends, self.block) & np.uint64(0xFFFFFFFF00000000)
        return high | (self._hash(ids, ends, self.m - self.block, self.block) >> np.uint64(32))

    def run(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """(last words of occurrences, places of their patterns), in texts that lie from ``begins`` to ``ends`` in ``ids``."""
        # Lanes: stretches of places, all moved on together; each looks back over its border, so none is missed.
        first = begins + self.m - 1
        n = np.maximum(-(-(ends - first) // lane), 0)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + nth * lane
        stop = np.minimum(at + lane, np.repeat(ends, n))
        found_at, found = [], []
        while len(at):
            h = self._hash(ids, at, self.block)
            step = self.shift[h & self.mask]
            here = at[step == 0]
            if len(here):
                key = self._key(ids, here)
                lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                while (more := lo < hi).any():  # a second turn only where unlike patterns have one key
                    here, lo, hi = here[more], lo[more], hi[more]
                    equal = np.ones(len(here), bool)
                    start = self.at[lo]
                    for k in range(self.m):
                        equal &= ids[here - (self.m - 1) + k] == self.flat[start + k]
                    found_at.append(here[equal])
                    found.append(lo[equal])
                    lo = lo + 1
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Index:
    """The windows of one block of the benchmark: a number for each of its words, and a Search for each length of windows."""

    def __init__(self, pieces: list[tuple[str, bytes]], settings: Settings) -> None:
        self.names = sorted({name for name, _ in pieces}, key=lambda s: s.encode("utf-8", "surrogatepass"))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        split = [text.split() for _, text in pieces]
        self.flat = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for ws in split for w in ws], np.int32)
        size = np.array([len(ws) for ws in split], np.int64)
        begin = np.cumsum(size) - size
        item = np.array([number[name] for name, _ in pieces], np.int64)
        self.searches = []
        for m in np.unique(np.minimum(size, settings.window)).tolist():
            own = np.flatnonzero(np.minimum(size, settings.window) == m)
            windows = size[own] - m + 1
            starts = np.repeat(begin[own], windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            search = Search(self.flat, starts, list(zip(begin[own].tolist(), size[own].tolist(), strict=True)), m, settings.block)
            self.searches.append((search, np.repeat(item[own], windows)))

    def ids(self, text: str | None) -> np.ndarray:
        """A number for each word of a text, 0 for those that the benchmark has not: equal numbers are equal words."""
        ws = words(text)
        return np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int32, len(ws))


_index: list = [None, None]


def _forget() -> None:
    _index[:] = [None, None]


def index_of(folder: str, block: int, settings: Settings) -> Index:
    """The index of a block, read from the shared folder; a worker keeps the last one."""
    common.claim("decontaminate", _forget)
    if _index[0] != (folder, block, settings):
        import pyarrow.parquet as pq

        from .tokens import _fs

        store, base = _fs(f"{folder}/block={block}")
        _forget()
        from pyarrow import fs

        rows: list[tuple[str, bytes]] = []
        for f in sorted(store.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda f: f.path):
            if f.path.endswith(".parquet"):
                table = pq.read_table(f.path, filesystem=store, columns=["item", "words"], partitioning=None)
                rows += zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True)
        _index[:] = [(folder, block, settings), Index(rows, settings)]
    return _index[1]


def benchmark_blocks(benchmark: DataFrame, settings: Settings, text: str = "text", item: str = "item_id") -> tuple[str, int]:
    """The benchmark's items as pieces of bounded size, written to a folder in blocks of about ``held`` words; (folder, blocks).

    An item's pieces overlap by a window less one word, so all its windows stay.
    A null item_id is the item of the empty name; equal ids are one item; equal pieces of an item are written once.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names, out, sizes = [], [], []
        for name, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ws = words(t)
            for k in range(0, max(1, len(ws) - settings.window + 1), settings.piece) if ws else ():
                part = ws[k : k + settings.piece + settings.window - 1]
                names.append(name), out.append(b" ".join(part)), sizes.append(len(part))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], ["item", "words", "n"])

    given = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    pieces = common.cut(common.map_arrow(given, cut, "item string, words binary, n long").distinct(), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // settings.held)
    folder = common.new_path(benchmark.sparkSession, "windows")
    if blocks:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
        dealt.repartition(int(blocks), "block").write.partitionBy("block").parquet(folder)
    return folder, int(blocks)


_FOUND = "doc_id long, n_words long, spans array<struct<first: long, past: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, n_words, ``spans`` (words from ``first`` up to ``past`` that windows of the benchmark cover, merged) and ``items``
    (ids, sorted as strings, of the items with such windows): a row per row of ``docs``.

    A window is ``window`` consecutive words of an item, or a shorter item whole.
    Each task searches its texts, a batch at a time, with the benchmark's blocks
    one after the other, which it reads from the shared folder: it holds one
    block, however large the benchmark, and nothing of the documents is shuffled.
    Words are compared as what they are: hashes only say where to compare.

    Null and empty texts have no words, spans or items; items without words have
    no windows; an empty benchmark hits nothing. Texts of any length are searched
    whole. Repeated rows and equal or null doc_ids give a row each; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    folder, blocks = benchmark_blocks(benchmark, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            a = 0
            size = np.zeros(batch.num_rows, np.int64)
            # Some million bytes at a time; a longer text by itself.
            weight = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
            while a < batch.num_rows:
                z = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + (1 << 24), "right")))
                yield from search(batch.slice(a, z - a), size[a:z])
                a = z

    def search(batch: pa.RecordBatch, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text")
        cover, owners, items = None, [], []
        if not blocks:
            n[:] = [len(words(t.as_py())) for t in texts]
        for block in range(blocks):
            index = index_of(folder, block, settings)
            own = [index.ids(t.as_py()) for t in texts]
            n[:] = list(map(len, own))
            ids, ends = np.concatenate(own), np.cumsum(n)
            del own
            cover = np.zeros(len(ids) + 1, np.int32) if cover is None else cover
            for s, item in index.searches:
                at, place = s.run(ids, ends - n, ends, settings.lane)
                if not len(at):
                    continue
                np.add.at(cover, at - s.m + 1, 1)
                np.add.at(cover, at + 1, -1)
                # Each document and pattern once; then the items that have the pattern.
                pair = np.unique(np.stack([np.searchsorted(ends, at, "right"), place]), axis=1)
                count = s.last[pair[1]] - s.first[pair[1]]
                member = np.repeat(s.first[pair[1]] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                both = np.unique(np.stack([np.repeat(pair[0], count), item[s.member[member]]]), axis=1)
                owners.append(both[0])
                items.append(np.array(index.names, object)[both[1]])
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        named = np.concatenate(items) if items else np.zeros(0, object)
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
        # An item may lie in several blocks, or have windows of several lengths.
        lists = [sorted(set(named[order[a:b]].tolist()), key=lambda s: s.encode("utf-8", "surrogatepass")) if a < b else [] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        first, past = _runs(cover, n) if cover is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin = np.cumsum(n) - n
        doc = np.searchsorted(begin + n, first, "right")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first - begin[doc]), pa.array(past - begin[doc])], ["first", "past"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), spans, pa.array(lists, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, _FOUND)


def _runs(cover: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past) of the runs of covered words; runs end where a document does."""
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.zeros(len(hit) + 1, bool)
    edge[np.cumsum(n)] = True
    starts = hit & np.concatenate([[True], ~hit[:-1]])[: len(hit)]
    starts |= hit & edge[:-1]
    stops = hit & np.concatenate([~hit[1:], [True]])[: len(hit)]
    stops |= hit & edge[1:]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any word that a window of the benchmark covers, with all their columns; texts without words stay.

    Found by doc_id and a hash of the text, so repeated rows stay or go together; an empty table gives no rows.
    """
    named = docs.select(F.xxhash64(text, F.col("doc_id").cast("string")).alias("doc_id"), F.col(text).alias("text"))
    bad = common.cut(scan(named, benchmark, settings).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return rows.join(common.small(bad), F.xxhash64(F.col(f"__row.`{text}`"), F.col("__row.doc_id").cast("string")) == F.col("__bad"), "left_anti").select("__row.*")


def digests(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from scan()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    found = scan(docs, benchmark, settings).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: digests() over tables ``documents`` and ``benchmark``, for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SPLIT} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT r, i, x.m, item FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM x) x JOIN p ON p.m = x.m AND p.g = x.g),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + m)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
