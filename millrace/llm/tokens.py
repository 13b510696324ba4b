"""Operators 2 and 3: token counts without ids, and token ids in flat binary files.

Both use the tokenizers library on *units*: pieces of text at whose ends the
tokenizer always has a boundary, so that encoding the units one by one gives
exactly what encoding the whole text gives. Units repeat heavily in text, so each
is encoded about once.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from . import common

#: Units longer than this are parted by the library's own pre-tokenizer (counts) or encoded where they stand (ids), and never remembered.
LONG_UNIT = 200
#: Units of one of the two generations that a Python worker remembers (about 200 bytes each).
CACHE_UNITS = 300_000
#: Most frequent pre-tokens whose piece counts are broadcast; the rest are joined by a shuffle.
HOT_UNITS = 300_000

#: A blank that the library may take together with a following space or newline,
#: which so are no safe place to cut.
_JOINED_BLANKS = re.compile("[^\\S \n][ \n]|᠎")
_OTHER_BLANKS = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_CLOSING = ".,;:!?|"
#: A word that ends in a letter below U+0250 is parted from closing marks by both tokenizer styles; but for U+0130,
#: whose small form ends in a mark of its own, which joins them.
_PARTED = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]$"


class Encoder:
    """Ids of texts by one tokenizer file, through remembered units.

    style ``byte``: byte-level BPE whose pre-tokens keep one leading space.
    style ``word``: white space is dropped, ASCII case does not matter.
    style ``whole``: any other file; every text is encoded by the library as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.style = style_of(spec)
        self.wide = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_in = re.compile("|".join(map(re.escape, self.special))).search if self.special else None
        # A special token never merges with what stands beside it.
        self.between = next((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), None) if self.style != "whole" else None
        self.between_id = self.library.token_to_id(self.between) if self.between else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.wide).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str] | None:
        """The units of a text, or None where it has to be encoded whole."""
        if self.style == "whole":
            return None
        if self.style == "word":
            return text.replace("\n", " ").split(" ")
        if (not text.isascii() or any(c in text for c in _OTHER_BLANKS[:8])) and _JOINED_BLANKS.search(text):
            return None
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1] in (" ", "\n"):
            return re.findall("[ \n]*[^ \n]+|[ \n]+", text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if "\0" not in text else re.findall("[ \n]*[^ \n]+|[ \n]+", text)

    def parts(self, unit: str) -> tuple[str, ...]:
        """A unit as a word and the closing marks after it, if the tokenizer surely parts them; a long one as its pre-tokens."""
        if len(unit) > LONG_UNIT and not (self.special_in and self.special_in(unit)):
            text = self.library.normalizer.normalize_str(unit) if self.library.normalizer else unit
            return tuple(text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        if self.style == "word" and unit.isascii():
            unit = unit if self.special_in and self.special_in(unit) else unit.lower()
        word = unit.rstrip(_CLOSING)
        if word and word != unit and word[-1] < "ɐ" and word[-1] != "İ" and word[-1].isalpha():
            return (word, unit[len(word) :])
        return (unit,)

    def each(self, units: list[str]) -> list[bytes]:
        """Ids of each unit on its own: one text, with a special token between units, takes the library less time than many."""
        if self.between is None or any(map(self.special_in, units)):
            return self.ids_of(units)
        ids = self.ids_of([self.between.join(units)])[0]
        ends = np.flatnonzero(np.frombuffer(ids, self.wide) == self.between_id) * self.wide.itemsize
        starts = [0, *(ends + self.wide.itemsize).tolist()]
        return [ids[a:b] for a, b in zip(starts, [*ends.tolist(), len(ids)], strict=True)]

    def marked(self, text: str) -> str | None:
        """The text with a NUL between units, or None where it has to be encoded whole."""
        if "\0" in text:
            return None
        if self.style == "word":
            return text.replace("\n", "\0").replace(" ", "\0")
        if self.style == "byte" and not any(x in text for x in ("  ", "\n ", " \n", "\n\n")) and text[:1] not in (" ", "\n") and text.isascii() and not any(c in text for c in _OTHER_BLANKS[:8]):
            return text.replace(" ", "\0 ").replace("\n", "\0\n")
        us = self.units(text)
        return None if us is None else "\0".join(us)

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, most of them remembered. Two generations: what was not met lately is forgotten."""
        if len(self.known) > CACHE_UNITS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        out = list(map(known.get, words))
        fresh = []
        for i in (i for i, v in enumerate(out) if v is None):
            if (got := old.get(words[i])) is not None:
                out[i] = known[words[i]] = got
            else:
                fresh.append(i)
        for k in range(0, len(fresh), 16_384):
            part = [words[i] for i in fresh[k : k + 16_384]]
            ids = self.each(part)
            known.update(zip(part, ids, strict=True))
            for i, v in zip(fresh[k : k + 16_384], ids, strict=True):
                out[i] = v
        return out

    def unit_ids(self, units: pa.Array) -> list[bytes]:
        """Ids of distinct units: as words and the closing marks after them, see parts(), but for all units at once."""
        long = pc.greater(pc.utf8_length(units), LONG_UNIT)
        plain = units
        if self.style == "word":
            fold = pc.equal(pc.utf8_length(units), pc.binary_length(units))
            for t in self.special:
                fold = pc.and_(fold, pc.invert(pc.match_substring(units, t)))
            plain = pc.if_else(fold, pc.ascii_lower(units), units)
        word = pc.utf8_rtrim(plain, _CLOSING)
        parted = pc.and_(pc.match_substring_regex(word, _PARTED), pc.not_equal(word, plain))
        word = pc.if_else(pc.or_(parted, long), word, plain)
        words = pc.if_else(long, "", word).dictionary_encode()
        ids = self.word_ids(_listed(words.dictionary))
        out = list(map(ids.__getitem__, _listed(words.indices)))
        at = np.flatnonzero(np.asarray(pc.and_(parted, pc.invert(long))))
        marks = [p[len(w) :] for p, w in zip(_listed(plain.take(pa.array(at))), _listed(word.take(pa.array(at))), strict=True)]
        kinds = list(dict.fromkeys(marks))
        known = dict(zip(kinds, self.word_ids(kinds), strict=True))
        for i, m in zip(at.tolist(), marks, strict=True):
            out[i] += known[m]
        for i in np.flatnonzero(np.asarray(long)).tolist():
            out[i] = self.ids_of([units[i].as_py()])[0]
        return out

    def encode(self, texts: list[str], block: int = 4_000_000) -> Iterator[bytes]:
        """The ids of each text as bytes, in order; memory follows a block of characters, or one longer text."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= block:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        """Every distinct unit is looked up once; the texts' ids are gathered from the units' in one flat array."""
        marked = [self.marked(t) for t in texts]
        split = pc.split_pattern(pa.array([m for m in marked if m is not None], pa.string()), "\0")
        units = split.flatten().dictionary_encode()
        ids = self.unit_ids(units.dictionary)
        size = self.wide.itemsize
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        flat, first = np.frombuffer(b"".join(ids), self.wide), np.cumsum(n) - n
        at = units.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        row = 0
        for text, m in zip(texts, marked, strict=True):
            if m is None:
                yield self.ids_of([text])[0]
                continue
            own = at[ends[row] : ends[row + 1]]
            row += 1
            length = n[own]
            stop = np.cumsum(length)
            yield flat[np.arange(int(stop[-1])) + np.repeat(first[own] - stop + length, length)].tobytes()


def _listed(values: pa.Array) -> list:
    """As to_pylist(), by numpy, which takes less time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def style_of(spec: dict) -> str:
    """How texts of a tokenizer file may be cut; see Encoder."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    added = spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if plain and steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", ""):
        return "word"
    return "whole"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One Encoder a worker process and file: tasks that follow each other share what it remembers."""
    common.claim("encoder", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- operator 2


def _unit_counts(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        enc = encoder(path)
        seen: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            if text and (us := enc.units(text)) is not None:
                seen.update(us)
        out: dict[str, int] = {}
        for u, n in seen.items():
            if u:
                for p in enc.parts(u):
                    out[p] = out.get(p, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["unit", "n"])

    return run


def pre_token_pieces(texts: DataFrame, path: str) -> DataFrame:
    """(unit, n, pieces): every distinct pre-token of column ``text``, how often it stands, its pieces.

    Counted per batch before the shuffle, then summed; the library sees each
    distinct pre-token once.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, unit = encoder(path), batch.column("unit")
        pieces = [len(ids) // enc.wide.itemsize for ids in enc.each(unit.to_pylist())]
        return pa.RecordBatch.from_arrays([unit, batch.column("n"), pa.array(pieces, pa.int32())], ["unit", "n", "pieces"])

    counts = common.map_arrow(texts.select("text"), _unit_counts(path), "unit string, n long")
    return common.map_arrow(counts.groupBy("unit").agg(F.sum("n").alias("n")), count, "unit string, n long, pieces int")


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), hot: int = HOT_UNITS) -> DataFrame:
    """One row per row of ``docs``: its ``keep`` columns, n_bytes (UTF-8) and n_tokens.

    Method: pieces are counted once per distinct pre-token (a table of its own),
    which is joined to each document's pre-token frequencies and summed; ids are
    never built. The ``hot`` most frequent pre-tokens (a fixed bound) go to the
    tasks by broadcast, so that a word which a third of all text repeats is
    never shuffled; every other pre-token is joined by a shuffle, as
    (pre-token, document, frequency) rows.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and equal or null
    doc_ids give a row each. Texts without safe cuts (see Encoder) are counted in
    place. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("text")) if text not in keep else docs.select(*keep)
    pieces = common.cut(pre_token_pieces(rows, path), "pieces")
    top = common.frequent(pieces, "n", hot).select("unit", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("unit").to_pylist(), top.column("pieces").to_pylist(), strict=True)))

    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("__row", T.LongType()), T.StructField("__unit", T.StringType()), T.StructField("__n", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, hot_pieces, ids, whole = encoder(path), known.value, common.RowIds(), {}
        for batch in batches:
            at, unit, n, size, own = [], [], [], [], []
            row_ids = ids.take(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                total, us = 0, enc.units(text)
                if us is None:
                    total, us = len(enc.ids_of([text])[0]) // enc.wide.itemsize, []
                for u, k in Counter(us).items():
                    if (c := whole.get(u)) is not None:
                        total += c * k
                    elif u:
                        ps = enc.parts(u)
                        cs = [hot_pieces.get(p) for p in ps]
                        if None not in cs:
                            if len(whole) < CACHE_UNITS and len(u) <= LONG_UNIT:
                                whole[u] = sum(cs)
                            total += k * sum(cs)
                        else:
                            total += k * sum(c for c in cs if c is not None)
                            for p, times in Counter(p for p, c in zip(ps, cs, strict=True) if c is None).items():
                                at.append(i), unit.append(p), n.append(k * times), own.append(False)
                # The document's own row: no pre-token ends in a blank after a digit, so it meets none, and rows spread evenly.
                at.append(i), unit.append(f"{row_ids[i]} "), n.append(total), own.append(True)
                size.append(len(text.encode("utf-8", "surrogatepass")))
            at, own = np.array(at), np.array(own)
            cols = [batch.column(f.name).take(pa.array(at)) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(row_ids)[at]), pa.array(unit, pa.string()), pa.array(n, pa.int64()), pa.array(np.where(own, np.array(size)[at], 0), pa.int64(), mask=~own)], schema.names)

    parts = rows.mapInArrow(run, schema)
    joined = parts.join(pieces.select(F.col("unit").alias("__unit"), "pieces"), "__unit", "left")
    total = F.sum(F.when(F.col("n_bytes").isNotNull(), F.col("__n")).otherwise(F.col("__n") * F.col("pieces")))
    return joined.groupBy("__row").agg(*[F.max(c).alias(c) for c in keep], F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens")).drop("__row")


# ---------------------------------------------------------------- operator 3


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order (equal ones by a hash of the text) into binary files below ``out``; returns the manifest.

    Each shard holds three flat little-endian files: ``NAME.ids`` (unsigned 16-bit
    ids, 32-bit for vocabularies over 65,536), ``NAME.off`` (64-bit offsets in ids,
    one more than there are documents) and ``NAME.doc`` (64-bit doc_ids, with a
    0/1 null flag each). Shards follow each other by range of doc_id, nulls first.
    The manifest has shard, name, n_docs, n_tokens and ``base``, the ids in all
    shards before: a prefix sum over shards. A task writes under a name of its
    own and renames when done, so a repeated or doubled task does no harm; the
    manifest names the files of the attempt that counted.

    Null text is empty (only the end id). Repeated rows are written each for itself
    and, as equal ones may be many, parted by a running number, so that no shard
    has to take them all. Texts of any length are written whole; an empty table
    gives no file and an empty manifest; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]  # a hash, for the keys of a sample go to the driver
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, shard = encoder(path), common.partition_id()
        store, base = _fs(out)
        end = b"" if end_id is None else np.array([end_id], enc.wide).tobytes()
        name, n_docs, at = f"{shard:06d}-{uuid.uuid4().hex}", 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store.create_dir(base, recursive=True)
        with contextlib.ExitStack() as files:
            ids, off, doc = (files.enter_context(store.open_output_stream(f"{base}/{name}.{kind}.tmp")) for kind in _KINDS)
            off.write(np.zeros(1, "<i8").tobytes())
            for batch in itertools.chain([first], batches):
                lengths = []
                for got in enc.encode(batch.column("text").to_pylist()):
                    ids.write(got)
                    ids.write(end)
                    lengths.append((len(got) + len(end)) // enc.wide.itemsize)
                ends = at + np.cumsum(np.array(lengths, "<i8"))
                off.write(ends.tobytes())
                null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc.write(np.ascontiguousarray(np.array([batch.column("doc_id").fill_null(0).to_numpy(), null], "<i8").T).tobytes())
                n_docs, at = n_docs + batch.num_rows, int(ends[-1]) if len(ends) else at
        for kind in _KINDS:
            store.move(f"{base}/{name}.{kind}.tmp", f"{base}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": n_docs, "n_tokens": at, "width": enc.wide.itemsize}], schema=_MANIFEST)

    manifest = common.cut(ordered.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long, width int"), "manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard, however many documents there are
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


#: The three files of a shard: ids, their offsets, the documents they belong to.
_KINDS = ("ids", "off", "doc")
_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])


class Flat:
    """A flat file as an array that is read where it is asked for: memory-mapped on a file system of this machine."""

    def __init__(self, uri: str, dtype: str) -> None:
        from pyarrow import fs

        store, path = _fs(uri)
        self.dtype = np.dtype(dtype)
        local = isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).size
        self.map = np.memmap(path, self.dtype, "r") if local else None
        self.file = None if local else store.open_input_file(path)

    def read(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; shards are read in parallel, a stretch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (r for b in batches for r in b.to_pylist()):
            at = f"{out}/{shard['name']}"
            ids, off, doc = Flat(f"{at}.ids", f"<u{shard['width']}"), Flat(f"{at}.off", "<i8"), Flat(f"{at}.doc", "<i8")
            for k in range(0, shard["n_docs"], 4096):
                stop = min(k + 4096, shard["n_docs"])
                o, d = np.array(off.read(k, stop + 1)), np.array(doc.read(2 * k, 2 * stop)).reshape(-1, 2)
                crc, a = [], 0
                # Some million ids at a time; a longer document by itself.
                while a < len(o) - 1:
                    z = max(a + 1, int(np.searchsorted(o, o[a] + (1 << 22), "right")) - 1)
                    block = np.asarray(ids.read(int(o[a]), int(o[z])), "<u4")
                    crc += [zlib.crc32(block[x:y].data) for x, y in zip((o[a:z] - o[a]).tolist(), (o[a + 1 : z + 1] - o[a]).tolist(), strict=True)]
                    a = z
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0]), pa.int64(), mask=d[:, 1] == 1), pa.array(o[:-1] + shard["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
