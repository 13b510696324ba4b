"""Byte ranges of framed files against framing from the start, at every split."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.envelope import ConfigError
from millrace.operators import framing
from millrace.sources import files, ranges


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.record_index, r.file_offset, None if r.record is None else bytes(r.record)) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Small files: empty, without a delimiter, with delimiters side by side, with a tail, with one at the very end."""
    r = random.Random(1)
    out = tmp_path_factory.mktemp("delimited")
    bodies = [b"", b"\n", b"tail", b"\n\n\n", b"ab\ncd\n", b"a\nlonger tail", b"".join(bytes(r.choice(b"abc\n") for _ in range(r.randrange(40))) for _ in range(9)), bytes(range(256)) * 2]
    for i, body in enumerate(bodies):
        (out / f"f{i}").write_bytes(body)
    return str(out)


def framed(body, max_len):
    """(offset, record) from the start, None for a record that is over."""
    at, out = 0, []
    while at < len(body):
        end = body.find(b"\n", at) + 1
        if end - at > max_len or (not end and len(body) - at >= max_len):
            out.append((at, None))
        elif end:
            out.append((at, body[at:end]))
        if not end:
            break
        at = end
    return out


@given(st.binary(max_size=60).map(lambda b: bytes(b"ab\n"[c % 3] for c in b)), st.integers(1, 70), st.integers(1, 20))
def test_delimited_range(body, split, max_len):
    got = []
    for start in range(0, len(body), split):
        stop, base = min(start + split, len(body)), max(start - 1, 0)
        data = np.frombuffer(body[base : min(len(body), stop + max_len)], np.uint8)
        starts, ends, over = ranges.delimited_range(data, base, start, stop, len(body), 10, max_len)
        got += [(a, None if o else body[a:z]) for a, z, o in zip(starts.tolist(), ends.tolist(), over.tolist(), strict=True)]
    assert got == framed(body, max_len)


@pytest.mark.parametrize("split", [17, 200])
def test_delimited(spark, folder, split):
    want = rows(framing.delimited(files.blobs(spark, folder), max_len=300))
    assert len(want) > 20 and rows(ranges.delimited(spark, folder, max_len=300, split=split)) == want


@pytest.mark.parametrize("max_len,split", [(1, 20), (5, 31)])
def test_records_over_the_limit(spark, folder, max_len, split):
    want = rows(framing.delimited(files.blobs(spark, folder), max_len=max_len, permissive=True))
    assert any(r[3] is None for r in want)
    assert rows(ranges.delimited(spark, folder, max_len=max_len, permissive=True, split=split)) == want
    for df in (ranges.delimited(spark, folder, max_len=max_len, split=split), framing.delimited(files.blobs(spark, folder), max_len=max_len)):
        with pytest.raises(Exception, match=f"no delimiter within {max_len}"):
            df.collect()


@pytest.mark.parametrize("split", [9, 64])
def test_fixed(spark, folder, split):
    assert rows(ranges.fixed(spark, folder, 4, split)) == rows(framing.fixed(files.blobs(spark, folder), 4))


def followed(body, width, most):
    at, out = 0, []
    while at + width <= len(body):
        n = int.from_bytes(body[at : at + width], "big")
        if n > most:
            return out, True
        if at + width + n > len(body):
            break
        out.append(at)
        at += width + n
    return out, False


@given(st.binary(max_size=200), st.sampled_from([1, 2]), st.integers(0, 12), st.integers(1, 80), st.booleans())
def test_ways(body, width, most, block, small):
    """Walking the blocks by their ways meets the records that following the whole file meets."""
    if small:  # mostly lengths that are allowed
        body = bytes(c % (most + 1) if width == 1 or i % 2 else 0 for i, c in enumerate(body))
    block = max(block, width + most)
    entry, index, got = 0, 0, {}
    for start in range(0, len(body), block):
        stop = min(start + block, len(body))
        exits, counts = ranges.ways(body[start : stop + width - 1], stop - start, len(body) - start, width, most)
        if entry >= 0:
            got[start] = (start + entry, index)
            index += int(counts[entry])
            entry = int(exits[entry])
    want, bad = followed(body, width, most)
    assert index == len(want) and (entry == -2) == bad
    for start, (first, nth) in got.items():
        own = [i for i, w in enumerate(want) if start <= w < start + block]
        assert not own or (want[own[0]], own[0]) == (first, nth)


def prefixed(r, n, width, most):
    out = b""
    for _ in range(n):
        size = r.choice((0, 1, r.randrange(most + 1), r.randrange(most + 1)))
        out += size.to_bytes(width, "big") + bytes(r.choice(b"\x00\x01\x02\x05xyz\xff") for _ in range(size))
    return out


@pytest.mark.parametrize("width,most,block,fan", [(1, 40, 50, 2), (1, 255, 1, 64), (2, 30, 60, 3), (4, 60, 100, 4)])
def test_length_prefixed(spark, tmp_path, width, most, block, fan):
    r = random.Random(width * most)
    for i in range(4):
        body = prefixed(r, [0, 1, 9, 40][i], width, most)
        (tmp_path / f"f{i}").write_bytes(body + (most.to_bytes(width, "big") + b"cut" if i % 2 and most > 3 else b"\x00" * (width - 1)))
    path = str(tmp_path)
    want = rows(framing.length_prefixed(files.blobs(spark, path), width, most))
    assert len(want) >= 50
    assert rows(ranges.length_prefixed(spark, path, width, most, block, fan)) == want


def test_length_that_is_not_allowed(spark, tmp_path):
    """Bytes that would be a bad length, had a record started there, do no harm; a length that is one is an error."""
    (tmp_path / "good").write_bytes(b"\x03\xff\xff\xff" * 50)
    assert len(rows(ranges.length_prefixed(spark, str(tmp_path), 1, 5, block=6, fan=2))) == 50
    (tmp_path / "bad").write_bytes(b"\x03\xff\xff\xff" * 50 + b"\x09 too long")
    with pytest.raises(Exception, match="payload of 9 bytes is over 5"):
        ranges.length_prefixed(spark, str(tmp_path), 1, 5, block=6, fan=2).collect()


def test_one_file_by_many_tasks(spark, tmp_path):
    """A single file is dealt over tasks by its ranges, though these are few bytes in the plan."""
    (tmp_path / "one").write_bytes(b"0123456\n" * 4000)
    df = ranges.delimited(spark, str(tmp_path), split=1000)
    assert df.rdd.getNumPartitions() == 32 and df.count() == 4000
    df = ranges.length_prefixed(spark, str(tmp_path), 1, 255, block=1000)
    assert df.rdd.getNumPartitions() == 32


def test_files_read(spark, folder):
    assert rows(files.read(spark, folder, max_len=300, split=5)) == rows(files.read(spark, folder, whole=True, max_len=300))
    for make in (lambda: ranges.fixed(spark, folder, 0), lambda: ranges.delimited(spark, folder, 256), lambda: ranges.length_prefixed(spark, folder, 3), lambda: ranges.ranges(spark, folder, 0)):
        with pytest.raises(ConfigError):
            make()
