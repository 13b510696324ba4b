import pytest

from millrace.envelope import ConfigError
from millrace.operators import framing


def blobs(spark, *contents):
    return spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def records(df):
    return [bytes(r.record) for r in df.orderBy("path", "record_index").collect()]


def test_fixed(spark):
    assert records(framing.fixed(blobs(spark, b"AAAAAAAABBBBBBBBCCCCCCCC"), 8)) == [b"A" * 8, b"B" * 8, b"C" * 8]
    assert records(framing.fixed(blobs(spark, b"AAAAAAAABBBBB", b"", b"xyz"), 8)) == [b"A" * 8]
    with pytest.raises(ConfigError):
        framing.fixed(blobs(spark, b"A"), 0)


def test_delimited(spark):
    out = framing.delimited(blobs(spark, b"hello\nworld\nfoo\n", b"line1\nline2\nincomplete", b"", bytes(range(256))))
    assert records(out) == [b"hello\n", b"world\n", b"foo\n", b"line1\n", b"line2\n", bytes(range(11))]
    assert [r.file_offset for r in out.filter("path = '0'").orderBy("record_index").collect()] == [0, 6, 12]


def test_delimited_too_long(spark):
    with pytest.raises(Exception, match="no delimiter within 5"):
        framing.delimited(blobs(spark, b"abcdef\n"), max_len=5).collect()
    assert [r.record for r in framing.delimited(blobs(spark, b"abcdef\nab\n"), max_len=5, permissive=True).orderBy("record_index").collect()] == [None, b"ab\n"]


def test_length_prefixed(spark):
    assert records(framing.length_prefixed(blobs(spark, b"\x05hello\x03bye\x09cut"))) == [b"\x05hello", b"\x03bye"]
    assert records(framing.length_prefixed(blobs(spark, b"\x00\x02ok\x00"), 2)) == [b"\x00\x02ok"]
    with pytest.raises(Exception, match="over 4"):
        framing.length_prefixed(blobs(spark, b"\x0a0123456789"), max_payload=4).collect()


def test_concatenation(spark):
    """Framed records are the file without its tail."""
    data = b"".join(bytes([len(w)]) + w for w in [b"a" * n for n in range(1, 60)])
    assert b"".join(records(framing.length_prefixed(blobs(spark, data + b"\xffcut")))) == data


def test_loop(spark):
    out = framing.looped(framing.fixed(blobs(spark, b"AAAABBBB"), 4), 2)
    assert [(r.loop_index, bytes(r.record)) for r in out.orderBy("loop_index", "record_index").collect()] == [(0, b"AAAA"), (0, b"BBBB"), (1, b"AAAA"), (1, b"BBBB")]
