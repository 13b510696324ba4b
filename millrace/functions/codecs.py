"""Fixed binary layouts as Column expressions; they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint_be(x: Column, width: int) -> Column:
    """The low ``width`` bytes of ``x``, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def read_uint_be(data: Column, offset: int, width: int) -> Column:
    """``width`` bytes from ``offset`` (0 first) as BIGINT; eight bytes keep their bits. Null if they are not all there."""
    digits = F.hex(F.substring(data, offset + 1, width))
    high = F.conv(F.left(digits, F.lit(max(1, 2 * width - 8))), 16, 10).cast("long")
    if width <= 4:
        value = F.conv(digits, 16, 10).cast("long")
    else:
        low = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long")
        value = F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(F.length(data) >= offset + width, value)


def turned(x: Column, width: int) -> Column:
    """The low ``width`` bytes of ``x`` in the other order, as a BIGINT: shifts and masks, no strings."""
    x = x.cast("long")
    bytes_ = [F.shiftleft(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long")), 8 * (width - 1 - i)) for i in range(width)]
    out = bytes_[0]
    for b in bytes_[1:]:
        out = out.bitwiseOR(b)
    return out


def uint_le(x: Column, width: int) -> Column:
    return uint_be(turned(x, width), width)


def read_uint_le(data: Column, offset: int, width: int) -> Column:
    return turned(read_uint_be(data, offset, width), width)


# Tick: sequence u64, price u64, quantity u32, all big-endian; 20 bytes.
TICK_BYTES = 20


def tick_encode(sequence: Column, price: Column, quantity: Column) -> Column:
    return F.concat(uint_be(sequence, 8), uint_be(price, 8), uint_be(quantity, 4))


def tick_decode(data: Column) -> Column:
    """A struct of sequence, price, quantity; null for any other length (such records are dropped)."""
    fields = F.struct(read_uint_be(data, 0, 8).alias("sequence"), read_uint_be(data, 8, 8).alias("price"), read_uint_be(data, 16, 4).alias("quantity"))
    return F.when(F.length(data) == TICK_BYTES, fields)


# Slot: a 32-byte little-endian header before the payload.
SLOT_MAGIC, SLOT_HEADER, SLOT_ALIGN = 0xFB570001, 32, 64
FLAG_VALID, FLAG_SUSPECT = 1, 2


def slot_size(payload_bytes: Column) -> Column:
    """Bytes of a slot: header and payload, rounded up to whole cache lines of 64."""
    return (F.ceil((payload_bytes + SLOT_HEADER) / SLOT_ALIGN) * SLOT_ALIGN).cast("long")


def slot_encode(schema_id: Column, suspect: Column, sequence: Column, ts_ns: Column, payload: Column) -> Column:
    flags = F.lit(FLAG_VALID).bitwiseOR(F.when(suspect, FLAG_SUSPECT).otherwise(0))
    head = [uint_le(F.lit(SLOT_MAGIC), 4), uint_le(schema_id, 2), uint_le(flags, 2), uint_le(sequence, 8), uint_le(ts_ns, 8), uint_le(F.length(payload), 4), uint_le(F.lit(0), 4)]
    return F.concat(*head, payload)


def slot_decode(data: Column) -> Column:
    """A struct of the header's fields and the payload; ``error`` says why a slot can't be read, else it is null."""

    def fields(s: Column) -> Column:
        error = (
            F.when(F.length(s["data"]) < SLOT_HEADER, "short slot")
            .when(s["magic"] != SLOT_MAGIC, "bad magic")
            .when(F.length(s["data"]) < SLOT_HEADER + s["n"], "payload overruns the slot")
        )
        return F.struct(
            s["schema_id"].alias("schema_id"),
            (s["flags"].bitwiseAND(FLAG_VALID) != 0).alias("valid"),
            (s["flags"].bitwiseAND(FLAG_SUSPECT) != 0).alias("suspect"),
            s["sequence"].alias("sequence"),
            s["ts_ns"].alias("ts_ns"),
            F.when(error.isNull(), F.substring(s["data"], F.lit(SLOT_HEADER + 1), s["n"].cast("int"))).alias("payload"),
            error.alias("error"),
        )

    parts = {"magic": (0, 4), "schema_id": (4, 2), "flags": (6, 2), "sequence": (8, 8), "ts_ns": (16, 8), "n": (24, 4)}
    # Inside transform() every part of the header is a value that is worked out once, however often it is used.
    header = F.struct(data.alias("data"), *[read_uint_le(data, *at).alias(name) for name, at in parts.items()])
    return F.transform(F.array(header), fields)[0]


# Ethernet, IPv4 and UDP headers before a payload: 42 bytes.
UDP_HEADER = 42


def udp_frame(payload: Column, port: Column) -> Column:
    """A broadcast frame from 192.168.1.1:12345 to 192.168.1.2:port; checksums are 0."""
    n = F.length(payload)
    fixed = lambda digits: F.unhex(F.lit(digits))
    return F.concat(
        fixed("FFFFFFFFFFFF" + "020000000001" + "0800" + "4500"),
        uint_be(n + 28, 2),
        fixed("00000000" + "4011" + "0000" + "C0A80101" + "C0A80102" + "3039"),
        uint_be(port, 2),
        uint_be(n + 8, 2),
        fixed("0000"),
        payload,
    )


def udp_parse(frame: Column) -> Column:
    """A struct of ether_type, protocol, port and payload; null for anything that is not IPv4 and UDP."""
    fields = F.struct(
        read_uint_be(frame, 12, 2).alias("ether_type"),
        read_uint_be(frame, 23, 1).alias("protocol"),
        read_uint_be(frame, 36, 2).alias("port"),
        F.substring(frame, UDP_HEADER + 1, 1 << 30).alias("payload"),
    )
    return F.when((F.length(frame) >= UDP_HEADER) & (read_uint_be(frame, 12, 2) == 0x0800) & (read_uint_be(frame, 23, 1) == 17), fields)
