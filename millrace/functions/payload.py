"""Payloads of generated packets, by sequence number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import read_uint_be, uint_be


def fixed_seq(sequence: Column, size: int) -> Column:
    """The sequence as eight big-endian bytes, then zeros; a shorter payload has its low bytes."""
    return uint_be(sequence, size) if size <= 8 else F.concat(uint_be(sequence, 8), F.unhex(F.lit("00" * (size - 8))))


def symbol_bytes(symbol: str) -> str:
    return symbol[:8].ljust(8)


def market_quote(sequence: Column, symbol: str = "AAPL") -> Column:
    """34 bytes: 'Q', flags, symbol of 8, bid, ask, sequence. Bids go round 100000 .. 100999, asks are one above."""
    bid = F.pmod(sequence, F.lit(1000)) + 100000
    return F.concat(F.unhex(F.lit("5100")), F.encode(F.lit(symbol_bytes(symbol)), "utf-8"), uint_be(bid, 8), uint_be(bid + 1, 8), uint_be(sequence, 8))


def market_quote_decode(data: Column) -> Column:
    fields = F.struct(
        F.rtrim(F.decode(F.substring(data, 3, 8), "utf-8")).alias("symbol"),
        read_uint_be(data, 10, 8).alias("bid"),
        read_uint_be(data, 18, 8).alias("ask"),
        read_uint_be(data, 26, 8).alias("sequence"),
    )
    return F.when((F.length(data) == 34) & (F.substring(data, 1, 1) == F.unhex(F.lit("51"))), fields)


def fix_quote(sequence: Column, symbol: str = "AAPL") -> Column:
    """A two-byte length and `35=Q|55=SYMBOL|44=PRICE|34=SEQUENCE|`."""
    body = F.encode(F.format_string(f"35=Q|55={symbol}|44=%d|34=%d|", F.pmod(sequence, F.lit(50)) + 100, sequence), "utf-8")
    return F.concat(uint_be(F.length(body), 2), body)


def fix_decode(data: Column) -> Column:
    """The body's tags as a map."""
    return F.str_to_map(F.rtrim(F.decode(F.substring(data, 3, 1 << 30), "utf-8"), F.lit("|")), F.lit("\\|"), F.lit("="))
