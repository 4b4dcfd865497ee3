"""Column functions: filter sizing, codes and slices."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LN2 = math.log(2)


def filter_bits(n: Column, p: Column) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p, 64 at least."""
    return F.greatest(F.ceil(-n * F.log(p) / (LN2 * LN2)), F.lit(64)).cast("long")


def filter_hashes(n: Column, bits: Column) -> Column:
    return F.least(F.greatest(F.round(bits / n * LN2), F.lit(1)), F.lit(30)).cast("int")


def false_positive_rate(n: Column, bits: Column, hashes: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * n / bits), hashes)


def varint_bytes(value: Column) -> Column:
    """Bytes of a number at seven bits each; one for zero."""
    return F.ceil(F.length(F.bin(value)) / 7).cast("int")


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * hits, hits + misses), F.lit(0.0))


def slices(items: Column, least: int, most: Column) -> Column:
    """All contiguous slices of an array, from `least` to `most` items."""
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, n))
    return F.flatten(F.transform(F.sequence(F.lit(least), most), starts))


def big_endian(value: Column, size: int = 8) -> Column:
    return F.lpad(F.hex(value), 2 * size, "0")


def request_packet(t1: Column) -> Column:
    """Byte-order mark, type 1, time stamp: 11 bytes as hexadecimal digits."""
    return F.concat(F.lit("FEFF01"), big_endian(t1))


def response_packet(t2: Column, t3: Column) -> Column:
    """Byte-order mark, type 2, two time stamps: 19 bytes as hexadecimal digits."""
    return F.concat(F.lit("FEFF02"), big_endian(t2), big_endian(t3))


def packet_time(packet: Column, at: int) -> Column:
    """The time stamp that begins at byte `at`."""
    return F.conv(F.substring(packet, 2 * at + 1, 16), 16, 10).cast("long")
