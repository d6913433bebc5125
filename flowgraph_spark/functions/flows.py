"""Column expressions shared by batch and streaming flow operators."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BENIGN, HISTORY_FLAGS, MISSING_TOKENS, RESP_PORT_BUCKETS

# Fixed value: text accepted as a number (no type suffixes, no infinities).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def canonical_label(label: Column) -> Column:
    trimmed = F.trim(label)
    return F.when(trimmed.isin(*MISSING_TOKENS), F.lit(BENIGN)).otherwise(trimmed)


def missing_to_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TOKENS), value)


def lenient_double(value: Column) -> Column:
    return F.when(value.cast("string").rlike(NUMBER_PATTERN), value.try_cast("double"))


def lenient_long(value: Column) -> Column:
    return lenient_double(value).try_cast("long")


def resp_port_bucket(port: Column) -> Column:
    low, middle, high = RESP_PORT_BUCKETS
    return (
        F.when(port.isNull() | (port < 1024), low).when(port < 49152, middle).otherwise(high)
    )


def is_wellknown_port(port: Column) -> Column:
    return F.coalesce((port >= 0) & (port < 1024), F.lit(False)).cast("byte")


def history_counts(history: Column):
    """One ``(letter, count)`` pair per history flag; null history counts zero."""
    text = F.coalesce(history, F.lit(""))
    return [
        (flag, (F.length(text) - F.length(F.replace(text, F.lit(flag), F.lit("")))).cast("int"))
        for flag in HISTORY_FLAGS
    ]


def history_column(flag: str) -> str:
    """Column name of a history count; Spark names do not differ by case alone."""
    case = "upper" if flag.isupper() else "lower"
    return f"hist_{case}_{flag.lower()}"


def flow_id(uid: Column, orig_h, orig_p, resp_h, resp_p) -> Column:
    usable = uid.isNotNull() & (uid != "") & (uid != "-")
    endpoints = F.concat(
        orig_h, F.lit(":"), orig_p.cast("string"), F.lit("->"),
        resp_h, F.lit(":"), resp_p.cast("string"),
    )
    return F.when(usable, uid).otherwise(endpoints)


def binary_label(label: Column) -> Column:
    return (label != BENIGN).cast("int")


def numeric_bucket(value: Column, boundaries) -> Column:
    """Text bucket: ``<b0``, ``lo-hi`` (closed-open), ``>=bn``; null and NaN give null."""
    bounds = list(boundaries)
    if not bounds or sorted(bounds) != bounds:
        raise ValueError("Bucket boundaries must be sorted and not empty.")
    missing = value.isNull() | F.isnan(value.cast("double"))
    bucket = F.when(missing, F.lit(None).cast("string")).when(value < bounds[0], F.lit(f"<{bounds[0]:g}"))
    for low, high in zip(bounds, bounds[1:]):
        bucket = bucket.when((value >= low) & (value < high), F.lit(f"{low:g}-{high:g}"))
    return bucket.otherwise(F.lit(f">={bounds[-1]:g}"))


def entity_hash(key: bytes, sensor: Column, entity: Column) -> Column:
    """HMAC-SHA256 of ``sensor NUL entity`` in hex, built from ``sha2`` alone.

    The plan holds the two padded keys, so treat plans as secret as the key.
    """
    if not key:
        raise ValueError("The entity key must not be empty.")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    message = F.encode(F.concat(sensor, F.lit("\0"), entity), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))
