"""Hashes that decide: split buckets, audit order, quota arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def bucket(sha: Column, modulus: int) -> Column:
    """First 64 bits of a hexadecimal digest, unsigned, modulo `modulus`."""
    return (F.conv(F.substring(sha, 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def split_name(sha: Column, modulus: int = 100, validation: tuple[int, ...] = (0,)) -> Column:
    return F.when(bucket(sha, modulus).isin(*validation), "validation").otherwise("train")


def audit_order(text: Column) -> Column:
    """Sorts like the first 8 bytes of the digest as a number."""
    return F.substring(sha256(text), 1, 16)
