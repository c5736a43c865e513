"""Rows told apart by key and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body_of(text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_key(key: str, text: str) -> Column:
    """A digest of 128 bits of key and text; rows that share it are equal in both. A null key is no empty one."""
    name = F.col(key).cast("string")
    head = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.md5(F.concat(head, F.lit(":"), body_of(text)).cast("binary")))
