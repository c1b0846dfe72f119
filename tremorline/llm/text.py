"""Column helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def whole(text: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def key_text(*parts: Column) -> Column:
    """The parts as one string; a null part reads as ``~``."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) decided by the parts: 52 bits of their MD5."""
    bits = F.conv(F.substring(F.md5(key_text(*parts).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but those ``used`` under names no operator takes, and a function that gives a frame the columns of ``docs`` back.

    An operator may then add columns of any name without replacing one of the input.
    """
    names = {c: c if c in used else f"_aside{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])
