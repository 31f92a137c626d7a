"""What the text operators share: words, row keys, written tables and joins of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.session import written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
LINE_WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A side is broadcast by hand only when it was counted and takes at most so many
# bytes as a hash table, which holds a row in some 48 bytes besides its columns.
BROADCAST_BYTES = 32_000_000
ROW_BYTES = 48

__all__ = ["BROADCAST_BYTES", "LINE_WORD", "SPACE", "WORD", "ascii_lower", "counted", "n_words", "plain", "small", "words", "written"]


def plain(text) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text in order; none for null."""
    return F.regexp_extract_all(plain(text), F.lit(pattern), F.lit(0))


def n_words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_count(plain(text), F.lit(pattern)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone. A text of single-byte characters takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table, as a hash table, takes at most ``limit`` bytes."""
    own = sum((F.octet_length(F.col(f.name).cast("binary" if f.dataType.simpleString() == "binary" else "string")) for f in df.schema if f.dataType.simpleString() in ("string", "binary")), F.lit(0))
    lists = sum((8 * F.greatest(F.size(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString().startswith("array")), F.lit(0))
    bytes_ = df.select((F.coalesce(own, F.lit(0)) + lists + ROW_BYTES + 8 * len(df.columns)).cast("long").alias("_bytes")).agg(F.sum("_bytes")).first()[0]
    return (bytes_ or 0) <= limit


def counted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it takes at most ``limit`` bytes; else Spark shuffles both sides."""
    return F.broadcast(df) if small(df, limit) else df
