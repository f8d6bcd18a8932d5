"""Public tokenizer files: found on the driver, shipped to the tasks."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import SparkSession


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes as a broadcast; such files are of fixed size (under 2 MB each)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write bytes as visible characters: printable Latin-1 bytes stand
    for themselves, the rest are numbered on from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
