"""Prefix filtering of sets by shared tokens, for similarity joins at ``percent`` Jaccard."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def least(n: int, percent: int) -> int:
    """Of n tokens, how many at least a set shares with one that it is linked to."""
    return -(-percent * n // 100)


def share(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / F.lit(100))


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """The overlap from which two sets of these sizes are linked."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))


def sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    """The length filter."""
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


#: Sizes of one step differ by less than this factor.
STEP = 1.5


def size_step(n: Column) -> Column:
    """The step that sets of this size are in; larger sets are in the same or a higher one."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(STEP))).cast("int")


def least_of_step(step: Column) -> Column:
    """A size that no set of a step is below."""
    return F.floor(F.pow(F.lit(STEP), step)) - 1


def reach(a: str, b: str) -> Column:
    """The positional filter: the largest overlap of two sets that share the token of two places
    (``i`` tokens stand before it)."""
    of = lambda side, name: F.col(f"{side}.{name}")
    return F.least(of(a, "i"), of(b, "i")) + F.least(of(a, "n") - of(a, "i"), of(b, "n") - of(b, "i"))


def bits_fit(a: str, b: str, n_a: Column, n_b: Column, bits: tuple[str, ...], percent: int) -> Column:
    """The bitmap filter: at least as many tokens as bits differ are in one of the two sets only."""
    apart = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in bits)
    return apart + 2 * needed(n_a, n_b, percent) <= n_a + n_b


def possible(percent: int) -> Column:
    """Whether sets of sizes ``n_a, n_b`` with ``s`` common tokens in their prefixes may be linked."""
    beyond = lambda n: share(n, percent) - 1  # noqa: E731  what a prefix leaves of a set
    rest = F.greatest(beyond(F.col("n_a")), beyond(F.col("n_b")))
    return F.col("s") + rest >= needed(F.col("n_a"), F.col("n_b"), percent)
