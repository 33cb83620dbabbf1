"""Simple case folding of single characters (R-142): neither lower() nor full folding.

Characters that are case variants of one another (by lower, upper or folded form of one character) make an orbit; each folds to the
orbit's least code point. Dotted capital I and dotless small i stand for themselves. The orbits are one translate() in the JVM.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ALONE = {"İ", "ı"}


@cache
def orbits() -> tuple[str, str]:
    """All characters that fold to another one, and what they fold to."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for c in map(chr, range(0x110000)):
        if c in ALONE or 0xD800 <= ord(c) < 0xE000:
            continue
        for other in {c.lower(), c.upper(), c.casefold()}:
            if len(other) == 1 and other != c and other not in ALONE:
                a, b = sorted((root(c), root(other)))
                parent[b] = a
    moved = sorted(c for c in parent if root(c) != c)
    return "".join(moved), "".join(map(root, moved))


def fold(text: str) -> str:
    return text.translate(dict(zip(map(ord, orbits()[0]), orbits()[1], strict=True)))


def fold_key(c: Column) -> Column:
    """Equal for texts that differ in case alone."""
    return F.translate(c, *orbits())
