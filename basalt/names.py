"""Column names that a table doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(*stems: str, of: tuple[DataFrame, ...]) -> list[str]:
    """For each stem a name that none of the tables has (names are compared without case)."""
    taken = {c.lower() for df in of for c in df.columns}
    out = []
    for stem in stems:
        name, n = f"__{stem}", 0
        while name in taken:
            n += 1
            name = f"__{stem}_{n}"
        taken.add(name)
        out.append(name)
    return out
