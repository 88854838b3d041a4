"""Files bounded by bytes: rows per file from a sketch of row widths.

One pass counts rows, bytes and the widest row per power of two of the width: at most 32 rows, whatever the
table's size. Neighbouring classes are then joined into as few width ranges as keep the number of files near
the least possible, and each range is written with as many rows per file as its widest row allows. Nothing is
shuffled or sorted: a range is a filter on the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files, in multiples of the least number that could hold the bytes, that are accepted to save a pass over the rows.
MOST_FILES = 4


@dataclass(frozen=True)
class WidthRange:
    """Rows wider than ``above`` and up to ``widest`` bytes; None means without a limit."""

    above: int | None
    widest: int | None
    rows_per_file: int

    def holds(self, width: Column) -> Column:
        low = F.lit(True) if self.above is None else width > self.above
        return low if self.widest is None else low & (width <= self.widest)


def line_bytes(line: Column) -> Column:
    """Bytes of a line in a text file, its end included."""
    return F.octet_length(line).cast("bigint") + 1


def width_sketch(rows: DataFrame, width: Column) -> DataFrame:
    """``width_class, n, bytes, widest``: the class is the least power of two that holds the width."""
    of = F.length(F.bin(F.greatest(width, F.lit(1)) - 1))
    return rows.groupBy(of.alias("width_class")).agg(
        F.count("*").alias("n"), F.sum(width).alias("bytes"), F.max(width).alias("widest")
    )


def width_ranges(sketch: list, bound: int, most_rows: int | None = None) -> list[WidthRange]:
    """Width ranges from a collected sketch, narrowest first, that cover every width.

    No file of a range has more than ``bound`` bytes, unless one row alone has. Of all ways to join
    neighbouring classes the one with the fewest ranges is taken whose files stay within ``MOST_FILES``
    times the least possible number; single classes, the finest way, always do.
    """
    if bound <= 0:
        raise ValueError("a file needs room for one byte at least: its bound is below 1")
    classes = sorted(sketch, key=lambda r: r["width_class"])

    def per_file(last: int) -> int:
        rows = max(1, bound // max(classes[last]["widest"], 1))
        return rows if most_rows is None else min(rows, most_rows)

    def files(first: int, last: int) -> int:
        return -(-sum(c["n"] for c in classes[first : last + 1]) // per_file(last))

    count = len(classes)
    # a row wider than the bound is a file of its own
    least = sum(max(min(-(-c["bytes"] // bound), c["n"]), -(-c["n"] // most_rows) if most_rows else 0) for c in classes)
    # best[k][j]: fewest files for the first j classes in k ranges, and where the last of these begins
    best = [{0: (0, None)}]
    while count:
        row = {}
        for j in range(1, count + 1):
            options = [(best[-1][i][0] + files(i, j - 1), i) for i in range(j) if i in best[-1]]
            if options:
                row[j] = min(options)
        best.append(row)
        if len(best) > count or (count in row and row[count][0] <= MOST_FILES * least):
            break
    cuts, j = [], count
    for k in range(len(best) - 1, 0, -1):
        i = best[k][j][1]
        cuts.append((i, j - 1))
        j = i
    cuts.reverse()
    # the first and the last range are open, so that no row is lost that the sketch did not see
    return [
        WidthRange(classes[i - 1]["widest"] if i else None, None if j == count - 1 else classes[j]["widest"], per_file(j))
        for i, j in cuts
    ]
