"""Pages of long listings: sorted once by ranges, then any page reads the files that hold its rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.cuts import written

#: Rows of a page.
PAGE = 60


@dataclass
class PageIndex:
    """A listing in the order of its files, and how many rows lie before each file: (file, first rank, rows), one entry a file."""

    table: DataFrame
    files: list[tuple[str, int, int]]
    order: Sequence[str]

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str]) -> PageIndex:
        """Sort `df` by ranges and store it; rows that are equal in `order` get a fixed order of their own."""
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        table = written(ranged)
        number = lambda p: F.expr(f"coalesce(try_cast(nullif(regexp_extract(_metadata.file_name, '{p}', 1), '') as long), 0)")
        counts = table.select(F.col("_metadata.file_path").alias("file"), number("^part-([0-9]+)").alias("part"), number("-c([0-9]+)[.]").alias("piece")).groupBy("file", "part", "piece").count()
        files, rank = [], 0
        for r in sorted(counts.collect(), key=lambda r: (r["part"], r["piece"])):  # one small row a file
            files.append((r["file"], rank, r["count"]))
            rank += r["count"]
        return cls(table, files, list(order))

    @property
    def rows(self) -> int:
        return self.files[-1][1] + self.files[-1][2] if self.files else 0

    def page(self, number: int, size: int = PAGE) -> DataFrame:
        """One page, in order; numbers beyond the last page give the last one, negative ones the first. Other files aren't read."""
        last = max(0, -(-self.rows // size) - 1)
        start = min(max(0, number), last) * size
        held = [(f, first) for f, first, n in self.files if first < start + size and first + n > start]
        if not held:
            return self.table.limit(0)
        own = self.table.sparkSession.read.schema(self.table.schema).parquet(*[f for f, _ in held])
        starts = F.create_map(*[F.lit(x) for pair in held for x in pair])
        ranked = own.withColumn("_rank", starts[F.col("_metadata.file_path")] + F.col("_metadata.row_index"))
        return ranked.filter(F.col("_rank").between(start, start + size - 1)).orderBy("_rank").drop("_rank")
