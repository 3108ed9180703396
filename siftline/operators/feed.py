"""FeedFrame: a table of text columns with the operators of a feed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.names import ColumnMap, resolve, sanitize
from siftline.operators import analytics, health
from siftline.operators.profile import profile
from siftline.plans.filters import compile_filter


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    columns: list[str]
    page: int
    page_size: int
    total_records: int
    total_pages: int


@dataclass(frozen=True)
class FeedFrame:
    """kept: what a reader holds in memory and on disk for this feed."""

    df: DataFrame
    names: ColumnMap
    kept: DataFrame | None = None

    def release(self) -> None:
        """Gives back what is held for the feed; it can still be used, and is then read again."""
        if self.kept is not None:
            self.kept.unpersist()

    @staticmethod
    def from_table(df: DataFrame) -> FeedFrame:
        """Any table as a feed: names sanitized, arrays of plain values joined, all else as text."""
        names = ColumnMap.of(df.columns)

        def text(c: str):
            col, kind = F.col(f"`{c}`"), dict(df.dtypes)[c]
            if kind.startswith("array<") and "struct" not in kind:
                return F.array_join(col.cast("array<string>"), ", ")
            return F.to_json(col) if kind.startswith(("array", "map", "struct")) else col.cast("string")

        return FeedFrame(df.select(*(text(o[0]).alias(s, metadata={"original": o[0]}) for s, o in names.originals.items())), names)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def column(self, name: str) -> str:
        return sanitize(name)

    def resolve(self, name: str) -> str | None:
        return resolve(name, self.columns)

    def filter(self, text: str | None) -> FeedFrame:
        return replace(self, df=self.df.filter(compile_filter(text, self.columns)))

    def missing(self, column: str) -> FeedFrame:
        return self.filter(f"missing:{column}")

    def populated(self, column: str) -> FeedFrame:
        return self.filter(f"populated:{column}")

    def overview(self, elapsed: float = 0.0) -> DataFrame:
        return analytics.overview(self.df, elapsed)

    def profile(self) -> DataFrame:
        return profile(self.df, self.names)

    def distribution(self, column: str, limit: int = 50) -> DataFrame:
        return analytics.distribution(self.df, sanitize(column), limit)

    def duplicates(self, column: str, limit: int = 30) -> DataFrame:
        return analytics.duplicates(self.df, sanitize(column), limit)

    def frequency(self, column: str, text: str | None = None) -> DataFrame:
        return analytics.frequency(self.filter(text).df, sanitize(column))

    def cross_tab(self, primary: str, secondary: str, limit: int | None = 150, text: str | None = None) -> DataFrame:
        return analytics.cross_tab(self.filter(text).df, sanitize(primary), sanitize(secondary), limit)

    def pairs(self, primary: str, secondary: str, text: str | None = None) -> DataFrame:
        return analytics.pairs(self.filter(text).df, sanitize(primary), sanitize(secondary))

    def custom(self, columns: Sequence[str], deduplicate: bool = False, include_counts: bool = False, text: str | None = None) -> DataFrame:
        own = [sanitize(c) for c in columns]
        return analytics.custom_columns(self.filter(text).df, own, deduplicate, include_counts, {c: self.names.original(c) for c in own})

    def page(self, number: int = 1, size: int = 50, sort: str | None = None, descending: bool = False, text: str | None = None) -> Page:
        chosen = self.filter(text).df
        total = chosen.count()
        rows = analytics.page(chosen, number, size, sanitize(sort) if sort else None, descending)
        rows = rows.withColumnsRenamed({c: self.names.original(c) for c in self.columns})
        return Page(rows, rows.columns, max(number, 1), size, total, max(1, -(-total // size)) if size else 1)

    def company_column(self) -> str | None:
        return health.company_column(self.columns)
