"""Column names: sanitizing, collisions, and how a name in a query finds its column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

#: Names that also stand for columns of other names, in the order in which those are looked for.
ALIASES = {
    "company": ["source_name", "source.name", "name", "brand_name", "company", "company_name", "employer", "brand"],
    "company_name": ["source_name", "source.name", "name", "brand_name", "company", "company_name", "employer", "brand"],
    "employer": ["source_name", "source.name", "name", "brand_name", "employer", "company", "company_name"],
    "name": ["source_name", "source.name", "name", "brand_name", "company", "company_name", "employer"],
    "brand": ["brand_name", "source_name", "name", "company"],
    "remote": ["remote", "work_model", "is_remote", "telecommute"],
    "work_model": ["work_model", "remote", "is_remote"],
    "title": ["title", "job_title", "role", "jobtitle", "headline"],
    "city": ["city", "job_city", "location", "place"],
    "state": ["state", "region", "province"],
    "country": ["country", "country_code", "nation"],
    "salary": ["salary", "pay", "compensation", "wage"],
    "id": ["id", "job_id", "refcode", "jobid", "req_id", "reference"],
    "refcode": ["refcode", "id", "job_id", "jobid", "req_id", "reference"],
}


def sanitize(name: str) -> str:
    """A column name: letters, digits and _ stay, all else becomes _; lower case; never empty, never a digit first."""
    kept = "".join(c if c.isalnum() or c == "_" else "_" for c in name).lower()
    if not kept:
        return "col"
    return f"col_{kept}" if kept[0].isnumeric() else kept


def strip_namespace(name: str) -> str:
    return name.rpartition(":")[2]


@dataclass(frozen=True)
class ColumnMap:
    """Sanitized names in table order, and the original name of each.

    collision="first": of originals with one sanitized name the first counts, the others' values are dropped;
    "coalesce": the first that is not null counts.
    """

    originals: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(names: Iterable[str], collision: str = "first") -> ColumnMap:
        out: dict[str, list[str]] = {}
        for n in names:
            out.setdefault(sanitize(n), []).append(n)
        return ColumnMap({k: tuple(v if collision == "coalesce" else v[:1]) for k, v in out.items()})

    @property
    def columns(self) -> list[str]:
        return [*self.originals]

    def original(self, column: str) -> str:
        return self.originals.get(column, (column,))[0]


def resolve(target: str, columns: Sequence[str]) -> str | None:
    """The column that a name in a query means: by equality, by its last part, or by an alias; none otherwise."""
    low, clean = target.lower(), sanitize(target)
    by_low = [(c, c.lower()) for c in columns]
    for c, x in by_low:
        if x in (low, clean):
            return c
    for c, x in by_low:
        if x.endswith(("_" + clean, "." + clean)):
            return c
    for candidate in ALIASES.get(low, ()):
        for c, x in by_low:
            if x == candidate or x.endswith("_" + candidate):
                return c
    return None
