"""The schema lattice and the common schema of a set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SCHEMA, PARENTS


def ancestors(schema: str) -> list[str]:
    out = [schema]
    while out[-1] in PARENTS:
        out.append(PARENTS[out[-1]])
    return out


def common(schemata: list[str]) -> str:
    """One schema is its own. Else neighbours of the sorted list are reduced to the narrower of each comparable pair, the others dropped, until one is left; or none, which gives the default."""
    found = sorted(set(schemata))
    while len(found) > 1:
        narrower = set()
        for a, b in zip(found, found[1:], strict=False):
            if b in ancestors(a):
                narrower.add(a)
            elif a in ancestors(b):
                narrower.add(b)
        found = sorted(narrower)
    return found[0] if len(found) == 1 else DEFAULT_SCHEMA


def common_schema(schemata: Column) -> Column:
    """The same for an array column. Each round of the fold shortens the list by one at least, so as many as there are schemata suffice."""
    known = sorted({*PARENTS, *PARENTS.values()})
    above = F.create_map(*[x for s in known for x in (F.lit(s), F.array(*[F.lit(a) for a in ancestors(s)]))])
    up = lambda s: F.coalesce(above[s], F.array(s))

    def shrink(found: Column) -> Column:
        pairs = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(F.array_contains(up(a), b), a).when(F.array_contains(up(b), a), b))
        return F.when(F.size(found) > 1, F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))).otherwise(found)

    first = F.array_sort(F.array_distinct(F.filter(F.coalesce(schemata, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), first, lambda acc, _: shrink(acc))
    return F.when(F.size(last) == 1, last[0]).otherwise(F.lit(DEFAULT_SCHEMA))
