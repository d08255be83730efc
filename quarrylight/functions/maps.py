"""Maps and times as the records use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def updated(base: Column, new: Column) -> Column:
    """A map with the entries of another over its own."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def sorted_entries(held: Column) -> Column:
    """A map's entries in order of their keys: equal maps give equal arrays."""
    return F.array_sort(F.map_entries(held))


def run_id(at: Column, name: Column | None = None) -> Column:
    """The default id of a run: its time in UTC, with a name's slug behind it if there is one."""
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return stamp if name is None else F.concat_ws("-", stamp, name)


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
