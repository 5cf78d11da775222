"""Free-form metadata maps: merge (later wins), lookup with default, sorted JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_last_wins(*maps: Column) -> Column:
    """Merge maps left to right; a key present in a later map replaces the
    earlier value (no session-wide dedup policy needed)."""
    out = maps[0]
    for m in maps[1:]:
        kept = F.map_filter(out, lambda k, v: ~F.array_contains(F.map_keys(m), k))
        out = F.map_concat(kept, m)
    return out


def lookup(m: Column, key: str, default=None) -> Column:
    """``m.get(key, default)``: missing keys give the default, never an error."""
    v = F.try_element_at(m, F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def json_sorted(m: Column) -> Column:
    """JSON object text with keys in sorted order (stable hashing input)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
