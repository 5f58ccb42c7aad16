"""Change feeds: what turns one state of a keyed table into the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(keys: Sequence[str]):
    return F.expr(" AND ".join(f"o.`{k}` <=> n.`{k}`" for k in keys))


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key that differs: ``op`` is insert, update or delete, the other columns are the new row's.

    Both states hold a key once. Keys and values are compared with NULL equal
    to NULL; values of a deleted key are NULL. Equal rows leave the plan right
    after the join, which is on the full key, so no key can be hot.
    """
    rest = [c for c in new.columns if c not in keys]
    if set(old.columns) != set(new.columns):
        raise ValueError("both states need the same columns")
    whole = F.struct(*rest) if rest else F.struct(F.lit(0))
    before = old.select(*keys, whole.alias("before")).alias("o")
    after = new.select(*keys, whole.alias("after")).alias("n")
    both = before.join(after, _same(keys), "full_outer").filter("NOT (before <=> after)")
    op = "CASE WHEN before IS NULL THEN 'insert' WHEN after IS NULL THEN 'delete' ELSE 'update' END AS op"
    # a missing side has no struct, so the key is taken from the side that is there
    named = [F.expr(f"CASE WHEN after IS NULL THEN o.`{k}` ELSE n.`{k}` END").alias(k) for k in keys]
    return both.select(F.expr(op), *named, *[F.col(f"after.`{c}`").alias(c) for c in rest])


def apply_changes(state: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state with a feed applied. Applying it again changes nothing."""
    kept = state.alias("o").join(feed.select(*keys).alias("n"), _same(keys), "left_anti")
    return kept.select(*state.columns).unionByName(feed.filter("op <> 'delete'").select(*state.columns))
