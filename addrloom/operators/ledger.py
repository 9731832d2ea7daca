"""Stewardship ledger: append-only versions, overrides as new versions, the current state as an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import first_by


def audit_id(*columns: str):
    """A repeatable id from the inputs, in place of a random one."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def ensure_recorded(ledger: DataFrame, rows: DataFrame, key: str = "audit_id") -> DataFrame:
    """The rows to append: those whose id is not in the ledger, once each."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def current(ledger: DataFrame, key: str = "audit_id", version: str = "version") -> DataFrame:
    """The newest version of each record."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def override(ledger: DataFrame, changes: DataFrame, columns: list[str], key: str = "audit_id") -> DataFrame:
    """New versions for overridden records: the changed columns, action MANUAL_OVERRIDE, status APPROVED. The old versions stay as history."""
    now = current(ledger, key)
    new = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = now.join(new, key).withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns}).withColumns({"version": F.col("version") + 1, "action_type": F.lit("MANUAL_OVERRIDE"), "review_status": F.lit("APPROVED")})
    return out.select(*ledger.columns)


def newest(ledger: DataFrame, n: int, ts: str = "ts", key: str = "audit_id") -> DataFrame:
    """A listing or what a prune keeps: the newest n rows, ties by the greater key."""
    return ledger.orderBy(F.desc(ts), F.desc(key)).limit(n)


def listing(ledger: DataFrame, review_status: str | None = None, action_type: str | None = None) -> DataFrame:
    out = ledger
    for column, value in (("review_status", review_status), ("action_type", action_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write wins by key."""
    both = table.unionByName(changes)
    return first_by(both.withColumn("_s", -F.col(seq)), [key], "_s").drop("_s")
