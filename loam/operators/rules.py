"""Row constraints, append-only and transition rules, and the changes that they guard, as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def not_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def one_of(c: str, values: list[str]) -> Column:
    return F.col(c).isin(*values)


def at_least(c: str, low: float) -> Column:
    return F.col(c) >= low


def like_email(c: str) -> Column:
    return F.col(c).like("%@%.%")


def length_is(c: str, n: int) -> Column:
    return F.length(c) == n


def violations(rows: DataFrame, rules: dict[str, Column], key: str | Column) -> DataFrame:
    """rule, row_key: a row for each rule that a row breaks, in one pass; a rule that is null holds, as in CHECK."""
    key = F.col(key) if isinstance(key, str) else key
    broken = F.array(*[F.when(~F.coalesce(p, F.lit(True)), F.lit(name)) for name, p in rules.items()])
    return rows.select(F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"), key.cast("string").alias("row_key"))


def foreign_keys(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose ``column`` is set but names no parent."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def rewritten(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: rows of ``old`` that ``new`` lacks (DELETED) or holds otherwise (UPDATED); append-only tables have none."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("was"))
    b = new.select(key, F.struct(*values).alias("now"), F.lit(True).alias("there"))
    both = a.join(b, key, "left")
    change = F.when(F.col("there").isNull(), "DELETED").when(~F.col("was").eqNullSafe(F.col("now")), "UPDATED")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


# Which status may follow which.
EVENT_STATUSES = {"received": ["processing", "processed", "failed"], "processing": ["processed", "failed"], "processed": [], "failed": []}
WORKFLOW = ["draft", "review", "approved", "published"]
TERMINAL = ["processed", "failed"]


def allowed(old: Column, new: Column, table: dict[str, list[str]] = EVENT_STATUSES) -> Column:
    """Whether ``new`` may follow ``old``; the same status always may."""
    return reduce(Column.__or__, [(old == k) & new.isin(*v) for k, v in table.items() if v], old == new)


def bad_transitions(history: DataFrame, key: str, order: list[str], status: str, table: dict[str, list[str]] = EVENT_STATUSES) -> DataFrame:
    """Rows of ``history`` whose status may not follow that of the key's row before, with old_status."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    rows = history.withColumn("old_status", before)
    return rows.where(F.col("old_status").isNotNull() & ~allowed(F.col("old_status"), F.col(status), table))


def next_status(c: Column, steps: list[str] = WORKFLOW) -> Column:
    """The step after ``c``; null for the last, for flagged and unknown ones."""
    names = F.array(*[F.lit(s) for s in steps])
    return F.when(F.array_position(names, c) > 0, F.get(names, F.array_position(names, c).cast("int")))


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows rejected: keys that the table holds, and all but the first of a key, by ``order``."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    marked = ranked.join(table.select(*keys).distinct().withColumn("_held", F.lit(True)), keys, "left")
    fresh = F.col("_held").isNull() & (F.col("_rank") == 1)
    return marked.where(fresh).select(*rows.columns), marked.where(~fresh).select(*rows.columns)


def guarded_update(rows: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``values`` set where ``where`` is true, and a row with the number of rows that changed."""
    hit = F.coalesce(where, F.lit(False))
    changed = rows.where(hit).agg(F.count("*").alias("changed"))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), changed


def merge(table: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key, new ones added.

    updated_at, if it was left as it was, becomes ``now``; processed_at, if null, becomes ``now`` with a terminal status.
    """
    columns = table.columns
    a, b = table.select(F.struct(*columns).alias("old"), F.col(key).alias("_key")), changes.select(F.struct(*columns).alias("new"), F.col(key).alias("_key"))
    rows = a.join(b, "_key", "full_outer")
    out = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in columns}
    replaced = F.col("old").isNotNull() & F.col("new").isNotNull()
    if "updated_at" in columns:
        out["updated_at"] = F.when(replaced & F.col("new.updated_at").eqNullSafe(F.col("old.updated_at")), now).otherwise(out["updated_at"])
    if {"processed_at", "status"} <= set(columns):
        late = F.col("new.status").isin(*TERMINAL) & F.col("new.processed_at").isNull()
        out["processed_at"] = F.when(late, now).otherwise(out["processed_at"])
    return rows.select(*[v.alias(c) for c, v in out.items()])


def cascade(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def session_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, rule: sessions whose fixed columns changed, or whose revocation was taken back or moved."""
    fixed = ["user_id", "refresh_token_hash", "created_at", "expires_at"]
    a, b = (df.select("id", F.struct(*fixed, "revoked_at").alias(n)) for df, n in ((old, "was"), (new, "now")))
    rules = [F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(f"{c} is immutable")) for c in fixed]
    rules.append(F.when(F.col("was.revoked_at").isNotNull() & ~F.col("was.revoked_at").eqNullSafe(F.col("now.revoked_at")), F.lit("revoked_at is final")))
    return a.join(b, "id").select("id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
