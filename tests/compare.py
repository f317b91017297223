"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def same_rows(df, sql, connection, sf):
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    wanted = connection.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    right = sorted(str([plain(r[names.index(c)]) for c in order]) for r in wanted.fetchall())
    left = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    assert left == right
