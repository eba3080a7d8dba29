"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(row[i] for i in order))
    return sorted(out, key=_key)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, types of values and all values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = _canonical(result.fetchall(), names)
    got = _canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    found = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    for a, b in zip(got, want):
        same = all(
            type(x) is type(y) and (x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y)))
            for x, y in zip(a, b)
        )
        if not same:
            found.append(f"{a} != {b}")
            break
    return found
