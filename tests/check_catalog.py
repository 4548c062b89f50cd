"""Run registered queries against their SQL texts and print differences.

    python tests/check_catalog.py [folder] [name prefix ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in order, dates as text, missing as None."""
    out = pd.DataFrame(index=range(len(df)))
    for c in sorted(df.columns):
        col = df[c].reset_index(drop=True)
        if str(col.dtype).startswith("datetime"):
            col = col.dt.strftime("%Y-%m-%d %H:%M:%S").str.removesuffix(" 00:00:00")
        elif col.dtype == object:
            col = col.map(lambda v: None if v is None or v is pd.NaT else str(v))
        out[c] = col
    if len(out.columns) and len(out):
        out = out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)
    return out


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        kinds = a[c].dtype.kind, b[c].dtype.kind
        nullable_int = a[c].isna().any() and set(kinds) == {"f", "i"}
        if len(a) and kinds[0] != kinds[1] and "O" not in kinds and not nullable_int:
            return f"column {c}: {a[c].dtype} / {b[c].dtype}"
        x, y = a[c], b[c]
        same = (x == y).fillna(False).astype(bool) | (x.isna() & y.isna())
        if not bool(np.all(same)):
            bad = np.flatnonzero(~same.to_numpy())
            return (f"column {c}: {len(bad)} values differ, first "
                    f"{a.iloc[bad[0]].to_dict()} / {b.iloc[bad[0]].to_dict()}")
    return None


def compare(spark, con, name: str, folder: str) -> str | None:
    found = entry.queries()[name](spark, folder).toPandas()
    sql = entry.oracle_sql().get(name)
    return None if sql is None else difference(found, con.execute(sql).df())


def main() -> None:
    from newslab.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            found = compare(spark, con, name, folder)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {time.time() - start:5.1f}s {name} {found or ''}",
              flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
