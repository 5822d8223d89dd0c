"""Runs queries on Spark and their SQL on DuckDB over the same tables, and compares rows and values."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return v


def compare(spark, name, query, sql, sf_dir) -> str:
    """Empty if equal, else what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    a, b = mine - theirs, theirs - mine
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark {sum(a.values())}: {list(a)[:2]}; only SQL {sum(b.values())}: {list(b)[:2]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from profilespark.session import local_session

    sf = sys.argv[1]
    spark = local_session()
    q, o = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or list(q):
        t = time.time()
        try:
            said = compare(spark, n, q[n], o[n], sf) if n in o else f"no SQL, {q[n](spark, sf).count()} rows"
        except Exception as ex:  # noqa: BLE001
            said = "ERROR " + str(ex)[:600]
        print(f"{n} {time.time() - t:.1f}s {said or 'ok'}", flush=True)
