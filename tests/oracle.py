"""Runs a registered query in Spark and its SQL in DuckDB and compares all rows.

As a script: ``python -m tests.oracle 0.01 [name prefix ...]``.
"""
from __future__ import annotations

import math
import sys
import time
import warnings

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sf_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir(sf)}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _family(t: str) -> str:
    t = t.upper()
    if any(k in t for k in ("BIGINT", "INT", "LONG", "SHORT", "BYTE")) and "HUGE" not in t:
        return "whole"
    if "DOUBLE" in t or "FLOAT" in t:
        return "float"
    if "VARCHAR" in t or "STRING" in t:
        return "text"
    return t


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and all rows agree."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    theirs = res.fetchall()
    ours = [tuple(r) for r in df.collect()]
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    for f in df.schema.fields:
        a, b = _family(f.dataType.simpleString()), _family(kinds[f.name])
        if a != b and not ({a, b} <= {"whole", "NUMBER"} or {a, b} <= {"float", "NUMBER"} or {a, b} <= {"text", "STRING"}):
            out.append(f"type of {f.name}: {f.dataType.simpleString()} / {kinds[f.name]}")
    pick = lambda rows, cols: sorted((tuple(_cell(r[cols.index(c)]) for c in order) for r in rows),
                                     key=lambda r: tuple((v is None, str(v)) for v in r))
    a, b = pick(ours, df.columns), pick(theirs, names)
    if len(a) != len(b):
        out.append(f"rows {len(a)} / {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ in {order}, e.g. {bad[0][0]} / {bad[0][1]}")
    return out


def main():
    warnings.filterwarnings("ignore")
    sys.path.insert(0, "/root/repo")
    from ballast.plans import catalog
    from ballast.session import local_session

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf)
    bad = 0
    for name, fn in catalog.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir(sf))
            if name in catalog.oracle_sql():
                t0 = time.time()
                diff = differences(df, con, catalog.oracle_sql()[name])
                note = "ok" if not diff else "DIFF " + "; ".join(diff)
            else:
                note = f"rows {len(df.collect())} (no sql)"
        except Exception as e:  # report and go on to the next query
            note = f"FAIL {type(e).__name__}: {str(e)[:1500]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:36s} {time.time() - t:6.1f}s  {note}", flush=True)
    print("bad:", bad, flush=True)


if __name__ == "__main__":
    main()
