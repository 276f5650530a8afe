"""Run registered queries and their SQL twins side by side."""

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df = df.assign(**{c: df[c].astype("float64")})
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(spark_df, duck_df):
    """First difference as text, or None."""
    a, b = canonical(spark_df), canonical(duck_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x.isna() & y.isna()) | (x == y)
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{int((~same).sum())} of {len(a)} differ in {c}; {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return None


def main(sf_dir, names):
    sys.path.insert(0, ".")
    from spectralake.session import build_session
    from workload.queries import QUERIES
    from workload.sql import SQL

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names or QUERIES:
        t = time.time()
        try:
            got = QUERIES[name](spark, sf_dir)
            types = dict(got.dtypes)
            got = got.toPandas()
            took = time.time() - t
            if name not in SQL:
                print(f"rows  {name:22s} {len(got):8d} {took:6.1f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(SQL[name]).df()
            why = difference(got, want)
            kinds = {c: str(k) for c, k in zip(con.description and [x[0] for x in con.description], [x[1] for x in con.description])}
            print(f"{'ok   ' if why is None else 'DIFF '} {name:22s} {len(got):8d} {took:6.1f}s sql {time.time() - t:5.1f}s {why or ''}", flush=True)
            pair = {c: (types.get(c), kinds.get(c)) for c in types}
            odd = {c: p for c, p in pair.items() if p[1] in ("HUGEINT",) or (p[0] == "int" and p[1] == "BIGINT") or (p[0] == "bigint" and p[1] == "INTEGER")}
            if odd:
                print("      types", odd, flush=True)
            if why:
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
