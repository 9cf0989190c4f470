"""Run registered queries and their SQL side by side: python -m tests.compare [folder] [name …]."""

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order))
    return sorted(out)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, folder, name, fn, sql):
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None, ""
    cur = connect(folder).execute(sql)
    columns = [d[0] for d in cur.description]
    want = canon(cur.fetchall(), columns)
    got = canon(rows, df.columns)
    if sorted(columns) != sorted(df.columns):
        return len(rows), False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return len(rows), False, f"{len(got)} rows / {len(want)}: {odd}"
    return len(rows), True, ""


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from fairlineage.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    oracle = E.oracle_sql()
    assert not set(oracle) - set(E.queries()), set(oracle) - set(E.queries())
    bad = []
    for name, fn in E.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            n, ok, why = compare(spark, folder, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            n, ok, why = 0, False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {name} rows={n} {time.time() - t:.1f}s {why}", flush=True)
        if ok is False:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
