"""Run every registered query in Spark and its oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [--no-broadcast] [data_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tally.sources.parquet import TABLES  # noqa: E402


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data_dir}/{t}.parquet"
        if os.path.isdir(path):  # written by Spark: a folder of part files
            path = f"{path}/*.parquet"
        if os.path.exists(path.replace("/*.parquet", "")):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return v
    return v


# Spark type name -> the DuckDB type it corresponds to.
TYPE_PAIRS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, build, sql, data_dir):
    t0 = time.time()
    df = build(spark, data_dir)
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    res = con.execute(sql)
    d_names = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    d_rows = res.fetchall()
    problems = []
    if sorted(s_names) != sorted(d_names):
        problems.append(f"columns spark={s_names} duck={d_names}")
    else:
        bad_types = {c: (s_types[c], d_types[c]) for c in s_names
                     if TYPE_PAIRS.get(s_types[c], s_types[c].upper()) != d_types[c]}
        if bad_types:
            problems.append(f"types spark/duck {bad_types}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_rows, s_names), rows_of(d_rows, d_names)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"{len(diff)} differing rows, e.g. spark={diff[0][0]} duck={diff[0][1]}")
    return problems, t_spark


def main(argv):
    shuffle_only = "--no-broadcast" in argv
    argv = [a for a in argv if a != "--no-broadcast"]
    data_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    import __spark_entry__ as entry
    from tally.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    if shuffle_only:  # the plan shapes a cluster gets when no dimension fits a broadcast
        spark.conf.set("tally.broadcast.maxBytes", "0")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duck(data_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or list(q):
        if name not in o:
            print(f"{name:28s} NO ORACLE")
            continue
        try:
            problems, t = compare(spark, con, name, q[name], o[name], data_dir)
        except Exception as e:  # report and continue
            problems, t = [f"error {type(e).__name__}: {str(e)[:400]}"], 0.0
        bad += bool(problems)
        print(f"{name:28s} {'OK ' if not problems else 'BAD'} {t:6.2f}s {'; '.join(problems)}")
    print(f"{len(wanted or q) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
