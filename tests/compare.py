"""Run queries and their SQL side by side: python tests/compare.py [FOLDER] [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings images annotations annotation_history split_members task_definitions messages indicators data_sources sampling_targets source_weights".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, folder, query, sql) -> list[str]:
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    out = []
    if sorted(df.columns) != sorted(columns):
        out.append(f"columns {sorted(df.columns)} and {sorted(columns)}")
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows and {len(theirs)}")
    out += [f"{a} and {b}" for a, b in zip(ours, theirs) if a != b][:3]
    return out


def main(folder: str, *names: str) -> int:
    import __spark_entry__ as entry

    from quillspark.session import local_session

    spark, con, sql, bad = local_session(8), connect(folder), entry.oracle_sql(), 0
    queries = entry.queries()
    for name in names or queries:
        began = time.time()
        try:
            if name in sql:
                wrong = differences(spark, con, folder, queries[name], sql[name])
            else:
                wrong = []
                queries[name](spark, folder).count()
        except Exception as error:
            wrong = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(wrong)
        print(f"{'BAD ' if wrong else 'ok  '} {name} {time.time() - began:.1f}s{'' if name in sql else ' (rows only)'}", *wrong, sep="\n      " if wrong else "", flush=True)
    print(f"{bad} differ of {len(names or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(*(sys.argv[1:] or ["/root/testdata/sf0.01"])))
