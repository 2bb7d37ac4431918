"""Own baseline of the headline queries: python tests/baseline.py [FOLDER] > table. Spark's warm time, rows, shuffle and spill,
and DuckDB's time for the same rows where there is SQL."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(folder: str = "/root/testdata/sf0.1", cores: str = "8") -> None:
    import __spark_entry__ as entry
    from bench import HEADLINE
    from quillspark.session import local_session
    from tests.compare import connect

    spark, con, queries, sql = local_session(cores, int(cores)), connect(folder), entry.queries(), entry.oracle_sql()
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved() -> tuple[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        out = [0, 0]
        for k in range(stages.size()):
            s = stages.apply(k)
            out = [out[0] + s.shuffleWriteBytes(), out[1] + s.diskBytesSpilled()]
        return out[0], out[1]

    print("| query | Spark s | rows | shuffle MB | spill MB | DuckDB s |\n|-|-|-|-|-|-|")
    for name in [q for q in HEADLINE if q in queries]:
        rows = queries[name](spark, folder).count()
        before, began = moved(), time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took, after = time.perf_counter() - began, moved()
        duck = ""
        if name in sql:
            began = time.perf_counter()
            con.execute(sql[name]).fetchall()
            duck = f"{time.perf_counter() - began:.2f}"
        print(f"| {name} | {took:.2f} | {rows:,} | {(after[0] - before[0]) / 1e6:.1f} | {(after[1] - before[1]) / 1e6:.1f} | {duck} |", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
