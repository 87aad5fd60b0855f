"""Run all (or the named) queries against their SQL twins: a developer tool."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from framelark.session import local_session  # noqa: E402

if __name__ == "__main__":
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = oracle.compare(spark, name, queries[name], sql[name])
            else:
                n = len(queries[name](spark, oracle.DATA).collect())
                problem = "" if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
