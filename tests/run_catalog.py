"""Run registered queries against their SQL and print one line each.

    python tests/run_catalog.py [folder] [name ...]
"""

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, spark_rows, sql_rows  # noqa: E402
from conftest import DATA  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from feedback_signals.session import build_session  # noqa: E402


def main(folder, names):
    spark = build_session("catalog", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-"), "spark.driver.bindAddress": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            t = time.time()
            got = spark_rows(fn(spark, folder))
            spent = time.time() - t
            state = "rows only"
            if name in sqls:
                t = time.time()
                want = sql_rows(con, sqls[name])
                sql_time = time.time() - t
                state = "ok" if got == want else "DIFFERENT"
                if state != "ok":
                    bad.append(name)
                    print("   spark", got[0], len(got[1]), [r for r in got[1] if r not in set(want[1])][:3])
                    print("   sql  ", want[0], len(want[1]), [r for r in want[1] if r not in set(got[1])][:3])
                state += f"  sql {sql_time:.2f}s"
            print(f"{name:30s} {len(got[1]):7d} rows {spent:6.2f}s  {state}", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"{name:30s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else DATA, sys.argv[2:])
