"""python tests/check.py [sf] [name ...]: compare queries with their SQL and print times."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402
from session import session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(d)
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or qs:
        t = time.time()
        try:
            df = qs[name](spark, d)
            if name in sql:
                ok, msg, n = compare(df, con, sql[name])
            else:
                n = df.count()
                ok, msg = True, "no SQL"
        except Exception as e:  # noqa: BLE001
            ok, msg, n = False, f"{type(e).__name__}: {str(e)[:900]}", -1
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {n:7d} {msg[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
