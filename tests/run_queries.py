"""``python tests/run_queries.py SF_DIR [name-part …]``: check registered queries by hand."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from trainset.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = build_session("check", 8), oracle.connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            got = oracle.spark_result(fn(spark, sf_dir))
            took = time.time() - t
            note = oracle.difference(got, oracle.duck_result(con, sqls[name])) if name in sqls else "no sql"
        except Exception as exc:  # noqa: BLE001
            took, got, note = time.time() - t, ((), ()), f"{type(exc).__name__}: {str(exc)[:1500]}"
        ok = note is None or note == "no sql"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {took:6.2f}s rows={len(got[1])} {note or ''}", flush=True)
    print("failed:", bad)
