"""Check queries by hand: python tests/run_checks.py [sf] [hotRows] [name ...]."""

import sys
import time

sys.path[:0] = [".", "tests"]
import oracle

from buildlens.plans.catalogue import ORACLES, QUERIES
from buildlens.session import local_session

sf, hot, *names = sys.argv[1:] or ["0.01", "0"]
spark = local_session(8)
if int(hot):
    spark.conf.set("buildlens.hotRows", hot)
folder = f"/root/testdata/sf{sf}"
con = oracle.connect(folder)
failed = []
for name in names or QUERIES:
    start = time.time()
    try:
        got = oracle.rows_of_spark(QUERIES[name](spark, folder))
        took = time.time() - start
        verdict = f"rows only {len(got[1])}"
        if name in ORACLES:
            bad = oracle.difference(got, oracle.rows_of_duckdb(con, ORACLES[name]))
            verdict = f"ok {len(got[1])}" if bad is None else f"DIFF {bad[:900]}"
    except Exception as error:
        took, verdict = time.time() - start, f"ERROR {str(error)[:1200]}"
    if verdict.startswith(("DIFF", "ERROR")):
        failed.append(name)
    print(f"{took:6.2f}s {name}: {verdict}", flush=True)
print("failed:", failed)
