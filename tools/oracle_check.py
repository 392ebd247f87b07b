"""Run registered queries at one scale factor and compare them with their DuckDB oracle.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans.oracle import compare, duck_connect  # noqa: E402
from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import local_session  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    spark = local_session(8)
    con = duck_connect(args.sf)
    reg = load_all()
    bad = 0
    for name, q in sorted(reg.items()):
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, args.sf)
            if q.sql is None:
                n = df.count()
                res = {"rows_only": n}
            else:
                res = compare(df, con, q.sql)
        except Exception as e:  # noqa: BLE001
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}"}
            traceback.print_exc(limit=2)
        ok = "error" not in res and res.get("values_ok", True) and res.get("rows_ok", True)
        bad += not ok
        print(("OK  " if ok else "BAD ") + name, f"{time.time() - t0:.1f}s",
              json.dumps(res, default=str)[:600], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
