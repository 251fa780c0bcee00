"""Run registered queries against their SQL twins: python tests/check.py [sf dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.plans import registry  # noqa: E402
from corpusflow.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name, query in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in registry.SQL:
                ok, message = compare(spark, con, sf, query, registry.SQL[name])
            else:
                ok, message = True, f"{query(spark, sf).count()} rows (no twin)"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", message, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
