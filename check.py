"""Compare registered queries with their SQL: check.py [--sf 0.01] [names or prefixes ...]"""

from __future__ import annotations

import sys
import time

import catalog
from cytoframe.session import build_session
from tests.compare import compare, connect


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    failed = 0
    for name, run in catalog.QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in catalog.SQL:
                bad = compare(df, connect(sf_dir), catalog.SQL[name])
            else:
                n = df.count()
                bad = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            bad = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bad is not None
        mark = "ok " if bad is None else "BAD"
        kind = "" if name in catalog.SQL else " (rows only)"
        print(f"{mark} {time.time() - start:6.1f}s {name}{kind} {bad or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
