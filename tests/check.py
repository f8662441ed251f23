"""Run registered queries against their SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabforge.catalog import ORACLES, QUERIES  # noqa: E402
from tabforge.session import local_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems = differences(df, con, ORACLES[name])
            else:
                rows = df.count()
                problems = [] if rows else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in ORACLES else "rows")
        print(f"{mark:5}{name:32}{time.time() - start:7.2f}s", *problems, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
