"""Run queries of the subpackage against their SQL: python -m tests.llm.run sf name ..."""

import sys
import time

from tabforge.llm import ORACLES, QUERIES
from tabforge.session import local_session
from tests.oracle import connect, differences

if __name__ == "__main__":
    sf, *names = sys.argv[1:]
    spark, con = local_session(8), connect(f"/root/testdata/sf{sf}")
    for name in names or QUERIES:
        began = time.time()
        df = QUERIES[name](spark, f"/root/testdata/sf{sf}")
        if name in ORACLES:
            print(name, differences(df, con, ORACLES[name]) or "ok", end=" ")
        else:
            print(name, df.count(), "rows", end=" ")
        print(round(time.time() - began, 1), "s", flush=True)
