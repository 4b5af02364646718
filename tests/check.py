"""python tests/check.py [pattern] [sf]: compare registered queries with their twins."""

import sys
import time

sys.path.insert(0, ".")
from tests import oracle  # noqa: E402
from vintagekit.plans import load_all  # noqa: E402
from vintagekit.session import get_session  # noqa: E402

pattern = sys.argv[1] if len(sys.argv) > 1 else ""
sf = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
spark = get_session("check", 8)
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(sf)
bad = 0
for name, q in load_all().items():
    if not any(name.startswith(p) for p in pattern.split(",")):
        continue
    t0 = time.time()
    try:
        df = q.run(spark, sf)
        t1 = time.time()
        if q.sql:
            said = oracle.compare(df, con, q.sql)
            kinds = oracle.type_differences(df, con, q.sql)
            if kinds:
                print("TYPE", name, kinds, flush=True)
            n = f"build {t1 - t0:.2f} duckdb {oracle.TIMES['duckdb']:.2f}"
        else:
            n = f"rows={len(df.collect())} (no twin)"
            said = None
    except Exception as e:  # noqa: BLE001
        said = f"{type(e).__name__}: {str(e)[:1500]}"
        n = ""
    bad += said is not None
    print(f"{'ok ' if said is None else 'BAD'} {name} {time.time() - t0:.2f}s {n} {said or ''}",
          flush=True)
print("bad:", bad)
