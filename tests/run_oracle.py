"""Dev loop: python tests/run_oracle.py [sf_dir] [name ...]"""
import sys
import time

sys.path.insert(0, ".")
from tessera.session import get_session  # noqa: E402
from tests.oracle_harness import compare, duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_session("local[8]", shuffle_partitions=8)
con = duck(sf)
qs, orc = E.queries(), E.oracle_sql()
bad = 0
for name in names or qs:
    t = time.time()
    if name not in orc:
        try:
            n = qs[name](spark, sf).count()
            print(f"{name:28s} rows-only {n:8d}  {time.time()-t:5.1f}s")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {str(e)[:300]}")
        continue
    try:
        n, problems = compare(spark, con, qs[name], orc[name], sf)
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:28s} {status} {n:8d}  {time.time()-t:5.1f}s {'; '.join(problems)[:600]}")
    except Exception as e:  # noqa: BLE001
        bad += 1
        print(f"{name:28s} ERROR {str(e)[:600]}")
print("failures:", bad)
