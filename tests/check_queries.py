"""python tests/check_queries.py [sf] [names...]: time every query and compare it with its oracle."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import __spark_entry__ as entry  # noqa: E402
from spoor.session import local_session  # noqa: E402
from tests import harness  # noqa: E402

sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
names = sys.argv[2:] or list(entry.queries())
spark, con, oracle, bad = local_session(8), harness.connect(sf), entry.oracle_sql(), []
for name in names:
    start = time.time()
    try:
        df = entry.queries()[name](spark, sf)
        columns, got = harness.spark_rows(df)
        took = time.time() - start
        if name not in oracle:
            print(f"  --  {name}: {len(got)} rows, no oracle, {took:.2f}s")
            continue
        wanted_columns, wanted = harness.duck_rows(con, oracle[name])
        same = columns == wanted_columns and got == wanted
        print(f"{'  ok ' if same else ' BAD '} {name}: {len(got)} rows, {took:.2f}s")
        if not same:
            bad.append(name)
            print("     columns", columns, "" if columns == wanted_columns else wanted_columns, "rows", len(got), len(wanted))
            extra, lacking = [r for r in got if r not in set(wanted)][:4], [r for r in wanted if r not in set(got)][:4]
            print("     only spark:", extra, "\n     only oracle:", lacking)
            print("     types", df.dtypes)
    except Exception:
        bad.append(name)
        print(f" ERR  {name}")
        print("".join(traceback.format_exc().splitlines(True)[-12:])[:3000])
print("failed:", bad)
