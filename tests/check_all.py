"""Run every registered query against its SQL: python tests/check_all.py [folder] [key...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from sellerlens.catalog import registry  # noqa: E402
from sellerlens.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    failed = 0
    for key, e in registry().entries.items():
        if keys and key not in keys:
            continue
        began = time.time()
        try:
            df = e.run(spark, folder)
            notes = differences(df, con, e.sql) if e.sql else [f"no SQL, {df.count()} rows"]
            n = df.count() if not notes else "-"
        except Exception as exc:  # report and go on with the next query
            notes, n = [f"{type(exc).__name__}: {str(exc)[:600]}"], "-"
        failed += bool(notes) and e.sql is not None
        print(f"{'OK ' if not notes else 'BAD'} {key} rows={n} {time.time() - began:.2f}s", *notes, flush=True)
    print(f"{failed} failed of {len(registry().entries)}")
