"""Print the physical plan of the feature frame over the production read path.

Usage: python tools/show_plan.py [sf_dir] [days]

Writes the three yearly extracts of ``sf_dir`` as Parquet folders in a fresh
scratch folder, reads them back through ``read_ledger`` and prints the
formatted plan tree of ``feature_frame`` for ``days`` backtest days, followed
by every scan's pushed filters and read schema.
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnscope.operators import asof as A  # noqa: E402
from churnscope.operators import features as FE  # noqa: E402
from churnscope.session import fresh_path, get_session  # noqa: E402
from churnscope.sources import fixtures as X  # noqa: E402
from churnscope.sources import read_ledger  # noqa: E402


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    days = int(argv[2]) if len(argv) > 2 else 4
    spark = get_session("local[8]", 8)
    base = fresh_path(spark, "plan-inputs")
    paths = []
    for i, raw in enumerate(X.raw_extracts(spark, sf)):
        p = f"{base}/extract{i}"
        raw.write.mode("overwrite").parquet(p)
        paths.append(p)
    reg_path = f"{base}/register"
    X.register(spark, sf).write.mode("overwrite").parquet(reg_path)
    led = read_ledger(spark, paths, X.HANDOVER)
    reg = spark.read.parquet(reg_path)
    df = FE.feature_frame(led, reg, A.backtest_days(spark, X.TRAINING_END, periods=days + 1))
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue().replace(base, "<scratch>")
    tree, _, details = text.partition("\n\n\n")
    print(tree.strip())
    print()
    for line in details.splitlines():
        if line.startswith(("(", "PushedFilters", "ReadSchema")) and ("Scan" in line or not line.startswith("(")):
            print(line)


if __name__ == "__main__":
    main(sys.argv)
