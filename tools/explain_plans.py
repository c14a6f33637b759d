"""Write ``explain("formatted")`` of the headline queries to docs/plans/.

Usage: python tools/explain_plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from bench import HEADLINE
    from ticketflow.plans.queries import REGISTRY
    from ticketflow.session import local_session

    spark = local_session(8)
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name in a.names or HEADLINE:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            REGISTRY[name](spark, a.sf).explain("formatted")
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(buf.getvalue())
        print(name, len(buf.getvalue()))


if __name__ == "__main__":
    main()
