"""Run registered queries and save their final (adaptive) physical plans.

    python tools/show_plans.py [SF_DIR] [query ...]

Writes ``docs/plans/<query>.txt`` with ``explain("formatted")`` taken after
the query ran, so adaptive re-planning (coalesced partitions, joins turned
into broadcasts at run time) is visible.
"""

from __future__ import annotations

import contextlib
import io
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from churnlab.plans.catalog import QUERIES  # noqa: E402
from churnlab.session import local_session  # noqa: E402

DEFAULT = ["jn4_user_matrix", "jn1_enriched_events", "win4_filled_running_listens", "agg7_session_totals", "agg2_listens_by_state"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    spark = local_session(8, 8)
    out = ROOT / "docs" / "plans"
    out.mkdir(parents=True, exist_ok=True)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        (out / f"{name}.txt").write_text(f"-- {name} on {sf_dir}, local[8], 8 shuffle partitions\n" + buf.getvalue())
        print(name, len(buf.getvalue()))


if __name__ == "__main__":
    main()
