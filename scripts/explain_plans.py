"""Write PLANS.md: the final (adaptive) physical plan of every registered question.

    python scripts/explain_plans.py [sf_dir]

Each question is executed once (its own query execution) so the adaptive plan is final;
long expressions are cut so the operator tree stays readable.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from ledgerlens.plans.registry import QUERIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402


def compact(line: str, width: int = 150) -> str:
    line = re.sub(r"\[[^\[\]]{60,}\]", "[...]", line)
    line = re.sub(r"\(([^()]{60,})\)", "(...)", line)
    return line if len(line) <= width else line[: width - 3] + "..."


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = [
        "# Physical plans",
        "",
        f"Final adaptive plans of every registered question on `{sf_dir}` (`local[8]`), written by",
        "`scripts/explain_plans.py`. `*(n)` marks whole-stage-codegen stages; long expressions are cut.",
        "Questions that check a broadcast bound or share an intermediate run those small jobs",
        "first; only the question's own final plan is shown.",
        "",
    ]
    for name, query in QUERIES.items():
        df = query(spark, sf_dir)
        df.collect()  # results are small; finalises this query's adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        cut = [i for i, x in enumerate(lines) if "== Initial Plan ==" in x]
        lines = lines[: cut[0]] if cut else lines
        out += [f"## {name}", "", "```"] + [compact(x) for x in lines] + ["```", ""]
    spark.stop()
    (ROOT / "PLANS.md").write_text("\n".join(out))


if __name__ == "__main__":
    main()
