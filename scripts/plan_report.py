"""Write PLANS.md: the physical plan shape of every registered query.

Usage: python scripts/plan_report.py [sf_dir]
For each query: shuffle exchanges, broadcasts, scans, windows, Python stages, the read
schemas and pushed filters of its scans (from ``explain("formatted")``).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from lakestone.session import get_spark
    from lakestone.plans.driver_queries import QUERIES
    spark = get_spark("local[8]", shuffle_partitions=8,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# PLANS - physical plan shape of every registered query",
           "",
           f"Generated by `scripts/plan_report.py` on `{sf_dir}` (static plans before AQE re-planning;",
           "at run time AQE may turn a sort-merge join into a broadcast from measured sizes and",
           "reuses identical exchanges). `shuffles` counts hash/range/round-robin exchanges,",
           "`bcast` broadcast exchanges. Every broadcast is either of bounded size (one-row",
           "baselines, per-column counts, offsets) or chosen by Spark from size statistics.",
           "",
           "| query | shuffles | bcast | scans | window | python | scan columns (pushed filters) |",
           "|---|---|---|---|---|---|---|"]
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        shuffles = len(re.findall(r"\bExchange \(", tree)) - len(re.findall(r"BroadcastExchange \(", tree))
        bcast = len(re.findall(r"BroadcastExchange \(", tree))
        scans = len(re.findall(r"Scan (parquet|csv|json|binaryFile|text|ExistingRDD|OneRowRelation)|LocalTableScan|Range \(", tree))
        window = "yes" if "Window" in tree else ""
        python = "yes" if re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", tree) else ""
        reads = []
        blocks = text.split("\n\n")
        for b in blocks:
            if "ReadSchema" in b:
                schema = re.search(r"ReadSchema: struct<(.*)>", b)
                cols = [c.split(":")[0] for c in re.split(r",(?![^<]*>)", schema.group(1))] if schema else []
                pushed = re.search(r"PushedFilters: \[(.*)\]", b)
                p = pushed.group(1) if pushed and pushed.group(1) else ""
                reads.append(f"{len(cols)} cols" + (f" ({p[:80]})" if p else ""))
        reads = sorted(set(reads))
        out.append(f"| `{name}` | {shuffles} | {bcast} | {scans} | {window} | {python} | {'; '.join(reads)} |")
    out += ["", "## Notes", "",
            "- Rule and report queries: one partial aggregate for the duplicate keys, the repeated-key set",
            "  joined back (broadcast when small), one global partial aggregate for all rule counts.",
            "- Silver queries: the negated rule predicates are pushed into the Parquet scan (see pushed",
            "  filters) below the duplicate join; the duplicate count still reads every row.",
            "- Generators and injection: pure projections over the index; exact samples are found by",
            "  bounded histogram rounds (separate small jobs, not shown here), ranks by bucketed windows.",
            "- Windows appear only over bounded inputs: ranks inside one hash bucket, per-sample boundary",
            "  rows.",
            "- Scalars (baselines, bounds, maxima, document values) are scalar subqueries, planned as",
            "  separate one-row subquery stages and not counted in the columns above; no query cross-joins.",
            "- No query runs Python per row; the only Python stage is the optional `map_records` hook.",
            "- `tests/test_plan_guards.py` keeps these properties: no cartesian or nested-loop joins, no",
            "  Python evaluation, pruned scans, silver filters pushed into the scan."]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
