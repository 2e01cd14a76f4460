"""Physical-plan summary of every SQL-checked registered query: shuffles,
join strategies, windows and Python operators (markdown table on stdout)."""

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortkit.plans import registry  # noqa: E402
from cohortkit.plans import model_queries  # noqa: E402,F401
from cohortkit.session import local_session  # noqa: E402

NODES = {
    "Exchange": r"\bExchange\b",
    "BroadcastExchange": r"BroadcastExchange",
    "BroadcastHashJoin": r"BroadcastHashJoin",
    "SortMergeJoin": r"SortMergeJoin",
    "ShuffledHashJoin": r"ShuffledHashJoin",
    "Window": r"\bWindow \(",
    "WindowGroupLimit": r"WindowGroupLimit",
    "HashAggregate": r"HashAggregate",
    "Python": r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    print("| query | " + " | ".join(NODES) + " | scans with pushed filters |")
    print("|---|" + "---|" * (len(NODES) + 1))
    for q in registry.REGISTRY:
        if q.sql is None:
            continue
        df = q.build(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        counts = [len(re.findall(p, tree)) for p in NODES.values()]
        pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", text))
        print(f"| {q.name} | " + " | ".join(str(c) for c in counts) + f" | {pushed} |", flush=True)


if __name__ == "__main__":
    main()
