"""Write the final (AQE) physical plan tree of every registered query to
docs/PLANS.md. Usage: python tools/dump_plans.py [sf_dir]"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def main() -> None:
    from workboard.registry import BUILDERS
    from workboard.session import build_session
    from workboard.sources.fixtures import Domain, StoredDomain, materialize

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    scratch = tempfile.mkdtemp(prefix="wb-plans-")
    spark = build_session("local[8]", shuffle_partitions=16,
                          checkpoint_fallback=os.path.join(scratch, "ckpt"))
    root = os.path.join(scratch, "domain")
    materialize(Domain(spark, sf_dir), root)
    d = StoredDomain(spark, sf_dir, root)
    out = ["# Final physical plans", "",
           f"Generated by `tools/dump_plans.py` over stored domain tables from `{sf_dir}`, "
           "local[8], 16 shuffle partitions, after execution (AQE final plans). "
           "Only the operator trees are kept; `explain('formatted')` has the per-node detail.", ""]
    for name, build in BUILDERS.items():
        df = build(d)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        tree = buf.getvalue().split("\n\n\n")[0].replace("== Physical Plan ==\n", "")
        tree = tree.split("+- == Initial Plan ==")[0]
        out += [f"## {name}", "", "```", tree.rstrip(), "```", ""]
    with open(os.path.join(HERE, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
