"""Write chosen analyses as parquet, for use with spark-submit.

    spark-submit rentlens/job.py --source parquet --from s3://bucket/rental \
        --to s3://bucket/marts --queries customer_profiles next_genre
"""

from __future__ import annotations

import argparse
import json

from rentlens.registry import PLANS
from rentlens.session import build_session
from rentlens.sources import from_jdbc, from_parquet, from_star, write_result
from rentlens.store import Store
from rentlens.workspace import Workspace

SOURCES = {"parquet": from_parquet, "star": from_star, "jdbc": from_jdbc}


def run(
    workspace: Workspace, target: str, names: list[str], mode: str = "errorifexists",
    params: dict[str, dict] | None = None,
) -> None:
    """All analyses over one workspace, so shared tables are built once.

    ``params`` has the arguments of analyses by name, such as
    ``{"customer_search": {"name": "^smith"}}``.
    """
    for name in names:
        result = PLANS[name](workspace, **(params or {}).get(name, {}))
        write_result(result, f"{target}/{name}", mode=mode)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--source", choices=SOURCES, default="parquet")
    parser.add_argument("--from", dest="origin", required=True, help="folder or JDBC url")
    parser.add_argument("--to", dest="target", required=True)
    parser.add_argument("--queries", nargs="+", choices=PLANS, default=["customer_profiles"])
    parser.add_argument("--mode", choices=["errorifexists", "overwrite"], default="errorifexists")
    parser.add_argument("--params", type=json.loads, default={}, help='{"query": {"argument": value}}')
    parser.add_argument("--option", action="append", default=[], help="key=value of the JDBC reader")
    parser.add_argument("--store", help="shared folder where derived tables stay for later jobs over the same files")
    parser.add_argument("--partitions", type=int, default=64, help="key ranges of JDBC reads")
    given = parser.parse_args()
    spark = build_session("rentlens-job")
    more = {}
    if given.source == "jdbc":
        more = {"options": dict(x.split("=", 1) for x in given.option), "partitions": given.partitions}
    store = Store(spark, given.store) if given.store else None
    if store:
        store.sweep()
    workspace = Workspace(spark, SOURCES[given.source](spark, given.origin, **more), store=store)
    run(workspace, given.target, given.queries, given.mode, given.params)
    workspace.close()


if __name__ == "__main__":
    main()
