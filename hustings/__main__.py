"""``python -m hustings sample|news|daily|backfill|benchmark``: flows from the command line; 0 if all went well."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from hustings.config import Settings, csv_list
from hustings.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hustings")
    p.add_argument("flow", choices=["sample", "news", "daily", "backfill", "benchmark"])
    p.add_argument("--out", default=None)
    p.add_argument("--manifest", default=None)
    p.add_argument("--sources", default=None, help="folder with geography.csv, seats.xlsx, candidates.csv, incumbents.csv and perhaps tour2.csv")
    p.add_argument("--date", type=date.fromisoformat, default=None)
    p.add_argument("--providers", type=csv_list, default=None)
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    from hustings.plans import flows
    from hustings.plans.lineage import Lineage
    from hustings.sources.files import read_benchmark_manifest
    from hustings.sources.http import urlopen_transport

    s = Settings.from_env()
    spark = session(a.master)
    out = a.out or s.data_dir
    lineage = Lineage(spark, f"{s.warehouse_path}/meta")
    try:
        if a.flow == "sample":
            base = a.sources or f"{s.data_dir}/raw"
            kinds = {"geography": ("csv", ",", "csv"), "seats": ("xlsx", "", "xlsx"), "candidates": ("csv", ";", "csv"), "incumbents": ("csv", ";", "csv"), "tour2": ("csv", ";", "csv")}
            sources = {k: flows.Source(k, f"{base}/{k}.{e}", f"{base}/{k}.{e}", kind, sep) for k, (kind, sep, e) in kinds.items()}
            run = flows.sampling_flow(spark, sources, out, s, lineage)
        elif a.flow == "benchmark":
            with open(a.manifest, encoding="utf-8") as f:
                cases, truth, _ = read_benchmark_manifest(spark, f.read())
            run = flows.benchmark_flow(spark, cases, truth, out, urlopen_transport, a.providers, s, lineage)
        else:
            flow = {"news": flows.news_flow, "daily": flows.daily_flow, "backfill": flows.backfill_flow}[a.flow]
            more = {"day": a.date} if a.flow == "daily" else {}
            if a.flow != "backfill":
                more["order"] = a.providers
            run = flow(spark, a.manifest or f"{out}/gold/sample_manifest.json", out, urlopen_transport, s=s, lineage=lineage, **more)
    except Exception as e:  # noqa: BLE001 - a command's errors are its exit code
        print(f"{a.flow} failed: {e}", file=sys.stderr)
        return 1
    print(f"{a.flow}: {run.status}, {run.rows} rows, {run.error_count} errors")
    return 0


if __name__ == "__main__":
    sys.exit(main())
