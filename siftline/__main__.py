"""python -m siftline FEED: reads a feed and shows what it holds."""

import argparse
import sys

from pyspark.sql import SparkSession

from siftline.operators import health
from siftline.sources import sinks
from siftline.sources.catalog import Catalog
from siftline.sources.reader import MODES, read_feed
from siftline.streaming.ingest import Progress, ingest


def _tell(p: Progress) -> None:
    print(f"{p.status}, {p.current_phase}: {p.percentage:.0f} %, {p.records_ingested} records, {p.elapsed_secs:.1f} s", file=sys.stderr)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftline", description="Read a feed and show what it holds.")
    p.add_argument("feed")
    p.add_argument("--mode", choices=[*MODES], default="full")
    p.add_argument("--tag", help="the records' element or array key; found by itself if absent")
    p.add_argument("--filter", default="", help="a filter text")
    p.add_argument("--distribution", metavar="COLUMN")
    p.add_argument("--duplicates", metavar="COLUMN")
    p.add_argument("--cross", nargs=2, metavar=("PRIMARY", "SECONDARY"))
    p.add_argument("--page", type=int, help="show this page of the rows")
    p.add_argument("--sort", metavar="COLUMN")
    p.add_argument("--csv", metavar="FOLDER", help="write the rows as CSV")
    p.add_argument("--json", metavar="FILE", help="write the rows as a JSON array")
    p.add_argument("--catalog", metavar="FOLDER", help="read under watch and keep the feed in this catalog")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siftline").getOrCreate()
    if a.catalog:
        feed = ingest(spark, a.feed, a.mode, a.tag, Catalog(a.catalog, spark), tell=_tell).feed
    else:
        feed = read_feed(spark, a.feed, a.mode, a.tag)
    chosen = feed.filter(a.filter)
    asked = False
    for flag, show in ((a.distribution, chosen.distribution), (a.duplicates, chosen.duplicates)):
        if flag:
            show(flag).show(50, truncate=60)
            asked = True
    if a.cross:
        chosen.cross_tab(*a.cross).show(50, truncate=30)
    if a.page is not None:
        chosen.page(a.page, 25, a.sort).rows.show(25, truncate=40)
    for target, as_json in ((a.csv, False), (a.json, True)):
        if target:
            print(sinks.export_records(chosen, target, as_json), "rows written to", target)
    if not (asked or a.cross or a.page is not None or a.csv or a.json):
        profile = chosen.profile()
        chosen.overview().show()
        profile.show(100, truncate=30)
        health.tier_counts(profile).show()


if __name__ == "__main__":
    main()
