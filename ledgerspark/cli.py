"""Command line: ``python -m ledgerspark.cli -b BLOCKS -o OUTPUT [--analysis NAME] [-v]``."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession

from ledgerspark.functions.codec import address, hash_pretty
from ledgerspark.plans import analyses
from ledgerspark.plans.chain_tables import load
from ledgerspark.sources.sinks import write_lines

VERSION = "0.2.0"
log = logging.getLogger("ledgerspark")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerspark", description="Analyses of block files.")
    p.add_argument("-b", "--blocks-dir", default=os.path.expanduser("~/.bitcoin/blocks"))
    p.add_argument("-o", "--output", default="clusters.csv", help="a file for clusters, a folder of part files else; - prints the lines")
    p.add_argument("--analysis", default="clusters", choices=["clusters", "balances", "addresses", "tx-hashes", "data-outputs", "donations", "merkle", "largest-clusters", "richest"])
    p.add_argument("--profile", default="reference", choices=["reference", "standard"])
    p.add_argument("--mode", default="FAILFAST", choices=["FAILFAST", "PERMISSIVE"])
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--version", action="version", version=VERSION)
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.appName("ledgerspark").getOrCreate()
    t = load(spark, args.blocks_dir, args.profile, args.mode)
    log.info("%s of %s", args.analysis, args.blocks_dir)
    if args.analysis == "clusters":
        tags = analyses.cluster_tags(analyses.cluster_keys(t["inputs"], t["outputs"], args.profile))
        write_lines(tags, args.output, order=["tag", "address"], one_file=True)
    elif args.analysis == "balances":
        write_lines(analyses.balances(t["inputs"], t["outputs"], args.profile), args.output)
    elif args.analysis == "addresses":
        write_lines(analyses.addresses(t["outputs"], args.profile), args.output, "address")  # in chain order
    elif args.analysis == "tx-hashes":
        write_lines(analyses.tx_hash_lines(t["txs"]), args.output, "line", order=["height", "ord"])
    elif args.analysis == "data-outputs":
        write_lines(analyses.data_outputs(t["inputs"], t["outputs"]), args.output, "text")
    elif args.analysis == "largest-clusters":
        found = analyses.largest_clusters(analyses.cluster_keys(t["inputs"], t["outputs"], args.profile))
        write_lines(found.withColumn("cluster", address(found["cluster"])), args.output, order=["n_addresses"])
    elif args.analysis == "richest":
        found = analyses.richest(analyses.balance_sums(t["inputs"], t["outputs"], args.profile))
        write_lines(found.withColumn("key", address(found["key"])), args.output)
    elif args.analysis == "donations":
        found = analyses.donations(t["inputs"], t["outputs"])
        write_lines(found.withColumn("txid", hash_pretty(found["txid"])), args.output)
    else:
        from ledgerspark.operators.merkle import check

        write_lines(check(t["blocks"], t["txs"], args.profile).select("height", "ok"), args.output)


if __name__ == "__main__":
    main()
