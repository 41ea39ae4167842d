"""Table readers and the document corpus that stands on the order tables.

The corpus text is one SQL expression that means the same in Spark and in
other engines, so that results can be compared. ``{orders}`` and the like are
the tables' places in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a table of ``sf_dir`` or a given frame."""
    used = set(re.findall(r"\{(\w+)\}", text))
    # all other braces are text
    text = "".join(p if re.fullmatch(r"\{\w+\}", p) else p.replace("{", "{{").replace("}", "}}") for p in re.split(r"(\{\w+\})", text))
    return spark.sql(text, **{n: frames.get(n) if n in frames else table(spark, sf_dir, n) for n in used})


def plain_sql(text: str) -> str:
    """The same SQL with bare table names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


NL = "chr(10)"
DAY = "cast(cast(o_orderdate as date) as string)"
CASH = "cast(cast(o_totalprice as decimal(18,2)) as string)"
KEY = "cast(o_orderkey as string)"

#: Six kinds of document by order key: invoice, receipt, contract, purchase order, bank statement, memo. Some lack a field.
CORPUS = f"""
SELECT o_orderkey AS job_id, o_orderkey % 6 AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'purchase_order' WHEN 4 THEN 'bank_statement' ELSE 'generic' END AS expected_route,
  CASE o_orderkey % 6
    WHEN 0 THEN 'From: Vendor ' || cast(o_custkey as string) || ' Ltd' || {NL} || 'Invoice Number INV-' || {KEY} || {NL} || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Invoice Date: ' || {DAY} || {NL} END || 'Bill To: Buyer ' || cast(o_custkey % 97 as string) || {NL} || 'Ship To: Depot' || {NL} || 'Amount Due: $' || {CASH} || {NL} || 'Payment Terms Net 30' || {NL} || CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' ELSE 'USD' END
    WHEN 1 THEN 'Receipt' || {NL} || 'Merchant: Corner Store ' || cast(o_custkey as string) || {NL} || 'Date: ' || {DAY} || {NL} || 'Subtotal: $' || {CASH} || {NL} || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'Tax: $3.00' || {NL} END || 'Total: $' || {CASH} || {NL} || 'Paid: Visa' || {NL} || 'Change 0'
    WHEN 2 THEN 'Service Agreement between Alpha' || cast(o_custkey as string) || ' LLC and Beta Inc. Effective Date: June ' || cast(1 + o_orderkey % 28 as string) || ', 2026. Term: 12 months. Governing Law: Lagos. Whereas each party accepts this contract and its terms, signature below.'
    WHEN 3 THEN 'Purchase Order Number PO-' || {KEY} || {NL} || 'Order Date: ' || {DAY} || {NL} || 'Supplier: Supply House ' || cast(o_custkey % 31 as string) || {NL} || 'Buyer: Buyer ' || cast(o_custkey as string) || {NL} || 'PO No 7 Line items 3' || {NL} || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Total: $' || {CASH} END
    WHEN 4 THEN 'Bank Statement' || {NL} || 'Account Number 12' || {KEY} || '89' || {NL} || 'Statement Period: 01/01/2026 - 01/31/2026' || {NL} || 'Opening Balance: $100.00' || {NL} || 'Closing Balance: $' || {CASH} || {NL} || 'Transaction list' || {NL} || '2026-01-02 Coffee shop $4.50' || {NL} || '2026-01-03 Book shop $' || cast(o_orderkey % 90 as string) || '.25'
    ELSE CASE WHEN o_orderkey % 12 = 5 THEN 'memo' ELSE 'Note from Anna to Bert, amount 12 of ' || {DAY} || '.  Nothing   else happened.' END
  END AS text,
  cast(CASE WHEN o_orderkey % 23 = 7 THEN 40 WHEN o_orderkey % 29 = 3 THEN 5 ELSE 70 + o_orderkey % 30 END as double) / 100 AS ocr_confidence,
  o_orderkey % 50 = 49 AS fallback_used,
  o_custkey AS customer, o_orderstatus AS order_status, cast(o_totalprice as decimal(18,2)) AS total
FROM {{orders}}"""


def spread(df: DataFrame, least_bytes: int = 64 << 20) -> DataFrame:
    """Rows dealt over all cores, where their files are too few and too small for that.

    A small file is one task however many cores there are, and the document flow
    is all computation. Files of some size keep their own splits: nothing is
    shuffled then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the file index knows it; no names are listed
    return df.repartition(cores) if size < cores * least_bytes and len(df.inputFiles()) < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, CORPUS, orders=spread(table(spark, sf_dir, "orders")))


def spread_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """As ``run_sql``, with every table dealt over all cores: for texts whose rows are costly to judge."""
    return run_sql(spark, sf_dir, text, **{n: spread(table(spark, sf_dir, n)) for n in set(re.findall(r"\{(\w+)\}", text))})
