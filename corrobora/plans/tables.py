"""Claims and labels derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.operators.prepare import deal_groups, unpivot_claims
from corrobora.operators.trust import adjudicate, join_trust, trust_counts, trust_table
from corrobora.plans.methods import prepare
from corrobora.session import spread

LINE_FIELDS = ("returnflag", "linestatus", "discount_pct", "tax_pct")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1000000.0


def line_records(spark: SparkSession, sf_dir: str, dealt: bool = True, only: Column | None = None) -> DataFrame:
    """Order lines as records in which suppliers describe parts, dealt by part unless told otherwise; perhaps ``only`` some lines."""
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_discount l_tax l_returnflag l_linestatus l_shipdate"
    line = load(spark, sf_dir, "lineitem").select(*columns.split())
    line = line if only is None else line.filter(only)
    line = deal_groups(line, ["l_partkey"]) if dealt else spread(line)

    def percent(c: str) -> Column:
        return F.rint(F.col(c) * 100).cast("long").cast("string")

    return line.select(
        F.col("l_partkey").alias("cluster_id"),
        F.col("l_suppkey").cast("string").alias("source_id"),
        epoch_seconds(F.col("l_shipdate")).alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offer_id"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        percent("l_discount").alias("discount_pct"),
        percent("l_tax").alias("tax_pct"),
    )


def claims(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Suppliers' conflicting claims about parts, one per order line and field."""
    return claims_of(line_records(spark, sf_dir, dealt))


def claims_of(records: DataFrame) -> DataFrame:
    """The claims of order lines, one per line and field."""
    return unpivot_claims(records, ["cluster_id", "source_id", "ts", "offer_id"], LINE_FIELDS, normalise=None)


def two_source_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same order lines, with the line status as one of two sources."""
    records = line_records(spark, sf_dir).withColumn("source_id", F.col("linestatus"))
    ids = ["cluster_id", "source_id", "ts", "offer_id"]
    return unpivot_claims(records, ids, ["returnflag", "discount_pct", "tax_pct"], normalise=None)


def learned_trust(spark: SparkSession, sf_dir: str, mode: str = "mean") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collapsed claims, silver labels and the trust learned from all of them."""
    collapsed, silver, _ = prepare(claims(spark, sf_dir))
    return collapsed, silver, trust_table(trust_counts(adjudicate(collapsed, silver)), mode)


def trusted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims with the mean trust of their source and field."""
    raw = claims(spark, sf_dir)
    collapsed, silver, _ = prepare(raw)
    return join_trust(raw, trust_table(trust_counts(adjudicate(collapsed, silver))))


def document_adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels of documents as outcomes per (source, language)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("cluster_id"),
        F.col("lang").alias("field"),
        F.col("source").alias("source_id"),
        F.col("quality").cast("byte").alias("x"),
        F.col("n_chars").cast("double").alias("ts"),
    )


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as a stream of claims about each user's last event."""
    events = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").alias("cluster_id"),
        F.lit("last_event").alias("field"),
        F.col("event_type").alias("value"),
        (k % 17).cast("string").alias("source_id"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.col("event_id").alias("offer_id"),
    )


def part_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wide offers: brand is the source, size the cluster."""
    part = load(spark, sf_dir, "part")
    return part.select(
        F.col("p_size").cast("long").alias("cluster_id"),
        F.col("p_partkey").alias("offer_id"),
        F.col("p_brand").alias("source_id"),
        (F.col("p_partkey") / 1000.0).alias("ts"),
        F.col("p_name").alias("Name"),
        F.col("p_type").alias("Type"),
    )


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to what they share: their exact text, and their source and length."""
    docs = load(spark, sf_dir, "documents")
    me = F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("left")
    same_text = F.concat(F.lit("Btext "), F.md5("text"))
    same_size = F.concat(F.lit("Bsize "), F.concat_ws(" ", "source", F.col("n_chars").cast("string")))
    return docs.select(me, F.explode(F.array(same_text, same_size)).alias("right"))
