"""What the text operators share: tables, null texts, bounded label samples, document order."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.session import pin

#: At most about so many labelled rows are used to fit a model.
LABEL_BOUND = 20_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that they need no copy of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="corrobora-code-")) / "corrobora_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, a missing one as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the third of documents that no model may learn from; a null id is not held out."""
    digest = F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))
    return F.coalesce(digest % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label) of every labelled document outside the held-out third.

    A document labelled more than once counts once, with its greatest label;
    null ids and labels are left out.
    """
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def label_sample(labels: DataFrame, label: str = "quality", bound: int = LABEL_BOUND) -> DataFrame:
    """About ``bound`` of :func:`training_labels`, small enough to broadcast.

    The choice hashes the id, so it does not
    depend on row order. The sample only bounds what a model is fitted on.
    """
    rows = pin(training_labels(labels, label), "labels")
    n = rows.count()
    if n > bound:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        rows = rows.filter(share < int((1 << 30) * bound / n))
    return rows


def labelled(docs: DataFrame, sample: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the label of the bounded sample; the sample travels, the texts stay where they are."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", how).select("text", "label")


def in_document_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt in ranges of ascending doc_id and sorted within each; null ids first, null texts empty.

    Rows that share an id are ordered, and dealt, by a hash of their text.
    """
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
