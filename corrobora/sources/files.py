"""Readers of the raw inputs and writers of results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corrobora.functions.text import norm_number, norm_text
from corrobora.operators.components import connected_components
from corrobora.operators.joins import lookup_join
from corrobora.operators.order import arrival_time
from corrobora.operators.prepare import multi_source, unpivot_claims
from corrobora.session import pin

# Names in the input formats.
OFFER_ATTRIBUTES = ("title", "brand", "description")
MUSIC_FIELDS = ("title", "artist", "album", "number", "year", "length", "language")
MUSIC_NUMBERS = ("year", "length", "number")
MATCH_FILES = ("matches", "gold", "perfectmapping", "train", "valid", "test")
LEFT_IDS = ("ltable_id", "table1.id", "lid", "id1", "idtablea")
RIGHT_IDS = ("rtable_id", "table2.id", "rid", "id2", "idtableb")
TRUE_LABELS = ("1", "1.0", "true", "True")
PAIR_FILE = r"([^/]+)__([^/.]+)\.json"


# ------------------------------------------------------------ offer pairs
def read_offer_pairs(
    spark: SparkSession,
    path: str,
    categories: Sequence[str],
    splits: Sequence[str],
    attributes: Sequence[str] = OFFER_ATTRIBUTES,
    pattern: str = PAIR_FILE,
) -> DataFrame:
    """Offers from JSON-lines pair files (plain or gzip), one row per offer id.

    ``pattern`` finds category and split in the file path; files of others are
    left out. Broken lines and missing ids are skipped. An offer keeps its first
    appearance by category, split, file, line and side; that is a group maximum
    on the reversed position, so no file is read in one piece.
    """
    halves = ["id", "cluster_id", *attributes]
    schema = T.StructType([T.StructField(f"{h}_{s}", T.StringType()) for s in ("left", "right") for h in halves])
    where = F.col("_metadata.file_path")
    raw = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .json(path)
        .select(
            "*",
            where.alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
            F.regexp_extract(where, pattern, 1).alias("category"),
            F.regexp_extract(where, pattern, 2).alias("split"),
        )
        .filter(F.col("category").isin(*categories) & F.col("split").isin(*splits))
    )

    def half(side: str, rank: int) -> Column:
        return F.struct(F.lit(rank).alias("_side"), *[F.col(f"{h}_{side}").alias(h) for h in halves])

    place = ["category", "split", "_file", "_block", "_line"]
    both = raw.select(*place, F.explode(F.array(half("left", 0), half("right", 1))).alias("o")).select(*place, "o.*")
    known = both.withColumn("offer_id", F.col("id").try_cast("long")).filter("offer_id is not null")
    rank = [
        F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")).alias("_c"),
        F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")).alias("_s"),
    ]
    first = known.groupBy("offer_id").agg(
        F.min(
            F.struct(*rank, "_file", "_block", "_line", "_side", "category", "cluster_id", *attributes)
        ).alias("w")
    )
    cluster = F.coalesce(F.col("w.cluster_id").try_cast("long"), F.lit(-1)).alias("cluster_id")
    return first.select("offer_id", cluster, "w.category", *[f"w.{a}" for a in attributes])


# -------------------------------------------------------- multi-source CSV
def read_csv_strings(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header: all columns as text, empty cells null, clean lower-case names.

    Quoted values may hold line breaks; large files that surely have none are
    read in splits with ``line_breaks=False``.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def read_music_claims(
    spark: SparkSession,
    path: str,
    order: str = "tid",
    fields: Sequence[str] = MUSIC_FIELDS,
    line_breaks: bool = True,
) -> DataFrame:
    """Claims of a multi-source record file with gold cluster ids.

    Values are numbered by field and record before clusters with a single source
    are dropped. Records are ordered by ``order``, their number in the file.
    """
    records = read_csv_strings(spark, path, line_breaks)
    present = [f for f in fields if f in records.columns]
    wide = records.select(
        F.col("cid").cast("long").alias("cluster_id"),
        F.concat(F.lit("s"), "sourceid").alias("source_id"),
        F.col("id").alias("rid"),
        F.col(order).cast("long").alias("_record"),
        *present,
    )
    rules = {f: norm_number if f in MUSIC_NUMBERS else norm_text for f in present}
    claims = unpivot_claims(wide, ["cluster_id", "source_id", "rid", "_record"], present, rules)
    position = F.array_position(F.array(*[F.lit(f) for f in present]), F.col("field"))
    numbered = pin(arrival_time(claims, [position, "_record"]).drop("_record"), "music")
    return multi_source(numbered)


# ------------------------------------------------------- two-table matches
def match_files(spark: SparkSession, root: str, names: Sequence[str] = MATCH_FILES) -> list[str]:
    """The CSV files under ``root`` with one of ``names``, in whatever case they are spelled."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    listed = store.listStatus(place) if store.exists(place) else []
    wanted = {f"{name.lower()}.csv" for name in names}
    return sorted(e.getPath().toString() for e in listed if e.getPath().getName().lower() in wanted)


def read_match_pairs(
    spark: SparkSession, root: str, names: Sequence[str] = MATCH_FILES, line_breaks: bool = False
) -> DataFrame:
    """Distinct matched (lid, rid) pairs pooled from all match files under ``root``.

    Where there is a label column, only true labels count. File names match in
    any case, and every file found is read: one that cannot be is an error. Ids
    hold no line breaks, so files are read in splits unless ``line_breaks`` says otherwise.
    """
    found = [read_csv_strings(spark, path, line_breaks) for path in match_files(spark, root, names)]
    if not found:
        raise ValueError(f"no match file under {root}")
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    left, right = (
        next((c for c in aliases if c in pooled.columns), None) for aliases in (LEFT_IDS, RIGHT_IDS)
    )
    if left is None or right is None:
        raise ValueError(f"no id columns among {pooled.columns}")
    if "label" in pooled.columns:
        pooled = pooled.filter(F.col("label").isin(*TRUE_LABELS))
    pairs = pooled.select(F.col(f"`{left}`").alias("lid"), F.col(f"`{right}`").alias("rid"))
    return pairs.dropna().distinct()


def cluster_claims(table_a: DataFrame, table_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims about the connected clusters of two matched tables.

    Only records in a cluster and attributes that both tables have are kept.
    """
    tagged = pairs.select(F.concat(F.lit("A"), "lid").alias("left"), F.concat(F.lit("B"), "rid").alias("right"))
    members = pin(connected_components(tagged), "members")
    names_b = set(table_b.columns) - {_id_column(table_b)}
    shared = [c for c in table_a.columns if c != _id_column(table_a) and c in names_b]
    sides = []
    for table, tag in ((table_a, "A"), (table_b, "B")):
        record = table.withColumn("node", F.concat(F.lit(tag), F.col(_id_column(table)).cast("string")))
        placed = lookup_join(record.select("node", *shared), members, ["node"], "inner")
        sides.append(placed.withColumn("source_id", F.lit(f"src{tag}")))
    claims = unpivot_claims(sides[0].unionByName(sides[1]), ["cluster_id", "source_id", "node"], shared)
    return arrival_time(claims, ["source_id", "field", "node"]).drop("node")


def _id_column(table: DataFrame) -> str:
    return next((c for c in table.columns if c.lower() == "id"), table.columns[0])


# ------------------------------------------------------------------- sinks
def save_csv(df: DataFrame, path: str) -> None:
    """Replace the CSV result at ``path``."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add the rows to the JSON-lines result at ``path``."""
    df.write.mode("append").json(path)


__all__ = [
    "append_jsonl",
    "cluster_claims",
    "match_files",
    "read_csv_strings",
    "read_match_pairs",
    "read_music_claims",
    "read_offer_pairs",
    "save_csv",
]
