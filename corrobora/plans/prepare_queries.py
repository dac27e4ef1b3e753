"""Queries on reading, cleaning, numbering and clustering claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions.ids import hash_time, source_bucket
from corrobora.functions.text import norm_number, norm_text
from corrobora.operators import prepare as pp
from corrobora.operators.components import connected_components
from corrobora.operators.incremental import Components
from corrobora.operators.sketches import STANDARD_ERROR, profile_estimates, profile_sketches
from corrobora.operators.monitor import resolved_labels, top_sources
from corrobora.operators.order import arrival_time, time_windows
from corrobora.plans import methods as me, tables
from corrobora.plans.registry import query
from corrobora.plans.sqlparts import assemble, hash_sql, windows_part
from corrobora.session import scratch_path
from corrobora.sources import files

OFFER_IDS = ["cluster_id", "offer_id", "source_id", "ts"]


@query("claims_unpivot", assemble("SELECT cluster_id, source_id, ts, offer_id, field, value FROM claims"))
def _(spark, sf) -> DataFrame:
    return tables.claims(spark, sf, dealt=False)


def sql_text(column: str) -> str:
    words = rf"trim(regexp_replace(lower(nfc_normalize({column})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
    return f"CASE WHEN lower(trim({column})) NOT IN ('', 'nan', 'none', 'null') THEN nullif({words}, '') END"


# The texts hold no compatibility characters, so canonical composition gives the same words here.
@query("norm_text", f"SELECT doc_id, lang, {sql_text('text')} AS value FROM documents")
def _(spark, sf):
    docs = tables.load(spark, sf, "documents")
    return docs.select("doc_id", "lang", norm_text(F.col("text")).alias("value"))


@query(
    "norm_number",
    r"""SELECT o_orderkey, raw, printf('%.2f', CAST(regexp_extract(replace(raw, ',', '.'), '-?[0-9]+(\.[0-9]+)?') AS DOUBLE)) AS value
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'about -' ELSE '' END || (c // 1000) || CASE WHEN o_orderstatus = 'O' THEN ',' ELSE '.' END
      || lpad(CAST(c % 1000 AS VARCHAR), 3, '0') || ' EUR' AS raw FROM (SELECT *, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS c FROM orders))""",
)
def _(spark, sf):
    c = F.rint(F.col("o_totalprice") * 100).cast("long")
    status = F.col("o_orderstatus")
    raw = F.concat(
        F.when(status == "F", "about -").otherwise(""),
        F.floor(c / 1000).cast("string"),
        F.when(status == "O", ",").otherwise("."),
        F.lpad((c % 1000).cast("string"), 3, "0"),
        F.lit(" EUR"),
    )
    numbered = tables.load(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return numbered.withColumn("value", norm_number(F.col("raw")))


@query(
    "source_bucket",
    """SELECT source_id, count(*) AS offers FROM (SELECT 'src_' || (l_orderkey * 65536 + l_linenumber) // 1048576 AS source_id FROM lineitem)
    GROUP BY source_id""",
)
def _(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    offer = F.col("l_orderkey") * 65536 + F.col("l_linenumber")
    return line.select(source_bucket(offer).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("offers"))


@query(
    "hash_time",
    """SELECT l_orderkey, l_linenumber, count(*) AS n,
    CAST((CAST(l_orderkey * 1000003 + l_linenumber AS HUGEINT) * 2654435761) % 4294967296 AS DOUBLE) / 4294967296.0 AS ts
    FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def _(spark, sf):
    keys = tables.load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return keys.withColumn("ts", hash_time(F.col("l_orderkey") * 1000003 + F.col("l_linenumber")))


@query(
    "arrival_time",
    assemble(
        """SELECT cluster_id, source_id, field, value, pos AS offer_id, pos / total AS ts FROM (
        SELECT *, row_number() OVER (ORDER BY field, offer_id) - 1 AS pos, count(*) OVER () AS total FROM offerclaims)"""
    ),
)
def _(spark, sf):
    claims = _offer_claims(spark, sf).withColumn("record", F.col("offer_id"))
    return arrival_time(claims, ["field", "record"]).drop("record")


def _offer_claims(spark, sf) -> DataFrame:
    return pp.unpivot_claims(tables.part_offers(spark, sf), OFFER_IDS, ["Name", "Type"], None)


@query(
    "time_windows",
    assemble('SELECT offer_id, ts, "window" FROM cut', cut=windows_part("stream", 8, '"window"')),
)
def _(spark, sf):
    return time_windows(tables.event_claims(spark, sf), 8).select("offer_id", "ts", "window")


@query(
    "dict_encode",
    assemble(
        """SELECT cluster_id, offer_id, source_id, ts, dense_rank() OVER (ORDER BY field) - 1 AS field_code,
        CASE WHEN value IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY value NULLS LAST) - 1 END AS value_code
        FROM (SELECT * REPLACE (CASE WHEN cluster_id % 5 <> 0 THEN value END AS value) FROM offerclaims)"""
    ),
)
def _(spark, sf):
    holes = _offer_claims(spark, sf).withColumn("value", F.when(F.col("cluster_id") % 5 != 0, F.col("value")))
    return pp.dict_encode(pp.dict_encode(holes, "field"), "value")


@query(
    "multi_source",
    assemble(
        """SELECT cluster_id, offer_id, source_id, ts, field, value FROM offerclaims WHERE cluster_id IN (
        SELECT cluster_id FROM offerclaims GROUP BY cluster_id HAVING count(DISTINCT source_id) >= 22)"""
    ),
)
def _(spark, sf):
    return pp.multi_source(_offer_claims(spark, sf), least=22)


@query(
    "relation_profile",
    assemble(
        """SELECT 'offers' AS measure, CAST(count(DISTINCT offer_id) AS DOUBLE) AS amount FROM offerclaims
        UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM offerclaims
        UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM offerclaims
        UNION ALL SELECT 'rows', count(*) FROM offerclaims
        UNION ALL SELECT 'avg_sources_per_cluster', round(avg(n), 6) FROM (SELECT count(DISTINCT source_id) AS n FROM offerclaims GROUP BY cluster_id)
        UNION ALL SELECT 'median_offers_per_cluster', median(n) FROM (SELECT count(DISTINCT offer_id) AS n FROM offerclaims GROUP BY cluster_id)
        UNION ALL SELECT 'rows of ' || field, count(*) FROM offerclaims GROUP BY field
        UNION ALL SELECT 'clusters of ' || type, count(DISTINCT cluster_id) FROM offers GROUP BY type"""
    ),
)
def _(spark, sf):
    offers = tables.part_offers(spark, sf).withColumn("category", F.col("Type"))
    claims = pp.unpivot_claims(offers, [*OFFER_IDS, "category"], ["Name", "Type"], None)
    return pp.relation_profile(claims).withColumn("amount", F.round("amount", 6))


@query(
    "relation_profile_sketch",
    assemble(
        """SELECT 'offers' AS measure, CAST(count(DISTINCT offer_id) AS DOUBLE) AS amount, true AS within FROM offerclaims
        UNION ALL SELECT 'clusters', count(DISTINCT cluster_id), true FROM offerclaims
        UNION ALL SELECT 'sources', count(DISTINCT source_id), true FROM offerclaims
        UNION ALL SELECT 'rows', count(*), true FROM offerclaims
        UNION ALL SELECT 'avg_sources_per_cluster', round(avg(n), 6), true FROM (
          SELECT count(DISTINCT source_id) AS n FROM offerclaims GROUP BY cluster_id)"""
    ),
)
def _(spark, sf):
    """Exact amounts, and whether the estimate from one merged sketch per source is within four standard errors of each."""
    claims = _offer_claims(spark, sf)
    exact = pp.relation_profile(claims).withColumn("amount", F.round("amount", 6))
    found = profile_estimates(profile_sketches(claims, ["source_id"]))
    names = ["offers", "clusters", "sources", "rows", "avg_sources_per_cluster"]
    estimates = found.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "measure", "estimate")
    errors = F.when(F.col("measure") == "avg_sources_per_cluster", 2).otherwise(1) * 4 * STANDARD_ERROR
    within = F.abs(F.col("estimate") - F.col("amount")) <= errors * F.col("amount")
    return exact.join(F.broadcast(estimates), "measure").select("measure", "amount", within.alias("within"))


SPLIT = f"""SELECT seed, cluster_id, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY {hash_sql('seed', 'cluster_id')}, cluster_id) <= 100
  THEN 'train' ELSE 'test' END AS part
  FROM (SELECT DISTINCT cluster_id FROM silver), (SELECT unnest([0, 1, 2]) AS seed)"""


@query("cluster_split", assemble(SPLIT))
def _(spark, sf):
    _, silver, _ = me.prepare(tables.claims(spark, sf))
    return me.cluster_split(silver, 100, (0, 1, 2))


@query(
    "split_claims",
    assemble(
        """SELECT cluster_id, field, source_id, value, ts, offer_id FROM collapsed
        WHERE cluster_id IN (SELECT cluster_id FROM split WHERE seed = 0 AND part = 'test')""",
        split=SPLIT,
    ),
)
def _(spark, sf):
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    return pp.split_claims(collapsed, me.cluster_split(silver, 100), "test")


@query(
    "resolved_labels",
    assemble(
        """SELECT s.cluster_id, s.field, s.value FROM streamsilver s
        SEMI JOIN (SELECT * FROM cut WHERE "window" <= 2) c ON s.cluster_id = c.cluster_id AND s.field = c.field""",
        cut=windows_part("stream", 8, '"window"'),
    ),
)
def _(spark, sf):
    claims = tables.event_claims(spark, sf)
    _, silver, _ = me.prepare(claims)
    return resolved_labels(silver, time_windows(claims, 8).filter("window <= 2"))


@query(
    "top_sources",
    assemble("SELECT source_id, count(*) AS claims FROM stream GROUP BY source_id ORDER BY claims DESC, source_id LIMIT 5"),
)
def _(spark, sf):
    return top_sources(tables.event_claims(spark, sf), 5)


@query(
    "replicate_claims",
    assemble(
        """SELECT cluster_id + i * span AS cluster_id, offer_id + i * offers AS offer_id, source_id, ts, field, value FROM (
        SELECT *, row_number() OVER (ORDER BY offer_id, field) - 1 AS place, count(*) OVER () AS total,
          max(cluster_id) OVER () + 1 AS span, max(offer_id) OVER () + 1 AS offers FROM offerclaims),
        (SELECT unnest([0, 1, 2]) AS i) WHERE i * total + place < 2 * total + total // 3"""
    ),
)
def _(spark, sf):
    claims = _offer_claims(spark, sf)
    rows = claims.count()
    return pp.replicate_claims(claims, 2 * rows + rows // 3, ["offer_id", "field"])


# -------------------------------------------------------------- components
REACH = """WITH RECURSIVE {links},
ends AS (SELECT l AS a, r AS b FROM links UNION SELECT r, l FROM links),
least AS (SELECT a AS node, a AS label FROM ends UNION SELECT e.b, t.label FROM least t JOIN ends e ON e.a = t.node),
member AS MATERIALIZED (SELECT node, min(label) AS root FROM least GROUP BY node)
"""


@query(
    "connected_components",
    REACH.format(
        links="""links AS MATERIALIZED (SELECT 'A' || doc_id AS l, 'Btext ' || md5(text) AS r FROM documents
        UNION SELECT 'A' || doc_id, 'Bsize ' || source || ' ' || n_chars FROM documents)"""
    )
    + "SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM member",
)
def _(spark, sf):
    return connected_components(tables.document_links(spark, sf))


@query(
    "components_incremental",
    REACH.format(
        links="""links AS MATERIALIZED (SELECT 'A' || doc_id AS l, 'Btext ' || md5(text) AS r FROM documents
        UNION SELECT 'A' || doc_id, 'Bsize ' || source || ' ' || n_chars FROM documents WHERE lang <> 'en')"""
    )
    + "SELECT node, root FROM member",
)
def _(spark, sf):
    """Links by text first, then those by size as a later batch; the latter are withdrawn again for English documents."""
    links = tables.document_links(spark, sf)
    by_text = F.col("right").startswith("Btext ")
    english = tables.load(spark, sf, "documents").filter("lang = 'en'").select(F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("left"))
    gone = links.filter(~by_text).join(english, "left", "left_semi")
    state = Components.of(links.filter(by_text)).add(links.filter(~by_text))
    remaining = links.filter(by_text).unionByName(links.filter(~by_text).join(english, "left", "left_anti"))
    return state.remove(gone, remaining).roots()


CUSTOMERS = "SELECT 'A' || c_custkey AS l, 'B' || c_nationkey AS r FROM customer WHERE c_acctbal >= 0"


def _write_matches(spark, sf) -> str:
    """Customers matched to nations, written as match files under names and labels in several spellings."""
    root = scratch_path(spark, "matches")
    customer = tables.load(spark, sf, "customer")
    rich = F.col("c_acctbal") >= 0
    early = F.col("c_mktsegment") < "H"
    building = F.col("c_mktsegment") == "BUILDING"
    for name, keep, spelling in (("train", early & ~building, "1"), ("Test", ~early, "true"), ("perfectMapping", building, "1.0")):
        pairs = customer.filter(keep).select(
            F.col("c_custkey").alias("ltable_id"),
            F.col("c_nationkey").alias("rtable_id"),
            F.when(rich, spelling).otherwise("0").alias("Label"),
        )
        files.save_csv(pairs, f"{root}/{name}.csv")
    return root


@query("gold_pairs", "SELECT CAST(c_custkey AS VARCHAR) AS lid, CAST(c_nationkey AS VARCHAR) AS rid FROM customer WHERE c_acctbal >= 0")
def _(spark, sf):
    return files.read_match_pairs(spark, _write_matches(spark, sf))


def _words(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(
    "cluster_claims",
    REACH.format(links=f"links AS MATERIALIZED ({CUSTOMERS})")
    + f""", placed AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM member),
    record AS (SELECT 'A' || c_custkey AS node, 'srcA' AS source_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS key FROM customer
      UNION ALL SELECT 'B' || n_nationkey, 'srcB', n_name, CAST(n_regionkey AS VARCHAR) FROM nation),
    said AS (SELECT cluster_id, source_id, node, 'name' AS field, {_words('name')} AS value FROM record JOIN placed USING (node)
      UNION ALL SELECT cluster_id, source_id, node, 'key', {_words('key')} FROM record JOIN placed USING (node)),
    numbered AS (SELECT *, row_number() OVER (ORDER BY source_id, field, node) - 1 AS offer_id, count(*) OVER () AS total FROM said)
    SELECT cluster_id, source_id, field, value, offer_id, offer_id / total AS ts FROM numbered""",
)
def _(spark, sf):
    customer, nation = tables.load(spark, sf, "customer"), tables.load(spark, sf, "nation")
    a = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Key"))
    b = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Key"))
    return files.cluster_claims(a, b, files.read_match_pairs(spark, _write_matches(spark, sf)))


# ----------------------------------------------------------------- sources
PART_TYPES = ("economy", "large", "medium", "promo", "small", "standard")


@query(
    "pool_offers",
    """SELECT offer_id, w.cluster_id AS cluster_id, w.category AS category, w.title AS title, w.brand AS brand, w.description AS description FROM (
      SELECT offer_id, arg_min(struct_pack(cluster_id := cluster_id, category := category, title := title, brand := brand, description := description),
        struct_pack(a := category, b := split, c := lid, d := side)) AS w FROM (
        SELECT l.p_partkey AS offer_id, CAST(l.p_size AS BIGINT) AS cluster_id, l.p_name AS title, l.p_brand AS brand, l.p_type AS description,
          lower(l.p_type) AS category, CASE WHEN l.p_size <= 25 THEN 0 ELSE 1 END AS split, l.p_partkey AS lid, 0 AS side
        FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1
        UNION ALL
        SELECT r.p_partkey, CASE WHEN r.p_size > 40 THEN -1 ELSE r.p_size END, r.p_name || ', ' || r.p_type, r.p_brand, NULL,
          lower(l.p_type), CASE WHEN l.p_size <= 25 THEN 0 ELSE 1 END, l.p_partkey, 1
        FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1) GROUP BY offer_id)""",
)
def _(spark, sf):
    part = tables.load(spark, sf, "part")
    left = part.select(*[F.col(c).alias(f"l_{c}") for c in part.columns])
    pairs = left.join(part, F.col("p_partkey") == F.col("l_p_partkey") + 1).select(
        F.lower("l_p_type").alias("category"),
        F.when(F.col("l_p_size") <= 25, "train").otherwise("valid").alias("split"),
        F.col("l_p_partkey").alias("id_left"),
        F.col("l_p_size").alias("cluster_id_left"),
        F.col("l_p_name").alias("title_left"),
        F.col("l_p_brand").alias("brand_left"),
        F.col("l_p_type").alias("description_left"),
        F.col("p_partkey").alias("id_right"),
        F.when(F.col("p_size") <= 40, F.col("p_size")).alias("cluster_id_right"),
        F.concat_ws(", ", "p_name", "p_type").alias("title_right"),
        F.col("p_brand").alias("brand_right"),
    )
    path = scratch_path(spark, "pairs")
    ordered = pairs.orderBy("category", "split", "id_left")
    ordered.write.partitionBy("category", "split").option("compression", "gzip").json(path)
    return files.read_offer_pairs(
        spark, path, PART_TYPES, ["train", "valid"], pattern=r"category=([^/]+)/split=([^/]+)/"
    )


@query(
    "music_claims",
    rf"""WITH raw AS (SELECT o_orderkey AS tid, o_custkey AS cluster_id, 's' || substr(o_orderpriority, 1, 1) AS source_id,
        CAST(o_orderkey AS VARCHAR) AS rid, {_words('o_orderpriority')} AS title, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lower(o_orderstatus) END AS artist,
        printf('%.2f', CAST(o_orderkey % 50 AS DOUBLE)) AS number, printf('%.2f', CAST(year(o_orderdate) AS DOUBLE)) AS year FROM orders),
      said AS (SELECT *, row_number() OVER (ORDER BY place, tid) - 1 AS offer_id, count(*) OVER () AS total FROM (
        SELECT 1 AS place, tid, cluster_id, source_id, rid, 'title' AS field, title AS value FROM raw
        UNION ALL SELECT 2, tid, cluster_id, source_id, rid, 'artist', artist FROM raw WHERE artist IS NOT NULL
        UNION ALL SELECT 3, tid, cluster_id, source_id, rid, 'number', number FROM raw
        UNION ALL SELECT 4, tid, cluster_id, source_id, rid, 'year', year FROM raw))
    SELECT cluster_id, source_id, rid, field, value, offer_id, offer_id / total AS ts FROM said
    WHERE cluster_id IN (SELECT cluster_id FROM said GROUP BY cluster_id HAVING count(DISTINCT source_id) >= 2)""",
)
def _(spark, sf):
    orders = tables.load(spark, sf, "orders")
    records = orders.select(
        F.col("o_orderkey").alias(" TID"),
        F.col("o_custkey").alias("CID "),
        F.substring("o_orderpriority", 1, 1).alias("SourceID"),
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("No. "), (F.col("o_orderkey") % 50).cast("string"), F.lit(",")).alias("number"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("artist"),
        F.year("o_orderdate").alias("year"),
        F.lit(None).cast("string").alias("language"),
    )
    path = scratch_path(spark, "music")
    files.save_csv(records, path)
    return files.read_music_claims(spark, path)


@query(
    "result_sinks",
    assemble("SELECT source_id, 2 * count(*) AS claims, 'both' AS sink FROM stream GROUP BY source_id"),
)
def _(spark, sf):
    counts = tables.event_claims(spark, sf).groupBy("source_id").agg(F.count("*").alias("claims"))
    csv, jsonl = scratch_path(spark, "csv"), scratch_path(spark, "jsonl")
    files.save_csv(counts, csv)
    files.save_csv(counts, csv)
    for _ in range(2):
        files.append_jsonl(counts, jsonl)
    from_csv = files.read_csv_strings(spark, csv).withColumn("claims", F.col("claims").cast("long"))
    from_json = spark.read.schema("source_id string, claims long").json(jsonl)
    summed = from_json.groupBy("source_id").agg(F.sum("claims").alias("claims"))
    same = summed.join(from_csv.withColumn("claims", F.col("claims") * 2), ["source_id", "claims"], "left_semi")
    return same.withColumn("sink", F.lit("both"))
