"""Common table expressions of the comparison SQL, and a small assembler for them."""

from __future__ import annotations


def lcb_sql(counts: str, key: str, delta: float = 0.05) -> str:
    """Beta quantile by bisection; the distribution function is its (all positive) power series."""
    log_front = "pa*ln(mid) + pb*ln(1-mid) + lgamma(pa+pb) - lgamma(pa) - lgamma(pb) - ln(pa)"
    term = "exp(lgamma(pa+pb+n) - lgamma(pa+pb) - lgamma(pa+1+n) + lgamma(pa+1) + n*ln(mid))"
    return f"""
    SELECT {key}, (lo + hi) / 2 AS trust FROM (
      WITH RECURSIVE bisect AS (
        SELECT {key}, 2.0 + succ AS pa, 2.0 + fail AS pb, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM {counts}
        UNION ALL
        SELECT {key}, pa, pb, CASE WHEN cdf < {delta} THEN mid ELSE lo END, CASE WHEN cdf < {delta} THEN hi ELSE mid END, step + 1
        FROM (SELECT *, exp({log_front}) * list_sum(list_transform(range(0, 1500), lambda n: {term})) AS cdf
              FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE step < 42))
      ) SELECT * FROM bisect WHERE step = 42)"""


def lcb_fraction_sql(counts: str, key: str, delta: float = 0.05, levels: int = 60) -> str:
    """The quantile of :func:`lcb_sql` for many rows: once per distinct pair of counts, by the continued fraction.

    The fraction converges fast below (a + 1) / (a + b + 2), where the distribution function is far above ``delta`` already.
    """
    front = "exp(pa*ln(mid) + pb*ln(1-mid) + lgamma(pa+pb) - lgamma(pa) - lgamma(pb) - ln(pa))"
    even = "(k//2)*(pb-k//2)*mid / ((pa+k-1)*(pa+k))"
    odd = "-(pa+k//2)*(pa+pb+k//2)*mid / ((pa+k-1)*(pa+k))"
    levels_down = f"list_transform(range({levels}, 0, -1), lambda k: CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END)"
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, {levels_down}), lambda f, d: 1 + d / f)"
    return f"""
    SELECT {key}, (lo + hi) / 2 AS trust FROM {counts} JOIN (
      WITH RECURSIVE bisect AS (
        SELECT DISTINCT succ, fail, 2.0 + succ AS pa, 2.0 + fail AS pb, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM {counts}
        UNION ALL
        SELECT succ, fail, pa, pb, CASE WHEN cdf < {delta} THEN mid ELSE lo END, CASE WHEN cdf < {delta} THEN hi ELSE mid END, step + 1
        FROM (SELECT *, CASE WHEN mid > (pa + 1) / (pa + pb + 2) THEN 1.0 ELSE {front} / {fraction} END AS cdf
              FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE step < 42))
      ) SELECT succ, fail, lo, hi FROM bisect WHERE step = 42) USING (succ, fail)"""


def vote_sql(source: str, keys: str = "cluster_id, field", weight: str = "trust") -> str:
    return f"""
    SELECT {keys}, arg_max(value, struct_pack(w := w, v := value)) AS value FROM (
      SELECT {keys}, value, sum(CAST(round_even({weight} * 4294967296.0, 0) AS BIGINT)) AS w
      FROM {source} GROUP BY {keys}, value) GROUP BY {keys}"""


def rank_sql(source: str, keys: str = "cluster_id, field", policy: str = "trust, ts, value, offer_id") -> str:
    fields = ", ".join(f"p{i} := {c.strip()}" for i, c in enumerate(policy.split(",")))
    return f"SELECT {keys}, arg_max(value, struct_pack({fields})) AS value FROM {source} GROUP BY {keys}"


def hash_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def collapse_sql(source: str, keys: str = "cluster_id, field") -> str:
    return f"""
    SELECT {keys}, source_id, w.value AS value, w.ts AS ts, w.offer_id AS offer_id FROM (
      SELECT {keys}, source_id, max(struct_pack(n := n, ts := ts, offer_id := offer_id, value := value)) AS w FROM (
        SELECT {keys}, source_id, value, count(*) AS n, max(ts) AS ts, max(offer_id) AS offer_id
        FROM {source} GROUP BY {keys}, source_id, value) GROUP BY {keys}, source_id)"""


def panel_sql(source: str, k: int = 5) -> str:
    return f"""
    SELECT field, source_id FROM (
      SELECT field, source_id, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, source_id) AS place
      FROM {source} GROUP BY field, source_id) WHERE place <= {k}"""


def silver_sql(source: str, panel: str, k_min: int = 2) -> str:
    return f"""
    SELECT cluster_id, field, t.value AS value FROM (
      SELECT cluster_id, field, max(struct_pack(sup := sup, value := value)) AS t FROM (
        SELECT cluster_id, field, value, count(DISTINCT source_id) AS sup
        FROM {source} JOIN {panel} USING (field, source_id) GROUP BY cluster_id, field, value)
      GROUP BY cluster_id, field)
    JOIN (SELECT cluster_id, field, count(DISTINCT source_id) AS heard
          FROM {source} JOIN {panel} USING (field, source_id) GROUP BY cluster_id, field) USING (cluster_id, field)
    WHERE t.sup >= {k_min} AND t.sup / heard >= 1.0 / 3"""


def trust_join_sql(claims: str, trust: str) -> str:
    return f"""SELECT c.cluster_id, c.field, c.source_id, c.value, c.ts, c.offer_id, coalesce(t.trust, 0.5) AS trust
    FROM {claims} c LEFT JOIN {trust} t ON c.source_id = t.source_id AND c.field = t.field"""


def source_join_sql(claims: str, weights: str) -> str:
    return f"""SELECT c.cluster_id, c.field, c.source_id, c.value, c.ts, c.offer_id, coalesce(t.trust, 0.5) AS trust
    FROM {claims} c LEFT JOIN {weights} t ON c.source_id = t.source_id"""


COUNTS = "CAST(sum(x) AS DOUBLE) AS succ, CAST(sum(1 - x) AS DOUBLE) AS fail"
DECAYED = "sum(w * x) AS succ, sum(w * (1 - x)) AS fail"
MEAN = "(2.0 + succ) / (4.0 + succ + fail)"

PARTS: dict[str, str] = {
    "lines": """
    SELECT l_partkey AS cluster_id, CAST(l_suppkey AS VARCHAR) AS source_id,
           epoch_us(l_shipdate) / 1000000.0 AS ts, l_orderkey * 8 + l_linenumber AS offer_id,
           l_returnflag AS returnflag, l_linestatus AS linestatus,
           CAST(CAST(round_even(l_discount * 100, 0) AS BIGINT) AS VARCHAR) AS discount_pct,
           CAST(CAST(round_even(l_tax * 100, 0) AS BIGINT) AS VARCHAR) AS tax_pct FROM lineitem""",
    "claims": " UNION ALL ".join(
        f"SELECT cluster_id, source_id, ts, offer_id, '{f}' AS field, {f} AS value FROM lines"
        for f in ("returnflag", "linestatus", "discount_pct", "tax_pct")
    ),
    "twoclaims": " UNION ALL ".join(
        f"SELECT cluster_id, linestatus AS source_id, ts, offer_id, '{f}' AS field, {f} AS value FROM lines"
        for f in ("returnflag", "discount_pct", "tax_pct")
    ),
    "collapsed": collapse_sql("claims"),
    "panel": panel_sql("collapsed"),
    "silver": silver_sql("collapsed", "panel"),
    "adj": """SELECT c.cluster_id, c.field, c.source_id, CAST(c.value = s.value AS BIGINT) AS x, c.ts
    FROM collapsed c JOIN silver s USING (cluster_id, field)""",
    "counts": f"SELECT source_id, field, {COUNTS} FROM adj GROUP BY source_id, field",
    "trust": f"SELECT source_id, field, {MEAN} AS trust FROM counts",
    "trustmap": "SELECT source_id, field, (1.0 + succ) / (2.0 + succ + fail) AS trust FROM counts",
    "trustlcb": lcb_sql("counts", "source_id, field"),
    "fadecounts": f"""SELECT source_id, field, {DECAYED} FROM (
      SELECT *, exp(-1e-8 * greatest((SELECT max(ts) FROM collapsed) - ts, 0.0)) AS w FROM adj)
    GROUP BY source_id, field""",
    "trustfade": f"SELECT source_id, field, {MEAN} AS trust FROM fadecounts",
    "trustlcbfade": lcb_sql("fadecounts", "source_id, field"),
    "rate": "SELECT source_id, (sum(x) + 1.0) / (count(*) + 2.0) AS trust FROM adj GROUP BY source_id",
    "ratefield": "SELECT source_id, field, CAST(sum(x) AS DOUBLE) / count(*) AS trust FROM adj GROUP BY ALL",
    "ratesmooth": "SELECT source_id, field, (sum(x) + 1.0) / (count(*) + 2.0) AS trust FROM adj GROUP BY ALL",
    "trusted": trust_join_sql("claims", "trust"),
    "weighted": trust_join_sql("collapsed", "trust"),
    "weightedlcb": trust_join_sql("collapsed", "trustlcb"),
    "pred": vote_sql("weighted"),
    "joined": """SELECT s.cluster_id, s.field, s.value AS truth, p.value AS pred
    FROM silver s LEFT JOIN pred p USING (cluster_id, field)""",
    "docadj": """SELECT d.doc_id AS cluster_id, d.lang AS field, d.source AS source_id,
      CAST(l.quality AS BIGINT) AS x, CAST(d.n_chars AS DOUBLE) AS ts FROM documents d JOIN labels l USING (doc_id)""",
    "doccounts": f"SELECT source_id, field, {COUNTS} FROM docadj GROUP BY source_id, field",
    "doctrust": f"SELECT source_id, field, {MEAN} AS trust, succ + fail AS n_eff FROM doccounts",
    "stream": """SELECT user_id AS cluster_id, 'last_event' AS field, event_type AS value,
      CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 17 AS VARCHAR) AS source_id,
      epoch_us(ts) / 1000000.0 AS ts, event_id AS offer_id FROM events""",
    "streamcollapsed": collapse_sql("stream"),
    "streampanel": panel_sql("streamcollapsed"),
    "streamsilver": silver_sql("streamcollapsed", "streampanel"),
    "offers": """SELECT CAST(p_size AS BIGINT) AS cluster_id, p_partkey AS offer_id, p_brand AS source_id,
      p_partkey / 1000.0 AS ts, p_name AS name, p_type AS type FROM part""",
    "offerclaims": """SELECT cluster_id, offer_id, source_id, ts, 'name' AS field, name AS value FROM offers
      UNION ALL SELECT cluster_id, offer_id, source_id, ts, 'type', type FROM offers""",
}


def windows_part(source: str, n: int, column: str) -> str:
    """Rows of ``source`` with their window number in (ts, offer_id) order."""
    return f"""SELECT *, CAST(((row_number() OVER (ORDER BY ts, offer_id, cluster_id, field, source_id, value) - 1) * {n})
      // (count(*) OVER ()) + 1 AS INTEGER) AS {column} FROM {source}"""


def _needs(text: str, known: dict[str, str]) -> list[str]:
    import re

    return [name for name in known if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text)]


def assemble(select: str, **extra: str) -> str:
    """``select`` preceded by the parts it (transitively) reads, in order of dependence."""
    known = {**PARTS, **extra}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text, known):
            if name not in ordered:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    if not ordered:
        return select
    body = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in ordered)
    return f"WITH {body}\n{select}"
