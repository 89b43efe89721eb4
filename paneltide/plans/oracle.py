"""DuckDB SQL twins of the fixture views, used by ``oracle_sql()``.

They are written independently of the Spark plans (row-level aggregates, not
the one-pass sums), so the oracle checks the Spark formulation too.
"""

from __future__ import annotations

PANEL_CTES = """
pt_base AS (
  SELECT l.l_suppkey AS entity, CAST(year(l.l_shipdate) AS INTEGER) AS year, l.l_quantity, l.l_discount, l.l_tax,
         l.l_returnflag, l.l_linestatus, p.p_brand
  FROM lineitem l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_suppkey IN (SELECT s_suppkey FROM supplier)
),
pt_stats AS (
  SELECT entity, year, CAST(count(*) AS DOUBLE) AS n_papers, avg(l_quantity) AS mean_patent_cit,
         avg(l_discount) AS tech_prox, avg(l_tax) AS research_novelty, stddev_samp(l_discount) AS intra_cohesion,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS oa_share,
         avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS imputed_share
  FROM pt_base GROUP BY entity, year
),
pt_brand AS (
  SELECT entity, year, p_brand, count(*) AS nb FROM pt_base GROUP BY entity, year, p_brand
),
pt_ent AS (
  SELECT b.entity, b.year, -sum((b.nb / s.n_papers) * ln(b.nb / s.n_papers)) AS topic_entropy
  FROM pt_brand b JOIN pt_stats s ON b.entity = s.entity AND b.year = s.year
  GROUP BY b.entity, b.year
),
pt_cuts AS (
  SELECT quantile_cont(mean_patent_cit, 1.0/3.0) AS q1, quantile_cont(mean_patent_cit, 2.0/3.0) AS q2
  FROM pt_stats WHERE n_papers > 0
),
panel AS (
  SELECT s.entity, s.year, s.n_papers, s.mean_patent_cit, s.tech_prox, s.research_novelty, e.topic_entropy,
         s.intra_cohesion, s.oa_share, s.imputed_share,
         CAST(CASE WHEN s.n_papers = 0 THEN -1
                   WHEN s.mean_patent_cit <= (SELECT q1 FROM pt_cuts) THEN 0
                   WHEN s.mean_patent_cit <= (SELECT q2 FROM pt_cuts) THEN 1
                   ELSE 2 END AS INTEGER) AS state
  FROM pt_stats s JOIN pt_ent e ON s.entity = e.entity AND s.year = e.year
)"""

META_CTES = """
meta AS (
  SELECT s.s_suppkey AS entity, n.n_name AS city,
         CAST((n.n_nationkey * 37) % 120 - 60 AS DOUBLE) AS lat,
         CAST((n.n_nationkey * 73) % 360 - 180 AS DOUBLE) AS lon,
         n.n_name AS region, r.r_name AS type,
         CAST(row_number() OVER (ORDER BY s.s_acctbal DESC, s.s_suppkey) AS INTEGER) AS rank
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# prepared panel (operators 3, 8-13, 41-45) with the fixture's event years
PREP_CTES = """
prep0 AS (
  SELECT p.*, m.city AS inst_city, m.region AS inst_region, m.type AS inst_type, m.rank AS inst_rank,
         CAST(coalesce(m.type = 'ASIA', false) AS INTEGER) AS is_c9,
         CAST(coalesce(m.type = 'AMERICA', false) AS INTEGER) AS is_c7,
         CAST(coalesce(m.type = 'EUROPE', false) AS INTEGER) AS is_transport,
         CAST(coalesce(m.type = 'MIDDLE EAST', false) AS INTEGER) AS is_research,
         CAST(coalesce(m.type IN ('ASIA', 'AFRICA'), false) AS INTEGER) AS is_east,
         ln(1 + coalesce(p.n_papers, 0)) AS log_n_papers,
         ln(1 + coalesce(p.mean_patent_cit, 0)) AS log_mean_pat,
         CASE WHEN m.rank IS NOT NULL THEN ln(greatest(CAST(m.rank AS DOUBLE), 1.0)) END AS log_inst_rank,
         (p.year - 1995) / 6.0 AS year_norm,
         CAST(p.year - 1995 AS INTEGER) AS year_idx,
         CAST(p.year >= 1997 AS INTEGER) AS post_BRI,
         CAST(p.year >= 1998 AS INTEGER) AS post_MiC2025,
         CAST(p.year >= 1999 AS INTEGER) AS post_NEV,
         CAST(p.year >= 2000 AS INTEGER) AS post_COVID
  FROM panel p LEFT JOIN meta m ON p.entity = m.entity
),
prep AS (
  SELECT *,
         post_BRI * year_norm AS post_BRI_trend,
         pow(coalesce(research_novelty, 0), 2) AS novelty_sq,
         coalesce(tech_prox, 0) * is_transport AS tech_x_transport,
         coalesce(tech_prox, 0) * is_c9 AS tech_x_c9,
         coalesce(research_novelty, 0) * log_inst_rank AS novelty_x_rank,
         coalesce(oa_share, 0) * post_BRI AS oa_x_post,
         coalesce(oa_share, 0) * coalesce(tech_prox, 0) AS oa_x_tech,
         lag(log_mean_pat) OVER (PARTITION BY entity ORDER BY year) AS log_mean_pat_lag,
         CAST(coalesce(lag(state) OVER (PARTITION BY entity ORDER BY year) = 2, false) AS INTEGER) AS high_state_lag
  FROM prep0
)"""


def with_ctes(*ctes: str, body: str) -> str:
    if not ctes:
        return body
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
