"""Registered queries, part 7: text, topics and embeddings (operators 23, 34,
40, 51, 53, 54, 57a-b, 58-66, 100-108)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import md5_uniform, md5_uniform_sql
from ..functions.text import STOP_WORDS, clean_text
from ..operators import embeddings as EM
from ..operators import topics as TP
from ..operators.describe import shannon_entropy
from ..operators.convergence import prefix_sums
from ..operators.ranking import row_number_rank
from ..operators.topics import limit_features
from ..session import materialise
from ..sources.tables import read_table
from .common import R, finish, fixtures, sql_round_sig
from .registry import query

N_VOCAB = 40
N_DOMAINS = 4
REFERENCE_LABEL = 0  # embeddings with this label play the reference ("patent") vocabulary
MIN_CONFIRMED = 5

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
CLEAN_LIST = (
    "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), ' '), "
    f"lambda t: length(t) >= 3 AND NOT list_contains({STOP_SQL}, t))"
)
TOK_CTE = f"toks AS (SELECT doc_id, lang AS topic, source AS entity, CAST(doc_id % 10 = 0 AS INTEGER) AS imputed, {CLEAN_LIST} AS l FROM documents)"
G1 = "SELECT {k}, unnest(l) AS term FROM toks"
G2 = "SELECT {k}, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS term FROM toks"
G3 = "SELECT {k}, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS term FROM toks"


def grams(keys: str, n_max: int) -> str:
    parts = [G1, G2, G3][:n_max]
    return " UNION ALL ".join(p.format(k=keys) for p in parts)


VOCAB_CTE = (
    f"vocab AS (SELECT term, CAST(rk AS INTEGER) AS rk FROM (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS rk FROM "
    f"(SELECT term, count(*) AS n FROM ({G1.format(k='doc_id')} WHERE topic = 'en') GROUP BY term)) WHERE rk < {N_VOCAB})"
)
TAX_CTE = f"taxonomy AS (SELECT 'domain_' || CAST(rk % {N_DOMAINS} AS VARCHAR) AS domain, rk % {N_DOMAINS} AS domain_order, rk AS term_order, term FROM vocab)"


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R("WITH " + ",\n".join(ctes) + "\n" + body if ctes else body, doubles)


# ------------------------------------------------------------------ fixture views
def _docs(spark, sf):
    return fixtures.papers(spark, sf)


def _tokens(spark, sf):
    return fixtures._memo(spark, sf, "doc_tokens", lambda: TP.doc_tokens(_docs(spark, sf), "doc_id", "text", ["topic", "entity", "imputed"]))


def _terms(spark, sf):
    """1-3-grams by topic, without those too rare for c-TF-IDF and PMI; written once."""
    return fixtures._memo(spark, sf, "topic_terms", lambda: TP.topic_terms(_tokens(spark, sf)))


def _vocab(spark, sf):
    """The N_VOCAB most frequent cleaned terms of English documents, by a query."""

    def build():
        en = _tokens(spark, sf).where(F.col("topic") == "en").select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
        top = limit_features(materialise(en, "en_words"), N_VOCAB)  # at most N_VOCAB rows, so the window below is small
        return top.select("term", (F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1).cast("int").alias("rk"))

    return fixtures._memo(spark, sf, "vocab", build)


def _taxonomy(spark, sf):
    v = _vocab(spark, sf)
    d = F.col("rk") % N_DOMAINS
    return v.select(F.concat(F.lit("domain_"), d.cast("string")).alias("domain"), d.alias("domain_order"), F.col("rk").alias("term_order"), "term")


# ------------------------------------------------------------------ 57a, 57b
@query("clean_text", sql=_sql("SELECT doc_id, array_to_string(l, ' ') AS clean FROM toks", "", TOK_CTE))
def q_clean_text(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", clean_text(F.col("text")).alias("clean"))


# Ordered literal replacements of the label shortener (source -> short form).
SHORT_LABEL_RULES = [
    ("University of Chinese Academy of Sciences", "U. of CAS"),
    ("University of Science and Technology of China", "USTC"),
    ("Chinese Academy of Sciences", "CAS"),
    ("Huazhong University of Science and Technology", "HUST"),
    ("South China University of Technology", "S. China U. Tech."),
    ("University", "U."),
    ("Institute", "Inst."),
    ("of Technology", "Tech."),
    ("  ", " "),
]
LABEL_WIDTH = 22


def short_label(c):
    for a, b in SHORT_LABEL_RULES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.substring(c, 1, LABEL_WIDTH)


def _short_sql(col: str) -> str:
    s = col
    for a, b in SHORT_LABEL_RULES:
        s = f"replace({s}, '{a}', '{b}')"
    return f"substr({s}, 1, {LABEL_WIDTH})"


@query(
    "short_labels",
    sql=_sql(
        f"SELECT p_partkey, {_short_sql('name')} AS short_name, trim(split_part(p_type, '&', 1)) AS type_prefix FROM "
        f"(SELECT *, [{', '.join(repr(a) for a, _ in SHORT_LABEL_RULES)}, ''][CAST(p_partkey % {len(SHORT_LABEL_RULES) + 1} + 1 AS INTEGER)] || ' ' || p_name AS name FROM part)",
        "",
    ),
)
def q_short_labels(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    # each rule's long form before the names in turn, and none, so every rule is reached
    prefix = F.array(*[F.lit(a) for a, _ in SHORT_LABEL_RULES], F.lit(""))
    p = p.withColumn("p_name", F.concat(F.get(prefix, (F.col("p_partkey") % (len(SHORT_LABEL_RULES) + 1)).cast("int")), F.lit(" "), F.col("p_name")))
    return p.select("p_partkey", short_label(F.col("p_name")).alias("short_name"), F.trim(F.split_part(F.col("p_type"), F.lit("&"), F.lit(1))).alias("type_prefix"))


# ------------------------------------------------------------------ 58 vocabulary relevance
@query(
    "vocab_relevance",
    sql=_sql(
        """SELECT doc_id, s / (CASE WHEN (SELECT max(s) FROM allr) > 0 THEN (SELECT max(s) FROM allr) ELSE 1.0 END) AS relevance FROM allr""",
        "relevance",
        TOK_CTE,
        VOCAB_CTE,
        f"cnt AS (SELECT doc_id, term, count(*) AS n FROM ({G1.format(k='doc_id')}) WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term)",
        "dfv AS (SELECT term, count(*) AS df FROM cnt GROUP BY term)",
        "wts AS (SELECT c.doc_id, c.n * (ln((1.0 + (SELECT count(*) FROM toks)) / (1.0 + d.df)) + 1) AS w FROM cnt c JOIN dfv d ON c.term = d.term)",
        "per AS (SELECT doc_id, sum(w) / sqrt(sum(w * w)) AS s FROM wts GROUP BY doc_id)",
        "allr AS (SELECT t.doc_id, coalesce(p.s, 0.0) AS s FROM toks t LEFT JOIN per p ON t.doc_id = p.doc_id)",
    ),
)
def q_vocab_relevance(spark, sf):
    return finish(TP.vocab_relevance(_tokens(spark, sf), _vocab(spark, sf)))


# ------------------------------------------------------------------ 59 c-TF-IDF, 60 PMI
CT_CTES = [
    TOK_CTE,
    f"tc AS (SELECT topic, term, count(*) AS n FROM ({grams('topic', 3)}) GROUP BY topic, term)",
    "dfc AS (SELECT term, count(*) AS df, sum(n) AS total FROM tc GROUP BY term HAVING count(*) >= 2)",
    "voc AS (SELECT term FROM dfc)",
    "kept AS (SELECT t.topic, t.term, t.n FROM tc t JOIN voc v ON t.term = v.term)",
    "kdf AS (SELECT term, count(*) AS df FROM kept GROUP BY term)",
    "kn AS (SELECT count(DISTINCT topic) AS n_docs FROM kept)",
    "kw AS (SELECT k.topic, k.term, (1 + ln(k.n)) * (ln((1.0 + kn.n_docs) / (1.0 + d.df)) + 1) AS w FROM kept k JOIN kdf d ON k.term = d.term, kn)",
    "kwn AS (SELECT topic, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic)) AS w FROM kw)",
    "ct AS (SELECT topic, CAST(r AS INTEGER) AS rank, term, w AS score FROM (SELECT topic, term, w, row_number() OVER (PARTITION BY topic ORDER BY " + sql_round_sig("w") + " DESC, term) AS r FROM kwn) WHERE r <= 12)",
]
PMI_CTES = [
    f"dtb AS (SELECT DISTINCT doc_id, topic, term FROM ({grams('doc_id, topic', 2)}))",
    "pdf AS (SELECT term, count(*) AS total FROM dtb GROUP BY term HAVING count(*) >= 3)",
    "pvoc AS (SELECT term, total FROM pdf)",
    "tn AS (SELECT topic, count(*) AS nt FROM toks GROUP BY topic)",
    "dft AS (SELECT d.topic, d.term, count(*) AS dft FROM dtb d JOIN pvoc v ON d.term = v.term GROUP BY d.topic, d.term)",
    """pmi_all AS (SELECT t.topic, v.term, ln(greatest(coalesce(f.dft, 0) / CAST(t.nt AS DOUBLE), 1e-10))
        - ln(greatest(v.total / CAST((SELECT count(*) FROM toks) AS DOUBLE), 1e-10))
        - ln(greatest(t.nt / CAST((SELECT count(*) FROM toks) AS DOUBLE), 1e-10)) AS pmi
      FROM tn t CROSS JOIN pvoc v LEFT JOIN dft f ON f.topic = t.topic AND f.term = v.term)""",
    "pm AS (SELECT topic, term, pmi, CAST(r AS INTEGER) AS rank FROM (SELECT topic, term, pmi, row_number() OVER (PARTITION BY topic ORDER BY " + sql_round_sig("pmi") + " DESC, term) AS r FROM pmi_all) WHERE r <= 20)",
]


def _ct(spark, sf):
    return fixtures._memo(spark, sf, "ctfidf", lambda: TP.ctfidf(_terms(spark, sf)))


def _pm(spark, sf):
    return fixtures._memo(spark, sf, "pmi", lambda: TP.topic_pmi(_tokens(spark, sf), _terms(spark, sf)))


@query("ctfidf", sql=_sql("SELECT topic, rank, term, score FROM ct", "score", *CT_CTES))
def q_ctfidf(spark, sf):
    return finish(_ct(spark, sf))


@query("topic_pmi", sql=_sql("SELECT topic, term, pmi, rank FROM pm", "pmi", TOK_CTE, *PMI_CTES))
def q_topic_pmi(spark, sf):
    return finish(_pm(spark, sf).select("topic", "term", "pmi", "rank"))


def _union_sql(k: int, name: str) -> str:
    return (
        f"{name} AS (SELECT topic, term, CAST(row_number() OVER (PARTITION BY topic ORDER BY src, rk) AS INTEGER) AS pos FROM ("
        f"SELECT topic, term, min(src) AS src, arg_min(rk, src * 1000 + rk) AS rk FROM ("
        f"SELECT topic, term, 0 AS src, rank AS rk FROM ct WHERE rank <= {k} UNION ALL SELECT topic, term, 1 AS src, rank AS rk FROM pm WHERE rank <= {k}"
        f") GROUP BY topic, term))"
    )


@query("term_union", sql=_sql("SELECT topic, term, pos FROM u6", "", *CT_CTES, *PMI_CTES, _union_sql(6, "u6")))
def q_term_union(spark, sf):
    return TP.ordered_union(_ct(spark, sf), _pm(spark, sf), "topic", 6)


UMASS_CTES = [
    "ut AS (SELECT topic, term, CAST(row_number() OVER (PARTITION BY topic ORDER BY pos) AS INTEGER) AS i FROM u6 WHERE length(term) >= 3)",
    f"dt3 AS (SELECT DISTINCT doc_id, term FROM ({grams('doc_id', 3)}) WHERE term IN (SELECT term FROM ut WHERE i <= 10))",
    "dj AS (SELECT term, count(*) AS D FROM dt3 GROUP BY term)",
    """up AS (SELECT a.topic, a.term AS ti, b.term AS tj FROM ut a JOIN ut b ON a.topic = b.topic AND b.i < a.i WHERE a.i <= 10 AND b.i <= 10)""",
    "co AS (SELECT x.term AS ti, y.term AS tj, count(*) AS Dij FROM dt3 x JOIN dt3 y ON x.doc_id = y.doc_id GROUP BY x.term, y.term)",
]


@query(
    "umass",
    sql=_sql(
        """SELECT t.topic, coalesce(s.c, 0.0) AS coherence_umass FROM (SELECT DISTINCT topic FROM u6) t LEFT JOIN (
  SELECT p.topic, avg(ln((coalesce(c.Dij, 0) + 1.0) / (coalesce(d.D, 0) + 1e-10))) AS c
  FROM up p LEFT JOIN co c ON c.ti = p.ti AND c.tj = p.tj LEFT JOIN dj d ON d.term = p.tj GROUP BY p.topic) s ON t.topic = s.topic""",
        "coherence_umass",
        *CT_CTES,
        *PMI_CTES,
        _union_sql(6, "u6"),
        *UMASS_CTES,
    ),
)
def q_umass(spark, sf):
    u = TP.ordered_union(_ct(spark, sf), _pm(spark, sf), "topic", 6)
    return finish(TP.umass(u, _tokens(spark, sf), "topic"))


DM_CTES = [
    VOCAB_CTE,
    TAX_CTE,
    "ttok AS (SELECT topic, flatten(list(string_split(term, ' ') ORDER BY pos)) AS l FROM u10 GROUP BY topic)",
    "dtok AS (SELECT domain, domain_order, flatten(list(string_split(term, ' ') ORDER BY term_order)) AS l FROM taxonomy GROUP BY domain, domain_order)",
    """ddocs AS (SELECT t.topic, '__topic__' AS doc, -1 AS domain_order, t.l FROM ttok t
       UNION ALL SELECT t.topic, d.domain AS doc, d.domain_order, d.l FROM (SELECT DISTINCT topic FROM ttok) t CROSS JOIN dtok d)""",
    """dg AS (SELECT topic, doc, unnest(l) AS term FROM ddocs
       UNION ALL SELECT topic, doc, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS term FROM ddocs)""",
    "dc AS (SELECT topic, doc, term, count(*) AS n FROM dg GROUP BY topic, doc, term)",
    "ddf AS (SELECT topic, term, count(*) AS df FROM dc GROUP BY topic, term)",
    "dn AS (SELECT topic, count(DISTINCT doc) AS n_docs FROM dc GROUP BY topic)",
    "dw0 AS (SELECT c.topic, c.doc, c.term, (1 + ln(c.n)) * (ln((1.0 + n.n_docs) / (1.0 + f.df)) + 1) AS w FROM dc c JOIN ddf f ON c.topic = f.topic AND c.term = f.term JOIN dn n ON n.topic = c.topic)",
    "dw AS (SELECT topic, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic, doc)) AS w FROM dw0)",
    """dsim AS (SELECT d.topic, d.doc, sum(d.w * t.w) AS sim FROM dw d JOIN dw t ON t.topic = d.topic AND t.term = d.term AND t.doc = '__topic__'
       WHERE d.doc <> '__topic__' GROUP BY d.topic, d.doc)""",
    """dsc AS (SELECT a.topic, a.doc AS domain, a.domain_order, coalesce(s.sim, 0.0) AS sim FROM ddocs a LEFT JOIN dsim s ON s.topic = a.topic AND s.doc = a.doc
       WHERE a.doc <> '__topic__')""",
]


def _dm(spark, sf):
    u10 = TP.ordered_union(_ct(spark, sf), _pm(spark, sf), "topic", 10)
    return TP.domain_match(u10, _taxonomy(spark, sf), "topic")


@query(
    "domain_match",
    sql=_sql(
        "SELECT topic, domain, domain_order, sim, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY "
        + sql_round_sig("score")
        + " DESC, domain_order) AS INTEGER) AS rank FROM (SELECT topic, domain, domain_order, sim, sim / (max(sim) OVER (PARTITION BY topic) + 1e-12) AS score FROM dsc)",
        "sim score",
        *CT_CTES,
        *PMI_CTES,
        _union_sql(10, "u10"),
        *DM_CTES,
    ),
)
def q_domain_match(spark, sf):
    return finish(_dm(spark, sf))


@query("topic_profile")
def q_topic_profile(spark, sf):
    ct, pm = _ct(spark, sf), _pm(spark, sf)
    u6 = TP.ordered_union(ct, pm, "topic", 6)
    coh = TP.umass(u6, _tokens(spark, sf), "topic")
    dm = _dm(spark, sf)
    best = dm.where(F.col("rank") == 1).select("topic", "domain")
    top5 = dm.where(F.col("rank") <= 5).groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "score")))).alias("domain_scores"))
    cts = ct.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("ctfidf_terms"))
    pms = pm.where(F.col("rank") <= 12).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("pmi_terms"))
    prof = cts.join(pms, "topic", "full").join(best, "topic", "left").join(coh, "topic", "left").join(top5, "topic", "left")
    kws = F.when(F.size(F.coalesce("ctfidf_terms", F.array())) > 0, F.slice("ctfidf_terms", 1, 3)).otherwise(F.slice("pmi_terms", 1, 3))
    short = F.substring(F.trim(F.split_part(F.col("domain"), F.lit("&"), F.lit(1))), 1, 35)
    name = F.concat(F.lit("T"), F.col("topic"), F.lit(": "), short, F.lit(" ["), F.array_join(kws, ", "), F.lit("]"))
    return finish(prof.select("topic", name.alias("name"), "domain", "ctfidf_terms", "pmi_terms", "coherence_umass", "domain_scores"))


# ------------------------------------------------------------------ 65/66 entity text similarity
ENTTYPE_CTE = (
    "etype AS (SELECT entity, arg_min(topic, struct_pack(neg := -n, t := topic)) AS type FROM "
    "(SELECT entity, topic, count(*) AS n FROM toks GROUP BY entity, topic) GROUP BY entity)"
)


def _entity_types(spark, sf):
    c = _tokens(spark, sf).groupBy("entity", "topic").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("entity").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias("type"))


WT_CTES = [
    TOK_CTE,
    ENTTYPE_CTE,
    "nconf AS (SELECT e.entity, e.type, (SELECT count(*) FROM toks t WHERE t.entity = e.entity AND t.imputed = 0) AS nc FROM etype e)",
    f"ec AS (SELECT entity, term, count(*) AS n FROM ({grams('entity, imputed', 2)}) WHERE imputed = 0 GROUP BY entity, term)",
    f"own AS (SELECT c.entity, c.term, c.n FROM ec c JOIN nconf n ON c.entity = n.entity WHERE n.nc >= {MIN_CONFIRMED})",
    f"pooled AS (SELECT n.type, o.term, sum(o.n) AS n FROM own o JOIN nconf n ON o.entity = n.entity GROUP BY n.type, o.term)",
    f"prof AS (SELECT entity, term, n FROM own UNION ALL SELECT l.entity, p.term, p.n FROM nconf l JOIN pooled p ON p.type = l.type WHERE l.nc < {MIN_CONFIRMED})",
    "ptot AS (SELECT term, sum(n) AS total FROM prof GROUP BY term)",
    "pv AS (SELECT term FROM ptot)",
    "pk AS (SELECT p.entity, p.term, p.n FROM prof p JOIN pv v ON p.term = v.term)",
    "pdf2 AS (SELECT term, count(*) AS df FROM pk GROUP BY term)",
    "pn AS (SELECT count(DISTINCT entity) AS n_docs FROM pk)",
    "pw0 AS (SELECT k.entity, k.term, (1 + ln(k.n)) * (ln((1.0 + pn.n_docs) / (1.0 + d.df)) + 1) AS w FROM pk k JOIN pdf2 d ON k.term = d.term, pn)",
    "pw AS (SELECT entity, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity)) AS w FROM pw0)",
    "sim AS (SELECT a.entity AS i, b.entity AS j, sum(a.w * b.w) AS sim FROM pw a JOIN pw b ON a.term = b.term AND a.entity <> b.entity GROUP BY a.entity, b.entity)",
]


def _wtext(spark, sf):
    return fixtures._memo(spark, sf, "w_text", lambda: TP.entity_text_similarity(_tokens(spark, sf), _entity_types(spark, sf), MIN_CONFIRMED))


@query("w_text", sql=_sql("SELECT i, j, sim, sim / sum(sim) OVER (PARTITION BY i) AS w FROM sim", "sim w", *WT_CTES))
def q_w_text(spark, sf):
    s = _wtext(spark, sf)
    return finish(s.select("i", "j", "sim", (F.col("sim") / F.sum("sim").over(Window.partitionBy("i"))).alias("w")))


@query(
    "w_text_discrimination",
    sql=_sql(
        """SELECT avg(h) AS mean_entropy, ln((SELECT count(*) FROM etype) - 1) AS max_entropy, 1 - avg(h) / ln((SELECT count(*) FROM etype) - 1) AS discrimination_ratio
FROM (SELECT e.entity, coalesce(x.h, 0.0) AS h FROM etype e LEFT JOIN (
  SELECT i, -sum(p * ln(p)) AS h FROM (SELECT i, sim / (sum(sim) OVER (PARTITION BY i) + 1e-10) AS p FROM sim) WHERE p > 0 GROUP BY i) x ON e.entity = x.i)""",
        "mean_entropy max_entropy discrimination_ratio",
        *WT_CTES,
    ),
)
def q_w_text_disc(spark, sf):
    return finish(TP.discrimination_ratio(_wtext(spark, sf), _entity_types(spark, sf).select("entity")))


# ------------------------------------------------------------------ 23 alias match, 34 support, 100-101
ALIAS_CTE = "alias AS (SELECT source AS entity, lower(source) AS alias, CAST(row_number() OVER (ORDER BY " + md5_uniform_sql("source", salt="alias") + ", source) AS INTEGER) AS priority FROM (SELECT DISTINCT source FROM documents))"


def _aliases(spark, sf):
    src = read_table(spark, sf, "documents").select("source").distinct()
    r = row_number_rank(src.withColumn("_k", md5_uniform("source", salt="alias")), "_k", "source", "priority")
    return r.select(F.col("source").alias("entity"), F.lower("source").alias("alias"), F.col("priority").cast("int").alias("priority"))


def alias_match(texts, aliases, text_col: str, id_col: str, mode: str = "priority", word_border: bool = False):
    """Containment join text x alias: first alias (by priority) contained in the
    lower-cased text, or the longest one in ``longest`` mode; with ``word_border`` only
    where no letter or digit touches it.

    An equi-join: each distinct text gives its substrings of the lengths that aliases
    have (their number is bounded by the longest alias), and those meet the aliases."""
    lengths = sorted(r[0] for r in aliases.select(F.length("alias")).distinct().collect() if r[0])
    t = texts.select(id_col, F.lower(F.col(text_col)).alias("_t"))
    size = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    places = F.transform(size, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - n + 1, F.lit(1))), lambda p: F.struct(p.alias("p"), n.alias("n"))))
    subs = t.select("_t").distinct().select("_t", F.explode(F.flatten(places)).alias("_x")).select("_t", F.col("_x.p").alias("_p"), F.substr("_t", F.col("_x.p"), F.col("_x.n")).alias("alias"))
    if word_border:
        side = lambda p: F.substr("_t", p, F.lit(1)).rlike(r"^[\p{L}\p{N}]")
        subs = subs.where(~(F.when(F.col("_p") > 1, side(F.col("_p") - 1)).otherwise(False)) & ~side(F.col("_p") + F.length("alias")))
    hits = t.join(subs.select("_t", "alias").distinct().join(aliases, "alias"), "_t")
    key = F.struct(F.col("priority")) if mode == "priority" else F.struct(-F.length("alias"), F.col("priority"))
    best = hits.groupBy(id_col).agg(F.min_by("entity", key).alias("matched"))
    return texts.select(id_col).join(best, id_col, "left")


@query(
    "alias_match",
    sql=_sql(
        """SELECT d.doc_id, (SELECT arg_min(a.entity, a.priority) FROM alias a WHERE instr(lower(d.source), a.alias) > 0) AS matched,
  (SELECT arg_min(a.entity, struct_pack(l := -length(a.alias), p := a.priority)) FROM alias a WHERE instr(lower(d.source), a.alias) > 0) AS matched_longest
FROM documents d""",
        "",
        ALIAS_CTE,
    ),
)
def q_alias_match(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    al = _aliases(spark, sf)
    a = alias_match(d, al, "source", "doc_id", "priority")
    b = alias_match(d, al, "source", "doc_id", "longest").withColumnRenamed("matched", "matched_longest")
    return a.join(b, "doc_id")


@query(
    "paper_filter",
    sql=_sql(
        "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_papers FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 "
        "AND l_quantity IS NOT NULL GROUP BY year(l_shipdate)",
        "",
    ),
)
def q_paper_filter(spark, sf):
    """Year-range filter expressed as a timestamp range, so it reaches the Parquet
    scan as pushed predicates (row groups outside the years are skipped)."""
    li = read_table(spark, sf, "lineitem").select("l_shipdate", "l_quantity")
    lo, hi = F.lit("1996-01-01 00:00:00").cast("timestamp"), F.lit("2001-01-01 00:00:00").cast("timestamp")
    kept = li.where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi) & F.col("l_quantity").isNotNull())
    return kept.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n_papers"))


PRIOR_SLOTS = 1 << 16
PRIOR_CTES = [
    "prior AS (SELECT source AS entity, count(*) AS prior_n FROM documents WHERE doc_id % 10 <> 0 GROUP BY source)",
    f"""pcum AS (SELECT entity, (sum(prior_n) OVER w - prior_n) / CAST(sum(prior_n) OVER () AS DOUBLE) AS lo,
       sum(prior_n) OVER w / CAST(sum(prior_n) OVER () AS DOUBLE) AS hi FROM prior
       WINDOW w AS (ORDER BY {md5_uniform_sql('entity', salt='order')}, entity ROWS UNBOUNDED PRECEDING))""",
]


@query(
    "prior_impute",
    sql=_sql(
        f"""SELECT d.doc_id, p.entity AS entity_imputed, 1 AS imputed FROM (SELECT doc_id, {md5_uniform_sql('doc_id', salt='prior')} AS u FROM documents WHERE doc_id % 10 = 0) d
JOIN pcum p ON d.u >= p.lo AND d.u < p.hi""",
        "",
        *PRIOR_CTES,
    ),
)
def q_prior_impute(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    prior = d.where(F.col("doc_id") % 10 != 0).groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("prior_n"))
    # entities in the order of a hash (evenly spread, so the rank helper's buckets are
    # even), running sums per bucket of positions
    ranked = row_number_rank(prior.withColumn("_k", md5_uniform("entity", salt="order")), "_k", "entity", "_r")
    cum = prefix_sums(ranked.select("entity", "prior_n", "_r"), "_r", [], ["prior_n"], 4096)
    tot = prior.agg(F.sum("prior_n")).scalar().cast("double")
    cum = cum.select("entity", ((F.col("cum_prior_n") - F.col("prior_n")) / tot).alias("lo"), (F.col("cum_prior_n") / tot).alias("hi"))
    # [0, 1) in slots: a range lies in all slots it touches, a uniform in one
    slot = lambda x: F.floor(x * F.lit(PRIOR_SLOTS)).cast("long")
    cum = cum.withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    miss = d.where(F.col("doc_id") % 10 == 0).select("doc_id", md5_uniform(F.col("doc_id"), salt="prior").alias("u")).withColumn("slot", slot(F.col("u")))
    out = miss.join(cum, "slot").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return out.select("doc_id", F.col("entity").alias("entity_imputed"), F.lit(1).alias("imputed"))


# ------------------------------------------------------------------ 105-108 embeddings
EMB_CTES = [
    "emb AS (SELECT vec_id, vec_id % 20 AS entity, CAST(1995 + vec_id % 7 AS INTEGER) AS year, label AS topic, embedding FROM embeddings)",
    "ev AS (SELECT vec_id, entity, year, topic, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM emb)",
]


def _emb(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 20).alias("entity"), (F.lit(1995) + F.col("vec_id") % 7).cast("int").alias("year"), F.col("label").alias("topic"), "embedding")


def _ev(spark, sf):
    return EM.long_vectors(_emb(spark, sf), "vec_id", "embedding", ["entity", "year", "topic"])


@query(
    "tech_proximity",
    sql=_sql(
        f"""SELECT entity, year, avg(cos) AS tech_prox, count(*) AS n FROM (
  SELECT v.vec_id, v.entity, v.year, sum(v.x * c.c) / (sqrt(sum(v.x * v.x)) * (SELECT sqrt(sum(c * c)) FROM cen)) AS cos
  FROM ev v JOIN cen c ON v.k = c.k GROUP BY v.vec_id, v.entity, v.year) GROUP BY entity, year""",
        "tech_prox",
        *EMB_CTES,
        f"cen AS (SELECT k, avg(x) AS c FROM ev WHERE topic = {REFERENCE_LABEL} GROUP BY k)",
    ),
)
def q_tech_proximity(spark, sf):
    ev = _ev(spark, sf)
    cos = EM.cosine_to_centroid(ev, ev.where(F.col("topic") == REFERENCE_LABEL), "vec_id", ["entity", "year"])
    return finish(cos.groupBy("entity", "year").agg(F.avg("cos").alias("tech_prox"), F.count(F.lit(1)).alias("n")))


@query(
    "novelty",
    sql=_sql(
        """SELECT entity, year, avg(nov) AS research_novelty, count(*) AS n FROM (
  SELECT v.vec_id, v.entity, v.year, 1 - sum(v.x * p.p) / (sqrt(sum(v.x * v.x)) * max(pn.pn)) AS nov
  FROM ev v JOIN prev p ON v.year = p.year AND v.k = p.k JOIN pnorm pn ON pn.year = v.year GROUP BY v.vec_id, v.entity, v.year) GROUP BY entity, year""",
        "research_novelty",
        *EMB_CTES,
        "ys AS (SELECT year, k, sum(x) AS s FROM ev GROUP BY year, k)",
        "prev AS (SELECT year, k, p FROM (SELECT year, k, sum(s) OVER (PARTITION BY k ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ys) WHERE p IS NOT NULL)",
        "pnorm AS (SELECT year, sqrt(sum(p * p)) AS pn FROM prev GROUP BY year)",
    ),
)
def q_novelty(spark, sf):
    nov = EM.novelty(_ev(spark, sf), "vec_id", "year", ["entity"])
    return finish(nov.groupBy("entity", "year").agg(F.avg("novelty").alias("research_novelty"), F.count(F.lit(1)).alias("n")))


@query(
    "topic_entropy",
    sql=_sql(
        """SELECT entity, year, -sum(p * ln(p)) AS entropy FROM (
  SELECT entity, year, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity, year) AS p FROM (SELECT entity, year, topic, count(*) AS n FROM emb GROUP BY entity, year, topic))
GROUP BY entity, year""",
        "entropy",
        *EMB_CTES,
    ),
)
def q_topic_entropy(spark, sf):
    return finish(shannon_entropy(_emb(spark, sf), ["entity", "year"], "topic"))


@query(
    "cohesion",
    sql=_sql(
        """SELECT s.entity, s.year, n.n, (s.ss - n.n) / (n.n * (n.n - 1.0)) AS intra_cohesion FROM
(SELECT entity, year, sum(su * su) AS ss FROM (SELECT entity, year, k, sum(u) AS su FROM eu GROUP BY entity, year, k) GROUP BY entity, year) s
JOIN (SELECT entity, year, count(DISTINCT vec_id) AS n FROM eu GROUP BY entity, year) n ON s.entity = n.entity AND s.year = n.year WHERE n.n >= 2""",
        "intra_cohesion",
        *EMB_CTES,
        "eu AS (SELECT v.vec_id, v.entity, v.year, v.k, v.x / m.nrm AS u FROM ev v JOIN (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM ev GROUP BY vec_id) m ON v.vec_id = m.vec_id)",
    ),
)
def q_cohesion(spark, sf):
    return finish(EM.cohesion(_ev(spark, sf), "vec_id", ["entity", "year"]))
