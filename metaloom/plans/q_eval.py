"""Evaluation, usage accounting and evaluation-set construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_literal, valid_vector
from ..operators import casebuild as CB
from ..operators import evaluation as EV
from ..operators import hierarchy as H
from ..operators import identity as I
from ..operators import search as S
from .q_search import SCORED_SQL
from .registry import Registry
from .tables import query_set, search_index, table

R = Registry()
VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
VSQL = "[" + ", ".join(f"{v}::DOUBLE" for v in VECTOR) + "]"
COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VSQL})"


@R.query("dense_cosine_topk", f"SELECT vec_id, round({COS}, 5) AS score FROM embeddings ORDER BY round({COS}, 9) DESC, vec_id LIMIT 20")
def dense_cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings").where(valid_vector(F.col("embedding"), 64))
    top = e.select("vec_id", F.round(cosine_literal(F.col("embedding"), VECTOR), 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    return top.withColumn("score", F.round("score", 5))


@R.query("dense_threshold", f"SELECT label, count(*) AS hits, round(max({COS}), 5) AS best FROM embeddings WHERE round({COS}, 9) >= 0.1 GROUP BY label")
def dense_threshold(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.round(cosine_literal(F.col("embedding"), VECTOR), 9).alias("score")).where("score >= 0.1")
    return e.groupBy("label").agg(F.count("*").alias("hits"), F.round(F.max("score"), 5).alias("best"))


# Judged results: the served top 8 of every query against document labels.
JUDGED_SQL = f"""{SCORED_SQL},
rt AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'left' ELSE 'right' END AS system, query_id AS case_id, CAST(doc_id AS VARCHAR) AS item, rank FROM tp JOIN ipg USING (path) WHERE rank <= 8),
gd AS (SELECT DISTINCT doc_id % 40 AS case_id, CAST(doc_id AS VARCHAR) AS item, CASE WHEN toxic = 1 THEN 'forbidden' WHEN quality = 1 THEN 'required' ELSE 'allowed' END AS role FROM labels),
js AS (SELECT rt.*, role FROM rt LEFT JOIN gd USING (case_id, item)),
pc AS (SELECT system, case_id, count(DISTINCT item) AS returned, count(*) FILTER (role = 'required') AS matched, count(*) FILTER (role IN ('required', 'allowed')) AS acceptable, count(*) FILTER (role = 'forbidden') AS forbidden FROM js GROUP BY ALL),
rq AS (SELECT case_id, count(*) AS required FROM gd WHERE role = 'required' GROUP BY ALL),
sc2 AS (SELECT system, pc.case_id, coalesce(required, 0) AS required, returned, matched, acceptable, forbidden, round(matched / nullif(coalesce(required, 0), 0), 6) AS recall, round(acceptable / nullif(returned, 0), 6) AS precision FROM pc LEFT JOIN rq USING (case_id)),
sc3 AS (SELECT *, CASE WHEN precision + coalesce(recall, 0) > 0 THEN round(2 * precision * coalesce(recall, 0) / (precision + coalesce(recall, 0)), 6) ELSE 0 END AS f1 FROM sc2)"""


def judged(spark, sf):
    """Returned items and gold sets; every labelled document is gold for one case."""
    queries = query_set(spark, sf)
    hits = S.search_many(search_index(spark, sf), queries).withColumn("item", F.substring_index("path", "/", -1))
    returned = hits.select(F.when(F.col("query_id") % 2 == 0, "left").otherwise("right").alias("system"), F.col("query_id").alias("case_id"), "item")
    role = F.when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 1, "required").otherwise("allowed")
    gold = table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("case_id"), F.col("doc_id").cast("string").alias("item"), role.alias("role"))
    return returned, gold.distinct(), hits


@R.query("case_scores", f"WITH {JUDGED_SQL} SELECT * FROM sc3")
def case_scores(spark, sf):
    returned, gold, _ = judged(spark, sf)
    return EV.score_cases(returned, gold)


@R.query(
    "eval_micro_prf",
    f"""WITH {JUDGED_SQL}, t AS (SELECT system, CAST(sum(required) AS BIGINT) AS required, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(acceptable) AS BIGINT) AS acceptable, count(*) AS runs FROM sc3 GROUP BY ALL),
    u AS (SELECT *, round(matched / nullif(required, 0), 6) AS recall, coalesce(round(acceptable / nullif(returned, 0), 6), CASE WHEN required > 0 THEN 0.0::DOUBLE END) AS precision FROM t)
    SELECT *, CASE WHEN recall > 0 AND precision > 0 THEN round(2 * recall * precision / (recall + precision), 6) WHEN required > 0 THEN 0.0::DOUBLE END AS f1 FROM u""",
)
def eval_micro_prf(spark, sf):
    returned, gold, _ = judged(spark, sf)
    return EV.micro_scores(EV.score_cases(returned, gold), ["system"])


@R.query(
    "recall_at_k",
    f"""WITH {JUDGED_SQL}, e AS (SELECT count(*) AS n FROM gd WHERE role <> 'forbidden') SELECT k, count(*) FILTER (rank <= k) AS found, n AS expected, round(count(*) FILTER (rank <= k) / n, 6) AS recall
    FROM (SELECT rank FROM rt JOIN gd USING (case_id, item) WHERE role <> 'forbidden'), (SELECT unnest([1::BIGINT, 3::BIGINT, 8::BIGINT]) AS k), e GROUP BY k, n""",
)
def recall_at_k(spark, sf):
    _, gold, hits = judged(spark, sf)
    good = gold.where("role <> 'forbidden'").select(F.col("case_id").alias("query_id"), "item")
    return EV.recall_at(hits.select("query_id", "item", "rank"), good, [1, 3, 8])


# Two systems asked for the parts of each customer: what came, resolved or not, against required, optional and forbidden parts.
ENTITY_SQL = """ru AS (SELECT system, c_custkey AS case_id, c_custkey % 17 <> 3 AS valid, c_acctbal < 0 AS expected_empty, c_mktsegment <> 'BUILDING' AS annotated,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 101 END AS tokens, c_custkey % 13 <> 0 AS complete FROM customer, (SELECT unnest(['left', 'right']) AS system)),
li AS (SELECT o_custkey AS case_id, 'part:' || l_partkey AS item, 'supplier:' || l_suppkey AS supplier, l_linenumber AS n, l_quantity AS q, l_tax AS tax, l_discount AS dc, l_returnflag AS flag, c_acctbal < 0 AS empty
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
gd AS (SELECT case_id, item, p_brand AS type, ['required', 'optional', 'forbidden'][min(CASE WHEN n = 1 THEN 1 WHEN flag = 'R' THEN 3 ELSE 2 END)] AS role FROM li JOIN part ON item = 'part:' || p_partkey WHERE n <= 2 AND NOT empty GROUP BY ALL),
en AS (SELECT CASE WHEN q > 25 THEN 'left' ELSE 'right' END AS system, case_id, CASE WHEN tax < 0.08 THEN item END AS item, CASE WHEN tax >= 0.08 THEN 'untyped:' || item END AS unknown FROM li WHERE n IN (1, CASE WHEN q > 25 THEN 3 ELSE 2 END) AND (NOT empty OR q < 10)),
rl AS (SELECT CASE WHEN q > 25 THEN 'left' ELSE 'right' END AS system, case_id, item AS source, CASE WHEN tax < 0.08 THEN supplier END AS target, item || '>' || supplier AS raw FROM li WHERE n = 1 AND dc < 0.05 AND NOT empty),
gr AS (SELECT DISTINCT case_id, item AS source, supplier AS target FROM li WHERE n = 1 AND flag <> 'N' AND NOT empty),
c1 AS (SELECT system, case_id, count(DISTINCT item) AS named, count(DISTINCT unknown) AS unknown, count(DISTINCT item) FILTER (role = 'required') AS matched, count(DISTINCT item) FILTER (role IN ('required', 'optional')) AS acceptable,
  count(DISTINCT item) FILTER (role = 'forbidden') AS forbidden FROM en LEFT JOIN gd USING (case_id, item) GROUP BY ALL),
c2 AS (SELECT system, case_id, count(DISTINCT CASE WHEN rl.target IS NULL THEN raw END) + count(DISTINCT CASE WHEN rl.target IS NOT NULL THEN raw END) AS told, count(DISTINCT CASE WHEN gr.case_id IS NOT NULL THEN raw END) AS hit
  FROM rl LEFT JOIN gr USING (case_id, source, target) GROUP BY ALL),
c3 AS (SELECT case_id, count(*) FILTER (role = 'required') AS required FROM gd GROUP BY ALL), c4 AS (SELECT case_id, count(*) AS wanted FROM gr GROUP BY ALL),
j AS (SELECT ru.*, coalesce(required, 0) AS required, coalesce(named, 0) + coalesce(unknown, 0) AS returned, CASE WHEN valid THEN coalesce(matched, 0) ELSE 0 END AS matched, CASE WHEN valid THEN coalesce(acceptable, 0) ELSE 0 END AS acceptable,
  coalesce(forbidden, 0) AS forbidden, coalesce(unknown, 0) AS unknown, coalesce(wanted, 0) AS relation_required, coalesce(told, 0) AS relation_returned, CASE WHEN valid THEN coalesce(hit, 0) ELSE 0 END AS relation_matched
  FROM ru LEFT JOIN c1 USING (system, case_id) LEFT JOIN c2 USING (system, case_id) LEFT JOIN c3 USING (case_id) LEFT JOIN c4 USING (case_id)),
k AS (SELECT *, matched / nullif(required, 0) AS r, CASE WHEN valid AND returned > 0 THEN acceptable / returned WHEN valid AND required = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p,
  relation_matched / nullif(relation_required, 0) AS rr, coalesce(relation_matched / nullif(relation_returned, 0), CASE WHEN relation_required > 0 THEN 0.0::DOUBLE END) AS rp FROM j),
es AS (SELECT * EXCLUDE (r, p, rr, rp), round(r, 6) AS recall, CASE WHEN NOT (expected_empty AND returned = 0) THEN round(p, 6) END AS precision,
  CASE WHEN NOT expected_empty THEN CASE WHEN r > 0 AND p > 0 THEN round(2 * r * p / (r + p), 6) ELSE 0.0::DOUBLE END END AS f1,
  CASE WHEN expected_empty THEN valid AND returned = 0 AND relation_returned = 0 END AS negative_correct, CASE WHEN expected_empty THEN returned + relation_returned > 0 END AS negative_false_positive,
  CASE WHEN annotated THEN round(rr, 6) END AS relation_recall, CASE WHEN annotated THEN round(rp, 6) END AS relation_precision,
  CASE WHEN annotated THEN CASE WHEN rr > 0 AND rp > 0 THEN round(2 * rr * rp / (rr + rp), 6) WHEN relation_required > 0 THEN 0.0::DOUBLE END END AS relation_f1 FROM k)"""


def entity_runs(spark, sf):
    """Runs, returned entities, gold, returned relations and gold relations of two systems over all customers."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    runs = c.select(
        F.explode(F.array(F.lit("left"), F.lit("right"))).alias("system"), key.alias("case_id"), (key % 17 != 3).alias("valid"), (F.col("c_acctbal") < 0).alias("expected_empty"), (F.col("c_mktsegment") != "BUILDING").alias("annotated"),
        F.when(key % 13 != 0, key % 101).alias("tokens"), (key % 13 != 0).alias("complete"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c.select("c_custkey", (F.col("c_acctbal") < 0).alias("empty")), F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        key.alias("case_id"), F.concat(F.lit("part:"), "l_partkey").alias("item"), F.concat(F.lit("supplier:"), "l_suppkey").alias("supplier"), "l_partkey", F.col("l_linenumber").alias("n"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("dc"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") > 25).alias("large"), (F.col("l_quantity") < 10).alias("few"), "empty",
    )
    system = F.when(F.col("large"), "left").otherwise("right")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("type"))
    roles = F.array(F.lit("required"), F.lit("optional"), F.lit("forbidden"))
    gold = li.where("n <= 2 AND NOT empty").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("case_id", "item", "type").agg(
        F.element_at(roles, F.min(F.when(F.col("n") == 1, 1).when(F.col("flag") == "R", 3).otherwise(2))).alias("role")
    )
    came = li.where("(n = 1 OR n = IF(large, 3, 2)) AND (NOT empty OR few)")
    entities = came.select(system.alias("system"), "case_id", F.when(F.col("tax") < 0.08, F.col("item")).alias("item"), F.when(F.col("tax") >= 0.08, F.concat(F.lit("untyped:"), "item")).alias("unknown"))
    first = li.where("n = 1 AND NOT empty")
    told = first.where("dc < 0.05").select(
        system.alias("system"), "case_id", F.col("item").alias("source"), F.lit("SUPPLIED_BY").alias("relation"), F.when(F.col("tax") < 0.08, F.col("supplier")).alias("target"), F.concat("item", F.lit(">"), "supplier").alias("unknown")
    )
    wanted = first.where("flag <> 'N'").select("case_id", F.col("item").alias("source"), F.lit("SUPPLIED_BY").alias("relation"), F.col("supplier").alias("target"))
    return runs, entities, gold, told, wanted


@R.query("entity_scores", f"WITH {ENTITY_SQL} SELECT * FROM es")
def entity_scores(spark, sf):
    return EV.entity_scores(*entity_runs(spark, sf))


@R.query(
    "entity_type_scores",
    f"""WITH {ENTITY_SQL}, a AS (SELECT DISTINCT system, case_id, item FROM en WHERE item IS NOT NULL)
    SELECT ru.system, type, count(*) AS required, count(*) FILTER (valid AND a.item IS NOT NULL) AS matched, round(count(*) FILTER (valid AND a.item IS NOT NULL) / count(*), 6) AS recall
    FROM ru JOIN gd USING (case_id) LEFT JOIN a ON a.system = ru.system AND a.case_id = ru.case_id AND a.item = gd.item WHERE role = 'required' GROUP BY ALL""",
)
def entity_type_scores(spark, sf):
    runs, entities, gold, _, _ = entity_runs(spark, sf)
    return EV.entity_type_scores(runs, entities, gold)


@R.query(
    "eval_macro",
    f"""WITH {ENTITY_SQL} SELECT system, count(*) AS runs, count(*) FILTER (valid) AS valid_runs, round(avg(recall), 6) AS recall_macro, round(avg(precision), 6) AS precision_macro, round(avg(tokens), 6) AS tokens_mean, median(tokens) AS tokens_median,
    count(*) FILTER (complete) AS complete_runs, CAST(sum(forbidden) AS BIGINT) AS forbidden_returns, CAST(sum(unknown) AS BIGINT) AS unknown_returns FROM es GROUP BY system""",
)
def eval_macro(spark, sf):
    return EV.macro_scores(EV.entity_scores(*entity_runs(spark, sf)), ["system"])


@R.query(
    "eval_grouping_sets",
    """SELECT lang, source, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS low, max(n_chars) AS high, count(n_chars) AS measured, count(*) AS expected, count(n_chars) = count(*) AS complete,
    CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
)
def eval_grouping_sets(spark, sf):
    return EV.grouped_report(table(spark, sf, "documents"), ["lang", "source"], "n_chars")


@R.query(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = CAST(floor(n * 0.5::DOUBLE) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN value END) AS p95, max(n) AS n FROM r GROUP BY ALL""",
)
def latency_percentiles(spark, sf):
    return EV.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@R.query(
    "amortized_cost",
    """WITH s AS (SELECT event_type AS system, avg(value) AS q, sum(value) AS b FROM events GROUP BY ALL) SELECT system, n, round(q + b / n, 4) AS cost FROM s, (SELECT unnest([1::BIGINT, 10::BIGINT, 100::BIGINT, 1000::BIGINT]) AS n)""",
)
def amortized_cost(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("system")).agg(F.avg("value").alias("query_cost"), F.sum("value").alias("build_cost"))
    return EV.amortized(s).withColumn("cost", F.round("cost", 4))


@R.query(
    "paired_deltas",
    f"WITH {JUDGED_SQL}, m AS (SELECT system, avg(recall) AS r, avg(precision) AS p FROM sc3 GROUP BY ALL) SELECT round(max(r) FILTER (system = 'left') - max(r) FILTER (system = 'right'), 6) AS delta_recall, round(max(p) FILTER (system = 'left') - max(p) FILTER (system = 'right'), 6) AS delta_precision FROM m",
)
def paired_deltas(spark, sf):
    returned, gold, _ = judged(spark, sf)
    macro = EV.score_cases(returned, gold).groupBy("system").agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    return EV.paired_deltas(macro, "left", "right", ["recall", "precision"])


@R.query(
    "tool_counts",
    """WITH c AS (SELECT DISTINCT user_id AS run, CAST(event_id AS VARCHAR) AS call_id, CASE event_type WHEN 'click' THEN 'data_search' WHEN 'view' THEN 'Read_file' WHEN 'purchase' THEN 'data_expand' WHEN 'signup' THEN 'grep' ELSE 'write' END AS tool FROM events)
    SELECT run, count(*) AS total, count(*) FILTER (tool IN ('data_search', 'grep')) AS search, count(*) FILTER (tool = 'data_expand') AS expand, count(*) FILTER (tool = 'Read_file') AS read, count(*) FILTER (tool <> 'write') AS retrieval FROM c GROUP BY ALL""",
)
def tool_counts(spark, sf):
    ev = table(spark, sf, "events")
    t = F.col("event_type")
    tool = F.when(t == "click", "data_search").when(t == "view", "Read_file").when(t == "purchase", "data_expand").when(t == "signup", "grep").otherwise("write")
    calls = ev.select(F.col("user_id").alias("run"), F.col("event_id").cast("string").alias("call_id"), tool.alias("tool"))
    return EV.tool_counts(calls.unionByName(calls))  # every event is reported twice


@R.query(
    "token_usage",
    """WITH c AS (SELECT user_id AS run, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CASE WHEN value < 0.05 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS o FROM events)
    SELECT run, CASE WHEN NOT bad THEN i END AS input_tokens, CASE WHEN NOT bad THEN o END AS output_tokens, CASE WHEN NOT bad THEN i + o END AS total_tokens FROM (SELECT run, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, bool_or(i IS NULL OR o IS NULL) AS bad FROM c GROUP BY ALL)""",
)
def token_usage(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").cast("string").alias("call_id"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        F.when(F.col("value") >= 0.05, F.floor("value")).alias("output_tokens"),
    )
    return EV.token_usage(ev)


@R.query(
    "reserved_tokens",
    """SELECT user_id AS run, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + greatest(CAST(floor(value) AS BIGINT), 64) END) AS BIGINT) AS tokens, bool_and(event_type = 'click') AS complete, count(*) AS calls FROM events GROUP BY ALL""",
)
def reserved_tokens(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.when(F.col("event_type") == "click", F.floor("value")).alias("reported"), F.get_json_object("props", "$.k").cast("long").alias("input_estimate"), F.floor("value").alias("output_estimate")
    )
    return EV.reserved_tokens(ev, 64)


@R.query(
    "branch_recall",
    """WITH b AS (SELECT o_custkey AS query_id, o_orderpriority AS branch, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY o_custkey, o_orderpriority),
    e AS (SELECT DISTINCT o_custkey AS query_id, o_orderpriority AS branch FROM orders WHERE o_totalprice > 300000), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY ALL),
    h AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) AS hk FROM b JOIN e USING (query_id, branch) GROUP BY ALL)
    SELECT query_id, round(h1 / n, 6) AS recall_at_1, round(h3 / n, 6) AS recall_at_3, round(hk / n, 6) AS recall_at_k, round(h3 / 3, 6) AS precision_at_3 FROM n JOIN h USING (query_id)""",
)
def branch_recall(spark, sf):
    from ..scale import top_per_group

    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "query_id").withColumnRenamed("o_orderpriority", "branch")
    counted = o.groupBy("query_id", "branch").agg(F.count("*").alias("n"))
    ranked = top_per_group(counted, ["query_id"], [F.desc("n"), F.asc("branch")], 5)
    return EV.branch_metrics(ranked.select("query_id", "branch", "rank"), o.where("o_totalprice > 300000").select("query_id", "branch"))


@R.query(
    "golden_gate",
    f"""WITH {JUDGED_SQL}, m AS (SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, CAST(sum(forbidden) AS BIGINT) AS forbidden FROM sc3)
    SELECT 'recall below 1.0: ' || CAST(recall AS VARCHAR) AS reason FROM m WHERE recall < 1 UNION ALL SELECT 'forbidden above 0: ' || forbidden FROM m WHERE forbidden > 0""",
)
def golden_gate(spark, sf):
    returned, gold, _ = judged(spark, sf)
    report = EV.score_cases(returned, gold).agg(F.round(F.avg("recall"), 6).alias("recall"), F.sum("forbidden").alias("forbidden"))
    return EV.golden_gate(report, {"recall": 1.0}, {"forbidden": 0})


# ----------------------------------------------------------------------------- construction <- orders graph
# customers are purposes, orders metrics, suppliers physical models, parts fields, nations business objects
def build_entities(spark, sf):
    kinds = (("customer", "c_custkey", "purposes", F.col("c_name")), ("orders", "o_orderkey", "metrics", F.concat(F.lit("order "), "o_orderkey")),
             ("supplier", "s_suppkey", "physical_models", F.col("s_name")), ("part", "p_partkey", "fields", F.col("p_name")), ("nation", "n_nationkey", "business_objects", F.col("n_name")))
    out = None
    for name, key, kind, label in kinds:
        part = table(spark, sf, name).select(F.concat(F.lit(name[0] + ":"), key).alias("id"), F.lit(kind).alias("type"), label.alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def build_edges(spark, sf):
    o, li, s = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    nid = lambda p, c: F.concat(F.lit(p), c)
    return (
        o.select(nid("c:", "o_custkey").alias("source"), F.lit("requires_metric").alias("relation"), nid("o:", "o_orderkey").alias("target"))
        .unionByName(li.select("l_orderkey", "l_suppkey").distinct().select(nid("o:", "l_orderkey").alias("source"), F.lit("supported_by").alias("relation"), nid("s:", "l_suppkey").alias("target")))
        .unionByName(s.select(nid("s:", "s_suppkey").alias("source"), F.lit("belongs_to_object").alias("relation"), nid("n:", "s_nationkey").alias("target")))
    )


EDGE_SQL = """
ed AS (SELECT 'c:' || o_custkey AS source, 'requires_metric' AS relation, 'o:' || o_orderkey AS target FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'supported_by', 's:' || l_suppkey FROM lineitem
  UNION ALL SELECT 's:' || s_suppkey, 'belongs_to_object', 'n:' || s_nationkey FROM supplier),
mo AS (SELECT 'metric_to_model' AS category, source AS anchor, '' AS direction, 1 AS hop, source, relation, target FROM ed WHERE relation = 'supported_by'
  UNION ALL SELECT 'purpose_to_data', source, '', 1, source, relation, target FROM ed WHERE relation = 'requires_metric'
  UNION ALL SELECT DISTINCT 'purpose_to_data', a.source, '', 2, b.source, b.relation, b.target FROM ed a JOIN ed b ON a.relation = 'requires_metric' AND b.relation = 'supported_by' AND b.source = a.target
  UNION ALL SELECT DISTINCT 'model_to_analysis', b.target, '', 1, b.source, b.relation, b.target FROM ed b WHERE b.relation = 'supported_by' AND b.target IN (SELECT y.target FROM ed x JOIN ed y ON x.relation = 'requires_metric' AND y.relation = 'supported_by' AND y.source = x.target)
  UNION ALL SELECT DISTINCT 'model_to_analysis', b.target, '', 2, a.source, a.relation, a.target FROM ed a JOIN ed b ON a.relation = 'requires_metric' AND b.relation = 'supported_by' AND b.source = a.target
  UNION ALL SELECT 'model_to_business', source, '', 1, source, relation, target FROM ed WHERE relation = 'belongs_to_object')"""


@R.query("case_motifs", f"WITH {EDGE_SQL} SELECT category, anchor, hop, count(*) AS edges FROM mo GROUP BY ALL")
def case_motifs(spark, sf):
    return CB.motifs(build_edges(spark, sf), build_entities(spark, sf)).groupBy("category", "anchor", "hop").agg(F.count("*").alias("edges"))


CASES_SQL = f"""{EDGE_SQL},
    g AS (SELECT category, anchor, max(hop) AS hops, count(*) AS edges FROM mo GROUP BY ALL), en AS (SELECT DISTINCT category, anchor, unnest([source, target]) AS id FROM mo),
    dk AS (SELECT 'o:' || o_orderkey AS id, 'doc-' || o_orderpriority AS document FROM orders UNION ALL SELECT 's:' || s_suppkey, 'doc-supply' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'doc-' || c_mktsegment FROM customer),
    nm AS (SELECT 'o:' || o_orderkey AS id, 'order ' || o_orderkey AS name FROM orders UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name FROM customer),
    dc AS (SELECT category, anchor, count(DISTINCT document) AS documents FROM en JOIN dk USING (id) GROUP BY ALL), kd AS (SELECT category, anchor, count(DISTINCT left(id, 1)) AS kinds FROM en GROUP BY ALL),
    z AS (SELECT g.*, coalesce(documents, 0) AS documents, kinds, name FROM g LEFT JOIN dc USING (category, anchor) JOIN kd USING (category, anchor) LEFT JOIN nm ON nm.id = anchor),
    cs AS (SELECT category, anchor, CAST(hops AS BIGINT) AS hops, edges, documents, CASE WHEN documents > 1 THEN 'cross_document' WHEN documents = 1 THEN 'single_document' ELSE 'unknown' END AS source_span,
      CASE WHEN documents = 0 OR documents > 1 AND kinds >= 3 THEN 'hard' WHEN documents > 1 OR hops >= 2 THEN 'medium' ELSE 'easy' END AS difficulty,
      CASE category WHEN 'metric_to_model' THEN '指标「' || name || '」由哪些模型提供？请列出指标和模型。' WHEN 'purpose_to_data' THEN '分析目的「' || name || '」需要哪些指标、维度、模型和字段？请列出能够确定的实体。'
        WHEN 'model_to_analysis' THEN '模型「' || name || '」支持哪些分析目的和指标？请列出模型及相关实体。' ELSE '模型「' || name || '」对应哪些业务对象？请列出模型和业务对象。' END AS query FROM z)"""


@R.query("motif_cases", f"WITH {CASES_SQL} SELECT * FROM cs")
def motif_cases(spark, sf):
    return cases(spark, sf).select("category", "anchor", "hops", "edges", "documents", "source_span", "difficulty", "query")


def cases(spark, sf):
    nid = lambda p, c: F.concat(F.lit(p), c)
    docs = table(spark, sf, "orders").select(nid("o:", "o_orderkey").alias("id"), nid("doc-", "o_orderpriority").alias("document")).unionByName(
        table(spark, sf, "supplier").select(nid("s:", "s_suppkey").alias("id"), F.lit("doc-supply").alias("document"))
    ).unionByName(table(spark, sf, "customer").select(nid("c:", "c_custkey").alias("id"), nid("doc-", "c_mktsegment").alias("document")))
    ents = build_entities(spark, sf)
    return CB.motif_cases(CB.motifs(build_edges(spark, sf), ents, docs), ents, docs)


@R.query(
    "relation_signatures",
    """WITH r AS (SELECT DISTINCT 'o:' || l_orderkey AS source, CASE l_returnflag WHEN 'A' THEN 'supported_by' WHEN 'N' THEN 'has_field' ELSE 'likes' END AS relation, CASE WHEN l_suppkey % 9 = 0 THEN 's:x' || l_suppkey ELSE 's:' || l_suppkey END AS target FROM lineitem)
    SELECT source, relation, target, CASE WHEN target LIKE 's:x%' OR relation = 'likes' THEN 'unresolved_relation' WHEN relation = 'has_field' THEN 'relation_type_mismatch' ELSE 'accepted' END AS verdict FROM r""",
)
def relation_signatures(spark, sf):
    f = F.col("l_returnflag")
    r = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o:"), "l_orderkey").alias("source"), F.when(f == "A", "supported_by").when(f == "N", "has_field").otherwise("likes").alias("relation"),
        F.when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("s:x"), "l_suppkey")).otherwise(F.concat(F.lit("s:"), "l_suppkey")).alias("target"),
    ).distinct()
    return CB.check_relations(r, build_entities(spark, sf))


@R.query(
    "alias_collision",
    "SELECT 'n' AS context_type, p_name AS key, count(DISTINCT p_type) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1",
)
def alias_collision(spark, sf):
    keys = table(spark, sf, "part").select(F.lit("n").alias("context_type"), F.col("p_name").alias("key"), F.col("p_type").alias("path"))
    return I.ambiguous_keys(keys, ["context_type", "key"], "path")


# derived evidence: a line item is derived from the order's first lines
EVID_SQL = """
rc AS (SELECT 'e' || p_partkey AS evidence_id, CASE WHEN p_size > 45 THEN 'DRAFT' ELSE 'APPROVED' END AS review_status, CASE WHEN p_size <= 20 THEN 'EXPLICIT' WHEN p_size <= 40 THEN 'DERIVED' ELSE 'CANDIDATE' END AS assertion_status FROM part),
pn AS (SELECT 'e' || p_partkey AS evidence_id, unnest(['e' || floor(p_partkey / 2)::BIGINT, 'e' || floor(p_partkey / 3)::BIGINT]) AS parent FROM part WHERE p_size > 20)"""


def evidence_tree(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_size")
    rec = p.select(F.concat(F.lit("e"), "p_partkey").alias("evidence_id"), F.when(s > 45, "DRAFT").otherwise("APPROVED").alias("review_status"),
                   F.when(s <= 20, "EXPLICIT").when(s <= 40, "DERIVED").otherwise("CANDIDATE").alias("assertion_status"))
    par = p.where("p_size > 20").select(F.concat(F.lit("e"), "p_partkey").alias("evidence_id"), F.explode(F.array(*[F.concat(F.lit("e"), F.floor(F.col("p_partkey") / d)) for d in (2, 3)])).alias("parent"))
    return rec, par


@R.query(
    "derivation_eligibility",
    f"""WITH RECURSIVE {EVID_SQL}, ap AS (SELECT * FROM rc WHERE review_status = 'APPROVED'), dp AS (SELECT DISTINCT pn.* FROM pn JOIN ap USING (evidence_id) WHERE assertion_status = 'DERIVED'),
    bad AS (SELECT evidence_id FROM rc WHERE NOT (review_status = 'APPROVED' AND assertion_status IN ('EXPLICIT', 'DERIVED')) UNION SELECT dp.evidence_id FROM dp WHERE evidence_id = parent UNION SELECT dp.evidence_id FROM dp JOIN bad ON bad.evidence_id = dp.parent)
    SELECT evidence_id FROM ap WHERE assertion_status IN ('EXPLICIT', 'DERIVED') AND evidence_id NOT IN (SELECT evidence_id FROM bad)""",
)
def derivation_eligibility(spark, sf):
    return CB.eligible_records(*evidence_tree(spark, sf))


@R.query(
    "derivation_cycles",
    """WITH RECURSIVE e AS (SELECT 'e' || p_partkey AS child, 'e' || (p_size * 29) AS parent FROM part WHERE p_partkey <> p_size * 29),
    ok AS (SELECT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child FROM e JOIN ok ON ok.node = e.parent)
    SELECT DISTINCT 'derived' AS view, child AS node FROM e WHERE child NOT IN (SELECT node FROM ok)""",
)
def derivation_cycles(spark, sf):
    p = table(spark, sf, "part")
    return H.cyclic_nodes(p.select(F.lit("derived").alias("view"), F.concat(F.lit("e"), F.col("p_size") * 29).alias("parent"), F.concat(F.lit("e"), "p_partkey").alias("child")))


@R.query(
    "nearby_records",
    """WITH r AS (SELECT DISTINCT 'r' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '-' || l_suppkey AS evidence_id, 'p' || l_partkey AS s, 's' || l_suppkey AS o FROM lineitem), e AS (SELECT s AS a, o AS b FROM r UNION SELECT o, s FROM r),
    n0 AS (SELECT DISTINCT 's' || s_suppkey AS anchor, 's' || s_suppkey AS node FROM supplier), n1 AS (SELECT * FROM n0 UNION SELECT anchor, b FROM n0 JOIN e ON a = node), n2 AS (SELECT * FROM n1 UNION SELECT anchor, b FROM n1 JOIN e ON a = node),
    x AS (SELECT DISTINCT anchor, evidence_id FROM n2 JOIN r ON r.s = node OR r.o = node) SELECT anchor, evidence_id FROM x QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY evidence_id) <= 8""",
)
def nearby_records(spark, sf):
    r = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        F.concat(F.lit("r"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("-"), "l_suppkey").alias("evidence_id"), F.concat(F.lit("p"), "l_partkey").alias("subject"), F.concat(F.lit("s"), "l_suppkey").alias("object")
    )
    return CB.nearby_records(r, table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))


@R.query(
    "path_motifs",
    """WITH r AS (SELECT DISTINCT 'r' || l_orderkey || '-' || l_partkey AS e, l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem)
    SELECT least(a.e, b.e) || '|' || greatest(a.e, b.e) AS signature, min(a.p) AS start, max(a.p) AS "end", CAST(2 AS BIGINT) AS edges FROM r a JOIN r b ON a.o = b.o AND a.p <> b.p GROUP BY 1""",
)
def path_motifs(spark, sf):
    """All chains of two records between parts."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().select(
        F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_partkey").alias("evidence_id"), F.concat(F.lit("o"), "l_orderkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object")
    )
    starts = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return CB.path_motifs(r, starts, low=2, high=2)


@R.query(
    "quota_selection",
    """WITH c AS (SELECT 'k' || o_orderkey AS case_id, o_orderpriority AS subtype, count(DISTINCT l_returnflag) AS layers, count(*) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT case_id, subtype, layers, evidence FROM c QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY layers DESC, evidence DESC, case_id) <= CASE subtype WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 5 ELSE 0 END""",
)
def quota_selection(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_returnflag").alias("layers"), F.count("*").alias("evidence"))
    c = table(spark, sf, "orders").join(li, "o_orderkey").select(F.concat(F.lit("k"), "o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("subtype"), "layers", "evidence")
    quotas = spark.createDataFrame([("1-URGENT", 12), ("2-HIGH", 7), ("3-MEDIUM", 5)], "subtype string, quota int")
    return CB.select_quotas(c, quotas)[0].select("case_id", "subtype", "layers", "evidence")


@R.query("diverse_sample")
def diverse_sample(spark, sf):
    c = cases(spark, sf)
    ready = c.select(
        "case_id", "category", "query", F.array(F.concat(F.lit("category="), "category"), F.concat(F.lit("span="), "source_span"), F.concat(F.lit("difficulty="), "difficulty")).alias("traits"),
        F.array("anchor").alias("entities"), F.array("source_span").alias("source_documents"), F.array().cast("array<string>").alias("topics"), F.concat_ws(":", "category", "hops").alias("motif"),
    )
    picked = CB.sample_diverse(ready, 6, {"entity": 2, "document": 4, "topic": 4, "motif": 3}, {"metric_to_model": 2, "purpose_to_data": 2, "model_to_analysis": 1, "model_to_business": 1})
    return picked.select("case_id", "category", "query", "pick")


@R.query(
    "literal_verification",
    """WITH u AS (SELECT DISTINCT doc_id % 20 AS d, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS lit FROM documents), e AS (SELECT doc_id AS id, regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g') AS name, doc_id % 20 AS d, lang FROM documents)
    SELECT id, bool_or(u.lit IS NOT NULL) AS located FROM e LEFT JOIN u ON u.lit = lower(trim(e.name)) AND u.d = CASE WHEN lang = 'en' THEN e.d ELSE (e.d + 1) % 20 END GROUP BY id""".replace("\\\\", "\\"),
)
def literal_verification(spark, sf):
    """Some line of a document must be found whole in the collection it cites (twenty collections)."""
    d = table(spark, sf, "documents")
    home = F.col("doc_id") % 20
    units = d.select(home.alias("document"), F.explode(F.split("text", "\n")).alias("literal"))
    ents = d.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("name"))
    cited = d.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", home).otherwise((home + 1) % 20).alias("document"))
    return CB.verify_literals(ents, units, cited)


@R.query(
    "origin_comparison",
    """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'parser' WHEN a.id IS NULL THEN 'raw_independent' ELSE 'both' END AS origin FROM (SELECT DISTINCT user_id AS id FROM events) a FULL JOIN (SELECT DISTINCT s_suppkey AS id FROM supplier) b ON a.id = b.id""",
)
def origin_comparison(spark, sf):
    """Users seen in events against supplier keys."""
    a = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return CB.compare_origins(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@R.query(
    "dataset_validation",
    f"""WITH {EVID_SQL}, cs AS (SELECT 'c' || o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 'S' ELSE 'M' END AS difficulty, CASE WHEN o_totalprice > 400000 THEN 2048 ELSE CASE WHEN o_orderstatus = 'F' THEN 2048 ELSE 4096 END END AS b FROM orders),
    rl AS (SELECT DISTINCT 'c' || l_orderkey AS case_id, 'e' || (l_partkey + CASE WHEN l_tax > 0.07 THEN 900000 ELSE 0 END) AS evidence_id, CASE l_returnflag WHEN 'A' THEN 'required' WHEN 'N' THEN 'allowed' ELSE 'forbidden' END AS role FROM lineitem)
    SELECT DISTINCT case_id, 'role_overlap' AS code, evidence_id FROM rl GROUP BY case_id, evidence_id HAVING count(*) > 1 UNION SELECT case_id, 'unknown_evidence', evidence_id FROM rl WHERE evidence_id NOT IN (SELECT evidence_id FROM rc)
    UNION SELECT case_id, 'gold_not_approved', evidence_id FROM rl JOIN rc USING (evidence_id) WHERE role <> 'forbidden' AND review_status <> 'APPROVED' UNION SELECT case_id, 'gold_status_forbidden', evidence_id FROM rl JOIN rc USING (evidence_id) WHERE role <> 'forbidden' AND assertion_status = 'CANDIDATE'
    UNION SELECT case_id, 'budget_mismatch', '' FROM cs WHERE b <> CASE difficulty WHEN 'S' THEN 2048 ELSE 4096 END""",
)
def dataset_validation(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    done = F.col("o_orderstatus") == "F"
    c = o.select(F.concat(F.lit("c"), "o_orderkey").alias("case_id"), F.when(done, "S").otherwise("M").alias("difficulty"), F.when((F.col("o_totalprice") > 400000) | done, 2048).otherwise(4096).alias("context_token_budget"))
    f = F.col("l_returnflag")
    roles = li.select(F.concat(F.lit("c"), "l_orderkey").alias("case_id"), F.concat(F.lit("e"), F.col("l_partkey") + F.when(F.col("l_tax") > 0.07, 900000).otherwise(0)).alias("evidence_id"),
                      F.when(f == "A", "required").when(f == "N", "allowed").otherwise("forbidden").alias("role"))
    return CB.validate_cases(c, roles, evidence_tree(spark, sf)[0])


@R.query(
    "case_difficulty",
    "SELECT l_orderkey, CASE WHEN e <= 1 AND y <= 2 THEN 'S' WHEN e <= 3 AND y <= 4 THEN 'M' ELSE 'L' END AS difficulty, CAST(CASE WHEN e <= 1 AND y <= 2 THEN 2048 WHEN e <= 3 AND y <= 4 THEN 4096 ELSE 8192 END AS BIGINT) AS budget FROM (SELECT l_orderkey, count(*) AS e, count(DISTINCT l_returnflag || l_linestatus) AS y FROM lineitem GROUP BY ALL)",
)
def case_difficulty(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("e"), F.count_distinct("l_returnflag", "l_linestatus").alias("y"))
    level = CB.difficulty(F.col("e"), F.col("y"))
    return g.select("l_orderkey", level.alias("difficulty"), CB.token_budget(level).alias("budget"))


@R.query(
    "dataset_description",
    f"""WITH {CASES_SQL} SELECT 'category' AS dimension, category AS value, count(*) AS cases FROM cs GROUP BY ALL UNION ALL SELECT 'source_span', source_span, count(*) FROM cs GROUP BY ALL
    UNION ALL SELECT 'difficulty', difficulty, count(*) FROM cs GROUP BY ALL UNION ALL SELECT 'duplicate_queries', '', count(*) - count(DISTINCT query) FROM cs
    UNION ALL SELECT 'repeated_motifs', '', count(*) - count(DISTINCT category || ':' || hops) FROM cs""",
)
def dataset_description(spark, sf):
    return CB.describe_cases(cases(spark, sf))


@R.query(
    "evidence_records",
    """SELECT 'ev-auto-' || substr(sha256('src-1' || chr(31) || '/p/' || p_partkey || chr(31) || 'f' || p_partkey || chr(31) || 'metric:part-' || p_partkey || '-' || replace(p_name, ' ', '-') || chr(31) || 'has_description' || chr(31) || p_type), 1, 20) AS evidence_id, 'has_description' AS predicate, p_type AS object,
    'Part ' || p_partkey || ' ' || p_name || ' 的 summary 为 ' || p_type AS statement, CASE WHEN p_size > 25 THEN 'CANDIDATE' ELSE 'EXPLICIT' END AS assertion_status FROM part""",
)
def evidence_records(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(
        F.concat(F.lit("f"), "p_partkey").alias("fragment_id"), F.lit("src-1").alias("source_id"), F.concat(F.lit("/p/"), "p_partkey").alias("pointer"), F.lit("metric").alias("context_type"),
        F.concat(F.lit("Part "), "p_partkey", F.lit(" "), "p_name").alias("name"), F.lit("summary").alias("section"), F.col("p_type").alias("value"), F.when(F.col("p_size") > 25, "DERIVED").otherwise("EXPLICIT").alias("status"),
    )
    return CB.evidence_records(rows).select("evidence_id", "predicate", "object", "statement", "assertion_status")
