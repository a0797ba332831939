"""Retrieval evaluation: micro and macro ratios, recall at k, reports, gates, usage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import global_rank, salted_join


def ratio(num: Column, den: Column) -> Column:
    return F.round(num / F.nullif(den, F.lit(0)), 6)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, F.round(2 * precision * recall / (precision + recall), 6)).otherwise(0.0)


def score_cases(returned: DataFrame, gold: DataFrame) -> DataFrame:
    """Per (system, case_id): required, matched, acceptable, forbidden and returned counts.

    ``returned``: distinct (system, case_id, item); ``gold``: (case_id, item, role) with role
    required, allowed or forbidden. Case results stay sets of rows; nothing is collected.
    """
    systems = returned.select("system", "case_id").distinct()
    required = gold.where("role = 'required'").groupBy("case_id").agg(F.count("*").alias("required"))
    judged = returned.distinct().join(gold, ["case_id", "item"], "left")
    per = judged.groupBy("system", "case_id").agg(
        F.count_distinct("item").alias("returned"), F.count_if(F.col("role") == "required").alias("matched"),
        F.count_if(F.col("role").isin("required", "allowed")).alias("acceptable"), F.count_if(F.col("role") == "forbidden").alias("forbidden"),
    )
    rows = systems.join(per, ["system", "case_id"]).join(required, "case_id", "left").withColumn("required", F.coalesce("required", F.lit(0)))
    rows = rows.withColumn("recall", ratio(F.col("matched"), F.col("required"))).withColumn("precision", ratio(F.col("acceptable"), F.col("returned")))
    return rows.withColumn("f1", f1(F.col("precision"), F.coalesce("recall", F.lit(0.0))))


def micro_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Micro recall, precision and F1 from summed counts."""
    total = scored.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("required", "returned", "matched", "acceptable")], F.count("*").alias("runs"))
    total = total.withColumn("recall", ratio(F.col("matched"), F.col("required")))
    empty = F.when(F.col("required") > 0, 0.0)
    total = total.withColumn("precision", F.coalesce(ratio(F.col("acceptable"), F.col("returned")), empty))
    both = 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))
    return total.withColumn("f1", F.when((F.col("recall") > 0) & (F.col("precision") > 0), F.round(both, 6)).otherwise(empty))


def entity_scores(runs: DataFrame, entities: DataFrame, gold: DataFrame, relations: DataFrame, gold_relations: DataFrame) -> DataFrame:
    """Per run: entity and relation recall, precision and F1, and whether cases that expect nothing stayed empty.

    ``runs``: (system, case_id, valid, expected_empty, annotated, ...), one row each, runs that
    returned nothing included; ``entities``: (system, case_id, item, unknown), item null for names
    that the registry does not resolve; ``gold``: (case_id, item, type, role) with disjoint roles
    required, optional and forbidden; ``relations``: (system, case_id, source, relation, target,
    unknown), ends null for unresolved ones; ``gold_relations``: (case_id, source, relation, target).

    Unknown names and relations count against precision. An invalid run matches nothing. A case
    that expects nothing has no F1, and no precision if nothing came; relation scores are null
    where relations are not ``annotated``. Repeated rows count once.
    """
    run, triple = ["system", "case_id"], ["source", "relation", "target"]
    roles = gold.select("case_id", "item", "role").distinct()
    required = roles.where("role = 'required'").groupBy("case_id").agg(F.count("*").alias("required"))
    named = entities.where("item IS NOT NULL").select(*run, "item").distinct().join(roles, ["case_id", "item"], "left").groupBy(*run).agg(
        F.count("*").alias("named"), F.count_if(F.col("role") == "required").alias("matched"), F.count_if(F.col("role").isin("required", "optional")).alias("acceptable"), F.count_if(F.col("role") == "forbidden").alias("forbidden")
    )
    unknown = entities.where("item IS NULL").select(*run, "unknown").distinct().groupBy(*run).agg(F.count("*").alias("unknown"))
    told = relations.select(*run, *triple, F.when(F.col("source").isNull() | F.col("target").isNull(), F.col("unknown")).alias("raw"))
    open_ends = F.col("source").isNull() | F.col("target").isNull()
    told = told.select(*run, *[F.when(~open_ends, F.col(c)).alias(c) for c in triple], "raw").distinct()
    right = gold_relations.select("case_id", *triple).distinct().withColumn("right", F.lit(True))
    told = told.join(right, ["case_id", *triple], "left").groupBy(*run).agg(F.count("*").alias("relation_returned"), F.count_if("right").alias("relation_matched"))
    wanted = right.groupBy("case_id").agg(F.count("*").alias("relation_required"))
    rows = runs.join(named, run, "left").join(unknown, run, "left").join(told, run, "left").join(required, "case_id", "left").join(wanted, "case_id", "left")
    counts = ["named", "matched", "acceptable", "forbidden", "unknown", "relation_returned", "relation_matched", "required", "relation_required"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rows = rows.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(0) for c in ("matched", "acceptable", "relation_matched")}).withColumn("returned", F.col("named") + F.col("unknown"))

    none, empty = F.col("returned") == 0, F.col("expected_empty")
    recall, share = F.col("matched") / F.nullif("required", F.lit(0)), F.col("acceptable") / F.nullif("returned", F.lit(0))
    precision = F.when(~none & F.col("valid"), share).when(none & (F.col("required") == 0) & F.col("valid"), 1.0).otherwise(0.0)
    both = lambda r, p: F.when((r > 0) & (p > 0), F.round(2 * r * p / (r + p), 6))
    relation_recall, relation_share = (F.col("relation_matched") / F.nullif(c, F.lit(0)) for c in ("relation_required", "relation_returned"))
    nought = F.when(F.col("relation_required") > 0, 0.0)
    annotated = lambda c: F.when(F.col("annotated"), c)
    quiet = none & (F.col("relation_returned") == 0)
    return rows.select(
        *runs.columns, "required", "returned", "matched", "acceptable", "forbidden", "unknown", "relation_required", "relation_returned", "relation_matched",
        F.round(recall, 6).alias("recall"), F.when(~(empty & none), F.round(precision, 6)).alias("precision"), F.when(~empty, F.coalesce(both(recall, precision), F.lit(0.0))).alias("f1"),
        F.when(empty, F.col("valid") & quiet).alias("negative_correct"), F.when(empty, ~quiet).alias("negative_false_positive"),
        annotated(F.round(relation_recall, 6)).alias("relation_recall"), annotated(F.coalesce(F.round(relation_share, 6), nought)).alias("relation_precision"),
        annotated(F.coalesce(both(relation_recall, relation_share), nought)).alias("relation_f1"),
    )


def entity_type_scores(runs: DataFrame, entities: DataFrame, gold: DataFrame) -> DataFrame:
    """(system, type, required, matched, recall): required entities of each type over all runs, and how many came in valid ones."""
    wanted = gold.where("role = 'required'").select("case_id", "item", "type").distinct()
    asked = runs.select("system", "case_id", "valid").join(wanted, "case_id")
    came = entities.where("item IS NOT NULL").select("system", "case_id", "item").distinct().withColumn("came", F.lit(True))
    rows = asked.join(came, ["system", "case_id", "item"], "left").groupBy("system", "type").agg(F.count("*").alias("required"), F.count_if(F.col("came") & F.col("valid")).alias("matched"))
    return rows.withColumn("recall", ratio(F.col("matched"), F.col("required")))


def macro_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means over runs per group, cases without a value left out; mean and median of tokens; sums of forbidden and unknown returns.

    ``scored``: rows of ``entity_scores`` with tokens and complete (whether all tokens were counted).
    """
    mean = lambda c: F.round(F.avg(c), 6)
    return scored.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if("valid").alias("valid_runs"), mean("recall").alias("recall_macro"), mean("precision").alias("precision_macro"), mean("tokens").alias("tokens_mean"),
        F.median("tokens").alias("tokens_median"), F.count_if("complete").alias("complete_runs"), F.sum("forbidden").alias("forbidden_returns"), F.sum("unknown").alias("unknown_returns"),
    )


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, found, expected, recall) over all queries: ranked (query_id, item, rank), gold (query_id, item)."""
    hits = ranked.join(gold.distinct(), ["query_id", "item"], "left_semi")
    expected = gold.distinct().agg(F.count("*").alias("n")).scalar()
    counts = hits.agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("found")) for k in ks])).alias("r")).select("r.*")
    return rows.select("k", "found", expected.alias("expected"), ratio(F.col("found"), expected).alias("recall"))


def grouped_report(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes and completeness per dimension value and overall."""
    sets = [[F.col(d)] for d in dims] + [[]]
    stats = [
        F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.count(value).alias("measured"), F.count("*").alias("expected"), (F.count(value) == F.count("*")).alias("complete"),
    ]
    return rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(*stats, F.grouping_id().cast("long").alias("level"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Value at place int(n x share) (0-based) of each group, by a distributed sort."""
    sized = rows.where(F.col(value).isNotNull())
    ranked = global_rank(sized.select(*group, value), group, [F.asc(value)], "place")
    n = sized.groupBy(*group).agg(F.count("*").alias("n"))
    at = salted_join(ranked, n, group, ["place"])
    picks = [
        F.max(F.when(F.col("place") == F.least(F.floor(F.col("n") * s), F.col("n") - 1) + 1, F.col(value))).alias(name) for name, s in shares.items()
    ]
    return at.groupBy(*group).agg(*picks, F.max("n").alias("n"))


def amortized(systems: DataFrame, calls: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """Cost per query when the build is shared by N queries: systems (system, query_cost, build_cost)."""
    rows = systems.withColumn("n", F.explode(F.array(*[F.lit(n).cast("long") for n in calls])))
    return rows.select("system", "n", F.round(F.col("query_cost") + F.col("build_cost") / F.col("n"), 6).alias("cost"))


def paired_deltas(scores: DataFrame, left: str, right: str, metrics: list[str]) -> DataFrame:
    """Left minus right of each metric where both systems are present."""
    pick = lambda s, m: F.max(F.when(F.col("system") == s, F.col(m)))
    return scores.agg(*[F.round(pick(left, m) - pick(right, m), 6).alias(f"delta_{m}") for m in metrics])


def tool_counts(calls: DataFrame) -> DataFrame:
    """Per run: total, search, expand, read and retrieval calls; a call id counts once.

    ``calls``: (run, call_id, tool). Runs with a missing id have unknown (null) counts.
    """
    bad = calls.where("call_id IS NULL OR call_id = ''").select("run").distinct().withColumn("bad", F.lit(True))
    once = calls.groupBy("run", "call_id").agg(F.min("tool").alias("tool"))
    name = F.lower("tool")
    search = name.rlike("search|find|grep|glob")
    expand = ~search & name.contains("expand")
    read = ~search & ~expand & name.contains("read")
    per = once.groupBy("run").agg(
        F.count("*").alias("total"), F.count_if(search).alias("search"), F.count_if(expand).alias("expand"), F.count_if(read).alias("read"),
        F.count_if(search | expand | read).alias("retrieval"),
    )
    known = lambda c: F.when(F.col("bad").isNull(), F.col(c)).alias(c)
    return per.join(bad, "run", "left").select("run", *[known(c) for c in ("total", "search", "expand", "read", "retrieval")])


def token_usage(calls: DataFrame) -> DataFrame:
    """Per run: input, output and total tokens; null when a call id disagrees with itself or lacks a count."""
    per_call = calls.groupBy("run", "call_id").agg(
        F.min("input_tokens").alias("i"), F.max("input_tokens").alias("i2"), F.min("output_tokens").alias("o"), F.max("output_tokens").alias("o2"),
        F.bool_or(F.expr("input_tokens IS NULL OR output_tokens IS NULL OR input_tokens < 0 OR output_tokens < 0")).alias("gap"),
    )
    per = per_call.groupBy("run").agg(
        F.sum("i").alias("i"), F.sum("o").alias("o"),
        F.bool_or(F.col("gap") | (F.col("i") != F.col("i2")) | (F.col("o") != F.col("o2")) | F.coalesce(F.col("call_id") == "", F.lit(True))).alias("bad"),
    )
    known = lambda c: F.when(~F.col("bad"), c)
    return per.select("run", known(F.col("i")).alias("input_tokens"), known(F.col("o")).alias("output_tokens"), known(F.col("i") + F.col("o")).alias("total_tokens"))


def reserved_tokens(calls: DataFrame, output_cap: int) -> DataFrame:
    """Per run: provider-reported tokens, else the estimated input plus the larger of output and the cap."""
    cost = F.coalesce("reported", F.col("input_estimate") + F.greatest("output_estimate", F.lit(output_cap)))
    return calls.groupBy("run").agg(F.sum(cost).alias("tokens"), F.bool_and(F.col("reported").isNotNull()).alias("complete"), F.count("*").alias("calls"))


def branch_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: branch recall at 1, 3 and all, precision at 3: ranked (query_id, branch, rank)."""
    e = expected.distinct()
    n = e.groupBy("query_id").agg(F.count("*").alias("expected"))
    hit = ranked.join(e, ["query_id", "branch"], "left_semi")
    per = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= 1).alias("h1"), F.count_if(F.col("rank") <= 3).alias("h3"), F.count("*").alias("hk"))
    rows = n.join(per, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "query_id", ratio(z("h1"), F.col("expected")).alias("recall_at_1"), ratio(z("h3"), F.col("expected")).alias("recall_at_3"),
        ratio(z("hk"), F.col("expected")).alias("recall_at_k"), ratio(z("h3"), F.lit(3)).alias("precision_at_3"),
    )


def golden_gate(report: DataFrame, minimums: dict[str, float], maximums: dict[str, float] | None = None) -> DataFrame:
    """One row per broken limit of a one-row report; an unmeasured metric breaks its limit too."""
    checks = [F.when(F.col(k).isNull() | (F.col(k) < v), F.concat(F.lit(f"{k} below {v}: "), F.coalesce(F.col(k).cast("string"), F.lit("unscored")))) for k, v in minimums.items()]
    checks += [F.when(F.col(k).isNull() | (F.col(k) > v), F.concat(F.lit(f"{k} above {v}: "), F.coalesce(F.col(k).cast("string"), F.lit("unscored")))) for k, v in (maximums or {}).items()]
    return report.select(F.explode(F.array_compact(F.array(*checks))).alias("reason"))
