"""Entity, relation and macro scores of runs against hand-made cases."""

from metaloom.operators import evaluation as EV

RUNS = "system string, case_id long, valid boolean, expected_empty boolean, annotated boolean, tokens long, complete boolean"
ENTITIES = "system string, case_id long, item string, unknown string"
GOLD = "case_id long, item string, type string, role string"
RELATIONS = "system string, case_id long, source string, relation string, target string, unknown string"
GOLD_RELATIONS = "case_id long, source string, relation string, target string"


def scored(spark, runs, entities=(), gold=(), relations=(), gold_relations=()):
    frames = [spark.createDataFrame(list(r), s) for r, s in zip((runs, entities, gold, relations, gold_relations), (RUNS, ENTITIES, GOLD, RELATIONS, GOLD_RELATIONS), strict=True)]
    return EV.entity_scores(*frames), frames


def test_entity_scores(spark):
    run = lambda case, valid=True, empty=False, annotated=True, tokens=10: ("s", case, valid, empty, annotated, tokens, tokens is not None)
    runs = [run(1), run(2, valid=False), run(3, empty=True), run(4, empty=True, tokens=None), run(5, annotated=False, tokens=40), run(6, tokens=30), run(7)]
    came = [("s", 1, "m:a", None), ("s", 1, "m:a", None), ("s", 1, "m:x", None), ("s", 1, "d:o", None), ("s", 1, None, "untyped:zz"), ("s", 2, "m:a", None), ("s", 4, None, "metrics:made up"), ("s", 5, "m:f", None)]
    gold = [(c, i, t, r) for c in (1, 2, 5, 6) for i, t, r in [("m:a", "metrics", "required"), ("m:b", "metrics", "required"), ("d:o", "dimensions", "optional"), ("m:f", "metrics", "forbidden")]]
    told = [("s", 1, "m:a", "uses", "d:o", None), ("s", 1, "m:a", "uses", "m:x", None), ("s", 1, None, "uses", "d:o", "raw"), ("s", 1, None, "uses", "d:o", "raw"), ("s", 5, "m:a", "uses", "d:o", None)]
    wanted = [(c, "m:a", "uses", "d:o") for c in (1, 5, 6)]
    rows, frames = scored(spark, runs, came, gold, told, wanted)
    got = {r.case_id: r for r in rows.collect()}
    assert len(got) == len(runs)
    one = got[1]  # a, x, o and one unknown name came; a of a and b was asked for, o may come
    assert (one.returned, one.matched, one.acceptable, one.unknown, one.recall, one.precision, one.f1) == (4, 1, 2, 1, 0.5, 0.5, 0.5)
    assert (one.relation_returned, one.relation_matched, one.relation_recall, one.relation_precision, one.relation_f1) == (3, 1, 1.0, 0.333333, 0.5)
    assert (got[2].recall, got[2].precision, got[2].f1, got[2].matched) == (0.0, 0.0, 0.0, 0)  # invalid
    assert (got[3].precision, got[3].f1, got[3].negative_correct, got[3].negative_false_positive) == (None, None, True, False)
    assert (got[4].precision, got[4].negative_correct, got[4].negative_false_positive) == (0.0, False, True)
    assert got[5].relation_recall is None and got[5].forbidden == 1 and got[5].precision == 0.0 and got[1].negative_correct is None
    assert (got[6].recall, got[6].precision, got[6].relation_recall, got[6].relation_precision, got[6].relation_f1) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert (got[7].recall, got[7].precision, got[7].relation_precision) == (None, 1.0, None)  # nothing asked, nothing came
    types = {r.type: (r.required, r.matched) for r in EV.entity_type_scores(*frames[:3]).collect()}
    assert types == {"metrics": (8, 1)}
    total = EV.macro_scores(rows, ["system"]).collect()[0]
    assert (total.runs, total.valid_runs, total.complete_runs, total.forbidden_returns, total.unknown_returns) == (7, 6, 6, 1, 2)
    assert (total.recall_macro, total.tokens_median) == (0.125, 10.0) and total.tokens_mean == 18.333333


def test_scores_of_no_runs(spark):
    rows, _ = scored(spark, [])
    assert rows.count() == 0 and EV.macro_scores(rows, ["system"]).count() == 0
