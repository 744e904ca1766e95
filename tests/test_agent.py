from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT
from scriptorium.operators import agent, governance


def asked(spark, *ids):
    return spark.createDataFrame([(i, f"question {i}") for i in ids], "query_id long, text string")


def ranked(spark, scores):
    """scores: {query: {rank: evidence}}."""
    rows = [(q, r, float(e)) for q, x in scores.items() for r, e in x.items()]
    return spark.createDataFrame(rows, "query_id long, rank int, evidence double")


def looped(spark, questions, evidence, **options):
    tools = governance.Tools()
    tools.add("retrieve", agent.ranked_evidence(evidence))
    ended, trace = agent.run(questions, tools, **options)
    steps = {}
    for r in trace.orderBy("query_id", "step").collect():
        steps.setdefault(r.query_id, []).append((r.step, r.tool, r.obs.k, round(r.obs.top_score or 0, 3), r.obs.n, r.obs.abstained))
    return {r.query_id: r for r in ended.collect()}, steps


def test_the_fixed_trace(spark):
    """Weak at every level, one step of k after the other, then abstention; others answer as soon as evidence suffices."""
    evidence = ranked(spark, {1: {1: 0.28, 15: 0.31, 25: 0.32, 35: 0.33}, 2: {1: 0.1, 12: 0.6}, 3: {3: 0.35}})
    ended, steps = looped(spark, asked(spark, 1, 2, 3, 4), evidence)
    assert steps[1] == [(1, "retrieve", 10, 0.28, 1, False), (2, "retrieve", 20, 0.31, 2, False), (3, "retrieve", 30, 0.32, 3, False), (4, "retrieve", 40, 0.33, 4, False), (5, "stop", 40, 0.33, 4, True)]
    assert steps[2] == [(1, "retrieve", 10, 0.1, 1, False), (2, "retrieve", 20, 0.6, 2, False), (3, "stop", 20, 0.6, 2, False)]
    assert steps[3] == [(1, "retrieve", 10, 0.35, 1, False), (2, "stop", 10, 0.35, 1, False)]
    assert [s[:2] for s in steps[4]] == [(1, "retrieve"), (2, "retrieve"), (3, "retrieve"), (4, "retrieve"), (5, "stop")] and ended[4].status == "abstain"
    assert {q: r.status for q, r in ended.items()} == {1: "abstain", 2: "answer", 3: "answer", 4: "abstain"}
    assert ended[1].steps == 4 and ended[3].n == 1


def test_steps_budget_and_guardrails(spark):
    evidence = ranked(spark, {k: {1: 0.1} for k in (1, 2, 3)})
    ended, steps = looped(spark, asked(spark, 1), evidence, config=replace(DEFAULT, max_steps=2))
    assert ended[1].status == "steps" and [s[1] for s in steps[1]] == ["retrieve", "retrieve", "steps"]
    ended, steps = looped(spark, asked(spark, 1), evidence, config=replace(DEFAULT, max_steps=4))
    assert ended[1].status == "abstain"
    ended, steps = looped(spark, asked(spark, 1), evidence, costs={"retrieve": 0.02})
    assert ended[1].status == "budget" and ended[1].spent == pytest.approx(0.04) and [s[1] for s in steps[1]] == ["retrieve", "retrieve", "budget"]
    hooks = governance.Hooks()
    calls = []
    hooks.register("on_step", lambda df: calls.append("step") or df.filter("query_id <> 3"))
    hooks.register("on_tool_call", lambda df: calls.append("tool") or df.filter("NOT (query_id = 2 AND k > 10)"))
    ended, steps = looped(spark, asked(spark, 1, 2, 3), evidence, hooks=hooks)
    assert {q: r.status for q, r in ended.items()} == {1: "abstain", 2: "blocked", 3: "blocked"}
    assert [s[1] for s in steps[2]] == ["retrieve", "blocked"] and [s[1] for s in steps[3]] == ["blocked"] and calls[:2] == ["step", "tool"]


def test_several_tools_and_rows_without_results(spark):
    """A policy of its own: one question reads a page, the other retrieves; a tool that says nothing counts as no evidence."""
    first = F.when(F.col("query_id") % 2 == 0, "read_page").otherwise("retrieve")
    policy = F.when(F.col("step") == 0, F.struct(first.alias("tool"), F.lit(7).alias("k"), F.lit(None).cast("string").alias("status"))).otherwise(F.struct(F.lit("stop").alias("tool"), F.col("k").alias("k"), F.lit("answer").alias("status")))
    tools = governance.Tools()
    tools.add("retrieve", agent.ranked_evidence(ranked(spark, {1: {1: 0.5}})))
    tools.add("read_page", lambda a: a.filter("query_id = 2").select("query_id", F.lit(0.9).alias("top_score"), "k", F.lit(1).alias("n")))
    ended, trace = agent.run(asked(spark, 1, 2, 4), tools, policy=policy)
    got = {(r.query_id, r.step): (r.tool, r.obs.top_score, r.args.get("k")) for r in trace.collect()}
    assert got[1, 1] == ("retrieve", 0.5, "7") and got[2, 1] == ("read_page", 0.9, "7") and got[4, 1] == ("read_page", 0.0, "7")
    none = agent.run(asked(spark).limit(0), tools)
    assert none[0].count() == 0 and none[1].count() == 0
    with pytest.raises(ValueError):
        agent.run(asked(spark, 1), governance.Tools())


def test_repeated_and_null_questions(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "query_id long, text string")
    ended, steps = looped(spark, rows, ranked(spark, {1: {1: 1.0}, 2: {1: 1.0}}))
    assert ended[1].text == "a" and ended[2].text is None and len(steps[1]) == len(steps[2]) == 2


def test_answers_quote_their_best_evidence(spark):
    evidence = spark.createDataFrame([(1, 1, 0.5, "c1", "one"), (1, 2, 0.9, "c2", "two mail a@b.com"), (1, 12, 1.0, "c3", "beyond k"), (2, 1, 0.1, "c4", "weak")], "query_id long, rank int, evidence double, chunk_id string, text string")
    tools, hooks, after = governance.Tools(), governance.Hooks(), []
    tools.add("retrieve", agent.ranked_evidence(evidence))
    ended, _ = agent.run(asked(spark, 1, 2), tools)
    hooks.register("before_answer", lambda df: df.withColumn("text", F.regexp_replace("text", "a@b.com", "[mail]")))
    hooks.register("after_answer", lambda df: after.append(df.columns))
    got = {r.query_id: r for r in agent.answered(ended, evidence, hooks).collect()}
    assert (got[1].text, got[1].citations, got[1].grounded) == ("two mail [mail]", ["c2"], True)
    assert (got[2].text, got[2].citations, got[2].grounded, got[2].status) == ("not found in the corpus", [], False, "abstain") and after
