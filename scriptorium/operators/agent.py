"""The agent's loop over many questions at once: perceive, decide, act, observe, as steps of a table of states.

A row is a question with what it saw last. Each step decides for all active rows, sends their actions through the seams and
to the tools, and writes the new states as a table: a lost executor repeats one step at most. Rows leave the loop one by one, when
the policy stops, a guardrail takes their action away, or the budget is spent; the loop ends with the last of them, or
after max_steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.shared import written
from .governance import Hooks, Tools, format_answer
from .retrieval import is_weak, next_k

STATE = ("query_id", "text", "step", "k", "top_score", "n", "spent")
#: How a question left the loop.
ANSWER, ABSTAIN, BLOCKED, BUDGET, STEPS = "answer", "abstain", "blocked", "budget", "steps"
OBS = "query_id", "top_score", "k", "n"


def evidence_policy(config: Config = DEFAULT) -> Column:
    """(tool, k, status) of a state: search, search wider while the evidence is weak, then answer or abstain."""
    wider = next_k(F.col("k"), config)
    go = lambda k: F.struct(F.lit("retrieve").alias("tool"), k.cast("int").alias("k"), F.lit(None).cast("string").alias("status"))
    stop = lambda how: F.struct(F.lit("stop").alias("tool"), F.col("k").cast("int").alias("k"), F.lit(how).alias("status"))
    weak = is_weak(F.col("top_score"), config)
    return F.when(F.col("k").isNull(), go(F.lit(config.k))).when(weak & wider.isNotNull(), go(wider)).when(weak, stop(ABSTAIN)).otherwise(stop(ANSWER))


def ranked_evidence(ranked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A retrieve tool over ranked candidates (query_id, rank, evidence): the best evidence of the first k, and how many they are."""

    def retrieve(actions: DataFrame) -> DataFrame:
        seen = F.col("rank") <= F.col("k")
        met = actions.select("query_id", "k").join(ranked.select("query_id", "rank", "evidence"), "query_id", "left")
        return met.groupBy("query_id", "k").agg(F.coalesce(F.max(F.when(seen, F.col("evidence"))), F.lit(0.0)).alias("top_score"), F.count_if(seen).alias("n"))

    return retrieve


def run(questions: DataFrame, tools: Tools, hooks: Hooks | None = None, policy: Column | None = None, costs: dict[str, float] | None = None, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(ended, trace) of questions (query_id, text).

    ended: query_id, text, k, top_score, n, steps, spent, status. trace: query_id, step, tool, args, obs (top_score, k, n, abstained), a row
    for each action and for the end of each question. A tool is a function of actions (query_id, text, step, tool, k) that gives
    a row of query_id, top_score, k, n each; a question without a row has seen nothing. Costs are by tool; an action that would pass the budget
    ends its question. A seam sees the rows of its step and may change texts or drop rows: what on_step or on_tool_call drops is
    blocked. A null text is a question like others, rows of one query_id are one question (their least text).
    """
    hooks, policy, costs = hooks or Hooks(), evidence_policy(config) if policy is None else policy, costs or {}
    spark = questions.sparkSession
    state = questions.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("text").alias("text"))
    state = state.select("query_id", "text", F.lit(0).alias("step"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("top_score"), F.lit(None).cast("long").alias("n"), F.lit(0.0).alias("spent"))
    state, ended, trace = written(state, "agent"), [], []
    price = F.coalesce(*(F.when(F.col("tool") == name, F.lit(float(c))) for name, c in sorted(costs.items())), F.lit(0.0))

    def end(rows: DataFrame, status: Column) -> None:
        ended.append(rows.select("query_id", "text", "k", "top_score", "n", F.col("step").alias("steps"), "spent", status.alias("status")))

    for _ in range(config.max_steps):
        seen = hooks.run("on_step", state)
        decided = seen.select(*STATE, policy.alias("a")).select(*STATE, "a.tool", F.col("a.k").alias("to"), "a.status")
        over = (F.col("tool") != "stop") & (F.col("spent") + price > config.budget)
        decided = written(decided.withColumn("status", F.when(over, BUDGET).otherwise(F.col("status"))).withColumn("cost", price), "agent")
        end(decided.filter("status IS NOT NULL"), F.col("status"))
        asked = decided.filter("status IS NULL")
        actions = written(hooks.run("on_tool_call", asked.select("query_id", "text", "step", "tool", F.col("to").alias("k"))), "agent")
        kept = actions.select("query_id").distinct()
        for before, after in ((state, seen), (asked, kept)):
            end(before.join(after.select("query_id"), "query_id", "left_anti"), F.lit(BLOCKED))
        used = sorted(r["tool"] for r in actions.select("tool").distinct().limit(len(Tools.NAMES) + 1).collect())
        if not used:
            state = None
            break
        seen_now = [tools.call(name, actions.filter(F.col("tool") == name)).select(*OBS) for name in used]
        found = seen_now[0]
        for more in seen_now[1:]:
            found = found.unionByName(more)
        done = actions.select("query_id", "text", "step", "tool", F.col("k").alias("to")).join(found.withColumn("_seen", F.lit(True)), "query_id", "left")
        done = done.join(asked.select("query_id", "spent", "cost"), "query_id")
        unseen = F.col("_seen").isNull()
        done = written(done.select("query_id", "text", "step", "tool", "to", F.when(unseen, F.col("to")).otherwise(F.col("k")).cast("int").alias("k"), F.when(unseen, 0.0).otherwise(F.col("top_score")).alias("top_score"),
                                   F.when(unseen, 0).otherwise(F.col("n")).cast("long").alias("n"), (F.col("spent") + F.col("cost")).alias("spent")), "agent")
        trace.append(_step(done, F.col("step") + 1, F.col("tool"), F.col("to"), F.lit(False)))
        state = done.withColumn("step", F.col("step") + 1).select(*STATE)
    if state is not None:
        # Those whose last step was the last one allowed may still end as they would have.
        last = state.select(*STATE, policy.alias("a")).withColumn("status", F.coalesce("a.status", F.lit(STEPS)))
        end(last, F.col("status"))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    out = written(out, "agent")
    trace.append(_step(out, F.col("steps") + 1, F.when(F.col("status").isin(ANSWER, ABSTAIN), "stop").otherwise(F.col("status")), F.col("k"), F.col("status") != ANSWER))
    steps = trace[0]
    for more in trace[1:]:
        steps = steps.unionByName(more)
    return out, steps


def _step(rows: DataFrame, number: Column, tool: Column, k: Column, abstained: Column) -> DataFrame:
    args = F.map_filter(F.create_map(F.lit("k"), k.cast("string"), F.lit("query"), F.col("text")), lambda _, v: v.isNotNull())
    obs = F.struct("top_score", F.col("k").cast("int").alias("k"), "n", abstained.alias("abstained"))
    return rows.select("query_id", number.cast("int").alias("step"), tool.alias("tool"), args.alias("args"), obs.alias("obs"))


def answered(ended: DataFrame, evidence: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """(query_id, status, text, citations, grounded, confidence) of ended questions: those to answer quote the best of their evidence.

    evidence: query_id, rank, evidence, chunk_id, text. The first of highest evidence within the k used is quoted and cited; without
    one, and for all other statuses, the answer is a refusal. Runs before_answer on what is to be said, after_answer on the answers.
    """
    hooks = hooks or Hooks()
    best = F.max_by(F.struct("chunk_id", F.col("text").alias("quote")), F.struct("evidence", -F.col("rank")))
    met = evidence.join(ended.filter(F.col("status") == ANSWER).select("query_id", F.col("k").alias("_k")), "query_id").filter(F.col("rank") <= F.col("_k"))
    said = ended.select("query_id", "status").join(met.groupBy("query_id").agg(best.alias("b")), "query_id", "left")
    said = said.select("query_id", "status", F.col("b.quote").alias("text"), F.when(F.col("b.chunk_id").isNotNull(), F.array(F.col("b.chunk_id").cast("string"))).alias("citations"))
    said = hooks.run("before_answer", said)
    made = said.withColumn("a", format_answer(F.col("text"), F.col("citations"), F.coalesce(F.size("citations"), F.lit(0))))
    return hooks.run("after_answer", made.select("query_id", "status", "a.text", "a.citations", "a.grounded", "a.confidence"))
