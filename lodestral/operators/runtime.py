"""The research loop: policy, executor and reducer until done or out of steps.

``run`` takes one run on the driver, whose state is a dict of plain values and DataFrames.
``run_all`` takes a table of runs, all of which make a step at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame, functions as F

from lodestral.functions.session import checkpoint
from lodestral.operators.traces import Tracer


class RunError(RuntimeError):
    """A step failed; ``trace_id`` finds its spans."""

    def __init__(self, message: str, trace_id: str):
        super().__init__(message)
        self.trace_id = trace_id


@dataclass
class Result:
    state: dict
    trace_id: str


def dispatch(executors: dict[str, Callable[[dict, dict], dict]]) -> Callable[[dict, dict], dict]:
    """One executor from several by action type; its observation must be of that type."""

    def execute(action: dict, state: dict) -> dict:
        if action["type"] not in executors:
            raise ValueError(f"no executor for {action['type']}")
        observation = executors[action["type"]](action, state)
        if observation.get("type") != action["type"]:
            raise ValueError(f"observation {observation.get('type')} for action {action['type']}")
        return observation

    return execute


def reduce(state: dict, action: dict, observation: dict) -> dict:
    """A new state: history grows, the step counts up, finish and stop end the run."""
    done = action["type"] in ("finish", "stop")
    return state | {
        "history": [
            *state["history"], {"step_index": state["current_step"], "action": action, "observation": observation}
        ], "current_step": state["current_step"] + 1, "last_action": action, "done": done,
        "final_answer": observation.get("answer") if action["type"] == "finish" else state.get("final_answer"),
    }


def run(state: dict, policy: Callable[[dict], dict], execute: Callable[[dict, dict], dict], tracer: Tracer, reducer=reduce) -> Result:
    state = {"history": [], "current_step": 0, "done": False, "last_action": None} | state
    try:
        with tracer.span("agent.run", input={"query": state.get("query")}) as whole:
            while not state["done"] and state["current_step"] < state["max_steps"]:
                step = state["current_step"]
                with tracer.span("agent.step", step_index=step) as s:
                    with tracer.span("agent.policy.select", step_index=step):
                        action = policy(state)
                    with tracer.span("agent.action.execute", step_index=step, action_type=action["type"]):
                        observation = execute(action, state)
                    s["output"] = {"action": action, "observation": observation}
                state = reducer(state, action, observation)
            whole["output"] = {"done": state["done"], "steps": state["current_step"]}
    except Exception as e:
        raise RunError(f"{type(e).__name__}: {e}", tracer.trace_id) from e
    return Result(state, tracer.trace_id)


#: What a step of a run leaves: spans of the policy, the action and the step itself below that of the run.
STEP_SPANS = ("agent.policy.select", "agent.action.execute", "agent.step")


def run_all(
    runs: DataFrame, policy: Callable[[DataFrame], DataFrame], executors: dict[str, Callable[[DataFrame], DataFrame]], max_steps: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, history, spans) of runs (run_id), each until it is done or has made ``max_steps`` steps.

    A step is a few jobs over all runs that go on: ``policy`` gives (run_id, type, params)
    for states (run_id, step, last_type), and the executor of each type gives (run_id, type,
    answer) for its actions (run_id, step, type, params).  An action without an executor,
    without an observation, or with one of another type raises.  States: run_id, step, done,
    last_type, answer.  History: run_id, step, type, params, answer.  Spans: run_id,
    span_id, parent, name, step.
    """
    text = F.lit(None).cast("string")
    states = checkpoint(runs.select("run_id", F.lit(0).alias("step"), F.lit(False).alias("done"), text.alias("last_type"), text.alias("answer")))
    history = []
    for step in range(max_steps):
        going = states.filter("not done").select("run_id", "step", "last_type")
        actions = checkpoint(going.join(policy(going), "run_id", "left").select("run_id", "step", "type", "params"))
        kinds = [r[0] for r in actions.select("type").distinct().limit(len(executors) + 1).collect()]
        if not kinds:
            break
        if unknown := [k for k in kinds if k not in executors]:
            raise ValueError(f"no executor for {unknown[0]}")
        seen = fold(DataFrame.unionByName, (executors[k](actions.filter(F.col("type") == k)).select("run_id", F.col("type").alias("seen"), "answer") for k in sorted(kinds)))
        made = checkpoint(actions.join(seen, "run_id", "left"))
        if odd := made.filter("seen is null or seen <> type").first():
            raise ValueError(f"observation {odd['seen']} for action {odd['type']}")
        history.append(made.select("run_id", "step", "type", "params", "answer"))
        now = made.select("run_id", F.struct("type", "answer").alias("m"))
        ends = F.col("m.type").isin("finish", "stop")
        states = checkpoint(states.join(now, "run_id", "left").select(
            "run_id", (F.col("step") + F.col("m").isNotNull().cast("int")).alias("step"), (F.col("done") | F.coalesce(ends, F.lit(False))).alias("done"), F.coalesce("m.type", "last_type").alias("last_type"),
            F.when(F.col("m.type") == "finish", F.col("m.answer")).otherwise(F.col("answer")).alias("answer"),
        ))
    none = states.select("run_id", "step", text.alias("type"), text.alias("params"), text.alias("answer")).limit(0)
    whole = fold(DataFrame.unionByName, history, none)
    name = F.explode(F.array(*map(F.lit, STEP_SPANS)))
    id_ = lambda name: F.concat_ws("-", F.col("run_id").cast("string"), F.col("step").cast("string"), name)
    root = states.select("run_id", F.col("run_id").cast("string").alias("span_id"), text.alias("parent"), F.lit("agent.run").alias("name"), F.lit(None).cast("int").alias("step"))
    steps = whole.select("run_id", "step", name.alias("name")).select(
        "run_id", id_(F.col("name")).alias("span_id"),
        F.when(F.col("name") == "agent.step", F.col("run_id").cast("string")).otherwise(id_(F.lit("agent.step"))).alias("parent"), "name", "step"
    )
    return states, whole, root.unionByName(steps)
