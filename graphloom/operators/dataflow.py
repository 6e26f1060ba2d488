"""A dataflow executor: nodes are functions over DataFrames, links may be guarded or lead back."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.measure import MET, UNMET
from graphloom.session import written

Work = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
Judge = Callable[[DataFrame], list[str]]


class Stop(RuntimeError):
    """What ends a run: a cycle, an input that isn't bound, a guard that nothing judges, or a node that raised."""


@dataclass
class Node:
    """A function with named inputs (true: optional) and the judges of its outputs [WFL-04, UDF-01]."""

    work: Work
    inputs: dict[str, bool] = field(default_factory=dict)
    judges: dict[str, Judge] = field(default_factory=dict)


@dataclass(frozen=True)
class Link:
    """From an output port to an input port; ``guard`` is 'met', 'unmet' or none; ``back`` leads to an earlier node."""

    source: str
    output: str
    target: str
    input: str
    guard: str | None = None
    back: bool = False


def fires(guard: str | None, verdicts: list[str]) -> bool:
    """No guard always fires, 'met' when no verdict says otherwise (nor any is given), 'unmet' when one does [FN-34]."""
    if guard == MET:
        return not any(v != MET for v in verdicts)
    return guard is None or (guard == UNMET and UNMET in verdicts)


@dataclass
class Flow:
    nodes: dict[str, Node]
    links: list[Link]

    def order(self) -> list[str]:
        """Nodes so that forward links lead onward; those ready at the same time by name [GRF-14, GRF-15]."""
        waits = {n: {x.source for x in self.links if x.target == n and not x.back} for n in self.nodes}
        ready = deque(sorted(n for n in waits if not waits[n]))
        placed: list[str] = []
        while ready:
            done = ready.popleft()
            placed.append(done)
            for n in sorted(waits):
                if done in waits[n]:
                    waits[n].discard(done)
                    if not waits[n]:
                        ready.append(n)
        if len(placed) < len(self.nodes):
            raise Stop("a cycle that no back link declares: " + ", ".join(sorted(set(self.nodes) - set(placed))))
        return placed

    def open_inputs(self) -> dict[tuple[str, str], bool]:
        """Inputs that no forward link feeds, and whether they are optional [GRF-19]."""
        fed = {(x.target, x.input) for x in self.links if not x.back}
        return {(n, p): optional for n, node in self.nodes.items() for p, optional in node.inputs.items() if (n, p) not in fed}

    def faults(self) -> list[str]:
        """Links to ports or nodes that aren't there, inputs fed twice, back links into required inputs [CHK-14, SUP-22, WIN-14]."""
        out, fed = [], set()
        for x in self.links:
            if x.source not in self.nodes or x.target not in self.nodes:
                out.append(f"{x.source} to {x.target}: no such node")
                continue
            if x.input not in self.nodes[x.target].inputs:
                out.append(f"{x.target} has no input {x.input}")
            if x.guard and x.output not in self.nodes[x.source].judges:
                out.append(f"{x.source}.{x.output} is guarded and nothing judges it")
            if x.back:
                if self.nodes[x.target].inputs.get(x.input) is False and (x.target, x.input) not in {(y.target, y.input) for y in self.links if not y.back}:
                    out.append(f"a back link is all that feeds {x.target}.{x.input}")
            elif (x.target, x.input) in fed:
                out.append(f"{x.target}.{x.input} is fed twice")
            fed.add((x.target, x.input)) if not x.back else None
        return out


@dataclass
class Run:
    """What a run did: node passes, what was bound at its end, and whether a budget ran out."""

    passes: dict[str, int] = field(default_factory=dict)
    trace: list[tuple[str, int, str]] = field(default_factory=list)
    bound: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    exhausted: list[str] = field(default_factory=list)
    queue: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        """'parked', 'exhausted' or 'completed' [WFL-09]."""
        return "parked" if self.queue else "exhausted" if self.exhausted else "completed"


def run(flow: Flow, bindings: dict[tuple[str, str], DataFrame], budget: int = 1, pause_before: str | None = None, resumed: Run | None = None, stored: bool = True) -> Run:
    """Run a flow [WFL-01..WFL-06, WFL-08, WFL-09]; judges are taken whatever their measured confidence.

    Bindings must name open inputs and give every required one. A node
    whose required input nothing delivered is skipped. A link that doesn't
    fire takes back what it delivered before; a back link fires while its
    target has passes left, and queues every node from its target to its
    source again. ``pause_before`` parks the run ahead of a node; passing
    the parked run resumes it. What a node makes is written before it is
    judged and delivered, so a node that only fails when its rows are read
    still stops the run by its own name; with ``stored`` false it isn't.
    """
    order = flow.order()
    if resumed is None:
        wanted = flow.open_inputs()
        if strange := set(bindings) - set(wanted):
            raise Stop(f"not an open input: {sorted(strange)}")
        if missing := [k for k, optional in wanted.items() if not optional and k not in bindings]:
            raise Stop(f"not bound: {sorted(missing)}")
        state = Run(bound=dict(bindings), queue=list(order))
    else:
        state = resumed
        state.bound |= bindings
    skip_pause = resumed is not None
    while state.queue:
        name = state.queue[0]
        if name == pause_before and not skip_pause:
            return state
        skip_pause = False
        state.queue.pop(0)
        node = flow.nodes[name]
        have = {p: state.bound[(name, p)] for p in node.inputs if (name, p) in state.bound}
        if any(not optional and p not in have for p, optional in node.inputs.items()):
            state.trace.append((name, state.passes.get(name, 0), "skipped"))
            continue
        state.passes[name] = state.passes.get(name, 0) + 1
        try:
            made = node.work(have)
            made = {p: written(v) for p, v in made.items()} if stored else made
        except Exception as problem:
            raise Stop(f"{name}: {problem}") from problem
        state.trace.append((name, state.passes[name], "ran"))
        for port, value in made.items():
            state.bound[(name, port)] = value
            leaving = [x for x in flow.links if x.source == name and x.output == port]
            judge = node.judges.get(port)
            if judge is None and any(x.guard for x in leaving):
                raise Stop(f"{name}.{port} is guarded and nothing judges it")
            verdicts = judge(value) if judge and any(x.guard for x in leaving) else []
            for x in leaving:
                spent = x.back and state.passes.get(x.target, 0) >= budget
                if not fires(x.guard, verdicts) or spent:
                    state.bound.pop((x.target, x.input), None)
                    if spent and fires(x.guard, verdicts):
                        state.exhausted.append(f"{x.target}.{x.input}")
                    continue
                state.bound[(x.target, x.input)] = value
                if x.back:
                    first, last = order.index(x.target), order.index(name)
                    again = [n for n in order[first : last + 1]]
                    state.queue = again + [n for n in state.queue if n not in again]
    return state


_RECORD = "queue array<string>, passes map<string, int>, exhausted array<string>, trace array<struct<node: string, nth: int, state: string>>, ports array<struct<node: string, port: string>>"


def parked(spark: SparkSession, state: Run, folder: str) -> None:
    """Write a parked run, its tables and then its record, so that it may be resumed in another session [WFL-08, STR-05]."""
    for (node, port), df in state.bound.items():
        df.write.mode("overwrite").parquet(f"{folder}/bound/{node}/{port}")
    record = (state.queue, state.passes, state.exhausted, state.trace, list(state.bound))
    spark.createDataFrame([record], _RECORD).coalesce(1).write.mode("overwrite").json(f"{folder}/record")


def unparked(spark: SparkSession, folder: str) -> Run:
    """The run that ``parked`` wrote."""
    r = spark.read.schema(_RECORD).json(f"{folder}/record").first()
    bound = {(p["node"], p["port"]): spark.read.parquet(f"{folder}/bound/{p['node']}/{p['port']}") for p in r["ports"]}
    return Run(passes=dict(r["passes"]), trace=[tuple(t) for t in r["trace"]], bound=bound, exhausted=list(r["exhausted"]), queue=list(r["queue"]))


def budget_for(priorities: list[str | None], by_priority: dict[str, int], otherwise: int = 1) -> int:
    """The most passes that any bound item's priority allows, else the plain budget [AGG-18]."""
    return max([by_priority[p] for p in priorities if p in by_priority], default=otherwise)
