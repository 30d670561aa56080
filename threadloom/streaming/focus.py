"""Working memory: what a session is about, as a small decaying graph with a budget.

Every ``input`` event opens a turn and fades all nodes; an event's first references become fresh, gain a count, and weigh on the edges among them.
Beyond the budget the node of lowest score goes, leaving a stub where a live neighbour remains. Decay counts turns, not time, so the events of a
session must be taken in order: ``focus_graphs`` does so for finite tables and ``focus_stream`` keeps the graph as the state of a keyed stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fading per turn, references per event, budgets of nodes and stubs, and the parts of a score.
FADE, REFS_PER_EVENT, NODE_BUDGET, STUB_BUDGET = 0.85, 12, 200, 100
RECENCY, FREQUENCY, DEGREE, PIN = 1.0, 0.5, 0.8, 10.0
OUT = "session string, name string, recency double, freq long, stub boolean, first_turn long, last_turn long, score double"


class Focus:
    """The graph of one session. nodes: name -> [recency, freq, pin, stub, first_turn, last_turn]; edges: (a, b), a < b -> weight."""

    def __init__(self, state: str | None = None, budget: int = NODE_BUDGET) -> None:
        held = json.loads(state) if state else {"turn": 0, "nodes": {}, "edges": []}
        self.turn, self.nodes, self.budget = held["turn"], held["nodes"], budget
        self.edges = {(a, b): w for a, b, w in held["edges"]}

    def dump(self) -> str:
        return json.dumps({"turn": self.turn, "nodes": self.nodes, "edges": [[a, b, w] for (a, b), w in self.edges.items()]})

    def event(self, kind: str, refs: Iterable[str]) -> None:
        if kind == "input":
            self.turn += 1
            for node in self.nodes.values():
                if not node[3]:
                    node[0] *= FADE
        fresh = [r for r in list(refs)[:REFS_PER_EVENT] if r]
        for name in fresh:
            node = self.nodes.setdefault(name, [1.0, 0, 0, False, self.turn, self.turn])
            node[0], node[1], node[3], node[5] = 1.0, node[1] + 1, False, self.turn
        for a, b in combinations(fresh, 2):
            pair = (a, b) if a <= b else (b, a)
            self.edges[pair] = self.edges.get(pair, 0.0) + 1.0
        self.trim()

    def neighbours(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {x: set() for x in self.nodes}
        for a, b in self.edges:
            out[a].add(b)
            out[b].add(a)
        return out

    def norms(self, near: dict[str, set[str]]) -> tuple[int, int]:
        """What degrees and frequencies are measured by: the largest of all nodes, the largest of nodes that aren't stubs."""
        return max(map(len, near.values()), default=0) or 1, max((n[1] for n in self.nodes.values() if not n[3]), default=0) or 1

    def score(self, name: str, degree: int, norms: tuple[int, int]) -> float:
        recency, freq, pin = self.nodes[name][:3]
        return RECENCY * recency + FREQUENCY * freq / norms[1] + DEGREE * degree / norms[0] + PIN * pin

    def scores(self) -> dict[str, float]:
        near = self.neighbours()
        norms = self.norms(near)
        return {x: self.score(x, len(near[x]), norms) for x in self.nodes}

    def trim(self) -> None:
        """Back to the budgets: the lowest scores go first, and of stubs the oldest. A heap of scores is kept as long as what they are
        measured by stays."""
        over = sum(not n[3] for n in self.nodes.values()) - self.budget
        stubs = sum(n[3] for n in self.nodes.values())
        if over <= 0 and stubs <= STUB_BUDGET:
            return
        near, gone, norms, heap = self.neighbours(), set(), None, []
        while over > 0:
            now = self.norms(near)
            if now != norms:
                norms = now
                heap = [(self.score(x, len(near[x]), norms), x) for x, n in self.nodes.items() if x in near and not n[3] and not n[2]]
                heapify(heap)
            if not heap:
                break  # all that is left is pinned
            stale, victim = heappop(heap)
            if victim not in near or self.nodes[victim][3]:
                continue
            if stale != (true := self.score(victim, len(near[victim]), norms)):
                heappush(heap, (true, victim))
                continue
            over -= 1
            if any(not self.nodes[x][3] for x in near[victim] - {victim}):
                self.nodes[victim][0], self.nodes[victim][3] = 0.0, True
            else:
                for x in near.pop(victim) - {victim}:
                    near[x].discard(victim)
                    if not self.nodes[x][3] and not self.nodes[x][2]:
                        heappush(heap, (self.score(x, len(near[x]), norms), x))
                gone.add(victim)
                del self.nodes[victim]
        stubs = sorted((n[5], x) for x, n in self.nodes.items() if n[3])
        for _, x in stubs[: max(0, len(stubs) - STUB_BUDGET)]:
            gone.add(x)
            del self.nodes[x]
        if gone:
            self.edges = {e: w for e, w in self.edges.items() if gone.isdisjoint(e)}

    def frame(self, session: str) -> pd.DataFrame:
        score = self.scores()
        rows = [
            (session, x, n[0], n[1], n[3], n[4], n[5], round(score[x], 9)) for x, n in sorted(self.nodes.items(), key=lambda i: (-score[i[0]], i[0]))
        ]
        return pd.DataFrame(rows, columns=["session", "name", "recency", "freq", "stub", "first_turn", "last_turn", "score"])

    def pairs(self) -> list[tuple[str, str, float]]:
        return [(a, b, w) for (a, b), w in sorted(self.edges.items())]


def focus_graphs(events: DataFrame, budget: int = NODE_BUDGET) -> DataFrame:
    """The nodes of every session's graph after all of its events (session string, seq, kind, refs array<string>). A session's ring is bounded by
    its owner."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        focus = Focus(budget=budget)
        for kind, refs in frame.sort_values("seq", kind="stable")[["kind", "refs"]].itertuples(index=False):
            focus.event(kind, refs if refs is not None else [])
        return focus.frame(frame["session"].iloc[0])

    return events.select("session", "seq", "kind", "refs").groupBy("session").applyInPandas(run, OUT)


def focus_stream(events: DataFrame, budget: int = NODE_BUDGET) -> DataFrame:
    """The same as a stream: with each batch, the graphs of the sessions that it touched, whole. Within a batch events are put in order of seq."""

    def process(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        focus = Focus(state.get[0] if state.exists else None, budget)
        batch = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for kind, refs in batch[["kind", "refs"]].itertuples(index=False):
            focus.event(kind, refs if refs is not None else [])
        state.update((focus.dump(),))
        yield focus.frame(key[0])

    return events.select("session", "seq", "kind", "refs").groupBy("session").applyInPandasWithState(
        process, OUT, "graph string", "update", GroupStateTimeout.NoTimeout
    )
