"""The ordered layer: one ruleset over one stream, event by event, for what depends on the order of arrival.

It holds per scope a ring of events, waiting anchors, causes, problems and ambiguities.  Plans use it by groups that share
no state (see run_groups and the streaming runner); whatever has no such dependence is a plan in evidence.py.

An event is a dict: event_id, event_type, time_ms, scope (type, key), target (type, key) or None, fields, strings, scopes.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..catalog import ANCESTORS, Catalog
from ..plans.rule_text import Correlate, Intent, Limits, Rule, Ruleset, exclusive_pairs
from .topology import upstream_of

LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Failed(Exception):
    """A predicate that cannot be computed; the rule does not fire."""


@dataclass
class Topology:
    known: set = field(default_factory=set)
    related: set = field(default_factory=set)  # (relation, a, b), either way
    above: dict = field(default_factory=dict)
    hops: int = 16

    def call(self, name: str, a, b) -> tuple[bool | None, str | None]:
        if a is None or b is None:
            return None, None
        if name == "upstream_of":
            return upstream_of(self.above, self.known, a, b, self.hops)
        if a == b or (name, a, b) in self.related or (name, b, a) in self.related:
            return True, None
        return (False, None) if a in self.known and b in self.known else (None, None)


@dataclass
class Binding:
    source: str
    state: str = "Bound"
    node: dict | None = None


@dataclass
class Partition:
    ring: list = field(default_factory=list)  # (time, number of arrival, event)
    pending: int = 0  # anchors that wait
    seen: set = field(default_factory=set)
    causes: dict = field(default_factory=dict)
    problems: list = field(default_factory=list)
    cooled: dict = field(default_factory=dict)
    ambiguities: dict = field(default_factory=dict)
    edges: list = field(default_factory=list)


class Engine:
    def __init__(self, rules: Ruleset, catalog: Catalog, limits: Limits = Limits(), topology: Topology | None = None, live: bool = False):
        self.rules, self.catalog, self.limits, self.topology, self.live = rules, catalog, limits, topology or Topology(hops=limits.hops), live
        self.parts: dict[tuple, Partition] = {}
        self.watermark: int | None = None
        self.audit: list[dict] = []
        self.diagnostics: list[tuple[str, str]] = []
        self.late: list[dict] = []
        self.absent: list[tuple] = []  # windows that were decided absent: scope, event type, from, to, rule
        self.sources: dict[tuple, list[int]] = {}
        self.waiting: list[tuple] = []  # (upper, scope, rule name, event id, rule, event), in the order in which they resume
        self.children: dict[tuple, dict[tuple, int]] = {}  # (cause, target) -> scopes below and their confidence
        self.rolled: set[tuple] = set()  # (child, parent) of the edges of roll-ups
        self.touched: set[int] = set()  # causes and problems that are new or changed since the last drain
        self.swept = LEAST
        self.arrived = self.left = 0
        self.pairs = exclusive_pairs(rules, catalog)

    # -- stream

    def ingest(self, event: dict, wall: int | None = None) -> None:
        t, scope = event["time_ms"], tuple(event["scope"])
        if self.live and self.watermark is not None and t <= self.watermark - self.limits.allowed_lateness:
            self.late.append(event)
            self.diagnostics.append(("ADGL3003", f"event {event['event_id']} is late"))
            return
        if not self.live and self.watermark is not None and t < self.watermark:
            if any(s == scope and k == event["event_type"] and a <= t <= b for s, k, a, b, _ in self.absent):
                self.note("late_event", "ADGL3002", event["event_type"], scope)
        self._advance(t, scope, wall)
        self._push(scope, event)
        self._resume()
        self._forget()
        self.left = self.limits.firings
        for rule in self.rules.rules:
            if rule.source == "event" and rule.kind == event["event_type"] and rule.scope == scope[0]:
                self._match(rule, scope, event)

    def _advance(self, t: int, scope: tuple, wall: int | None) -> None:
        """Offline the greatest time; live the least over scopes that are not idle, each behind by max_disorder."""
        if not self.live:
            self.watermark = t if self.watermark is None else max(self.watermark, t)
            return
        wall = t if wall is None else wall
        own = self.sources.setdefault(scope, [LEAST, wall])
        own[0], own[1] = max(own[0], t - self.limits.max_disorder), wall
        awake = [local for local, seen in self.sources.values() if wall - seen < self.limits.idle_timeout]
        if awake and (self.watermark is None or min(awake) > self.watermark):
            self.watermark = min(awake)

    def tick(self, wall: int) -> None:
        """Wall time goes on without an event: scopes that have become idle no longer hold the watermark."""
        awake = [local for local, seen in self.sources.values() if wall - seen < self.limits.idle_timeout]
        if self.live and awake and self.watermark is not None and min(awake) > self.watermark:
            self.advance(min(awake))

    def advance(self, t: int) -> None:
        """A punctuation: time has come to t."""
        self.watermark = t if self.watermark is None else max(self.watermark, t)
        self._resume()
        self._forget()

    def finish(self) -> None:
        """All that waits is decided; a second call changes nothing."""
        if self.watermark is not None and self.waiting:
            self.advance(max(self.watermark + self.rules.forward, self.waiting[-1][0]) + 1)

    def part(self, scope: tuple) -> Partition:
        return self.parts.setdefault(scope, Partition())

    def _push(self, scope: tuple, event: dict) -> None:
        ring = self.part(scope).ring
        if len(ring) >= self.limits.events:
            ring.pop(0)
            self.diagnostics.append(("ADGL3005", f"{scope}: the oldest event made room"))
        self.arrived += 1
        insort(ring, (event["time_ms"], self.arrived, event), key=lambda x: x[:2])

    def _match(self, rule: Rule, scope: tuple, event: dict) -> None:
        if not self._holds(rule, rule.where, {rule.anchor: Binding("event", node=event)}, scope):
            return
        upper = event["time_ms"] + rule.forward
        if upper <= self.watermark:
            self._run(rule, scope, Binding("event", node=event))
            return
        p = self.part(scope)
        insort(self.waiting, (upper, scope, rule.name, event["event_id"], rule, event), key=lambda x: x[:4])
        p.pending += 1
        if p.pending > self.limits.pending:
            last = next(i for i in reversed(range(len(self.waiting))) if self.waiting[i][1] == scope)
            del self.waiting[last]
            p.pending -= 1
            self.diagnostics.append(("ADGL3004", f"{scope}: an anchor that waits longest was dropped"))

    def _resume(self) -> None:
        n = bisect_left(self.waiting, self.watermark, key=lambda x: x[0])
        ready, self.waiting = self.waiting[:n], self.waiting[n:]
        for _, scope, _, _, rule, event in ready:
            p = self.part(scope)
            p.pending -= 1
            at = bisect_left(p.ring, (event["time_ms"],), key=lambda x: x[:1])
            if not any(x[2]["event_id"] == event["event_id"] for x in p.ring[at : bisect_right(p.ring, event["time_ms"], key=lambda x: x[0])]):
                self.diagnostics.append(("MissingAnchor", f"{rule.name}: the anchor {event['event_id']} has gone"))
                continue
            self.left = self.limits.firings
            self._run(rule, scope, Binding("event", node=event))

    def _forget(self) -> None:
        """State that no window reaches any more goes, in one sweep for every quarter of the lookback."""
        if self.watermark < self.swept + self.limits.max_lookback // 4:
            return
        self.swept = self.watermark
        oldest = self.watermark - self.limits.max_lookback
        window = oldest // self.limits.dedup_window
        for p in self.parts.values():
            del p.ring[: bisect_left(p.ring, (oldest,), key=lambda x: x[:1])]
            p.seen = {k for k in p.seen if k[-1] >= window}
            p.cooled = {k: t for k, t in p.cooled.items() if t >= oldest - self.cooldown}
        self.absent = [a for a in self.absent if a[3] >= oldest]

    @property
    def cooldown(self) -> int:
        return self.limits.dedup_window if self.limits.cooldown is None else self.limits.cooldown

    # -- predicates

    def _holds(self, rule: Rule, e: tuple | None, names: dict[str, Binding], scope: tuple) -> bool:
        try:
            return e is None or self.value(e, names, scope) is True
        except Failed as why:
            self.diagnostics.append(("ADGL3007", f"{rule.name}: {why}"))
            return False

    def value(self, e: tuple, names: dict[str, Binding], scope: tuple):
        """None is unknown.  Both sides of an operator are computed."""
        op = e[0]
        if op in ("int", "str", "bool", "ms"):
            return e[1]
        if op == "name":
            root, _, rest = e[1].partition(".")
            if e[1] == "scope" and root not in names:
                return scope
            b = names[root]
            if b.state != "Bound":
                return None
            if rest == "time":
                return b.node["time_ms"]
            if rest in ("", "target"):
                return b.node.get("target") or b.node["scope"]
            if b.source != "event":
                return b.node.get(rest) if rest == "confidence" else None
            last = rest.rpartition(".")[2]
            for group in ("fields", "strings", "scopes"):
                if last in (b.node.get(group) or {}):
                    return b.node[group][last]
            return None
        if op == "call":
            state = names[e[2][0][1]].state
            return None if state == "Unknown" else (state == "Bound") == (e[1] == "present")
        if op == "not":
            x = self.value(e[1], names, scope)
            return None if x is None else not x
        x, y = self.value(e[1], names, scope), self.value(e[2], names, scope)
        if op == "and":
            return False if x is False or y is False else None if x is None or y is None else True
        if op == "or":
            return True if x is True or y is True else None if x is None or y is None else False
        if x is None or y is None:
            return None
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op in ("/", "%"):
            if y == 0:
                raise Failed("division by zero")
            q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
            x = q if op == "/" else x - q * y
        else:
            x = x + y if op == "+" else x - y if op == "-" else x * y
        if not LEAST <= x <= MOST:
            raise Failed("overflow")
        return x

    # -- rules

    def _bind(self, rule: Rule, c: Correlate, scope: tuple, names: dict[str, Binding], anchor: Binding) -> Binding:
        p, t = self.part(scope), anchor.node["time_ms"]
        low, high = t - c.back, t + c.forward
        if c.source == "event":
            ring = p.ring
            found = [x[2] for x in ring[bisect_left(ring, low, key=lambda x: x[0]) : bisect_right(ring, high, key=lambda x: x[0])] if x[2]["event_type"] == c.kind]
        elif c.source == "Problem":
            found = sorted((x for x in p.problems if x["kind"] == c.kind and low <= x["time_ms"] <= high), key=lambda x: (x["time_ms"], x["id"]))
        else:
            found = sorted((x for x in p.causes.values() if x["kind"] == c.kind and low <= x["time_ms"] <= high), key=lambda x: (x["time_ms"], x["id"]))
        hits, first, unknown = 0, None, False
        for node in found:
            if node is anchor.node:
                continue
            here = {**names, c.name: Binding(c.source, node=node)}
            args = [self.value(a, here, scope) for a in c.topo[2]] if len(c.topo[2]) == 2 else [None, None]
            true, fault = self.topology.call(c.topo[1], *(tuple(a) if isinstance(a, (list, tuple)) else None for a in args))
            if fault:
                self.diagnostics.append((fault, f"{rule.name}: {c.topo[1]}"))
            unknown |= true is None
            if true:
                hits += 1
                first = first or node
                if hits == c.count:
                    return Binding(c.source, node=first)
        if unknown:
            return Binding(c.source, "Unknown")
        if c.source == "event":
            self.absent.append((scope, c.kind, low, high, rule.name))
        return Binding(c.source, "Absent")

    def _run(self, rule: Rule, scope: tuple, anchor: Binding) -> None:
        if self.left <= 0:
            self.diagnostics.append(("ADGL3103", f"{rule.name}: too many firings"))
            return
        self.left -= 1
        names = {rule.anchor: anchor}
        for c in rule.correlates:
            names[c.name] = self._bind(rule, c, scope, names, anchor)
        intents: tuple[Intent, ...] = rule.body
        if rule.condition is not None:
            try:
                true = self.value(rule.condition, names, scope)
            except Failed as why:
                self.diagnostics.append(("ADGL3007", f"{rule.name}: {why}"))
                return
            # A rule with a branch has no other body.
            intents = rule.then if true is True else rule.otherwise if true is False else rule.unknown
        for i in intents:
            self._intent(rule, i, scope, names)

    def _target(self, rule: Rule, e: tuple | None, scope: tuple, names: dict[str, Binding]):
        if e is None:
            return scope
        if e[0] != "name" or e[1].count(".") > 1:
            self.diagnostics.append(("ADGL3008", f"{rule.name}: target"))
            return None
        got = self.value(e, names, scope)
        if not isinstance(got, (tuple, list)):
            self.diagnostics.append(("ADGL3008", f"{rule.name}: {e[1]} is no scope"))
            return None
        return tuple(got)

    def _intent(self, rule: Rule, i: Intent, scope: tuple, names: dict[str, Binding]) -> None:
        target = self._target(rule, i.target, scope, names)
        if target is None:
            return
        bound = [names[n] for n in i.evidence if names[n].state == "Bound"]
        if i.verb == "infer":
            self._infer(rule, i, scope, target, names[rule.anchor].node["time_ms"], bound)
        elif i.verb == "emit":
            self._emit(rule, i, scope, target, bound)
        else:
            if i.kind == "suppress_symptom" and names[i.argument].state == "Bound":
                hit = names[i.argument].node
                for x in self.part(scope).problems:
                    if (x["kind"], x["target"]) == (hit["kind"], hit["target"]):
                        x["superseded"] = True
                        self.touched.add(x["id"])
            self.note(i.kind, "ADGL3001" if i.kind == "request_observation" and not self.live else None, i.argument, target, rule.name)

    def note(self, action: str, code: str | None, argument, target: tuple, rule: str = "") -> None:
        self.audit.append({"wm": self.watermark, "rule": rule, "action": action, "argument": argument, "target": target, "code": code})

    def _infer(self, rule: Rule, i: Intent, scope: tuple, target: tuple, t: int, bound: list[Binding]) -> None:
        p = self.part(scope)
        key = (rule.name, i.kind, target, t // self.limits.dedup_window)
        if key in p.seen:
            return
        cause = p.causes.get((i.kind, target))
        if cause is None and len(p.causes) >= self.limits.causes:
            self.diagnostics.append(("ADGL3102", f"{scope}: too many causes"))
            return
        p.seen.add(key)
        if cause is None:
            cause = p.causes[i.kind, target] = {"id": self._new(), "kind": i.kind, "target": target, "scope": scope, "time_ms": t, "confidence": 0}
        cause["confidence"] = max(0, min(100, cause["confidence"] + i.weight))
        kind = "Supports" if i.weight >= 0 else "Contradicts"
        p.edges += [{"src": b.node.get("event_id", b.node.get("id")), "dst": cause["id"], "kind": kind} for b in bound]
        self._changed(scope, cause)
        if scope != target and target[0] in ANCESTORS[scope[0]]:
            self._roll_up(i.kind, target, cause)

    def _new(self) -> int:
        self.arrived += 1
        return self.arrived

    def _roll_up(self, kind: str, target: tuple, child: dict) -> None:
        """The parent holds the largest confidence among the scopes below it; what it inferred itself is overwritten."""
        below = self.children.setdefault((kind, target), {})
        below[child["scope"]] = child["confidence"]
        parent = self.part(target)
        cause = parent.causes.get((kind, target))
        if cause is None:
            cause = parent.causes[kind, target] = {"id": self._new(), "kind": kind, "target": target, "scope": target, "time_ms": self.watermark, "confidence": 0}
        if (child["id"], cause["id"]) not in self.rolled:
            self.rolled.add((child["id"], cause["id"]))
            parent.edges.append({"src": child["id"], "dst": cause["id"], "kind": "RollsUp"})
        cause["confidence"] = max(below.values())
        self._changed(target, cause)

    def _changed(self, scope: tuple, cause: dict) -> None:
        self.touched.add(cause["id"])
        self._compare(scope, cause)
        self._decide("Cause", scope, cause)

    def _decide(self, source: str, scope: tuple, node: dict) -> None:
        for rule in self.rules.rules:
            if rule.source == source and rule.kind == node["kind"] and rule.scope == scope[0]:
                if self._holds(rule, rule.where, {rule.anchor: Binding(source, node=node)}, scope):
                    self._run(rule, scope, Binding(source, node=node))

    def _compare(self, scope: tuple, cause: dict) -> None:
        p = self.part(scope)
        for pair in self.pairs:
            if cause["kind"] not in pair:
                continue
            other = p.causes.get((pair[0] if pair[1] == cause["kind"] else pair[1], cause["target"]))
            a, b = cause["confidence"], other["confidence"] if other else 0
            key = (pair, cause["target"])
            if 40 <= a < 80 and 40 <= b < 80 and abs(a - b) < 15:
                if key not in p.ambiguities:
                    p.ambiguities[key] = "Active"
                    known = self.catalog.problems.get("AmbiguousDiagnosis")
                    self._problem(scope, "AmbiguousDiagnosis", cause["target"], "Medium", known.sarif_id if known else "ap_ambiguous", [cause, other])
                    self.note("mark_ambiguous", None, "/".join(pair), cause["target"], self.rules.name)
            elif p.ambiguities.get(key) == "Active" and (max(a, b) >= 80 or abs(a - b) >= 15):
                p.ambiguities[key] = "Resolved"

    def _problem(self, scope: tuple, kind: str, target: tuple, severity: str, sarif: str, evidence: list[dict]) -> dict:
        made = {"id": self._new(), "kind": kind, "target": target, "scope": scope, "time_ms": self.watermark, "severity": severity, "sarif_id": sarif}
        made |= {"causes": list(dict.fromkeys(x["kind"] for x in evidence)), "superseded": False}
        self.part(scope).problems.append(made)
        self.touched.add(made["id"])
        return made

    def _emit(self, rule: Rule, i: Intent, scope: tuple, target: tuple, bound: list[Binding]) -> None:
        p, key = self.part(scope), (rule.name, i.kind, target)
        if key in p.cooled and self.watermark - p.cooled[key] <= self.cooldown:
            return
        p.cooled[key] = self.watermark
        known = self.catalog.problems.get(i.kind)
        severity = i.severity or (known.severity if known else "Medium")
        made = self._problem(scope, i.kind, target, severity, i.sarif_id or (known.sarif_id if known else "unknown"), [b.node for b in bound if b.source != "event"])
        self._decide("Problem", scope, made)

    # -- read-out

    def snapshot(self) -> dict[str, list[dict]]:
        causes = sorted((c for p in self.parts.values() for c in p.causes.values()), key=lambda c: (c["scope"], c["kind"], c["target"]))
        problems = [x for s in sorted(self.parts) for x in self.parts[s].problems]
        audit = sorted(self.audit, key=lambda a: (a["wm"], a["rule"], a["action"], a["target"]))
        return {"causes": causes, "problems": problems, "audit": audit}

    def drain(self) -> dict[str, list[dict]]:
        """What is new or changed since the last call, for a stream that keeps no history here.

        Audit, diagnostics and late events go with it, and so do problems and edges that no window reaches any more: such
        a problem can no longer be marked as superseded.
        """
        got = self.snapshot()
        new = {part: [x for x in got[part] if x["id"] in self.touched] for part in ("causes", "problems")} | {"audit": got["audit"]}
        self.touched, self.audit, self.diagnostics, self.late = set(), [], [], []
        oldest = LEAST if self.watermark is None else self.watermark - self.limits.max_lookback
        for p in self.parts.values():
            p.problems = [x for x in p.problems if x["time_ms"] >= oldest]
            p.edges = []
        return new


OUTPUT = "root string, part string, scope string, kind string, target string, confidence int, time_ms long, severity string, sarif_id string, causes string, superseded boolean, code string"


def event_of(row) -> dict:
    """An event from a row with scope_type, scope_key, target_type, target_key, fields (JSON of numbers, texts and scopes)."""
    parts = json.loads(row.fields) if row.fields else {}
    target = (row.target_type, row.target_key) if row.target_type else None
    return {"event_id": int(row.event_id), "event_type": row.event_type, "time_ms": int(row.time_ms), "scope": (row.scope_type, row.scope_key), "target": target} | {
        "fields": {k: v for k, v in parts.items() if isinstance(v, int)},
        "strings": {k: v for k, v in parts.items() if isinstance(v, str)},
        "scopes": {k: tuple(v) for k, v in parts.items() if isinstance(v, list)},
    }


def rows_of(root: str, snapshot: dict[str, list[dict]]) -> pd.DataFrame:
    name = lambda s: ":".join(map(str, s))
    out = [(root, "cause", name(c["scope"]), c["kind"], name(c["target"]), c["confidence"], c["time_ms"], None, None, None, None, None) for c in snapshot["causes"]]
    out += [(root, "problem", name(x["scope"]), x["kind"], name(x["target"]), None, x["time_ms"], x["severity"], x["sarif_id"], ",".join(x["causes"]), x["superseded"], None) for x in snapshot["problems"]]
    out += [(root, "audit", None, a["action"], name(a["target"]), None, a["wm"], None, a["argument"], a["rule"], None, a["code"]) for a in snapshot["audit"]]
    made = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return made.astype({"confidence": "Int32", "time_ms": "Int64"})


def run_groups(events: DataFrame, root: str, rules: Ruleset, catalog: Catalog, limits: Limits = Limits(), topology: Topology | None = None) -> DataFrame:
    """The snapshot of each group of events; groups (column root) must hold all scopes that roll up into one another.

    A group is replayed in order of (time_ms, event_id) by one task, as its state is sequential; roots are what spreads.
    """

    def replay(key, pdf: pd.DataFrame) -> pd.DataFrame:
        engine = Engine(rules, catalog, limits, topology)
        for row in pdf.sort_values(["time_ms", "event_id"]).itertuples(index=False):
            engine.ingest(event_of(row))
        engine.finish()
        return rows_of(str(key[0]), engine.snapshot())

    return events.groupBy(root).applyInPandas(lambda key, pdf: replay(key, pdf), OUTPUT)
