"""Rulesets as plans: anchors, bindings, branches and their intents over whole event tables.

Each rule is one branch of the plan.  Results are those of the ordered layer where the input is in time order and no
limit is reached; a rule's work counts as done at the end of its window (exec_ms), the order of inferences is
(exec_ms, place of the rule, event_id).  Decisions follow causes, and problems of other decisions, in all their branches; they
look back at causes and problems that came before them in that order, and may mark problems as superseded.

Roll-up and ambiguity over time belong to the ordered layer; a decision on AmbiguousDiagnosis is refused here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import checked
from ..operators import evidence
from ..operators.correlate import bind
from .lexing import names_in
from .rule_text import WARNINGS, Limits, Rule, Ruleset, check

EVENT = ["event_id", "event_type", "time_ms", "scope_type", "scope_key", "target", "fields", "strings", "scopes"]


@dataclass
class Plan:
    infers: DataFrame
    causes: DataFrame
    problems: DataFrame
    actions: DataFrame


def expression(e: tuple, load: Callable[[str], Column], state: Callable[[str], Column]) -> checked.Checked:
    op = e[0]
    if op in ("int", "ms"):
        return checked.exact(F.lit(e[1]).cast("long"))
    if op in ("str", "bool"):
        return checked.exact(F.lit(e[1]))
    if op == "name":
        return checked.exact(load(e[1]))
    if op == "call":
        return checked.presence(state(e[2][0][1]), e[1])
    if op == "not":
        return checked.negate(expression(e[1], load, state))
    a, b = (expression(x, load, state) for x in e[1:3])
    if op in ("and", "or"):
        return checked.logic(op, a, b)
    return checked.compare(op, a, b) if op in ("==", "!=", "<", "<=", ">", ">=") else checked.arithmetic(op, a, b)


def _loader(rule: Rule, catalog: Catalog) -> Callable[[str], Column]:
    sources = {rule.anchor: (rule.source, rule.kind)} | {c.name: (c.source, c.kind) for c in rule.correlates}

    def load(name: str) -> Column:
        if name == "scope" and name not in sources:
            return F.struct("scope_type", F.col("scope_key").alias("key"))
        root, _, rest = name.partition(".")
        at = (lambda c: F.col(c)) if root == rule.anchor else (lambda c: F.col(f"{root}.{c}"))
        last = rest.rpartition(".")[2]
        if last == "time":
            return at("time_ms")
        if last in ("", "target"):
            return F.coalesce(at("target"), F.struct(at("scope_type").alias("scope_type"), at("scope_key").alias("key")))
        if sources[root][0] != "event":
            return at(last)
        kind = catalog.events[sources[root][1]].fields[last]
        return at("scopes" if kind.startswith("scope") else "strings" if kind == "string" else "fields")[last]

    return load


def _intents(rows: DataFrame, rule: Rule, place: int, load, branch: str, intents) -> list[tuple[str, DataFrame]]:
    out = []
    for i in intents:
        target = load(i.target[1]) if i.target else F.struct(F.col("scope_type").alias("scope_type"), F.col("scope_key").alias("key"))
        ids = [F.col("event_id") if n == rule.anchor else F.when(F.col(f"{n}_state") == "Bound", F.col(f"{n}.event_id")) for n in i.evidence]
        cols = [
            F.lit(rule.name).alias("rule"), F.lit(place).alias("place"), F.lit(i.kind).alias("kind"), "event_id", "time_ms", "exec_ms", "scope_type", "scope_key",
            F.concat_ws(":", target["scope_type"], target["key"]).alias("target"), F.lit(i.weight).alias("weight"), F.lit(i.argument).cast("string").alias("argument"),
            F.filter(F.array(*ids) if ids else F.array().cast("array<bigint>"), lambda x: x.isNotNull()).alias("evidence"),
        ]
        mine = rows if branch == "always" else rows.where(F.col("_branch") == branch)
        out.append((i.verb, mine.where(target.isNotNull()).select(*cols)))
    return out


def compile_rules(rules: Ruleset, events: DataFrame, catalog: Catalog, limits: Limits = Limits(), relate: Callable[[DataFrame, str, Column, Column], DataFrame] | None = None, bucket: int | None = None) -> Plan:
    """Evidence rules to inferences and causes, and decisions to problems and actions.

    events: EVENT columns (target struct<scope_type,key>, maps fields, strings, scopes).  relate(pairs, function, a, b) adds
    _true; without it relations hold between equal scopes and are unknown between others.
    """
    if wrong := [x for x in check(rules, catalog, limits) if x[0] not in WARNINGS]:
        raise ValueError(f"{wrong}")
    if cannot := refused(rules):
        raise ValueError(f"the ordered layer is to run {cannot}")
    relate = relate or (lambda pairs, f, a, b: pairs.withColumn("_true", F.when(a == b, True)))
    parts: dict[str, list[DataFrame]] = {"infer": [], "action": [], "emit": []}
    for place, rule in enumerate(rules.rules):
        if rule.decision:
            continue
        load = _loader(rule, catalog)
        rows = events.where((F.col("event_type") == rule.kind) & (F.col("scope_type") == rule.scope))
        if rule.where is not None:
            rows = rows.where(expression(rule.where, load, None).holds())
        for c in rule.correlates:
            others = events.where((F.col("event_type") == c.kind) & (F.col("scope_type") == rule.scope)).select(*EVENT)
            a, b = (load(x[1]) for x in c.topo[2])
            rows = bind(rows, others, c.name, ["scope_type", "scope_key"], c.back, c.forward, c.count, lambda pairs, c=c, a=a, b=b: relate(pairs, c.topo[1], a, b), bucket)
        rows = rows.withColumn("exec_ms", F.col("time_ms") + rule.forward)
        if rule.condition is None:
            groups = [("always", rule.body)]
        else:
            true = expression(rule.condition, load, lambda n: F.col(f"{n}_state"))
            rows = rows.withColumn("_branch", F.when(true.error, "error").when(true.value, "then").when(~true.value, "else").otherwise("unknown"))
            groups = [("then", rule.then), ("else", rule.otherwise), ("unknown", rule.unknown)]
        for branch, intents in groups:
            for verb, found in _intents(rows, rule, place, load, branch, intents):
                parts[verb].append(found)
    spark = events.sparkSession
    shape = "rule string, place int, kind string, event_id long, time_ms long, exec_ms long, scope_type string, scope_key string, target string, weight int, argument string, evidence array<bigint>"
    union = lambda found: reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)
    order = ["exec_ms", "place", "event_id"]
    keys = ["scope_type", "scope_key", "kind", "target"]
    infers = evidence.first_in_window(union(parts["infer"]), ["rule", *keys], limits.dedup_window, order)
    runs = evidence.clamped_sums(infers, keys, order, "weight")
    causes = runs.groupBy(*keys).agg(F.max_by("confidence", F.struct(*order)).alias("confidence"), F.min_by("time_ms", F.struct(*order)).alias("first_ms"))

    first = runs.groupBy(*keys).agg(F.min(F.struct("exec_ms", F.col("place").cast("int").alias("place"), "event_id", F.lit(-1).alias("rank"))).alias("_ord"), F.min_by("time_ms", F.struct(*order)).alias("time_ms"))
    emitted, waiting = {}, [(place, rule) for place, rule in enumerate(rules.rules) if rule.decision]
    hushed = []
    while waiting:
        # Checks leave no cycle, so some rule starts from no other's problems; what a rule looks back at may come of later rules.
        leads = lambda r: {r.kind if r.source == "Problem" else None, *(c.kind for c in r.correlates if c.source == "Problem")} - {None}
        free = [(p, r) for p, r in waiting if not any(i.verb == "emit" and i.kind in leads(r) for _, o in waiting if o is not r for i in _all_intents(o))]
        if not free:
            raise ValueError("the ordered layer is to run decisions that look back at one another")
        place, rule = free[0]
        waiting.remove((place, rule))
        for verb, kind, found in _decided(rule, place, runs, first, emitted, catalog, limits, relate):
            if verb == "action":
                parts["action"].append(found)
            elif verb == "suppress":
                hushed.append(found)
            else:
                emitted.setdefault(kind, []).append(found)
    problems = [f for found in emitted.values() for f in found]
    nothing = "scope_type string, scope_key string, rule string, place int, problem string, target string, time_ms long, event_id long, severity string, sarif_id string, causes array<string>, superseded boolean"
    return Plan(infers, causes, _superseded(reduce(DataFrame.unionByName, problems), hushed) if problems else spark.createDataFrame([], nothing), union(parts["action"]))


def _superseded(problems: DataFrame, hushed: list[DataFrame]) -> DataFrame:
    """problems with superseded: those of a kind and target that a later decision of their scope marks."""
    if not hushed:
        return problems.withColumn("superseded", F.lit(False)).drop("_ord")
    last = reduce(DataFrame.unionByName, hushed).groupBy("_type", "_key", "_kind", "_target").agg(F.max("_ord").alias("_last"))
    same = (F.col("scope_type") == F.col("_type")) & (F.col("scope_key") == F.col("_key")) & (F.col("problem") == F.col("_kind")) & (F.col("target") == F.col("_target"))
    found = problems.join(last, same, "left").withColumn("superseded", F.coalesce(F.col("_ord") <= F.col("_last"), F.lit(False)))
    return found.drop("_ord", "_type", "_key", "_kind", "_target", "_last")


def _all_intents(rule: Rule) -> list:
    return [i for group in (rule.body, rule.then, rule.otherwise, rule.unknown) for i in group or ()]


def refused(rules: Ruleset) -> list[str]:
    """What a plan cannot do, by rule."""
    return [f"{r.name}: a decision on AmbiguousDiagnosis" for r in rules.rules if r.source == "Problem" and r.kind == "AmbiguousDiagnosis"]


def _scope_of(target: Column) -> Column:
    """type:key as the struct that events have."""
    return F.struct(F.substring_index(target, ":", 1).alias("scope_type"), F.substr(target, F.instr(target, ":") + 1).alias("key"))


def _bound(rows: DataFrame, rule: Rule, c, first: DataFrame, emitted: dict[str, list[DataFrame]], relate) -> DataFrame:
    """rows with the binding of a correlate among the causes or problems that came before each row."""
    if c.source == "Cause":
        others = first.where(F.col("kind") == c.kind).withColumn("_uid", F.xxhash64("scope_type", "scope_key", "kind", "target"))
    elif c.kind in emitted:
        others = reduce(DataFrame.unionByName, emitted[c.kind]).withColumn("_uid", _uid())
    else:
        return rows.withColumns({f"{c.name}_state": F.lit("Absent"), c.name: F.lit(None).cast("struct<target:string>")})
    others = others.where(F.col("scope_type") == rule.scope).select("scope_type", "scope_key", "target", "time_ms", F.col("_uid").alias("event_id"), "_ord")

    def related(pairs: DataFrame) -> DataFrame:
        at = lambda e: _scope_of(F.col("target") if e[1].partition(".")[0] == rule.anchor else F.col(f"{e[1].partition('.')[0]}.target"))
        a, b = map(at, c.topo[2])
        return relate(pairs, c.topo[1], a, b).withColumn("_true", F.when(F.col(f"{c.name}._ord") < F.col("_ord"), F.col("_true")).otherwise(False))

    return bind(rows, others, c.name, ["scope_type", "scope_key"], c.back, c.forward, c.count, related)


def _uid() -> Column:
    return F.xxhash64("scope_type", "scope_key", "rule", "problem", "target", "_ord")


def _decided(rule: Rule, place: int, runs: DataFrame, first: DataFrame, emitted: dict[str, list[DataFrame]], catalog: Catalog, limits: Limits, relate) -> list[tuple[str, str, DataFrame]]:
    """(verb, kind, rows) of every intent of a decision."""
    name = F.concat_ws(":", "scope_type", "scope_key")
    if rule.source == "Cause":
        # A cause's time is that of its first inference.
        since = first.select(*[F.col(k).alias(f"_f_{k}") for k in ("scope_type", "scope_key", "kind", "target")], F.col("time_ms").alias("_first_ms"))
        rows = runs.where(F.col("kind") == rule.kind)
        if rule.correlates or any(n.endswith(".time") for e in (rule.where, rule.condition) if e is not None for n in names_in(e)):
            same = F.lit(True)
            for k in ("scope_type", "scope_key", "kind", "target"):
                same = same & (F.col(k) == F.col(f"_f_{k}"))
            rows = rows.join(since, same)
        else:
            rows = rows.withColumn("_first_ms", F.col("time_ms"))
        order = F.struct("exec_ms", F.col("place").cast("int").alias("place"), "event_id", F.lit(-1).alias("rank"))
        rows = rows.select("scope_type", "scope_key", "target", F.col("_first_ms").alias("time_ms"), "event_id", "confidence", F.col("exec_ms").alias("_at"), F.array("kind").alias("_causes"), order.alias("_ord"))
        rows = rows.withColumn("_uid", F.xxhash64("scope_type", "scope_key", "target", "_ord"))
    elif rule.kind in emitted:
        rows = reduce(DataFrame.unionByName, emitted[rule.kind]).withColumn("_uid", _uid())
        rows = rows.select("scope_type", "scope_key", "target", "time_ms", "event_id", F.lit(None).cast("int").alias("confidence"), F.col("time_ms").alias("_at"), F.array("problem").alias("_causes"), "_ord", "_uid")
    else:
        return []
    rows = rows.where(F.col("scope_type") == rule.scope)
    own = lambda n: name if n == "scope" and n != rule.anchor else {"": F.col("target"), "target": F.col("target"), "time": F.col("time_ms")}.get(n.partition(".")[2], F.col("confidence"))
    if rule.where is not None:
        rows = rows.where(expression(rule.where, own, None).holds())
    rows = rows.withColumn("_event", F.col("event_id")).withColumn("event_id", F.col("_uid"))
    for c in rule.correlates:
        rows = _bound(rows, rule, c, first, emitted, relate)
    rows = rows.withColumn("event_id", F.col("_event"))
    groups = [(F.lit(True), rule.body)]
    if rule.condition is not None:
        true = expression(rule.condition, own, lambda n: F.col(f"{n}_state"))
        groups = [(~true.error & true.value, rule.then), (~true.error & ~true.value, rule.otherwise), (~true.error & true.value.isNull(), rule.unknown)]
    cooldown = limits.dedup_window if limits.cooldown is None else limits.cooldown
    after = F.struct(F.col("_ord.exec_ms").alias("exec_ms"), F.col("_ord.place").alias("place"), F.col("_ord.event_id").alias("event_id"), F.lit(place).alias("rank"))
    out = []
    for when, intents in groups:
        for i in intents:
            root = i.target[1].partition(".")[0] if i.target else None
            target = name if root is None else F.col("target") if root == rule.anchor else F.col(f"{root}.target")
            some = rows.where(F.coalesce(when, F.lit(False)) & target.isNotNull())
            if i.verb == "emit":
                known = catalog.problems[i.kind]
                some = some.select(
                    "scope_type", "scope_key", F.lit(rule.name).alias("rule"), F.lit(place).alias("place"), F.lit(i.kind).alias("problem"), target.alias("target"), F.col("_at").alias("time_ms"), "event_id",
                    F.lit(i.severity or known.severity).alias("severity"), F.lit(i.sarif_id or known.sarif_id).alias("sarif_id"), F.col("_causes").alias("causes"), after.alias("_ord"),
                )
                out.append(("emit", i.kind, evidence.cooled(some, ["scope_type", "scope_key", "rule", "problem", "target"], cooldown)))
                continue
            if i.kind == "suppress_symptom":
                kind, hit = next(((c.kind, F.col(f"{c.name}.target")) for c in rule.correlates if c.name == i.argument), (rule.kind, F.col("target")))
                hushed = some.where(hit.isNotNull()) if i.argument == rule.anchor else some.where(F.col(f"{i.argument}_state") == "Bound")
                out.append(("suppress", kind, hushed.select(F.col("scope_type").alias("_type"), F.col("scope_key").alias("_key"), F.lit(kind).alias("_kind"), hit.alias("_target"), after.alias("_ord"))))
            some = some.select(
                F.lit(rule.name).alias("rule"), F.lit(place).alias("place"), F.lit(i.kind).alias("kind"), "event_id", "time_ms", F.col("_at").alias("exec_ms"), "scope_type", "scope_key",
                target.alias("target"), F.lit(i.weight).cast("int").alias("weight"), F.lit(i.argument).cast("string").alias("argument"), F.array().cast("array<bigint>").alias("evidence"),
            )
            out.append(("action", i.kind, some))
    return out
