"""Read-outs: reports, redaction, actions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import LEVELS
from ..functions import keys

# Fixed value: the schema that a report names.
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

# Audit codes of actions without a live control plane.
NO_OP, NOT_SUPPORTED = "ADGL3001", "NotSupported"


def level(severity: Column) -> Column:
    out = F.lit("note")
    for s, l in LEVELS.items():
        out = F.when(severity == s, l).otherwise(out)
    return out


def results(problems: DataFrame, evidence: str | None = None) -> DataFrame:
    """One report line (JSON) for each problem that is not superseded: rule, level, message, fingerprints, evidence.

    problems: problem, sarif_id, severity, scope_type, target_type, target_key (BIGINT, see keys), causes array, superseded;
    evidence names a column of map<string, string>, which is left out where it is empty.
    """
    scope = keys.scope_name(F.col("scope_type"))
    target = F.concat(keys.scope_name(F.col("target_type")), F.lit(":"), keys.hex64(keys.scope_hash(F.col("target_type"), F.col("target_key"))))
    parts = [
        F.col("sarif_id").alias("ruleId"),
        level(F.col("severity")).alias("level"),
        F.struct(F.concat(F.col("problem"), F.lit(" detected in "), scope, F.lit(" scope")).alias("text")).alias("message"),
        F.struct(scope.alias("scope"), target.alias("target"), F.col("causes").alias("causes")).alias("partialFingerprints"),
    ]
    if evidence is not None:
        found = F.map_from_entries(F.array_sort(F.map_entries(evidence)))
        parts.append(F.when(F.size(evidence) > 0, F.struct(found.alias("evidence"))).alias("properties"))
    return problems.where(~F.col("superseded")).withColumn("result", F.to_json(F.struct(*parts)))


def envelope(lines: DataFrame, tool: str = "strandline") -> DataFrame:
    """The report of one ruleset.  A report is a document: it is made of as many results as its reader can hold."""
    head = json.dumps({"version": "2.1.0", "$schema": SCHEMA, "runs": [{"tool": {"driver": {"name": tool}}}]}, separators=(",", ":"))
    body = F.array_join(F.array_sort(F.collect_list("result")), ",")
    return lines.agg(F.concat(F.lit(head[:-3] + ',"results":['), body, F.lit("]}]}")).alias("report"))


def report_lines(lines: DataFrame, path: str, tool: str = "strandline") -> None:
    """A report of any size, as a folder of files of results, a line each, and its head in a file beside them."""
    lines.select("result").write.mode("overwrite").text(f"{path}/results")
    envelope(lines.limit(0), tool).write.mode("overwrite").text(f"{path}/head")


def redacted(fields: Column, private: set[str]) -> Column:
    """A map of fields as text, with values of private names replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*sorted(private)) if private else F.lit(False), "<redacted>").otherwise(v.cast("string")))


def collected(edges: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Fields of the events that edges link to the keys `by`: of a name met twice, the value of the later edge.

    edges: by, src (event_id), edge_no; events: event_id, fields map<string, bigint>.
    """
    met = edges.join(events.select("event_id", "fields"), F.col("src") == F.col("event_id"))
    pairs = met.select(*by, "edge_no", F.explode("fields").alias("name", "value"))
    return pairs.groupBy(*by, "name").agg(F.max_by("value", "edge_no").alias("value"))


def emitted(actions: DataFrame, live: bool = False) -> DataFrame:
    """Actions as audit rows with an outcome; without a control plane none is carried out."""
    if live:
        outcome = F.when(F.col("action").isin("request_observation", "run_check", "request_topology"), NOT_SUPPORTED).otherwise("ok")
    else:
        outcome = F.when(F.col("action") == "request_observation", NO_OP).otherwise("ok")
    return actions.withColumn("outcome", outcome)
