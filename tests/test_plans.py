"""Plans over tables: folds, cooldown, streams against batch, reports, and every registered query against its SQL."""

import json
import pickle
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline import queries
from strandline.operators import engine, evidence
from strandline.plans import rule_plan, rule_text
from strandline.sources import events, reports
from strandline.streaming import runner

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(df):
    def one(x):
        if x is None or not hasattr(x, "__len__") and pd.isna(x):
            return "NULL"
        if isinstance(x, str):
            return x
        v = float(x)
        return str(int(v)) if v == int(v) else f"{v:.6f}"

    cols = sorted(df.columns)
    return cols, sorted([one(x) for x in r] for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    sql = queries.oracle_sql().get(name)
    assert len(got)
    if sql:
        assert norm(got) == norm(db.sql(sql).df())


def test_clamped_sums_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.randrange(1000), rng.choice([-60, -30, -5, 10, 40, 85])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, k int, time_ms long, weight int")
    for batch in (7, 100, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["event_id"]: r["confidence"] for r in evidence.clamped_sums(df, ["k"], ["time_ms", "event_id"], "weight").collect()}
        now, want = {}, {}
        for i, k, t, w in sorted(rows, key=lambda r: (r[2], r[0])):
            now[k] = want[i] = max(0, min(100, now.get(k, 0) + w))
        assert got == want


def test_cooldown_counts_from_the_last_kept(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.randrange(2000)) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    got = {r["event_id"] for r in evidence.cooled(spark.createDataFrame(rows, "event_id long, k int, time_ms long"), ["k"], 50).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    last, want = {}, set()
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] > 50:
            last[k] = t
            want.add(i)
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rules = rule_text.parse(queries.RULES)
    flat = queries.flat_events(spark, SF)
    batch = engine.run_groups(flat, "root", rules, queries.CATALOG, queries.LIMITS).toPandas()
    rows = flat.toPandas().sort_values(["time_ms", "event_id"])
    cut = len(rows) // 3
    parts = [rows.iloc[:cut], rows.iloc[cut : 2 * cut], rows.iloc[2 * cut :]]
    end = rows.groupby("root").tail(1).assign(event_type=runner.FLUSH)
    source = tmp_path / "in"
    seen = {}

    def keep(df, _):
        for r in df.toPandas().itertuples(index=False):
            if r.part != "audit":
                seen[r.root, r.part, r.scope, r.kind, r.target, r.part == "problem" and r.time_ms] = r

    for n, part in enumerate([*parts, end]):
        spark.createDataFrame(part, flat.schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(flat.schema).parquet(str(source))
        got = runner.run_stream(stream, "root", rules, queries.CATALOG, queries.LIMITS)
        q = got.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    cols = ["root", "part", "scope", "kind", "target", "confidence", "severity", "sarif_id"]
    state = lambda df: sorted(map(str, df[df.part != "audit"][cols].astype(str).values.tolist()))
    assert state(pd.DataFrame(seen.values())) == state(batch) and len(batch) > 20


def test_a_waiting_anchor_is_decided_without_another_row(spark, tmp_path):
    """A row of another root moves the stream's time; the timer then decides what waits in the first."""
    rules = rule_text.parse(queries.RULES)
    row = lambda root, i, kind, t: (root, i, f"shop.{kind}", t, "ClientMac", root, None, None, json.dumps({"value_c": 5000}))
    schema = queries.flat_events(spark, SF).schema
    hour, source, seen = queries.HOUR, tmp_path / "in", []

    def keep(df, _):
        seen.append(sorted((r["root"], r["part"], r["kind"]) for r in df.collect()))

    for rows in ([row("1", 1, "error", 100 * hour)], [row("2", 2, "error", 120 * hour)], [row("2", 3, "view", 121 * hour)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = runner.event_time(spark.readStream.schema(schema).parquet(str(source)), hour)
        got = runner.run_stream(stream, "root", rules, queries.CATALOG, queries.LIMITS)
        q = got.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    found = [x for batch in seen for x in batch]
    assert ("1", "problem", "ShopDown") in found and ("1", "cause", "CheckoutBroken") in found and not any(r == "2" for r, *_ in found)


def test_state_stays_flat_over_a_long_run():
    rules = rule_text.parse(queries.RULES)
    limits = rule_text.Limits(max_lookback=40 * queries.HOUR, dedup_window=queries.HOUR, cooldown=0)
    engine_ = engine.Engine(rules, queries.CATALOG, limits)
    sizes = []
    for i in range(4000):
        engine_.ingest({"event_id": i, "event_type": "shop.error", "time_ms": i * queries.HOUR, "scope": ("ClientMac", "c"), "target": None, "fields": {"value_c": 2000}, "strings": {}, "scopes": {}})
        if i % 50 == 0:
            engine_.drain()
            if i >= 500:
                sizes.append(len(pickle.dumps(engine_)))
    assert max(sizes) < 1.3 * min(sizes)


def test_wall_time_wakes_what_idle_scopes_held():
    rules = rule_text.parse(queries.RULES)
    limits = rule_text.Limits(max_lookback=40 * queries.HOUR, dedup_window=queries.HOUR, max_disorder=0, idle_timeout=100)
    live = engine.Engine(rules, queries.CATALOG, limits, live=True)
    made = lambda i, scope, t: {"event_id": i, "event_type": "shop.error", "time_ms": t, "scope": ("ClientMac", scope), "target": None, "fields": {"value_c": 2000}, "strings": {}, "scopes": {}}
    live.ingest(made(1, "a", 0), wall=0)
    live.ingest(made(2, "b", 30 * queries.HOUR), wall=50)
    live.tick(99)
    assert live.watermark == 0 and not live.snapshot()["causes"]
    live.tick(120)  # scope a is idle now
    assert live.watermark == 30 * queries.HOUR and [c["scope"] for c in live.snapshot()["causes"]] == [("ClientMac", "a")]
    live.tick(900)  # all are idle: the watermark stays
    assert live.watermark == 30 * queries.HOUR


def test_plan_equals_ordered_layer(spark):
    """Causes and decisions of the plan are those of the replay; times differ, as the replay works when an event ends a window."""
    rules = rule_text.parse(queries.DECISIONS)
    plan = rule_plan.compile_rules(rules, queries.rule_events(spark, SF), queries.CATALOG, queries.LIMITS)
    replay = engine.run_groups(queries.flat_events(spark, SF), "root", rules, queries.CATALOG, queries.LIMITS).toPandas()
    name = F.concat(F.lit("ClientMac:"), "scope_key").alias("scope")
    causes = plan.causes.select(name, "kind", "confidence").toPandas()
    own = replay[replay.part == "cause"]
    assert sorted(zip(causes.scope, causes.kind, causes.confidence)) == sorted(zip(own.scope, own.kind, own.confidence.astype(int)))
    problems = {tuple(r) for r in plan.problems.select(name, "problem", "severity").collect()}
    own = replay[(replay.part == "problem") & (replay.kind != "AmbiguousDiagnosis")]
    assert problems == set(zip(own.scope, own.kind, own.severity)) and {k for _, k, _ in problems} == {"ShopDown", "ShopClosed", "ClientsLeave"}
    done = {tuple(r) for r in plan.actions.select("target", "kind").collect()}
    own = replay[(replay.part == "audit") & (replay.kind != "mark_ambiguous")]
    assert done == set(zip(own.target, own.kind)) and {k for _, k in done} == {"run_check", "request_observation"}


def test_plan_looks_back_as_the_ordered_layer_does(spark):
    rules = rule_text.parse(queries.LOOKBACK.replace("e.time + 43200s]", "e.time]"))
    plan = rule_plan.compile_rules(rules, queries.rule_events(spark, SF), queries.CATALOG, queries.LIMITS)
    replay = engine.run_groups(queries.flat_events(spark, SF), "root", rules, queries.CATALOG, queries.LIMITS).toPandas()
    own = replay[(replay.part == "problem") & (replay.kind != "AmbiguousDiagnosis")]
    want = sorted(zip(own.scope, own.kind, own.target, own.time_ms.astype(int), own.superseded.astype(bool)))
    got = sorted(map(tuple, plan.problems.select(F.concat(F.lit("ClientMac:"), "scope_key"), "problem", "target", "time_ms", "superseded").collect()))
    assert got == want and {k for _, k, *_ in got} == {"ShopDown", "ShopClosed", "ClientsLeave"} and {x[-1] for x in got} == {True, False}


def test_plans_refuse_ambiguity(spark):
    on = "decision on { scope: ClientMac anchor a: Problem(AmbiguousDiagnosis) action run_check(lldp_poll) { target: a.target } } }"
    with pytest.raises(ValueError, match="ordered layer"):
        rule_plan.compile_rules(rule_text.parse(queries.RULES.rstrip().rstrip("}") + on), queries.rule_events(spark, SF), queries.CATALOG, queries.LIMITS)


def test_watermark_in_slots(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(5000)) for i in range(500)]
    df = spark.createDataFrame(rows, "arrival long, time_ms long")
    got = {r["arrival"]: r["wm"] for r in runner.watermarks(df, 17).collect()}
    top = -1
    for i, t in rows:
        top = max(top, t)
        assert got[i] == top


def test_reports(spark):
    rows = [
        ("Slow", "s1", "Critical", "Vlan", "Vlan", 7, ["X"], False, {"b": "2", "a": "1"}), ("Slow", "s2", "Low", "Vlan", "Vlan", 7, ["X", "Y"], True, {}),
        ("Odd", "s3", "Optional", "Port", "Global", 0, [], False, {}),
    ]
    df = spark.createDataFrame(rows, "problem string, sarif_id string, severity string, scope_type string, target_type string, target_key long, causes array<string>, superseded boolean, evidence map<string,string>")
    lines = {x["ruleId"]: x for x in (json.loads(r["result"]) for r in reports.results(df, "evidence").collect())}
    assert {k: x["level"] for k, x in lines.items()} == {"s1": "error", "s3": "note"}
    assert lines["s1"]["message"] == {"text": "Slow detected in vlan scope"} and lines["s1"]["properties"] == {"evidence": {"a": "1", "b": "2"}} and "properties" not in lines["s3"]

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    assert lines["s1"]["partialFingerprints"] == {"scope": "vlan", "target": f"vlan:{fnv(bytes([3]) + (7).to_bytes(8, 'big')):016x}", "causes": ["X"]}
    assert lines["s3"]["partialFingerprints"] == {"scope": "port", "target": f"global:{fnv(bytes([5]) + bytes(8)):016x}", "causes": []}
    whole = json.loads(reports.envelope(reports.results(df), "t").first()[0])
    assert whole["version"] == "2.1.0" and whole["$schema"].endswith("sarif-2.1.0.json") and len(whole["runs"][0]["results"]) == 2 and whole["runs"][0]["tool"]["driver"]["name"] == "t"


def test_a_report_of_any_size(spark, tmp_path):
    lines = spark.range(50).select(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")).alias("result")).repartition(3)
    reports.report_lines(lines, str(tmp_path / "r"))
    assert sorted(json.loads(r[0])["n"] for r in spark.read.text(str(tmp_path / "r/results")).collect()) == list(range(50))
    assert json.loads(spark.read.text(str(tmp_path / "r/head")).first()[0])["runs"][0]["results"] == []


def test_event_sources(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", 2), ("a", 3)], {"l": [5, 1, 5, *range(100, 200)]})], "id int, fields array<struct<name:string,value:bigint>>, int_lists map<string,array<bigint>>")
    r = events.normalised(df).first()
    assert r["fields"] == {"a": 1, "b": 2} and r["int_lists"]["l"][:3] == [1, 5, 100] and len(r["int_lists"]["l"]) == 64
    texts = spark.createDataFrame([("0x01 02_03",), ("123",), ("zz",), ("",)], "t string")
    assert [None if x[0] is None else bytes(x[0]) for x in texts.select(events.hex_bytes(F.col("t"))).collect()] == [b"\x01\x02\x03", None, None, b""]
    routed = events.routed(df, F.array(F.lit("x"), F.lit("y"), F.lit("x"), F.lit(None)))
    assert sorted(r["scope"] for r in routed.collect()) == ["x", "y"]


def test_keys(spark):
    from strandline.functions import keys

    df = spark.createDataFrame([(5, 80, 3, 90), (3, 90, 5, 80)], "a long, b long, c long, d long")
    got = df.select(keys.endpoints((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("k"), keys.endpoints((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), compat=True).alias("s"), keys.fnv_hex(F.lit("a")).alias("h"), keys.fnv_hex(F.lit("")).alias("e")).collect()
    assert got[0]["k"] == got[1]["k"] and len(got[0]["k"]) == 32 and got[0]["s"] == got[0]["k"][:16] and (got[0]["h"], got[0]["e"]) == ("af63dc4c8601ec8c", "cbf29ce484222325")
    ip = lambda x: F.unhex(F.lit(x))
    ends = [(ip("0A000001"), F.lit(5)), (ip("20010DB8000000000000000000000001"), F.lit(6))]
    row = df.select(keys.session_key(*ends).alias("x"), keys.session_key(*reversed(ends)).alias("y"), keys.address(ip("0A000001")).alias("a")).first()
    assert row["x"] == row["y"] and bytes(row["a"]).hex() == "00000000000000000000ffff0a000001"


def test_sinks(spark, tmp_path):
    from strandline.sources.sinks import Sinks

    sinks, got = Sinks(), []
    sinks.register("list", lambda rows, batch: got.extend((batch, r["n"]) for r in rows.collect()))
    sinks.table("files", str(tmp_path / "out"))
    rows = spark.createDataFrame([("problem", 1), ("audit", 2), ("cause", 3)], "part string, n int")
    sinks.route(rows, "part", {"problem": "list", "audit": "files"})
    assert got == [(None, 1)] and [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    for wrong in (lambda: sinks.deliver("nothing", rows), lambda: sinks.register("list", print)):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sinks.table("streamed", str(tmp_path / "streamed"))
    sinks.start(stream, "part", {"cause": "streamed"}, str(tmp_path / "check"), "append").trigger(availableNow=True).start().awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "streamed")).collect()] == [3]
