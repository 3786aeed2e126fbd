"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows.

Scopes: user_id stands for a client, user_id % 10 for the network above it, nations and regions for a topology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Catalog, EventType, ProblemType
from .functions import checked, keys, unsigned
from .functions.names import dns_names
from .operators import correlate, engine, evidence, flow, topology
from .plans import rule_plan, rule_text, wire_decode, wire_text
from .sources import events as source
from .sources import reports
from .streaming import runner

HOUR = 3_600_000
BACK, FORWARD, WINDOW = 6 * HOUR, 12 * HOUR, 24 * HOUR
EV = """ev AS (SELECT event_id, event_type, floor(epoch_us(ts) / 1000)::BIGINT AS time_ms, user_id, user_id % 10 AS parent,
 round(value * 100)::BIGINT AS value_c, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events)"""
_known: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _known[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def ev(spark, d) -> DataFrame:
    return source.canonical(source.tables(spark, d, "events"))


def kind(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("event_type") == name)


# --- predicates --------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, user_id, value_c, k FROM ev WHERE event_type = 'error' AND (value_c > 1000 OR k % 7 = 3) AND NOT (value_c + k < 500)")
def anchor_filter(spark, d):
    e = rule_text._Reader("(e.value_c > 1000 or e.k % 7 == 3) and not (e.value_c + e.k < 500)").expression()
    got = rule_plan.expression(e, lambda n: F.col(n.partition(".")[2]), None)
    return kind(ev(spark, d), "error").where(got.holds()).select("event_id", "user_id", "value_c", "k")


@query(f"""WITH {EV}, x AS (SELECT event_id, value_c - 1000 AS a, k % 5 AS b, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS c FROM ev)
SELECT event_id, CASE WHEN b = 0 THEN NULL ELSE (abs(a) // abs(b)) * sign(a) * sign(b) END::BIGINT AS quotient, b = 0 AS failed, a + c AS total, a > 0 OR c > 50 AS either, a > 0 AND c > 50 AS every,
 CASE WHEN a > 0 THEN NULL ELSE 9223372036854775807 - 1000000 + a END::VARCHAR AS high FROM x""")
def checked_arithmetic(spark, d):
    x = ev(spark, d).select("event_id", (F.col("value_c") - 1000).alias("a"), (F.col("k") % 5).alias("b"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("c"))
    a, b, c = (checked.exact(F.col(n)) for n in "abc")
    q = checked.arithmetic("/", a, b)
    zero, fifty = checked.exact(F.lit(0)), checked.exact(F.lit(50))
    left, right = checked.compare(">", a, zero), checked.compare(">", c, fifty)
    top = checked.arithmetic("+", checked.exact(F.lit((1 << 63) - 1 - 1_000_000)), checked.exact(F.when(F.col("a") <= 0, F.col("a")).otherwise(F.lit((1 << 63) - 1))))
    return x.select("event_id", q.value.alias("quotient"), q.error.alias("failed"), checked.arithmetic("+", a, c).value.alias("total"), checked.logic("or", left, right).value.alias("either"), checked.logic("and", left, right).value.alias("every"), top.value.cast("string").alias("high"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_partkey - l_suppkey * 10, 0) AS less, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey // (l_linenumber % 3) END AS quotient,
 (l_partkey & 255) AS low, (l_partkey | 256) AS high, xor(l_partkey, l_suppkey) AS mixed, (l_partkey << 3) AS up, (l_partkey >> 2) AS down,
 CASE WHEN l_partkey > l_suppkey THEN 1 ELSE 0 END AS more, ((18446744073709551615::HUGEINT * (l_partkey + 1)) % 18446744073709551616::HUGEINT)::VARCHAR AS wrapped FROM lineitem""")
def unsigned_arithmetic(spark, d):
    x, y, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    b = unsigned.binary
    num = lambda c: c.cast("long")
    return source.tables(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", num(b("-", x, b("*", y, F.lit(10)))).alias("less"), num(b("/", x, b("%", n, F.lit(3)))).alias("quotient"), num(b("&", x, F.lit(255))).alias("low"),
        num(b("|", x, F.lit(256))).alias("high"), num(b("^", x, y)).alias("mixed"), num(b("<<", x, F.lit(3))).alias("up"), num(b(">>", x, F.lit(2))).alias("down"), num(b(">", x, y)).alias("more"),
        unsigned.number(b("*", unsigned.unary("inv", F.lit(0)), x + 1)).cast("string").alias("wrapped"),
    )


@query(f"""WITH {EV}, hit AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id + 1 END AS seen FROM ev WHERE event_type = 'click')
SELECT event_id FROM hit WHERE seen = user_id AND value_c > 1000 QUALIFY row_number() OVER (PARTITION BY user_id, time_ms // {WINDOW} ORDER BY time_ms, event_id) = 1""")
def anchor_scope(spark, d):
    """The key of the rule's own scope in a predicate."""
    rules = rule_text.parse('ruleset "s" { version = "1" evidence own { scope: ClientMac anchor e: event(shop.click) { e.seen == scope and e.value_c > 1000 } infer Cause(ClientLeft) { target: e.target, weight: +5 } } }')
    seen = F.struct(F.lit("ClientMac").alias("scope_type"), F.when(F.col("event_id") % 2 == 0, F.col("scope_key")).otherwise((F.col("scope_key").cast("long") + 1).cast("string")).alias("key"))
    events = rule_events(spark, d).withColumn("scopes", F.create_map(F.lit("seen"), seen))
    click = EventType(("ClientMac",), {"time": "int", "target": "scope:ClientMac", "value_c": "int", "seen": "scope:ClientMac"})
    return rule_plan.compile_rules(rules, events, CATALOG.with_(events={"shop.click": click}), LIMITS).infers.select("event_id")


# --- correlation -------------------------------------------------------------------------------------------

_PAIRS = f"""WITH {EV}, a AS (SELECT * FROM ev WHERE event_type = 'error' AND value_c > 1000), c AS (SELECT * FROM ev WHERE event_type = 'purchase'),
m AS (SELECT a.event_id, c.event_id AS cid, c.time_ms AS ct, c.k AS ck FROM a JOIN c ON a.user_id = c.user_id AND c.time_ms BETWEEN a.time_ms - {BACK} AND a.time_ms + {FORWARD} AND a.event_id <> c.event_id)"""


def anchors(spark, d) -> DataFrame:
    return kind(ev(spark, d), "error").where("value_c > 1000")


def bound(spark, d, count=1, bucket=None, back=BACK, forward=FORWARD) -> DataFrame:
    return correlate.bind(anchors(spark, d), kind(ev(spark, d), "purchase"), "p", ["user_id"], back, forward, count, bucket=bucket)


@query(_PAIRS + " SELECT event_id, user_id FROM a WHERE event_id IN (SELECT event_id FROM m)")
def correlate_present(spark, d):
    return bound(spark, d).where(checked.presence(F.col("p_state"), "present").holds()).select("event_id", "user_id")


@query(_PAIRS + " SELECT event_id, user_id FROM a WHERE event_id NOT IN (SELECT event_id FROM m)")
def correlate_absent(spark, d):
    return bound(spark, d).where(checked.presence(F.col("p_state"), "absent").holds()).select("event_id", "user_id")


@query(_PAIRS + " SELECT a.event_id, count(cid) AS n, count(cid) >= 2 AS enough FROM a LEFT JOIN m USING (event_id) GROUP BY a.event_id")
def correlate_count(spark, d):
    return bound(spark, d, 2).select("event_id", F.col("p_count").alias("n"), (F.col("p_state") == "Bound").alias("enough"))


@query(_PAIRS + " SELECT a.event_id, arg_min(cid, (ct, cid)) AS witness, min(ct) AS witness_ms FROM a LEFT JOIN m USING (event_id) GROUP BY a.event_id")
def correlate_witness(spark, d):
    return bound(spark, d).select("event_id", F.col("p.event_id").alias("witness"), F.col("p.time_ms").alias("witness_ms"))


@query(_PAIRS.replace(str(FORWARD), "0") + " SELECT a.event_id, count(cid) AS n FROM a LEFT JOIN m USING (event_id) GROUP BY a.event_id")
def correlate_backward(spark, d):
    return bound(spark, d, forward=0).select("event_id", F.col("p_count").alias("n"))


@query(_PAIRS + " SELECT event_id, cid AS candidate FROM m")
def correlate_bucketed(spark, d):
    got = correlate.interval_pairs(anchors(spark, d), kind(ev(spark, d), "purchase"), "p", ["user_id"], BACK, FORWARD, bucket=BACK)
    return got.select("event_id", F.col("p.event_id").alias("candidate"))


@query(f"""WITH {EV}, a AS (SELECT * FROM ev WHERE event_type = 'error') SELECT a.event_id, count(c.event_id) AS n FROM a LEFT JOIN ev c ON c.event_type = 'click' AND a.user_id = c.user_id
 AND c.time_ms BETWEEN a.time_ms - {BACK} AND a.time_ms + {FORWARD} GROUP BY a.event_id""")
def correlate_frame(spark, d):
    got = correlate.count_around(ev(spark, d), F.col("event_type") == "error", F.col("event_type") == "click", ["user_id"], BACK, FORWARD)
    return got.select("event_id", F.col("n").cast("long").alias("n"))


@query(_PAIRS + f""", s AS (SELECT DISTINCT a.event_id FROM a JOIN ev e ON e.event_type = 'signup' AND a.user_id = e.user_id AND e.time_ms BETWEEN a.time_ms - {WINDOW} AND a.time_ms)
SELECT a.event_id, a.event_id IN (SELECT event_id FROM m) AND a.event_id NOT IN (SELECT event_id FROM s) AS fires FROM a""")
def correlate_multi(spark, d):
    both = correlate.bind(bound(spark, d), kind(ev(spark, d), "signup"), "s", ["user_id"], WINDOW, 0)
    fires = checked.logic("and", checked.presence(F.col("p_state"), "present"), checked.presence(F.col("s_state"), "absent"))
    return both.select("event_id", fires.value.alias("fires"))


@query(f"""WITH {EV}, a AS (SELECT * FROM ev WHERE event_type = 'error' AND value_c > 1000), known AS (SELECT DISTINCT user_id FROM ev WHERE k % 2 = 0 AND event_type = 'click' AND value_c > 1500),
m AS (SELECT a.event_id, CASE WHEN a.user_id = c.user_id THEN true WHEN a.user_id + 10 = c.user_id OR c.user_id + 10 = a.user_id THEN true
 WHEN a.user_id IN (SELECT user_id FROM known) AND c.user_id IN (SELECT user_id FROM known) THEN false END AS t
 FROM a JOIN ev c ON c.event_type = 'signup' AND a.parent = c.parent AND c.time_ms BETWEEN a.time_ms - {HOUR} AND a.time_ms AND a.event_id <> c.event_id)
SELECT a.event_id, CASE WHEN count(*) FILTER (WHERE t) > 0 THEN 'Bound' WHEN count(*) FILTER (WHERE m.event_id IS NOT NULL AND t IS NULL) > 0 THEN 'Unknown' ELSE 'Absent' END AS state FROM a LEFT JOIN m USING (event_id) GROUP BY a.event_id""")
def correlate_unknown(spark, d):
    e = ev(spark, d)
    known = kind(e, "click").where("k % 2 = 0 AND value_c > 1500").select(F.col("user_id").alias("node")).distinct()
    users = e.select("user_id").distinct()
    related = users.select(F.col("user_id").alias("a"), (F.col("user_id") + 10).alias("b"))
    relate = lambda pairs: topology.same(pairs, F.col("user_id"), F.col("s.user_id"), known, related)
    got = correlate.bind(anchors(spark, d), kind(e, "signup"), "s", ["parent"], HOUR, 0, relate=relate)
    return got.select("event_id", F.col("s_state").alias("state"))


@query("""WITH known AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0) SELECT c.c_custkey, n.n_nationkey AS other,
 CASE WHEN c.c_nationkey = n.n_nationkey THEN true WHEN abs(c.c_nationkey - n.n_nationkey) = 5 THEN true WHEN c.c_nationkey IN (FROM known) AND n.n_nationkey IN (FROM known) THEN false END AS same
 FROM customer c JOIN nation n ON n.n_regionkey = c.c_custkey % 5""")
def topo_same(spark, d):
    nation = source.tables(spark, d, "nation")
    pairs = source.tables(spark, d, "customer").join(nation, F.col("n_regionkey") == F.col("c_custkey") % 5)
    known = nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("long").alias("node"))
    related = nation.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 5).cast("long").alias("b"))
    got = topology.same(pairs, F.col("c_nationkey").cast("long"), F.col("n_nationkey").cast("long"), known, related, "same")
    return got.select("c_custkey", F.col("n_nationkey").alias("other"), "same")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey // 2 AS up, n_nationkey AS down FROM nation WHERE n_nationkey > 0), r(up, down, n) AS (SELECT up, down, 1 FROM e UNION SELECT e.up, r.down, r.n + 1 FROM r JOIN e ON r.up = e.down WHERE r.n < 16)
SELECT up, down, min(n) AS n FROM r WHERE up <> down GROUP BY up, down""")
def topo_upstream(spark, d):
    nation = source.tables(spark, d, "nation").where("n_nationkey > 0")
    return topology.reach(nation.select(F.expr("cast(n_nationkey div 2 as int)").alias("up"), F.col("n_nationkey").cast("int").alias("down")))


@query("""WITH RECURSIVE e AS (SELECT (n_nationkey // 2)::INT AS up, n_nationkey::INT AS down FROM nation WHERE n_nationkey > 0 UNION SELECT 23, 11),
r(up, down, n) AS (SELECT up, down, 1 FROM e UNION SELECT e.up, r.down, r.n + 1 FROM r JOIN e ON r.up = e.down WHERE r.n < 17),
c AS (SELECT DISTINCT up, down FROM r), turning AS (SELECT DISTINCT up AS node FROM c WHERE up = down),
bad AS (SELECT node FROM turning UNION SELECT c.down FROM c JOIN turning ON turning.node = c.up)
SELECT s_suppkey, n_nationkey AS above, CASE WHEN n_nationkey = s_nationkey THEN false WHEN n_nationkey % 7 = 6 OR s_nationkey % 7 = 6 THEN NULL
 WHEN s_nationkey IN (FROM bad) THEN false ELSE EXISTS (SELECT 1 FROM c WHERE c.up = n_nationkey AND c.down = s_nationkey) END AS upstream FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5""")
def topo_upstream_of(spark, d):
    """Three values, with unknown nodes, and ways up that lead into a cycle."""
    nation = source.tables(spark, d, "nation")
    edges = nation.where("n_nationkey > 0").select(F.expr("cast(n_nationkey div 2 as int)").alias("up"), F.col("n_nationkey").cast("int").alias("down"))
    edges = edges.unionByName(spark.createDataFrame([(23, 11)], "up int, down int"))
    pairs = source.tables(spark, d, "supplier").join(nation, F.col("n_regionkey") == F.col("s_suppkey") % 5)
    known = nation.where("n_nationkey % 7 <> 6").select(F.col("n_nationkey").cast("int").alias("node"))
    got = topology.upstream(pairs, F.col("n_nationkey").cast("int"), F.col("s_nationkey").cast("int"), known, edges, out="upstream")
    return got.select("s_suppkey", F.col("n_nationkey").alias("above"), "upstream")


# --- evidence ----------------------------------------------------------------------------------------------

_INFERS = f"""WITH {EV}, raw AS (SELECT event_id, user_id, parent, event_type AS cause, time_ms, time_ms // {WINDOW} AS w,
 CASE WHEN k % 4 = 0 THEN -30 ELSE (k % 6) * 10 END AS weight FROM ev WHERE event_type IN ('error', 'click')),
infers AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY user_id, cause, w ORDER BY time_ms, event_id) = 1)"""
_FOLD = "list_reduce(list_prepend(0, list(weight::BIGINT ORDER BY time_ms, event_id)), lambda a, x: greatest(0, least(100, a + x)))"
_CAUSES = _INFERS + f", causes AS (SELECT user_id, parent, cause, {_FOLD} AS confidence, arg_min(time_ms, (time_ms, event_id)) AS first_ms FROM infers GROUP BY user_id, parent, cause)"
KEYS, ORDER = ["user_id", "parent", "cause"], ["time_ms", "event_id"]


def infers(spark, d) -> DataFrame:
    rows = ev(spark, d).where(F.col("event_type").isin("error", "click"))
    rows = rows.select("event_id", "user_id", "parent", F.col("event_type").alias("cause"), "time_ms", F.when(F.col("k") % 4 == 0, -30).otherwise(F.col("k") % 6 * 10).alias("weight"))
    return evidence.first_in_window(rows, ["user_id", "cause"], WINDOW, ORDER)


def found_causes(spark, d) -> DataFrame:
    return evidence.causes(infers(spark, d), KEYS, ORDER)


@query(_INFERS + " SELECT event_id, user_id, cause, weight FROM infers")
def infer_dedup(spark, d):
    return infers(spark, d).select("event_id", "user_id", "cause", F.col("weight").cast("int").alias("weight"))


@query(_INFERS + " SELECT user_id, cause, least(100, sum(abs(weight)))::INT AS confidence FROM infers GROUP BY user_id, cause")
def cause_confidence(spark, d):
    rows = infers(spark, d).withColumn("weight", F.abs("weight"))
    return evidence.causes(rows, ["user_id", "cause"], ORDER, mixed=False).drop("first_ms")


@query(_CAUSES + " SELECT user_id, cause, confidence, first_ms, CASE WHEN confidence >= 80 THEN 'Confirmed' WHEN confidence >= 40 THEN 'Probable' WHEN confidence >= 10 THEN 'Candidate' END AS band FROM causes")
def cause_confidence_signed(spark, d):
    return found_causes(spark, d).select("user_id", "cause", "confidence", "first_ms", evidence.band(F.col("confidence")).alias("band"))


@query(_INFERS + " SELECT user_id, cause, arg_min(event_id, (time_ms, event_id)) AS first_event, min(time_ms) AS first_ms FROM infers GROUP BY user_id, cause")
def first_infer(spark, d):
    return infers(spark, d).groupBy("user_id", "cause").agg(F.min_by("event_id", F.struct(*ORDER)).alias("first_event"), F.min("time_ms").alias("first_ms"))


@query(_CAUSES + " SELECT parent, cause, max(confidence) AS confidence, count(*) AS children FROM causes WHERE user_id <> parent GROUP BY parent, cause")
def rollup_max(spark, d):
    got = evidence.rolled_up(found_causes(spark, d).withColumnRenamed("parent", "target"), "user_id", "target", ["cause"])
    return got.withColumnRenamed("user_id", "parent")


_RUNS = _INFERS + """, pre AS (SELECT i.*, (SELECT list_reduce(list_prepend(0, list(x.weight::BIGINT ORDER BY x.time_ms, x.event_id)), lambda a, x: greatest(0, least(100, a + x))) FROM infers x
 WHERE x.user_id = i.user_id AND x.cause = i.cause AND (x.time_ms, x.event_id) <= (i.time_ms, i.event_id)) AS confidence FROM infers i)"""


def decided(spark, d) -> DataFrame:
    return evidence.clamped_sums(infers(spark, d), KEYS, ORDER, "weight").where("confidence >= 80")


@query(_RUNS + " SELECT event_id, user_id, cause, confidence FROM pre WHERE confidence >= 80")
def decision_threshold(spark, d):
    return decided(spark, d).select("event_id", "user_id", "cause", "confidence")


@query(f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, time_ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY time_ms, event_id) AS n FROM ev WHERE event_type = 'error'),
t(user_id, n, event_id, last, kept) AS (SELECT user_id, n, event_id, time_ms, true FROM p WHERE n = 1 UNION ALL
 SELECT p.user_id, p.n, p.event_id, CASE WHEN p.time_ms - t.last > {3 * WINDOW} THEN p.time_ms ELSE t.last END, p.time_ms - t.last > {3 * WINDOW} FROM t JOIN p ON p.user_id = t.user_id AND p.n = t.n + 1)
SELECT user_id, event_id FROM t WHERE kept""")
def problem_cooldown(spark, d):
    got = evidence.cooled(kind(ev(spark, d), "error").select("user_id", "time_ms", "event_id"), ["user_id"], 3 * WINDOW)
    return got.select("user_id", "event_id")


@query(f"""WITH {EV}, p AS (SELECT event_id, user_id, parent, time_ms FROM ev WHERE event_type = 'error')
SELECT p.event_id, EXISTS (SELECT 1 FROM p u WHERE u.user_id = p.user_id // 2 AND u.user_id <> p.user_id AND u.time_ms BETWEEN p.time_ms - {BACK} AND p.time_ms) AS superseded FROM p""")
def suppress(spark, d):
    p = kind(ev(spark, d), "error").select("event_id", "event_type", "user_id", "time_ms").withColumn("above", F.expr("user_id div 2"))
    up = p.where("true").select("event_id", "event_type", F.col("user_id").alias("above"), "time_ms")
    got = correlate.bind(p.where("above <> user_id"), up, "u", ["above"], BACK, 0)
    flags = got.where("u_state = 'Bound'").select(F.col("event_id").alias("_e"))
    return p.join(flags, F.col("event_id") == F.col("_e"), "left").select("event_id", F.col("_e").isNotNull().alias("superseded"))


@query(_CAUSES + """ SELECT a.user_id, a.cause AS cause_a, b.cause AS cause_b, a.confidence AS confidence_a, b.confidence AS confidence_b FROM causes a JOIN causes b ON a.user_id = b.user_id AND a.cause = 'click' AND b.cause = 'error'
 WHERE a.confidence BETWEEN 40 AND 79 AND b.confidence BETWEEN 40 AND 79 AND abs(a.confidence - b.confidence) < 15""")
def ambiguity(spark, d):
    got = evidence.ambiguous(found_causes(spark, d), [("click", "error")], ["user_id"])
    return got.select("user_id", "cause_a", "cause_b", "confidence_a", "confidence_b")


@query(_PAIRS + """, w AS (SELECT a.event_id, a.user_id, arg_min(cid, (ct, cid)) AS witness FROM a LEFT JOIN m USING (event_id) GROUP BY ALL)
SELECT event_id AS src, user_id AS dst, 'Supports' AS kind FROM w UNION ALL SELECT witness, user_id, 'Supports' FROM w WHERE witness IS NOT NULL""")
def evidence_edges(spark, d):
    rows = bound(spark, d).select("event_id", "user_id", F.col("p.event_id").alias("witness"), F.lit(35).alias("weight"))
    return evidence.edges(rows, ["event_id", "witness"], F.col("user_id").alias("dst"))


# --- reports -----------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, 'value_c=' || value_c || ';user=<redacted>' AS fields FROM ev")
def redact(spark, d):
    cat = Catalog(events={"e": EventType(("ClientMac",), {"user": "int", "value_c": "int"}, frozenset({"user"}))})
    fields = F.create_map(F.lit("value_c"), F.col("value_c"), F.lit("user"), F.col("user_id"))
    red = reports.redacted(fields, cat.private_fields())
    return ev(spark, d).select("event_id", F.concat(F.lit("value_c="), red["value_c"], F.lit(";user="), red["user"]).alias("fields"))


def fnv_sql(*parts: str) -> str:
    """FNV-1a-64 in SQL over byte lists."""
    step = "(xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {' || '.join(parts)}), lambda h, b: {step})"


def u64_sql(x: str) -> str:
    """The eight bytes of a number that is not negative (a HUGEINT may have the top bit)."""
    return f"list_transform([56, 48, 40, 32, 24, 16, 8, 0], lambda s: ((({x})::HUGEINT >> s) & 255::HUGEINT))"


def hex_sql(x: str) -> str:
    return f"lpad(lower(to_hex(({x})::UBIGINT)), 16, '0')"


_TARGET = f"""keyed AS (SELECT user_id, {fnv_sql(u64_sql("user_id"))} AS key FROM (SELECT DISTINCT user_id FROM causes)),
hashed AS (SELECT user_id, 'client_mac:' || {hex_sql(fnv_sql("[2::HUGEINT]", u64_sql("key")))} AS target FROM keyed)"""


@query(_CAUSES + f""", {_TARGET} SELECT c.user_id, '{{"ruleId":"l3_' || cause || '","level":"' || CASE WHEN confidence >= 80 THEN 'error' ELSE 'warning' END || '","message":{{"text":"Slow detected in client_mac scope"}},"partialFingerprints":{{"scope":"client_mac","target":"'
 || target || '","causes":["' || cause || '"]}}' || CASE WHEN c.user_id % 3 = 0 THEN '' ELSE ',"properties":{{"evidence":{{"confidence":"' || confidence || '","user":"<redacted>"}}}}' END || '}}' AS result
 FROM causes c JOIN hashed USING (user_id) WHERE confidence >= 40 AND c.user_id % 5 <> 0""")
def sarif_rows(spark, d):
    fields = F.when(F.col("user_id") % 3 != 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("confidence"), F.col("confidence").cast("string")))
    rows = found_causes(spark, d).where("confidence >= 40").select(
        "user_id", F.lit("Slow").alias("problem"), F.concat(F.lit("l3_"), "cause").alias("sarif_id"), F.when(F.col("confidence") >= 80, "High").otherwise("Medium").alias("severity"),
        F.lit("ClientMac").alias("scope_type"), F.lit("ClientMac").alias("target_type"), keys.scope_key("ClientMac", F.col("user_id")).alias("target_key"), F.array("cause").alias("causes"),
        (F.col("user_id") % 5 == 0).alias("superseded"), reports.redacted(F.coalesce(fields, F.create_map().cast("map<string,string>")), {"user"}).alias("evidence"),
    )
    return reports.results(rows, "evidence").select("user_id", "result")


_IP = lambda x: f"[0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 255, 255, 10, 0, ({x}) // 256, ({x}) % 256]::HUGEINT[]"


@query(f"""WITH e AS (SELECT c_custkey, c_nationkey, {_IP("c_custkey % 65536")} || {u64_sql("c_nationkey + 80")} AS x, {_IP("(c_custkey * 7) % 65536")} || {u64_sql("443")} AS y FROM customer),
k AS (SELECT *, {fnv_sql("(CASE WHEN x <= y THEN x || y ELSE y || x END)")} AS session, {fnv_sql(u64_sql("c_custkey"), u64_sql("c_nationkey"))} AS port FROM e)
SELECT c_custkey, {hex_sql("session")} AS session, {hex_sql("port")} AS port, {hex_sql(fnv_sql("[0::HUGEINT]", u64_sql("session")))} AS session_hash, {hex_sql(fnv_sql("[1::HUGEINT]", u64_sql("port")))} AS port_hash,
 {hex_sql(fnv_sql("[5::HUGEINT]", u64_sql("0")))} AS global_hash FROM k""")
def scope_hashes(spark, d):
    """Keys of sessions (the ends in either order, addresses of 4 bytes) and of ports, and the hashes that reports show."""
    ip = lambda c: F.concat(F.unhex(F.lit("0A00")), F.unhex(F.lpad(F.hex((c % 65536).cast("long")), 4, F.lit("0"))))
    c = F.col("c_custkey")
    session = keys.session_key((ip(c), F.col("c_nationkey") + 80), (ip(c * 7), F.lit(443)))
    port = keys.scope_key("Port", c, F.col("c_nationkey"))
    shown = lambda scope, key: keys.hex64(keys.scope_hash(F.lit(scope), key))
    got = source.tables(spark, d, "customer").select("c_custkey", session.alias("_s"), port.alias("_p"))
    return got.select(
        "c_custkey", keys.hex64(F.col("_s")).alias("session"), keys.hex64(F.col("_p")).alias("port"), shown("Session", F.col("_s")).alias("session_hash"), shown("Port", F.col("_p")).alias("port_hash"),
        shown("Global", keys.scope_key("Global")).alias("global_hash"),
    )


@query(_PAIRS + " SELECT event_id, 'request_observation' AS action, 'ADGL3001' AS outcome FROM a WHERE event_id NOT IN (SELECT event_id FROM m)")
def audit_actions(spark, d):
    rows = bound(spark, d).where("p_state = 'Absent'").select("event_id", F.lit("request_observation").alias("action"))
    return reports.emitted(rows)


@query(f"WITH {EV} SELECT user_id, 'k' AS name, arg_max(k, event_id) AS value FROM ev WHERE event_type = 'error' GROUP BY user_id UNION ALL SELECT user_id, 'value_c', arg_max(value_c, event_id) FROM ev WHERE event_type = 'error' GROUP BY user_id")
def collect_evidence(spark, d):
    e = kind(ev(spark, d), "error")
    edges = e.select("user_id", F.col("event_id").alias("src"), F.col("event_id").alias("edge_no"))
    fields = e.select("event_id", F.create_map(F.lit("k"), F.col("k"), F.lit("value_c"), F.col("value_c")).alias("fields"))
    return reports.collected(edges, fields, ["user_id"])


# --- rules in text -----------------------------------------------------------------------------------------

RULES = """
ruleset "shop" {
    version = "3"
    requires = ["topology"]
    mutually_exclusive(ClientLeft, CheckoutBroken)
    evidence nothing_bought_near_error {
        scope: ClientMac
        anchor e: event(shop.error) { e.value_c > 1000 }
        correlate p: event(shop.purchase) { topo: same_client(p.target, e.target) time: p.time in [e.time - 21600s, e.time + 43200s] }
        if absent(p) {
            infer Cause(CheckoutBroken) { weight: +55, target: e.target, evidence: [e] }
            action run_check(lldp_poll) { target: e.target }
        } else {
            infer Cause(ClientLeft) { weight: +20, target: e.target, evidence: [p, e] }
        }
    }
    decision page {
        scope: ClientMac
        anchor b: Cause(CheckoutBroken) { b.confidence > 50 }
        emit Problem(ShopDown) { severity: Critical, evidence: [b], sarif_id: "shop_down" }
    }
}
"""
#: The same with decisions that branch, act, and follow a problem.
DECISIONS = RULES.rstrip().rstrip("}") + """
    decision followed {
        scope: ClientMac
        anchor d: Problem(ShopDown)
        emit Problem(ShopClosed) { target: d.target, severity: Low }
        action run_check(stp_root_check) { target: d.target }
    }
    decision sorted {
        scope: ClientMac
        anchor l: Cause(ClientLeft) { l.confidence >= 20 }
        if l.confidence > 40 { emit Problem(ClientsLeave) { target: l.target, evidence: [l] } } else { action request_observation(aaa.telemetry) { target: l.target } }
    }
}
"""
#: Decisions that look back: at an earlier problem, which takes this one back, and at another cause.
LOOKBACK = RULES.rstrip().rstrip("}") + """
    decision once {
        scope: ClientMac
        anchor d: Problem(ShopDown)
        correlate u: Problem(ShopDown) { topo: same_client(u.target, d.target) time: u.time in [d.time - 259200s, d.time] }
        if present(u) { action suppress_symptom(d) { reason: "known", evidence: [u] } }
    }
    decision both {
        scope: ClientMac
        anchor b: Cause(CheckoutBroken) { b.confidence > 50 }
        correlate l: Cause(ClientLeft) { topo: same_client(l.target, b.target) time: l.time in [b.time - 360000s, b.time + 72000s] }
        if present(l) { emit Problem(ClientsLeave) { target: l.target, evidence: [b, l] } } else { emit Problem(ShopClosed) { target: b.target } }
    }
}
"""
CATALOG = Catalog(
    events={f"shop.{n}": EventType(("ClientMac",), {"time": "int", "target": "scope:ClientMac", "value_c": "int", "k": "int", "network": "scope:Vlan"}) for n in ("error", "purchase", "click", "signup", "view", "flush")},
    causes={"CheckoutBroken": ("ClientMac", "Vlan"), "ClientLeft": ("ClientMac", "Vlan")},
    problems={name: ProblemType(("ClientMac", "Vlan"), "Medium", "shop") for name in ("ShopDown", "ShopClosed", "ClientsLeave")} | {"AmbiguousDiagnosis": ProblemType(("ClientMac", "Vlan"), "Medium", "ap_ambiguous")},
)
LIMITS = rule_text.Limits(max_lookback=120 * HOUR, dedup_window=WINDOW, cooldown=0, causes=1 << 20, events=1 << 20, pending=1 << 20)


def rule_events(spark, d) -> DataFrame:
    scope = "struct<scope_type:string,key:string>"
    return ev(spark, d).select(
        "event_id", F.concat(F.lit("shop."), "event_type").alias("event_type"), "time_ms", F.lit("ClientMac").alias("scope_type"), F.col("user_id").cast("string").alias("scope_key"),
        F.lit(None).cast(scope).alias("target"), F.create_map(F.lit("value_c"), F.col("value_c"), F.lit("k"), F.col("k")).alias("fields"), F.create_map().cast("map<string,string>").alias("strings"),
        F.create_map(F.lit("network"), F.struct(F.lit("Vlan").alias("scope_type"), F.col("parent").cast("string").alias("key"))).alias("scopes"), "parent",
    )


def shop_plan(spark, d) -> rule_plan.Plan:
    return rule_plan.compile_rules(rule_text.parse(RULES), rule_events(spark, d), CATALOG, LIMITS)


_SHOP = _PAIRS + f""", raw AS (SELECT a.*, time_ms + {FORWARD} AS exec_ms, event_id NOT IN (SELECT event_id FROM m) AS lone FROM a),
named AS (SELECT *, CASE WHEN lone THEN 'CheckoutBroken' ELSE 'ClientLeft' END AS cause, CASE WHEN lone THEN 55 ELSE 20 END AS weight FROM raw),
infers AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY user_id, cause, time_ms // {WINDOW} ORDER BY exec_ms, event_id) = 1),
runs AS (SELECT *, least(100, sum(weight) OVER (PARTITION BY user_id, cause ORDER BY exec_ms, event_id)) AS confidence FROM infers),
down AS (SELECT * FROM runs WHERE cause = 'CheckoutBroken' AND confidence > 50 QUALIFY coalesce(exec_ms > lag(exec_ms) OVER (PARTITION BY user_id ORDER BY exec_ms, event_id), true))"""


@query(_SHOP + " SELECT user_id::VARCHAR AS client, cause, least(100, sum(weight))::INT AS confidence, arg_min(time_ms, (exec_ms, event_id)) AS first_ms FROM infers GROUP BY user_id, cause")
def ruleset_causes(spark, d):
    return shop_plan(spark, d).causes.select(F.col("scope_key").alias("client"), F.col("kind").alias("cause"), "confidence", "first_ms")


@query(_SHOP + " SELECT user_id::VARCHAR AS client, exec_ms AS time_ms, 'Critical' AS severity, 'shop_down' AS sarif_id FROM down")
def ruleset_problems(spark, d):
    """The flagship: rules in text, through anchors, bindings, inferences and decisions, to problems."""
    return shop_plan(spark, d).problems.select(F.col("scope_key").alias("client"), "time_ms", "severity", "sarif_id")


@query(_SHOP + " SELECT user_id::VARCHAR AS client, event_id, 'lldp_poll' AS argument FROM raw WHERE lone")
def ruleset_actions(spark, d):
    return shop_plan(spark, d).actions.select(F.col("scope_key").alias("client"), "event_id", "argument")


@query(_SHOP + """, parted AS (SELECT * FROM runs WHERE cause = 'ClientLeft' AND confidence >= 20),
leaving AS (SELECT * FROM parted WHERE confidence > 40 QUALIFY coalesce(exec_ms > lag(exec_ms) OVER (PARTITION BY user_id ORDER BY exec_ms, event_id), true))
SELECT user_id::VARCHAR AS client, exec_ms AS time_ms, 'ShopDown' AS what, 'page' AS rule, 'Critical' AS severity, 'CheckoutBroken' AS cause FROM down UNION ALL
SELECT user_id::VARCHAR, exec_ms, 'ShopClosed', 'followed', 'Low', 'ShopDown' FROM down UNION ALL
SELECT user_id::VARCHAR, exec_ms, 'run_check', 'followed', 'stp_root_check', NULL FROM down UNION ALL
SELECT user_id::VARCHAR, exec_ms, 'ClientsLeave', 'sorted', 'Medium', 'ClientLeft' FROM leaving UNION ALL
SELECT user_id::VARCHAR, exec_ms, 'request_observation', 'sorted', 'aaa.telemetry', NULL FROM parted WHERE confidence <= 40""")
def ruleset_decisions(spark, d):
    """Decisions that branch, act and follow another decision's problem: what they emit and do."""
    plan = rule_plan.compile_rules(rule_text.parse(DECISIONS), rule_events(spark, d), CATALOG, LIMITS)
    client = F.col("scope_key").alias("client")
    found = plan.problems.select(client, "time_ms", F.col("problem").alias("what"), "rule", "severity", F.array_join("causes", ",").alias("cause"))
    done = plan.actions.where(F.col("rule").isin("followed", "sorted"))
    return found.unionByName(done.select(client, F.col("exec_ms").alias("time_ms"), F.col("kind").alias("what"), "rule", F.col("argument").alias("severity"), F.lit(None).cast("string").alias("cause")))


@query(_SHOP + f""", again AS (SELECT d.* FROM down d WHERE EXISTS (SELECT 1 FROM down u WHERE u.user_id = d.user_id AND u.exec_ms >= d.exec_ms - 259200000 AND (u.exec_ms, u.event_id) < (d.exec_ms, d.event_id))),
firsts AS (SELECT user_id, cause, arg_min(time_ms, (exec_ms, event_id)) AS t, min((exec_ms, event_id)) AS o FROM infers GROUP BY user_id, cause),
met AS (SELECT d.user_id, d.exec_ms, d.event_id, bool_or(coalesce(l.o < (d.exec_ms, d.event_id) AND l.t BETWEEN b.t - 360000000 AND b.t + 72000000, false)) AS left_before
 FROM runs d JOIN firsts b ON b.user_id = d.user_id AND b.cause = 'CheckoutBroken' LEFT JOIN firsts l ON l.user_id = d.user_id AND l.cause = 'ClientLeft'
 WHERE d.cause = 'CheckoutBroken' AND d.confidence > 50 GROUP BY ALL),
kept AS (SELECT * FROM met QUALIFY coalesce(exec_ms > lag(exec_ms) OVER (PARTITION BY user_id, left_before ORDER BY exec_ms, event_id), true))
SELECT user_id::VARCHAR AS client, exec_ms AS time_ms, 'ShopDown' AS problem,
 EXISTS (SELECT 1 FROM again a WHERE a.user_id = d.user_id AND (a.exec_ms, a.event_id) >= (d.exec_ms, d.event_id)) AS superseded FROM down d UNION ALL
SELECT user_id::VARCHAR, exec_ms, CASE WHEN left_before THEN 'ClientsLeave' ELSE 'ShopClosed' END, false FROM kept""")
def ruleset_lookback(spark, d):
    """Decisions that look back at problems and causes, and problems that they take back."""
    plan = rule_plan.compile_rules(rule_text.parse(LOOKBACK), rule_events(spark, d), CATALOG, LIMITS)
    return plan.problems.select(F.col("scope_key").alias("client"), "time_ms", "problem", "superseded")


ORDERED = RULES.replace("e.time + 43200s]", "e.time]").replace("target: e.target, evidence", "target: e.network, evidence")


def flat_events(spark, d) -> DataFrame:
    fields = F.to_json(F.struct("value_c", "k", F.array(F.lit("Vlan"), F.col("parent").cast("string")).alias("network")))
    return ev(spark, d).select(
        F.col("parent").cast("string").alias("root"), "event_id", F.concat(F.lit("shop."), "event_type").alias("event_type"), "time_ms", F.lit("ClientMac").alias("scope_type"),
        F.col("user_id").cast("string").alias("scope_key"), F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("target_key"), fields.alias("fields"),
    )


_BACKWARD = _PAIRS.replace(f"AND a.time_ms + {FORWARD}", "AND a.time_ms")


@query(_BACKWARD + f""", named AS (SELECT a.*, CASE WHEN event_id IN (SELECT event_id FROM m) THEN 'ClientLeft' ELSE 'CheckoutBroken' END AS kind FROM a),
infers AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY user_id, kind, time_ms // {WINDOW} ORDER BY time_ms, event_id) = 1),
own AS (SELECT user_id, parent, kind, least(100, sum(CASE kind WHEN 'ClientLeft' THEN 20 ELSE 55 END))::INT AS confidence FROM infers GROUP BY user_id, parent, kind)
SELECT 'ClientMac:' || user_id AS scope, 'Vlan:' || parent AS target, kind, confidence FROM own UNION ALL SELECT 'Vlan:' || parent, 'Vlan:' || parent, kind, max(confidence) FROM own GROUP BY parent, kind""")
def ordered_rollup(spark, d):
    """The ordered layer: clients' causes and their roll-up into the network, replayed per network."""
    got = engine.run_groups(flat_events(spark, d), "root", rule_text.parse(ORDERED), CATALOG, LIMITS)
    return got.where("part = 'cause'").select("scope", "target", "kind", "confidence")


# --- streams -----------------------------------------------------------------------------------------------

_ARRIVE = f"""{EV}, arr AS (SELECT *, event_id * 1000 + (event_id * 7919) % 40000 AS arrival FROM ev), wm AS (SELECT *, max(time_ms) OVER (ORDER BY arrival, event_id) AS wm,
 max(time_ms) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM arr)"""


def arrived(spark, d) -> DataFrame:
    rows = ev(spark, d).withColumn("arrival", F.col("event_id") * 1000 + F.col("event_id") * 7919 % 40000)
    return runner.watermarks(rows, 1_000_000, ("arrival", "event_id"))


@query(f"WITH {_ARRIVE} SELECT event_id, wm, time_ms < wm AS behind FROM wm")
def watermark_trace(spark, d):
    return arrived(spark, d).select("event_id", "wm", (F.col("time_ms") < F.col("wm")).alias("behind"))


@query(f"WITH {_ARRIVE} SELECT event_id FROM wm WHERE time_ms < wm AND time_ms <= wm - {HOUR}")
def late_drop(spark, d):
    # A row behind the watermark did not raise it, so the watermark before it is the one with it.
    return runner.split_late(arrived(spark, d).where(F.lit(True)), HOUR, F.when(F.col("time_ms") < F.col("wm"), F.col("wm")))[1].select("event_id")


@query(f"""WITH {_ARRIVE}, a AS (SELECT * FROM ev WHERE event_type = 'error' AND value_c > 1000), late AS (SELECT * FROM wm WHERE time_ms < wm AND event_type = 'purchase')
SELECT DISTINCT l.event_id, 'ADGL3002' AS code FROM late l JOIN a ON a.user_id = l.user_id AND l.time_ms BETWEEN a.time_ms - {BACK} AND a.time_ms AND l.wm > a.time_ms
 WHERE NOT EXISTS (SELECT 1 FROM wm c WHERE c.event_type = 'purchase' AND c.user_id = a.user_id AND c.time_ms BETWEEN a.time_ms - {BACK} AND a.time_ms AND c.time_ms = c.wm)""")
def late_audit(spark, d):
    """Late events that fall into a window that was decided absent."""
    rows = arrived(spark, d)
    late = kind(rows, "purchase").where("time_ms < wm")
    closed = correlate.bind(anchors(spark, d), kind(rows, "purchase").where("time_ms = wm"), "p", ["user_id"], BACK, 0).where("p_state = 'Absent'").select("event_id", "event_type", "user_id", "time_ms")
    pairs = correlate.interval_pairs(closed, late, "l", ["user_id"], BACK, 0).where("l.wm > time_ms")
    return pairs.select(F.col("l.event_id").alias("event_id"), F.lit("ADGL3002").alias("code")).distinct()


# --- wire formats ------------------------------------------------------------------------------------------


def put(c, size: int):
    return F.lpad(F.hex(F.col(c).cast("long") if isinstance(c, str) else c.cast("long")), 2 * size, F.lit("0"))


def flipped(c, size: int):
    h = put(c, size)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def text_of():
    """A text of varying length."""
    return F.repeat("l_returnflag", F.col("l_linenumber").cast("int"))


def lines(spark, d, *parts) -> DataFrame:
    return source.tables(spark, d, "lineitem").withColumn("buf", F.unhex(F.concat(*parts)))


def protocol(body: str, meta: str = "") -> wire_text.Protocol:
    return wire_text.one(f"protocol P {{ meta {{ endian = big; mode = datagram; {meta} }} {body} }}")


ID = ["l_orderkey", "l_linenumber"]


def read(df: DataFrame, p: wire_text.Protocol, *names: str) -> DataFrame:
    got = wire_decode.columns(p, F.col("buf"))
    return df.select(*ID, *[got[n].cast("long").alias(n.replace(".", "_")) for n in names])


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity::BIGINT AS qty FROM lineitem")
def wire_header(spark, d):
    p = protocol("message M { part: u32; supp: u24; line: u8; qty: u16; }")
    return read(lines(spark, d, put("l_partkey", 4), put("l_suppkey", 3), put("l_linenumber", 1), put("l_quantity", 2)), p, "part", "supp", "line", "qty")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supp, l_quantity::BIGINT AS qty FROM lineitem")
def wire_le(spark, d):
    p = protocol("message M { part: u32le; supp: u24le; qty: u16be; }")
    return read(lines(spark, d, flipped("l_partkey", 4), flipped("l_suppkey", 3), put("l_quantity", 2)), p, "part", "supp", "qty")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 16 AS a, l_partkey % 512 AS b, l_suppkey % 8 AS c, l_quantity::BIGINT AS qty FROM lineitem")
def wire_bits(spark, d):
    p = protocol("message M { a: bitfield{4}; b: bitfield{9}; c: bitfield{3}; qty: u16; }")
    packed = F.expr("(l_linenumber % 16) * 4096 + (l_partkey % 512) * 8 + l_suppkey % 8")
    return read(lines(spark, d, put(packed, 2), put("l_quantity", 2)), p, "a", "b", "c", "qty")


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS n, 5 * (1 - (l_linenumber % 2)) + l_partkey * (l_linenumber % 2) AS body, l_suppkey AS supp FROM lineitem")
def wire_slice(spark, d):
    p = protocol("message M { n: u8; size: u8; body: bytes[size]; supp: u32; }")
    odd = F.concat(F.lit("04"), put("l_partkey", 4))
    return read(lines(spark, d, put("l_linenumber", 1), F.when(F.col("l_linenumber") % 2 == 1, odd).otherwise(F.lit("0105")), put("l_suppkey", 4)), p, "n", "body", "supp")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN l_partkey END AS extra, l_suppkey AS supp FROM lineitem")
def wire_optional(spark, d):
    p = protocol("message M { n: u8; extra: u32 if n > 3; supp: u16; }")
    return read(lines(spark, d, put("l_linenumber", 1), F.when(F.col("l_linenumber") > 3, put("l_partkey", 4)).otherwise(""), put("l_suppkey", 2)), p, "extra", "supp")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey END AS one, CASE WHEN l_linenumber = 2 THEN l_suppkey END AS two, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS other,
 l_quantity::BIGINT AS qty FROM lineitem""")
def wire_match(spark, d):
    p = protocol("message M { n: u8; match n { case 1 => { one: u32; } case 2 => { two: u16; } default => { other: u8; } } qty: u8; }")
    middle = F.when(F.col("l_linenumber") == 1, put("l_partkey", 4)).when(F.col("l_linenumber") == 2, put("l_suppkey", 2)).otherwise(put("l_linenumber", 1))
    return read(lines(spark, d, put("l_linenumber", 1), middle, put("l_quantity", 1)), p, "one", "two", "other", "qty")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 2 THEN 'first' WHEN l_partkey % 256 >= 200 THEN 'second' END AS error FROM lineitem")
def wire_validate(spark, d):
    p = protocol('message M { n: u8; validate n >= 2 -> "first"; m: u8; validate m < 200 && n > 0 -> "second"; }')
    got = wire_decode.columns(p, F.col("buf"))
    return lines(spark, d, put("l_linenumber", 1), put(F.col("l_partkey") % 256, 1)).select(*ID, got["__error"].alias("error"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_linenumber::BIGINT AS rest FROM lineitem")
def wire_rest(spark, d):
    p = protocol("message M { n: u8; rest: bytes[..]; }")
    return read(lines(spark, d, put("l_linenumber", 1), F.hex(text_of())), p, "n", "rest")


def decoded(df: DataFrame, p: wire_text.Protocol, **how) -> DataFrame:
    return wire_decode.decode_column(df.select(*ID, "buf"), "buf", p, **how)


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS kind, CASE WHEN l_linenumber = 1 THEN l_partkey END AS part FROM lineitem")
def wire_layer(spark, d):
    p = protocol("message Outer { kind: u8; body: bytes[..]; } message Inner { part: u32; } bind Outer payload to Inner when kind == 1;")
    got = decoded(lines(spark, d, put("l_linenumber", 1), put("l_partkey", 4)), p, layers=True)
    return got.select(*ID, F.col("fields")["kind"].cast("long").alias("kind"), F.col("fields")["Inner.part"].cast("long").alias("part"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS turns, (SELECT sum(l_suppkey + i) FROM range(0, l_linenumber) t(i))::BIGINT AS total, (l_suppkey + l_linenumber - 1) AS last FROM lineitem")
def wire_tlv(spark, d):
    p = protocol("""message Item { type: u8; size: u8; validate size >= 2 -> "short"; value: bytes[size - 2]; }
        message M { length: u8; let start = __current_offset; loop items carry sum: u32 = 0 while (__current_offset - start) < length { item: Item; next sum = sum + item.value; } }""")
    item = lambda i: F.concat(F.lit("0106"), put(F.col("l_suppkey") + i, 4))
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.col("l_linenumber").cast("int") - 1), item), "")
    got = decoded(lines(spark, d, put(F.col("l_linenumber") * 6, 1), items), p)
    turns = F.size(F.filter("emitted", lambda e: e["name"] == "value"))
    return got.select(*ID, turns.cast("long").alias("turns"), F.col("fields")["items.carries.sum"].cast("long").alias("total"), F.col("fields")["items.item.value"].cast("long").alias("last"))


@query("SELECT l_orderkey, l_linenumber, 'p' || (l_partkey % 10) || '.example' AS name, 5 AS wire_len, 'ok' AS status FROM lineitem")
def wire_names(spark, d):
    # The name "example" at 0, and at 9 a label with a pointer to it.
    buf = F.concat(F.lit("076578616d706c6500"), F.lit("0270"), put(F.col("l_partkey") % 10 + 48, 1), F.lit("c000"))
    got = lines(spark, d, buf).withColumn("n", dns_names(F.col("buf"), F.lit(9)))
    return got.select(*ID, "n.name", "n.wire_len", "n.status")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part FROM lineitem")
def hex_source(spark, d):
    text = F.concat(F.lit("0x"), F.substring(put("l_partkey", 4), 1, 4), F.lit(" _"), F.substring(put("l_partkey", 4), 5, 4))
    rows = source.tables(spark, d, "lineitem").withColumn("buf", source.hex_bytes(text))
    return read(rows, protocol("message M { part: u32; }"), "part")


# --- flows -------------------------------------------------------------------------------------------------


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def flow_key(spark, d):
    key = keys.both_ways(F.col("l_partkey"), F.col("l_suppkey"))
    got = source.tables(spark, d, "lineitem").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    part = lambda i: F.conv(F.hex(F.substring("key", i, 8)), 16, 10).cast("long")
    return got.select(part(1).alias("a"), part(9).alias("b"), "n")


_STATES = "list_reduce(list_prepend('IDLE', list(event_type ORDER BY time_ms, event_id)), lambda s, x: CASE WHEN s = 'IDLE' AND x = 'click' THEN 'PENDING' WHEN s = 'PENDING' AND x = 'purchase' THEN 'DONE' WHEN s = 'PENDING' AND x = 'error' THEN 'IDLE' WHEN s = 'DONE' AND x = 'click' THEN 'PENDING' ELSE s END)"


@query(f"WITH {EV} SELECT user_id, {_STATES} AS state, count(*) AS n_messages FROM ev GROUP BY user_id")
def flow_fsm(spark, d):
    moves = {"IDLE": {"click": "PENDING"}, "PENDING": {"purchase": "DONE", "error": "IDLE"}, "DONE": {"click": "PENDING"}}
    got = flow.table_machine(ev(spark, d), ["user_id"], ORDER, F.col("event_type"), moves, "IDLE", F.floor(F.col("time_ms") / (7 * WINDOW)))
    return got.withColumn("n_messages", F.col("n_messages").cast("long"))


MACHINE = """protocol P { message M { x: u8; } state_machine S { key = user;
 state IDLE { on click guard (k > 20) -> PENDING { set req = k; emit OPENED; }; }
 state PENDING { on purchase guard (k != req) -> IDLE { emit CLOSED; }; on error -> IDLE { emit FAILED; }; } } }"""


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY time_ms, event_id) AS n FROM ev),
r(user_id, n, event_id, state, req, emitted) AS (SELECT user_id, 0::BIGINT, -1::BIGINT, 'IDLE', 0::BIGINT, '' FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.event_id,
 CASE WHEN state = 'IDLE' AND event_type = 'click' AND k > 20 THEN 'PENDING' WHEN state = 'PENDING' AND (event_type = 'purchase' AND k <> req OR event_type = 'error') THEN 'IDLE' ELSE state END,
 CASE WHEN state = 'IDLE' AND event_type = 'click' AND k > 20 THEN k ELSE req END,
 CASE WHEN state = 'IDLE' AND event_type = 'click' AND k > 20 THEN 'OPENED' WHEN state = 'PENDING' AND event_type = 'purchase' AND k <> req THEN 'CLOSED' WHEN state = 'PENDING' AND event_type = 'error' THEN 'FAILED' ELSE '' END
 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT event_id, state AS state_after, emitted FROM r WHERE n > 0""")
def flow_machine(spark, d):
    machine = wire_text.one(MACHINE).machines[0]
    rows = ev(spark, d).select("user_id", "event_id", "time_ms", "event_type", "k")
    return flow.run_machine(rows, machine, "user_id", ORDER, "event_type", ["k"]).select("event_id", "state_after", "emitted")


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT user_id, event_id, event_type, k, row_number() OVER w AS n, coalesce(time_ms - lag(time_ms) OVER w > {BACK}, false) AS expired FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, event_id)),
r(user_id, n, event_id, state, req, expired) AS (SELECT user_id, 0::BIGINT, -1::BIGINT, 'IDLE', 0::BIGINT, false FROM g WHERE n = 1 UNION ALL SELECT user_id, n, event_id,
 CASE WHEN was = 'IDLE' AND event_type = 'click' AND k > 20 THEN 'PENDING' WHEN was = 'PENDING' AND (event_type = 'purchase' AND k <> old OR event_type = 'error') THEN 'IDLE' ELSE was END,
 CASE WHEN was = 'IDLE' AND event_type = 'click' AND k > 20 THEN k ELSE old END, expired
 FROM (SELECT g.*, CASE WHEN g.expired THEN 'IDLE' ELSE r.state END AS was, CASE WHEN g.expired THEN 0 ELSE r.req END AS old FROM r JOIN g ON g.user_id = r.user_id AND g.n = r.n + 1))
SELECT event_id, state AS state_after, expired FROM r WHERE n > 0""")
def flow_machine_expiry(spark, d):
    """The machine with sessions that end after six idle hours and start anew."""
    rows = ev(spark, d).select("user_id", "event_id", "time_ms", "event_type", "k")
    return flow.run_machine(rows, wire_text.one(MACHINE).machines[0], "user_id", ORDER, "event_type", ["k"], idle=BACK).select("event_id", "state_after", "expired")


@query(f"""WITH {EV} SELECT s.event_id, s.time_ms + {WINDOW} AS deadline FROM ev s WHERE s.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.event_type = 'purchase' AND c.user_id = s.user_id
 AND c.time_ms > s.time_ms AND c.time_ms <= s.time_ms + {WINDOW})""")
def flow_timers(spark, d):
    e = ev(spark, d)
    return flow.due_timers(kind(e, "click"), kind(e, "purchase"), ["user_id"], "time_ms", WINDOW).select("event_id", "deadline")


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER w <= {BACK} THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY time_ms, event_id)::BIGINT AS session FROM g) SELECT user_id, session, min(time_ms) AS first, max(time_ms) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def flow_expiry(spark, d):
    return flow.idle_sessions(ev(spark, d), ["user_id"], "time_ms", "event_id", BACK)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, repeat(l_returnflag, l_linenumber) AS body, coalesce(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, l_partkey % 9 = 0 AS lost FROM lineitem),
f AS (SELECT *, max(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS gap FROM s)
SELECT l_orderkey, count(*) AS n_segments, string_agg(body, '' ORDER BY pos) AS payload FROM f WHERE gap = 0 GROUP BY l_orderkey""")
def reassembly(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = source.tables(spark, d, "lineitem").withColumn("at", F.coalesce(F.sum("l_linenumber").over(w), F.lit(0))).where("l_partkey % 9 <> 0")
    segments = rows.select("l_orderkey", F.lit(0).cast("long").alias("start"), "at", text_of().cast("binary").alias("data"))
    # A copy of each, shorter: the longer stays.
    short = segments.withColumn("data", F.substring("data", 1, 2))
    got = flow.contiguous(segments.unionByName(short), ["l_orderkey"], "start", "at", "data")
    return got.select("l_orderkey", "n_segments", F.col("payload").cast("string").alias("payload"))


@query("""WITH m AS (SELECT l_orderkey AS flow, l_linenumber::BIGINT AS n, coalesce(sum(l_linenumber + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS head FROM lineitem),
f AS (SELECT flow, max(head + n + 1) AS size FROM m GROUP BY flow), c AS (SELECT flow, size, unnest(range(0, size, 5)) AS pos FROM f),
j AS (SELECT c.flow, c.pos, least(c.pos + 5, c.size) AS upto, m.head, m.n, m.head + m.n + 1 AS stop FROM c JOIN m ON m.flow = c.flow)
SELECT flow, pos // 5 AS piece, count(*) FILTER (WHERE stop > pos AND stop <= upto) AS messages, (coalesce(sum(n) FILTER (WHERE stop > pos AND stop <= upto), 0))::BIGINT AS total,
 coalesce(max(stop - upto) FILTER (WHERE head < upto AND stop > upto), 1)::BIGINT AS needed FROM j GROUP BY flow, pos, upto""")
def wire_resume(spark, d):
    """Messages of a size and so many bytes, one after the other in a stream that comes in pieces of five bytes."""
    w = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    one = F.concat(put("l_linenumber", 1), F.expr("repeat('AB', cast(l_linenumber as int))"))
    flows = source.tables(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("flow")).agg(F.array_sort(F.collect_list(F.struct(*w, one.alias("hex")))).alias("m"))
    whole = flows.select("flow", F.array_join(F.transform("m", lambda x: x["hex"]), "").alias("hex"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("hex") - 1) / 10).cast("int")), lambda i: F.substring(F.col("hex"), i * 10 + 1, F.lit(10)))
    rows = whole.select("flow", F.posexplode(pieces).alias("piece", "part")).select("flow", F.col("piece").cast("long").alias("piece"), F.unhex("part").alias("part"))
    p = wire_text.one("protocol Sized { meta { mode = stream; } message M { n: u8; body: bytes[n]; } }")
    got = wire_decode.resume_column(rows, "flow", ["piece"], "part", p)
    total = F.aggregate("done", F.lit(0).cast("long"), lambda a, m: a + m["n"].cast("long"))
    return got.select("flow", "piece", F.size("done").cast("long").alias("messages"), total.alias("total"), "needed")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS flow, l_linenumber * 10 AS pos, repeat(chr(64 + l_linenumber::INT), 10 * (1 + (l_partkey % 3)::INT)) AS body FROM lineitem WHERE l_suppkey % 11 <> 0),
u AS (SELECT flow, pos, arg_max(body, length(body)) AS body FROM s GROUP BY flow, pos),
r(flow, upto, n, payload) AS (SELECT DISTINCT flow, 10::BIGINT, 0::BIGINT, '' FROM s UNION ALL
 SELECT r.flow, r.upto + length(u.body), r.n + 1, r.payload || u.body FROM r JOIN u ON u.flow = r.flow AND u.pos = r.upto)
SELECT flow, max(n) AS n_segments, arg_max(payload, n) AS payload FROM r WHERE n > 0 GROUP BY flow""")
def reassembly_overlap(spark, d):
    """Segments that reach over those after them; a number that lies before the end is passed over."""
    rows = source.tables(spark, d, "lineitem").where("l_suppkey % 11 <> 0")
    body = F.expr("repeat(char(64 + l_linenumber), 10 * (1 + cast(l_partkey % 3 as int)))")
    segments = rows.select(F.col("l_orderkey").alias("flow"), F.lit(10).cast("long").alias("start"), (F.col("l_linenumber") * 10).cast("long").alias("at"), body.cast("binary").alias("data"))
    got = flow.contiguous(segments, ["flow"], "start", "at", "data")
    return got.select("flow", "n_segments", F.col("payload").cast("string").alias("payload"))


def queries() -> dict:
    return dict(_known)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
