"""The rule language, its checks, and the ordered layer."""

import pytest

from strandline import catalog
from strandline.operators.engine import Engine, Topology
from strandline.plans import rule_text
from strandline.plans.lexing import LanguageError
from strandline.plans.rule_text import Limits, check, parse

SCOPES = ("Port", "Session")
CAT = catalog.seed().with_(
    events={"store.warming": catalog.EventType(SCOPES, {"time": "int", "target": "scope:Port", "degrees": "int"}), "store.door": catalog.EventType(SCOPES, {"time": "int", "target": "scope:Port"})},
    causes={"DoorLeftOpen": SCOPES, "CompressorTired": SCOPES},
    problems={"FoodAtRisk": catalog.ProblemType(SCOPES)},
)
COLD = """
ruleset "cold store" {
    version = "7"
    requires = ["topology"]
    mutually_exclusive(DoorLeftOpen, CompressorTired)
    evidence warming {
        scope: Port
        anchor w: event(store.warming) { w.degrees >= 9 }
        correlate d: event(store.door) {
            topo: same_port(d.target, w.target)
            time: d.time in [w.time - 4s, w.time + 1500ms]
            %s
        }
        if absent(d) {
            action run_check(cable_loopback) { target: w.target }
            infer Cause(DoorLeftOpen) { target: w.target, weight: -10, evidence: [w] }
            infer Cause(CompressorTired) { target: w.target, weight: +30, evidence: [w] }
        } else {
            infer Cause(DoorLeftOpen) { target: w.target, weight: +90, evidence: [w, d] }
        }
    }
    decision spoils {
        scope: Port
        anchor c: Cause(DoorLeftOpen) { c.confidence > 75 }
        emit Problem(FoodAtRisk) { severity: Low, evidence: [c], sarif_id: "cold_7" }
    }
}
"""
RULES = parse(COLD % "")
S = ("Port", "north")


def event(i, kind, t, scope=S, target=None, **fields):
    return {"event_id": i, "event_type": kind, "time_ms": t, "scope": scope, "target": target, "fields": fields, "strings": {}, "scopes": {}}


def warm(i, t, **more):
    return event(i, "store.warming", t, degrees=more.pop("degrees", 12), **more)


def door(i, t, **more):
    return event(i, "store.door", t, **more)


def run(events, rules=RULES, **how):
    engine = Engine(rules, CAT, **how)
    for e in events:
        engine.ingest(e)
    engine.finish()
    return engine, engine.snapshot()


def confidences(got):
    return {c["kind"]: c["confidence"] for c in got["causes"]}


OPEN, TIRED = {"DoorLeftOpen": 90}, {"CompressorTired": 30, "DoorLeftOpen": 0}


def test_a_door_makes_a_problem():
    engine, got = run([warm(1, 8000), door(2, 9000)])
    assert confidences(got) == OPEN and got["causes"][0]["time_ms"] == 8000
    assert [(x["kind"], x["severity"], x["sarif_id"], x["causes"]) for x in got["problems"]] == [("FoodAtRisk", "Low", "cold_7", ["DoorLeftOpen"])]
    assert [e["kind"] for e in engine.part(S).edges] == ["Supports", "Supports"] and not got["audit"]


def test_absence_waits_for_the_window():
    engine = Engine(RULES, CAT)
    engine.ingest(warm(1, 8000))
    engine.advance(9500)
    assert not engine.snapshot()["causes"]  # the end of the window must lie behind
    engine.advance(9501)
    got = engine.snapshot()
    assert confidences(got) == TIRED and not got["problems"]
    assert [(a["action"], a["argument"], a["code"]) for a in got["audit"]] == [("run_check", "cable_loopback", None)]
    assert [e["kind"] for e in engine.part(S).edges] == ["Contradicts", "Supports"]
    engine.finish()
    assert engine.snapshot()["causes"] == got["causes"]


@pytest.mark.parametrize("t,state", [(3999, TIRED), (4000, OPEN), (9500, OPEN), (9501, TIRED)])
def test_windows_hold_both_ends(t, state):
    _, got = run(sorted([warm(1, 8000), door(2, t)], key=lambda e: e["time_ms"]))
    assert confidences(got) == state


def test_mild_days_and_missing_fields_do_not_fire():
    assert not run([warm(1, 8000, degrees=8)])[1]["causes"]
    assert not run([event(1, "store.warming", 5)])[1]["causes"]


def test_counts_and_unknown_relations():
    rules = parse(COLD % "having: count >= 3")
    assert confidences(run([warm(1, 8000), door(2, 8100), door(3, 8200)], rules)[1]) == TIRED
    assert confidences(run([warm(1, 8000), door(2, 8100), door(3, 8200), door(4, 8300)], rules)[1]) == OPEN
    south = ("Port", "south")
    _, got = run([warm(1, 8000), door(2, 8100, target=south)])
    assert not got["causes"] and [a["action"] for a in got["audit"]] == ["request_topology"]
    known = Topology(known={S, south})
    assert confidences(run([warm(1, 8000), door(2, 8100, target=south)], topology=known)[1]) == TIRED
    related = Topology(known={S, south}, related={("same_port", south, S)})
    assert confidences(run([warm(1, 8000), door(2, 8100, target=south)], topology=related)[1]) == OPEN


def test_one_inference_a_window_and_cooldown():
    assert confidences(run([warm(1, 8000), door(2, 8100), warm(3, 8500), door(4, 8600)])[1]) == OPEN
    apart = [warm(1, 8000), door(2, 8100), warm(3, 29_500), door(4, 29_600)]
    _, got = run(apart)
    assert confidences(got) == {"DoorLeftOpen": 100} and len(got["problems"]) == 2
    assert len(run(apart, limits=Limits(cooldown=60_000))[1]["problems"]) == 1


def test_late_events():
    _, got = run([warm(1, 8000), event(2, "port.link_flap", 12_000, ("Port", "p")), door(3, 8200)])
    assert confidences(got) == TIRED and "ADGL3002" in [a["code"] for a in got["audit"]]
    live = Engine(RULES, CAT, Limits(max_disorder=100, allowed_lateness=50), live=True)
    for e in (warm(1, 1000), warm(2, 5000), warm(3, 4851), warm(4, 4850)):
        live.ingest(e)
    assert live.watermark == 4900 and [e["event_id"] for e in live.late] == [4] and live.diagnostics[-1][0] == "ADGL3003"


def test_idle_scopes_do_not_hold_the_watermark():
    live = Engine(RULES, CAT, Limits(idle_timeout=100), live=True)
    live.ingest(warm(1, 1000), wall=0)
    live.ingest(warm(2, 3000, scope=("Port", "s2")), wall=10)
    assert live.watermark == 1000
    live.ingest(warm(3, 4000, scope=("Port", "s2")), wall=200)
    assert live.watermark == 4000


def test_limits():
    engine, _ = run([warm(i, i) for i in range(10)], limits=Limits(events=4))
    assert engine.diagnostics.count(("ADGL3005", f"{S}: the oldest event made room")) == 6
    engine, got = run([warm(i, 1000 + i, target=("Port", f"t{i}")) for i in range(5)], limits=Limits(causes=2))
    assert len([c for c in got["causes"] if c["scope"] == S]) == 2 and "ADGL3102" in {c for c, _ in engine.diagnostics}
    engine, got = run([warm(i, 1000 * i) for i in range(6)], limits=Limits(pending=1))
    assert "ADGL3004" in {c for c, _ in engine.diagnostics} and got["causes"]
    engine, _ = run([warm(i, 1000 * i) for i in range(200)])
    assert len(engine.part(S).ring) <= 61 + 15


def test_the_scope_in_predicates():
    rules = parse((COLD % "").replace("w.degrees >= 9", "w.target == scope"))
    assert check(rules, CAT) == []
    assert confidences(run([warm(1, 8000), door(2, 8100)], rules)[1]) == OPEN
    assert not run([warm(1, 8000, target=("Port", "south"))], rules)[1]["causes"]
    assert "ADGL0210" in {c for c, _ in check(parse((COLD % "").replace("w.degrees >= 9", "scope > 4")), CAT)}


def test_an_anchor_that_made_room_is_not_decided():
    engine, got = run([warm(1, 8000), *(event(i, "port.link_flap", 8000 + i) for i in range(2, 6)), event(9, "port.link_flap", 20_000)], limits=Limits(events=3))
    assert not got["causes"] and ("MissingAnchor", "warming: the anchor 1 has gone") in engine.diagnostics


SUPPRESS = """ruleset "r" { version = "1"
    evidence flap { scope: Port anchor e: event(port.link_flap) infer Cause(PhysicalLinkAbsent) { target: e.target, weight: +90 } }
    decision down { scope: Port anchor c: Cause(PhysicalLinkAbsent) { c.confidence >= 80 } emit Problem(DeviceUnreachable) { target: c.target } }
    decision mask { scope: Port anchor d: Problem(DeviceUnreachable)
        correlate u: Problem(DeviceUnreachable) { topo: upstream_of(u.target, d.target) time: u.time in [d.time - 30s, d.time + 5s] }
        if present(u) { action suppress_symptom(d) { reason: "above", evidence: [u] } } } }"""


def test_problems_above_suppress_those_below():
    rules, p, a, b = parse(SUPPRESS), ("Port", "p"), ("Port", "a"), ("Port", "b")
    topology = Topology(known={a, b}, above={b: [a]})
    _, got = run([event(1, "port.link_flap", 1000, p, a), event(2, "port.link_flap", 2000, p, b)], rules, topology=topology)
    # Other scopes of the same type are rolled up into as well, so look at the scope of the events.
    assert [(x["target"], x["superseded"]) for x in got["problems"] if x["scope"] == p] == [(a, False), (b, True)]
    # A problem above that comes later does not suppress.
    _, got = run([event(1, "port.link_flap", 1000, p, b), event(2, "port.link_flap", 2000, p, a)], rules, topology=topology)
    assert not any(x["superseded"] for x in got["problems"] if x["scope"] == p)


def test_roll_up_and_ambiguity():
    rules = parse("""ruleset "r" { version = "1" mutually_exclusive(Congestion, PmtudBlackhole)
        evidence a { scope: ClientMac anchor e: event(dhcp.timeout) infer Cause(Congestion) { target: e.vlan, weight: +50 } }
        evidence b { scope: ClientMac anchor e: event(radius.access_request) infer Cause(PmtudBlackhole) { target: e.vlan, weight: +45 } } }""")
    v = ("Vlan", "10")
    mk = lambda i, kind, t, c: event(i, kind, t, ("ClientMac", c)) | {"scopes": {"vlan": v}}
    engine, got = run([mk(1, "dhcp.timeout", 1000, "c1"), mk(2, "dhcp.timeout", 9000, "c1"), mk(3, "dhcp.timeout", 9500, "c2"), mk(4, "radius.access_request", 9600, "c2")], rules)
    assert {(c["scope"], c["kind"]): c["confidence"] for c in got["causes"]} == {
        (("ClientMac", "c1"), "Congestion"): 100, (("ClientMac", "c2"), "Congestion"): 50, (("ClientMac", "c2"), "PmtudBlackhole"): 45, (v, "Congestion"): 100, (v, "PmtudBlackhole"): 45,
    }
    assert [(x["scope"], x["kind"]) for x in got["problems"]] == [(("ClientMac", "c2"), "AmbiguousDiagnosis")]
    assert list(engine.part(("ClientMac", "c2")).ambiguities.values()) == ["Active"]
    assert [e["kind"] for e in engine.part(v).edges].count("RollsUp") == 3


def test_errors_stop_a_predicate_and_unknown_does_not_fire():
    rules = lambda e: parse('ruleset "r" { version = "1" evidence a { scope: Port anchor e: event(port.crc_errors) { %s } infer Cause(Congestion) { target: e.target, weight: +9 } } }' % e)
    fire = lambda e, **f: bool(run([event(1, "port.crc_errors", 1, ("Port", "p"), **f)], rules(e))[1]["causes"])
    assert fire("e.count / 2 == 3", count=7) and fire("e.count % 4 == 3", count=7)
    assert not fire("e.count > 1 or 1 / (e.count - 7) > 0", count=7)
    assert not fire("e.count + 9223372036854775807 > 0", count=7)
    assert not fire("e.count > 1") and not fire("not (e.count > 1)")
    assert fire("e.time == 1 and not (e.count == 3)", count=4)


NEGATIVE = {
    "ADGL0100": [("version = ", "versio = ")],
    "ADGL0104": [("evidence warming", "evidence __warming")],
    "ADGL0110": [("1500ms", "2m"), ("1500ms", "7minutes")],
    "ADGL0201": [("event(store.door)", "event(store.window)")],
    "ADGL0202": [("Cause(DoorLeftOpen) { target", "Cause(Ghosts) { target")],
    "ADGL0203": [("Problem(FoodAtRisk)", "Problem(Ghosts)")],
    "ADGL0205": [("+90", "90"), ("+90", "+101")],
    "ADGL0206": [("action run_check(cable_loopback)", "action explode")],
    "ADGL0207": [("run_check(cable_loopback)", "request_observation(cable_loopback)")],
    "ADGL0208": [("run_check(cable_loopback)", "run_check(icmp.visibility)")],
    "ADGL0209": [("evidence: [w, d]", "evidence: [w, nobody]"), ("w.degrees >=", "w.nothing >=")],
    "ADGL0210": [("w.degrees >= 9", 'w.degrees > "x"'), ("w.degrees >= 9", "w.degrees + 1"), ("scope: Port\n        anchor w", "scope: AccessPoint\n        anchor w")],
    "ADGL0211": [("scope: Port\n        anchor w", "scope: AccessPoint\n        anchor w"), ("Cause(DoorLeftOpen) { target", "Cause(RfInterference) { target")],
    "ADGL0212": [("Problem(FoodAtRisk)", "Problem(WlanRadiusOutage)")],
    "ADGL0411": [("w.time - 4s", "d.time - 4s"), ("[w.time - 4s", "[w.time + 4s")],
    "ADGL0412": [("4s", "80s")],
    "ADGL0413": [("d.time in", "w.time in")],
    "ADGL0420": [("same_port(", "close_to(")],
    "ADGL0421": [("(d.target, w.target)", "(d.target)")],
    "ADGL0430": [('"topology"', '"magic"')],
    "ADGL0440": [("mutually_exclusive(", "mutually_exclusive(CompressorTired, PacketLossPath) mutually_exclusive(")],
    "ADGL0450": [("emit Problem(FoodAtRisk)", "infer Cause(FoodAtRisk)"), ("event(store.warming)", "Cause(Congestion)")],
    "ADGL0501": [("w.degrees >= 9", "size(w) > 9")],
    "ADGL0502": [("mutually_exclusive(", "mutually_exclusive(PhysicalLinkAbsent, RfInterference) mutually_exclusive(")],
    "ADGL0503": [],
    "ADGL0504": [("w.time + 1500ms]", "w.time + 1500ms] having: count >= 0")],
    "ADGL0505": [("w.time + 1500ms]", "w.time + 1500ms] having: count >= 33")],
}


@pytest.mark.parametrize("code", NEGATIVE)
def test_checks(code):
    assert check(RULES, CAT) == []
    if code == "ADGL0503":
        assert code in {c for c, _ in check(RULES, CAT, Limits(dedup_window=0))}
    for old, new in NEGATIVE[code]:
        text = (COLD % "").replace(old, new)
        assert text != COLD % ""
        try:
            found = {c for c, _ in check(parse(text), CAT)}
        except LanguageError as why:
            found = {why.code}
        assert code in found, found


def test_catalog():
    cat = catalog.seed()
    assert {k: (p.scopes, p.severity, p.sarif_id) for k, p in cat.problems.items() if k in ("XlIcmpTcpMss", "TcpZeroWindow", "WifiApWidth320WithoutEht")} == {
        "XlIcmpTcpMss": (("Session",), "Medium", "l3_pmtud_blackhole"), "TcpZeroWindow": (("Session",), "Medium", "tcp_zero_window"),
        "WifiApWidth320WithoutEht": (("AccessPoint",), "Medium", "wifi_ap_width320_without_eht"),
    }
    assert cat.causes["WifiClientStickySignal"] == ("ClientMac",) and cat.events["wifi.mgmt.deauth"].scopes == ("ClientMac", "AccessPoint")
    assert {s for p in cat.problems.values() for s in p.scopes} | {s for c in cat.causes.values() for s in c} == set(catalog.ANCESTORS)
    assert all(set(e.private) <= set(e.fields) for e in cat.events.values())


def test_more_checks():
    loop = """ruleset "r" { version = "1" decision a { scope: Port anchor p: Problem(DeviceUnreachable) emit Problem(WlanRadiusOutage) { severity: Low } }
        decision b { scope: Port anchor p: Problem(WlanRadiusOutage) emit Problem(DeviceUnreachable) { severity: Low } } }"""
    assert "ADGL0410" in {c for c, _ in check(parse(loop), CAT)}
    for text, code in [("x" * 300, "ADGL0101"), ("not " * 70 + "true", "ADGL0103"), ("(" * 70 + "1" + ")" * 70, "ADGL0103")]:
        with pytest.raises(LanguageError) as why:
            rule_text._Reader(text).expression() if code == "ADGL0103" else parse('ruleset "r" { version = "1" evidence %s { } }' % text)
        assert why.value.code == code
    with pytest.raises(LanguageError) as why:
        parse(" " * (4 << 20) + "x")
    assert why.value.code == "ADGL0102"


def test_precedence():
    e = rule_text._Reader("a.x + 2 * 3 > 4 and not b.y == 1 or c.z").expression()
    assert e == ("or", ("and", (">", ("+", ("name", "a.x"), ("*", ("int", 2), ("int", 3))), ("int", 4)), ("==", ("not", ("name", "b.y")), ("int", 1))), ("name", "c.z"))


def test_includes():
    rule = 'evidence %s { scope: Port anchor e: event(port.crc_errors) infer Cause(Congestion) { target: e.target, weight: +1 } }'
    files = {
        "main": 'include "a"\ninclude "b"\nruleset "m" { version = "1" ' + rule % "own" + "}",
        "a": 'include "c"\nruleset "a" { version = "9" requires = ["x"] ' + rule % "ra" + "}",
        "b": 'include "c"\nruleset "b" { version = "9" ' + rule % "rb" + "}",
        "c": 'ruleset "c" { version = "9" ' + rule % "rc" + "}",
        "loop": 'include "loop"\nruleset "l" { version = "1" }',
    }
    got = rule_text.load("main", files.__getitem__)
    assert [r.name for r in got.rules] == ["rc", "ra", "rb", "own"] and got.version == "1" and not got.requires
    with pytest.raises(LanguageError) as why:
        rule_text.load("loop", files.__getitem__)
    assert why.value.code == "ADGL0106"


def test_upstream_of():
    from strandline.operators.topology import upstream_of

    above, known = {"c": ["b"], "b": ["a"], "x": ["y"], "y": ["x"]}, set("abcxyz")
    assert upstream_of(above, known, "a", "c") == (True, None)
    assert upstream_of(above, known, "c", "a") == (False, None) and upstream_of(above, known, "a", "a") == (False, None)
    assert upstream_of(above, known, "a", "unknown") == (None, None)
    assert upstream_of(above, known, "y", "x") == (False, "ADGL3006")
    assert upstream_of(above, known, "a", "c", hops=1) == (True, None)
    assert upstream_of(above, known, "a", "c", hops=0) == (False, "ADGL3006")
