"""Formats, machines and reassembly."""

import random

import pytest

from strandline.functions import unsigned
from strandline.functions.names import Plugins, dns_name
from strandline.operators import flow
from strandline.plans import wire_text
from strandline.plans.lexing import LanguageError
from strandline.plans.wire_decode import Decoder, Invalid, NeedMore, columns, compute, decode_column

TAG = """protocol Parcel { meta { endian = big; mode = datagram; } message Label { kind: u16; office: u16; validate office != 0 -> "no office";
    name_size: u8; zone: u8; urgent: u16; validate urgent <= 3 && (urgent == 3 || !(zone == 255)) -> "odd zone"; name: bytes[name_size]; place: bytes[name_size - 2]; rest: bytes[..]; } }"""
DATA = bytes.fromhex("0102 00a0 05 07 0002 4142434445 313233 ffee")
FIELDS = {"kind": 258, "office": 160, "name_size": 5, "zone": 7, "urgent": 2, "name": 0x4142434445, "place": 0x313233, "rest": 2}


def test_a_label_both_ways(spark):
    p = wire_text.one(TAG)
    got = Decoder(p).decode(DATA)
    assert got.fields == {**FIELDS, "__current_offset": 18} and got.consumed == 18 and got.error is None
    bad = DATA[:2] + b"\0\0" + DATA[4:]
    far = DATA[:5] + b"\xff" + DATA[6:]
    assert Decoder(p).decode(bad).error == "no office" and Decoder(p).decode(far).error == "odd zone"
    df = spark.createDataFrame([(1, DATA), (2, bad), (3, far)], "i int, b binary")
    cols = columns(p, df["b"])
    rows = df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()
    assert {n: int(rows[0][n]) for n in FIELDS} == FIELDS and rows[0]["__error"] is None and rows[0]["__complete"]
    assert rows[1]["__error"] == "no office" and rows[2]["__error"] == "odd zone"
    got = decode_column(df, "b", p).orderBy("i").collect()
    assert {k: int(v) for k, v in got[0]["fields"].items()} == {**FIELDS, "__current_offset": 18} and [r["error"] for r in got] == [None, "no office", "odd zone"]


def one(body, data, **how):
    return Decoder(wire_text.one(f"protocol P {{ meta {{ endian = big; mode = datagram; }} {body} }}"), **how).decode(bytes.fromhex(data))


def test_scalars_and_short_reads():
    assert one("message M { a: u24; b: u16le; c: u32; d: u8; }", "010203 0405 01").fields == {"a": 0x010203, "b": 0x0504, "c": 0, "d": 1, "__current_offset": 6}
    assert one("message M { a: bitfield{3}; b: bitfield{7}; c: u8; }", "ffc0 07").fields == {"a": 7, "b": 127, "c": 7, "__current_offset": 3}
    assert one("message M { n: u8; s: bytes[n]; t: u8; }", "09 0102").fields == {"n": 9, "s": 0x0102, "t": 0, "__current_offset": 10}
    assert one("message M { a: u8; x: u16 if a > 3; r: bytes[..]; }", "04 0001 ffff").fields == {"a": 4, "x": 1, "r": 2, "__current_offset": 5}
    with pytest.raises(NeedMore):
        Decoder(wire_text.one("protocol P { meta { mode = stream; } message M { a: u32; } }")).decode(b"\x01")


def test_expressions():
    got = one("message M { a: u8; let b = a > 3 ? 10 : 20; let c = (a & 0) ?? 7; let d = a - 9; let e = 1 / 0; let f = 1 + 2 * 3 == 7 && !(a == 0); let g = ~0; let h = 1 << 4 | 1; }", "05").fields
    assert {k: got[k] for k in "bcdefgh"} == {"b": 10, "c": 7, "d": 0, "e": 0, "f": 1, "g": (1 << 64) - 1, "h": 17}
    assert one("message M { a: u8; let b = nothing; }", "05").error and one("message M { a: u8; let b = nothing; }", "05", compat=True).fields["b"] == 0


def test_loops_matches_and_references():
    tlv = """message A { type: u8; length: u8; validate length >= 2 -> "short"; value: bytes[length - 2]; }
        message M { n: u8; loop items carry left: u8 = n while left > 0 { a: A; next left = left - 1; } end: u8; }"""
    got = one(tlv, "02 01 03 aa 02 04 bbcc 07")
    assert got.fields["items.a.value"] == 0xBBCC and got.fields["items.carries.left"] == 0 and got.fields["end"] == 7
    assert got.emitted == [("n", 2), ("type", 1), ("length", 3), ("value", 0xAA), ("type", 2), ("length", 4), ("value", 0xBBCC), ("end", 7)]
    assert one(tlv, "01 01 01").error == "short"
    assert one("message M { n: u8; loop l while __count < n { x: u8; } }", "03 010203").fields["l.x"] == 3
    assert "does not end" in one("message M { n: u8; loop l while n > 0 { x: u8; } }", "03 0102").error
    match = "message M { t: u8; match t { case 1 => { a: u8; } default => { b: u16; } } }"
    assert one(match, "01 05 06").fields["a"] == 5 and one(match, "02 0506").fields["b"] == 0x0506


def test_layers_and_root():
    p = wire_text.one("protocol P { message Inner { part: u16; } message Outer { k: u8; i: Head; body: bytes[..]; } message Head { x: u8; } bind Outer payload to Inner when k == 1; }")
    assert p.root == "Inner"
    p = wire_text.one("protocol P { message Outer { k: u8; body: bytes[..]; } message Inner { part: u16; } bind Outer payload to Inner when k == 1; }")
    assert Decoder(p).layers(b"\x01\x00\x09")["Inner.part"] == 9 and "Inner.part" not in Decoder(p).layers(b"\x02\x00\x09")


def test_format_errors_and_checks():
    for text in ("protocol P { }", "protocol P { message M { a: bitfield{65}; } }", "protocol P { message M { x: u8; loop l while __rem > 0 { y: u8; } } }"):
        with pytest.raises(LanguageError):
            wire_text.one(text)
    assert {c for c, _ in wire_text.check(wire_text.one("protocol P { message M { n: u8; s: bytes[n - 2]; q: Nothing; } }"))} == {"NFDV01", "NFDL0102"}
    assert not wire_text.check(wire_text.one('protocol P { message M { n: u8; validate n >= 2 -> "x"; s: bytes[n - 2]; } }'))


def test_unsigned_operators_equal_the_interpreter(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    values = [0, 1, 2, 63, (1 << 32) - 1, 1 << 32, (1 << 63) - 1, 1 << 63, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(20)]
    pairs = [(str(a), str(b)) for a in values for b in values]
    df = spark.createDataFrame(pairs, "a string, b string")
    ops = ["+", "-", "*", "/", "%", "==", "!=", "<", "<=", ">", ">=", "and", "or", "&", "|", "^", "<<", ">>"]
    a, b = (unsigned.raw(F.col(c).cast(unsigned.KIND)) for c in "ab")
    shown = lambda c, name: unsigned.number(c).cast("string").alias(name)
    rows = df.select("a", "b", *[shown(unsigned.binary(op, a, b), f"o{i}") for i, op in enumerate(ops)], *[shown(unsigned.unary(op, a), op) for op in ("neg", "inv", "not")]).collect()
    for r in rows:
        for i, op in enumerate(ops):
            assert int(r[f"o{i}"]) == compute(op, int(r["a"]), int(r["b"])), (op, r["a"], r["b"])
        assert int(r["not"]) == (int(r["a"]) == 0)
        assert int(r["neg"]) == -int(r["a"]) % (1 << 64) and int(r["inv"]) == (1 << 64) - 1 - int(r["a"])


def test_names():
    root = b"\x07example\x00" + b"\x02p1\xc0\x00" + b"\xc0\x0e"
    assert dns_name(root, 0) == ("example", 9, "ok") and dns_name(root, 9) == ("p1.example", 5, "ok")
    assert dns_name(root, 14)[2] == "loop" and dns_name(b"\x05ab", 0)[2] == "truncated" 
    # Sizes from 0x40 to 0xBF are lengths too.
    assert dns_name(b"\x80", 0)[2] == "truncated" and dns_name(b"\x41" + b"a" * 65 + b"\0", 0) == ("a" * 65, 67, "ok")
    plugins = Plugins()
    plugins.register("twice", 1, lambda root, x: x * 2)
    assert plugins.invoke("twice", b"", 4) == 8
    with pytest.raises(TypeError):
        plugins.invoke("twice", b"")
    with pytest.raises(KeyError):
        plugins.invoke("nothing", b"")
    text = 'protocol D { message M { let d = invoke("dns_decompress", __root_buffer, __root_offset); q: bytes[d.wire_len]; t: u16; } }'
    got = Decoder(wire_text.one(text)).decode(b"\x07example\x00\x00\x05")
    assert got.fields["t"] == 5 and got.consumed == 11


MACHINE = wire_text.one("""protocol T { message Segment { f: u8; } state_machine C { key = bidir_tuple((a, b), (c, d));
    state CLOSED { on Segment guard (syn == 1 && ack == 0) -> SYN_SENT { emit SEEN; set n = 5; start_timer(idle, 10); }; }
    state SYN_SENT { on Segment guard (ack == n) -> ESTABLISHED { emit UP; cancel_timer(idle); }; on timer_idle -> CLOSED { }; }
    state ESTABLISHED { } } }""").machines[0]


def test_machine_timers_and_eviction():
    s = flow.Sessions(MACHINE, capacity=2)
    assert MACHINE.initial == "CLOSED" and s.feed("k", "Segment", {"syn": 1, "ack": 1}) == ("CLOSED", "CLOSED", [])
    assert s.feed("k", "Segment", {"syn": 1, "ack": 0}, now=100) == ("CLOSED", "SYN_SENT", ["SEEN"])
    assert s.advance(109) == []
    assert s.feed("k", "Segment", {"ack": 5}) == ("SYN_SENT", "ESTABLISHED", ["UP"]) and s.advance(200) == []
    s.feed("a", "Segment", {"syn": 1})
    s.schedule("a", "x", 5)
    s.schedule("k", "y", 5)
    assert [(k, n) for k, n, *_ in s.advance(5)] == [("a", "x"), ("k", "y")]
    s.feed("b", "Segment", {})
    assert set(s.flows) == {"k", "b"} and s.expire(0) == ["k"]


def test_reassembly_in_any_order(spark):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(300))
    cuts = sorted(rng.sample(range(1, 300), 12))
    parts = [(a, data[a:b]) for a, b in zip([0, *cuts], [*cuts, 300])]
    rng.shuffle(parts)
    r = flow.Reassembler(0)
    for at, piece in parts:
        r.push(at, piece[:1])
        r.push(at, piece) if at > r.next else None
    whole = flow.Reassembler(0)
    for at, piece in parts:
        whole.push(at, piece)
    assert bytes(whole.data) == data and whole.needed(310) == 10
    whole.compact(20)
    assert bytes(whole.data) == data[-20:]
    with pytest.raises(ValueError):
        flow.Reassembler(0, limit=5).push(0, b"123456")
    rows = [(1, 0, at, bytearray(p)) for at, p in parts] + [(1, 0, parts[0][0], bytearray(parts[0][1][:1]))] + [(2, 0, 0, bytearray(b"ab")), (2, 0, 3, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "k int, s long, n long, d binary")
    got = {r["k"]: (r["n_segments"], bytes(r["payload"])) for r in flow.contiguous(df, ["k"], "s", "n", "d").collect()}
    assert got == {1: (13, data), 2: (1, b"ab")}


def test_reassembly_of_overlaps_equals_the_fold(spark):
    from pyspark.sql import functions as F

    three = [(0, 0, b"a" * 10), (0, 5, b"b" * 5), (0, 10, b"c" * 5)]
    rng = random.Random(4)
    flows = {0: three}
    for k in range(1, 40):
        flows[k] = [(k, at, bytes([65 + rng.randrange(20)]) * rng.choice([0, 1, 2, 3, 5])) for at in rng.choices(range(25), k=rng.randrange(1, 40))]
    rows = [(k, 7, at + 7, bytearray(d)) for k, parts in flows.items() for _, at, d in parts]
    df = spark.createDataFrame(rows, "k int, s long, n long, d binary")
    for limit in (1 << 20, 12):
        want = {}
        for k, parts in flows.items():
            longest = {}
            for _, at, d in parts:
                if len(d) >= len(longest.get(at, b"")):
                    longest[at] = max(longest.get(at, b""), d, key=len)
            end, out = 0, []
            for at in sorted(longest):
                if at > end or at == end and end + len(longest[at]) > limit:
                    break
                if at == end:
                    out.append(longest[at])
                    end += len(longest[at])
            if out:
                want[k] = (len(out), len(b"".join(out)))
        got = {r["k"]: (r["n_segments"], len(r["payload"])) for r in flow.contiguous(df, ["k"], "s", "n", "d", limit).collect()}
        assert got == want
    assert got[0][1] == 10 and flow.contiguous(df.where("k = 0"), ["k"], "s", "n", "d").first()["payload"] == b"a" * 10 + b"c" * 5
    one = flow.Reassembler(0)
    for _, at, d in three:
        one.push(at, d)
    assert bytes(one.data) == b"a" * 10 + b"c" * 5
    top = (1 << 32) - 4
    wrapped = [(1, top, top, bytearray(b"wxyz")), (1, top, 0, bytearray(b"ab")), (1, top, top - 3, bytearray(b"old"))]
    df = spark.createDataFrame(wrapped, "k int, s long, n long, d binary").withColumn("n", flow.unwrapped(F.col("n"), F.col("s")))
    assert flow.contiguous(df, ["k"], "s", "n", "d").first()["payload"] == b"wxyzab"


def test_machine_plan_equals_fold(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, rng.randrange(5), i * 10, rng.choice("abc")) for i in range(300)]
    moves = {"X": {"a": "Y"}, "Y": {"b": "Z", "c": "X"}, "Z": {"a": "X"}}
    df = spark.createDataFrame(rows, "i long, k int, t long, s string")
    got = {r["k"]: r["state"] for r in flow.table_machine(df, ["k"], ["t", "i"], F.col("s"), moves, "X", F.floor(F.col("t") / 100)).collect()}
    want = {}
    for _, k, _, s in rows:
        want[k] = moves.get(want.get(k, "X"), {}).get(s, want.get(k, "X"))
    assert got == want


def test_unknown_message_is_an_error():
    assert one("message M { a: Nothing; }", "00").error == "no message Nothing"


def test_a_stream_in_any_pieces(spark):
    from strandline.plans.wire_decode import Resumable, resume_column

    p = wire_text.one("protocol S { meta { endian = big; mode = stream; } message M { n: u16; k: u8; loop l while __count < (n & 3) { x: u24; } s: bytes[k & 7]; b: bitfield{12}; t: u8; } }")
    rng = random.Random(6)
    data = b"".join(bytes([rng.randrange(256), rng.randrange(256), rng.randrange(256)]) + bytes(rng.randrange(256) for _ in range(30)) for _ in range(20))
    whole = Resumable(p)
    want = [g.fields for g in whole.feed(data)]
    assert len(want) > 10
    rows = []
    for k in range(30):
        cuts = sorted(rng.sample(range(1, len(data)), rng.randrange(1, 60)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        stream, found, left = Resumable(p), [], 1
        for i, piece in enumerate(pieces):
            got = stream.feed(piece)
            assert not (got and len(piece) < left) and stream.needed >= 1
            left = stream.needed
            found += [g.fields for g in got]
            rows.append((k, i, bytearray(piece)))
        assert found == want and stream.data == whole.data and stream.needed == whole.needed
    df = spark.createDataFrame(rows, "k int, i int, b binary").repartition(5)
    got = {}
    for r in sorted(resume_column(df, "k", ["i"], "b", p).collect(), key=lambda r: (r["k"], r["i"])):
        got.setdefault(r["k"], []).extend({n: int(v) for n, v in m.items()} for m in r["done"])
    assert set(got) == set(range(30)) and all(x == want for x in got.values())
    small = Resumable(wire_text.one("protocol S { meta { mode = stream; } message M { n: u32; s: bytes[n]; } }"), limit=8)
    small.feed(b"\0\0\1\0")
    assert small.needed == 256 and small.feed(b"123456") == [] and small.error == "the buffer is full" and small.feed(b"7") == []


FORMATS = {
    "numbers": "message M { a: u24; b: u16le; c: u32 if a > 70000; d: u8; e: u64le; f: u64; }",
    "bits": "message M { a: bitfield{3}; b: bitfield{7}; c: u8; d: bitfield{13}; e: u16; }",
    "bytes": "message M { n: u8; s: bytes[n & 15]; t: u16; u: bytes[t]; r: bytes[..]; z: u8; }",
    "lets": "message M { a: u8; b: u64; let c = a > 3 ? b * b : b + 1; let d = (a & 1) ?? (b - 7); let e = b / (a & 3) + b % (a & 7); let f = ~b ^ -a | b << a; let g = (b >> a) != 3 && a <= 9 || !(b < 5); let h = __rem + __current_offset; }",
    "checks": 'message M { a: u8; validate a >= 20 -> "low"; b: u8; validate b != a -> "same"; let q = c; c: u8; }',
    "tlv": 'message A { type: u8; size: u8; validate size >= 2 -> "short"; value: bytes[(size & 7) - 2]; } message M { n: u8; loop items carry sum: u32 = n while __count < (n & 15) { a: A; next sum = sum + a.value; } end: u8; }',
    "count": "message M { n: u8; loop l while __count < (n & 7) { x: u8; loop k while __count < 2 { y: u8; } } z: u16; }",
    "endless": "message M { n: u8; loop l while n > 0 { x: bytes[n & 1]; } }",
    "match": "message M { t: u8; match t & 3 { case 1 => { a: u8; } case 2 => { b: u16; c: M if t > 250; } default => { d: u24; let e = a; } } f: u8; }",
    "deep": "message M { t: u8; m: M if t > 9; }",
    "unknown": "message M { t: u8; let a = t > 128 ? nothing : 4; b: Gone if t > 64; c: u8; }",
    "layers": "message O { k: u8; j: u8; body: bytes[j & 7]; } message I { part: u16; more: u8; } message J { last: u8; } bind O payload to I when k > 99; bind O payload to J when I.more > 7 || k < 20;",
}


@pytest.mark.parametrize("name", FORMATS)
@pytest.mark.parametrize("compat", [False, True])
def test_batches_equal_single_messages(name, compat):
    import pyarrow as pa

    from strandline.plans import wire_batch, wire_decode

    p = wire_text.one(f"protocol P {{ meta {{ endian = big; mode = datagram; }} {FORMATS[name]} }}")
    assert wire_batch.can_batch(p)
    rng = random.Random(name)
    data = [None, b""] + [bytes(rng.choice([0, 1, 2, 3, 5, 9, 130, 255, rng.randrange(256)]) for _ in range(rng.randrange(40))) for _ in range(150)]
    for limits in ((100_000, 300, 1024, 8), (23, 3, 6, 2)):
        wide = name == "layers"
        got = wire_batch.decoded_arrays(p, compat, pa.array(data, pa.binary()).slice(1), wide, limits)
        old = [getattr(wire_decode, k) for k in ("STEPS", "TURNS", "NAMES", "DEPTH")]
        wire_decode.STEPS, wire_decode.TURNS, wire_decode.NAMES, wire_decode.DEPTH = limits
        try:
            for i, message in enumerate(data[1:]):
                one = Decoder(p, compat)
                want = one.decode(message)
                fields = one.layers(message) if wide else want.fields
                assert {k: int(v) for k, v in got[0][i].as_py()} == fields, (i, message)
                assert [(x["name"], int(x["value"])) for x in got[1][i].as_py()] == want.emitted
                assert (got[2][i].as_py(), got[3][i].as_py()) == (want.consumed, want.error)
        finally:
            wire_decode.STEPS, wire_decode.TURNS, wire_decode.NAMES, wire_decode.DEPTH = old
