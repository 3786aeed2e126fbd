"""The format language: text to protocols."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexing import LanguageError, Reader, calls_in, names_in

SCALARS = {f"u{n}{e}": (n // 8, e or "be") for n in (8, 16, 24, 32, 48, 64) for e in ("", "be", "le")}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # a scalar, bits, bytes, rest, or a message's name
    size: tuple | int | None = None
    when: tuple | None = None
    little: bool | None = None


@dataclass(frozen=True)
class Let:
    name: str
    value: tuple


@dataclass(frozen=True)
class Validate:
    value: tuple
    message: str


@dataclass(frozen=True)
class Match:
    value: tuple
    cases: tuple  # (expression, statements)
    default: tuple | None = None


@dataclass(frozen=True)
class Loop:
    name: str
    carries: tuple  # (name, initial)
    condition: tuple
    body: tuple
    nexts: tuple  # (name, value)


@dataclass(frozen=True)
class Transition:
    message: str
    guard: tuple | None
    to: str
    actions: tuple  # ("set", name, value), ("emit", name), ("start", name, value) or ("cancel", name)


@dataclass(frozen=True)
class Machine:
    name: str
    key: tuple
    states: dict[str, tuple[Transition, ...]]

    @property
    def initial(self) -> str:
        return next(iter(self.states))


@dataclass(frozen=True)
class Protocol:
    name: str
    messages: dict[str, tuple]
    little: bool = False
    stream: bool = False
    binds: tuple = ()  # (outer, message, condition)
    machines: tuple[Machine, ...] = ()
    plain: dict = field(default_factory=dict)

    @property
    def root(self) -> str:
        """The first message that no other refers to, else the first."""
        used = {f.kind for m in self.messages.values() for f in fields_in(m)}
        return next((m for m in self.messages if m not in used), next(iter(self.messages)))


def fields_in(body: tuple):
    for s in body:
        if isinstance(s, Field):
            yield s
        elif isinstance(s, Loop):
            yield from fields_in(s.body)
        elif isinstance(s, Match):
            for _, b in s.cases:
                yield from fields_in(b)
            yield from fields_in(s.default or ())


class _Reader(Reader):
    levels = [("??",), ("or",), ("and",), ("==", "!="), ("|",), ("^",), ("&",), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
    spelled = {"||": "or", "&&": "and"}
    prefixes = {"!": "not", "~": "inv", "-": "neg"}
    syntax, ternary = "NFDL0100", True

    def module(self) -> list[Protocol]:
        out = []
        while self.now.kind != "end":
            out.append(self.protocol())
        return out

    def protocol(self) -> Protocol:
        self.need("protocol")
        name, meta = self.word(), {}
        self.need("{")
        if self.take("meta"):
            self.need("{")
            while not self.take("}"):
                key = self.word()
                self.need("=")
                meta[key] = self.word()
                self.need(";")
        messages, binds, machines = {}, [], []
        while not self.take("}"):
            if self.take("message"):
                message = self.word()
                messages[message] = self.body()
            elif self.take("bind"):
                outer = self.word()
                self.need("payload")
                self.need("to")
                inner = self.word()
                self.need("when")
                binds.append((outer, inner, self.expression()))
                self.need(";")
            elif self.take("state_machine"):
                machines.append(self.machine())
            else:
                raise self.fail(f"unexpected {self.now.text!r}")
        if not messages:
            raise self.fail("a protocol has a message")
        return Protocol(name, messages, meta.get("endian") == "little", meta.get("mode") == "stream", tuple(binds), tuple(machines))

    def body(self) -> tuple:
        self.need("{")
        out = []
        while not self.take("}"):
            out.append(self.statement())
        return tuple(out)

    def statement(self):
        if self.take("let"):
            name = self.word()
            self.need("=")
            made = Let(name, self.expression())
        elif self.take("validate"):
            value = self.expression()
            self.need("->")
            made = Validate(value, self.string())
        elif self.has("match") and not self.ahead(":"):
            return self.match()
        elif self.has("loop") and not self.ahead(":"):
            return self.loop()
        else:
            made = self.field()
        self.need(";")
        return made

    def field(self) -> Field:
        name = self.word()
        self.need(":")
        kind, size, little = self.word(), None, None
        if kind == "bitfield":
            self.need("{")
            kind, size = "bits", self.integer()
            if not 1 <= size <= 64:
                raise self.fail("1 to 64 bits")
            self.need("}")
        elif kind == "bytes":
            self.need("[")
            if self.take("..") or self.take("EOF") or self.take("stream"):
                kind = "rest"
            else:
                size = self.expression()
            self.need("]")
        elif kind in SCALARS:
            size, order = SCALARS[kind]
            little = order == "le" if kind[-2:] in ("le", "be") else None
            kind = "number"
        when = None
        if self.take("if"):
            when = self.expression()
            if "__rem" in names_in(when):
                raise self.fail("__rem cannot decide a field", "NFDL0101")
        return Field(name, kind, size, when, little)

    def match(self) -> Match:
        self.need("match")
        value, cases, default = self.expression(), [], None
        self.need("{")
        while not self.take("}"):
            if self.take("default"):
                self.need("=>")
                default = self.body()
            else:
                self.need("case")
                case = self.expression()
                self.need("=>")
                cases.append((case, self.body()))
        return Match(value, tuple(cases), default)

    def loop(self) -> Loop:
        self.need("loop")
        name, carries, body, nexts = self.word(), [], [], []
        while self.take("carry"):
            own = self.word()
            if self.take(":"):
                self.word()
            self.need("=")
            carries.append((own, self.expression()))
        self.need("while")
        condition = self.expression()
        if "__rem" in names_in(condition):
            raise self.fail("__rem cannot decide a loop", "NFDL0101")
        self.need("{")
        while not self.take("}"):
            if self.take("next"):
                own = self.word()
                self.need("=")
                nexts.append((own, self.expression()))
                self.need(";")
            else:
                body.append(self.statement())
        return Loop(name, tuple(carries), condition, tuple(body), tuple(nexts))

    def machine(self) -> Machine:
        name, states = self.word(), {}
        self.need("{")
        self.need("key")
        self.need("=")
        key = self.key()
        self.need(";")
        while not self.take("}"):
            self.need("state")
            state, moves = self.word(), []
            self.need("{")
            while not self.take("}"):
                moves.append(self.transition())
            states[state] = tuple(moves)
        if not states:
            raise self.fail("a machine has a state")
        return Machine(name, key, states)

    def key(self) -> tuple:
        if self.take("("):
            parts = self.listed(self.key, ")")
            return ("tuple", tuple(parts))
        if self.has("bidir", "bidir_tuple"):
            kind = self.word()
            self.need("(")
            return (kind, tuple(self.listed(self.key, ")")))
        return self.expression()

    def transition(self) -> Transition:
        self.need("on")
        message = self.word()
        guard = self.expression() if self.take("guard") else None
        self.need("->")
        to, actions = self.word(), []
        self.need("{")
        while not self.take("}"):
            verb = self.word()
            if verb == "emit":
                actions.append(("emit", self.word()))
            elif verb == "set":
                name = self.word()
                self.need("=")
                actions.append(("set", name, self.expression()))
            elif verb in ("start_timer", "cancel_timer"):
                self.need("(")
                name = self.word()
                if verb == "start_timer":
                    self.need(",")
                    actions.append(("start", name, self.expression()))
                else:
                    actions.append(("cancel", name))
                self.need(")")
            else:
                raise self.fail(f"no action {verb}")
            self.need(";")
        self.take(";")
        return Transition(message, guard, to, tuple(actions))


def parse(source: str) -> list[Protocol]:
    return _Reader(source).module()


def check(protocol: Protocol) -> list[tuple[str, str]]:
    """Unknown messages and names, lengths that may be negative or have no bound."""
    found = []
    for name, body in protocol.messages.items():
        known, floors = {"__current_offset", "__count", "__rem", "__root_buffer", "__root_offset"}, {}

        def visit(body, known, floors):
            for s in body:
                if isinstance(s, Field):
                    if s.kind not in ("number", "bits", "bytes", "rest") and s.kind not in protocol.messages:
                        found.append(("NFDL0102", f"{name}: no message {s.kind}"))
                    if s.kind == "bytes":
                        if least(s.size, floors) < 0:
                            found.append(("NFDV01", f"{name}.{s.name}: the length may be negative"))
                        if calls_in(s.size):
                            found.append(("NFDV02", f"{name}.{s.name}: the length has no bound"))
                    known.add(s.name)
                elif isinstance(s, Let):
                    known.add(s.name)
                    floors[s.name] = least(s.value, floors)
                elif isinstance(s, Validate):
                    facts(s.value, floors)
                elif isinstance(s, Loop):
                    visit(s.body, known | {c for c, _ in s.carries}, dict(floors))
                elif isinstance(s, Match):
                    for _, b in s.cases:
                        visit(b, set(known), dict(floors))
                    visit(s.default or (), set(known), dict(floors))

        def least(e, floors) -> int:
            if e[0] == "int":
                return e[1]
            if e[0] == "name":
                return floors.get(e[1], 0)
            if e[0] == "-":
                return least(e[1], floors) - e[2][1] if e[2][0] == "int" else -1
            if e[0] in ("+", "*", "/", "%"):
                a, b = least(e[1], floors), least(e[2], floors)
                return {"+": a + b, "*": a * b, "/": 0, "%": 0}[e[0]]
            return 0

        def facts(e, floors) -> None:
            if e[0] == "and":
                facts(e[1], floors)
                facts(e[2], floors)
            elif e[0] in (">", ">=", "==") and e[1][0] == "name" and e[2][0] == "int":
                floors[e[1][1]] = max(floors.get(e[1][1], 0), e[2][1] + (e[0] == ">"))

        visit(body, known, floors)
    return found


def one(source: str) -> Protocol:
    found = parse(source)
    if not found:
        raise LanguageError("NFDL0100", "no protocol")
    return found[0]
