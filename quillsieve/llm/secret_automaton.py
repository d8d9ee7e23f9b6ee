"""Secret scans: one minimal automaton for all rules, run over the bytes of many texts in step."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import blocks, extend, field, text_bytes, with_columns


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then one or more bytes of ``tail``; it counts if the tail part has ``least`` bytes.

    ``head`` may use classes, groups, (?i:...), | ? * + and {m}; ``tail`` is one class.
    """

    name: str
    head: str
    tail: str
    least: int


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN\x20((RSA|EC|DSA|OPENSSH|ENCRYPTED)\x20)?PRIVATE\x20KEY----", "[-]", 1),
    Rule("forge_token", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("chat_token", "xox[abeprs]-", "[A-Za-z0-9-]", 10),
    Rule("live_key", "[rs]k_live_", "[A-Za-z0-9]", 16),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
)
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Thompson construction over byte sets for the syntax that ``Rule`` allows."""

    def __init__(self):
        self.epsilon: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def node(self) -> int:
        self.epsilon.append([])
        self.moves.append([])
        return len(self.moves) - 1

    def reversed(self) -> _Parser:
        """The same nodes with every way turned round."""
        out = _Parser()
        for _ in self.moves:
            out.node()
        for x, ways in enumerate(self.epsilon):
            for y in ways:
                out.epsilon[y].append(x)
        for x, ways in enumerate(self.moves):
            for wanted, y in ways:
                out.moves[y].append((wanted, x))
        return out

    def build(self, pattern: str, start: int) -> int:
        self.text, self.at, self.fold = pattern, 0, False
        end = self.alternatives(start)
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")
        return end

    def alternatives(self, start: int) -> int:
        end = self.node()
        while True:
            self.epsilon[self.sequence(start)].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return end
            self.at += 1

    def sequence(self, now: int) -> int:
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin, fold = self.at, self.fold
            now = self.repeated(now, begin, fold)
        return now

    def repeated(self, now: int, begin: int, fold: bool) -> int:
        def once(from_: int) -> int:
            self.at, self.fold = begin, fold
            return self.atom(from_)

        inner = self.node()
        self.epsilon[now].append(inner)
        end = once(inner)
        sign = self.text[self.at : self.at + 1]
        stop = self.at + 1
        out = self.node()
        if sign in ("?", "*", "+") and sign:
            self.epsilon[end].append(out)
            if sign in "*+":
                self.epsilon[end].append(inner)
            if sign in "?*":
                self.epsilon[inner].append(out)
        elif sign == "{":
            stop = self.text.index("}", self.at) + 1
            for _ in range(int(self.text[self.at + 1 : stop - 1]) - 1):
                end = once(end)
            self.epsilon[end].append(out)
        else:
            return end
        self.at, self.fold = stop, fold
        return out

    def atom(self, now: int) -> int:
        if self.text[self.at] == "(":
            self.at += 1
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            end = self.alternatives(now)
            self.at += 1
            return end
        end = self.node()
        self.moves[now].append((self.bytes_at(), end))
        return end

    def byte(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def bytes_at(self) -> frozenset:
        if self.text[self.at] != "[":
            got = {self.byte()}
        else:
            self.at += 1
            got = set()
            while self.text[self.at] != "]":
                low = high = self.byte()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.byte()
                got |= set(range(low, high + 1))
            self.at += 1
        if self.fold:
            got |= {b ^ 32 for b in got if 65 <= b & ~32 <= 90}
        return frozenset(got)


class Automaton:
    """Minimal DFA as arrays: ``code`` maps bytes to classes, ``step`` has next states, ``accept`` rule bits.

    States in ``step`` are multiplied by the number of classes. State 0 is the start; in an unanchored
    automaton it is also what a byte that no rule knows leads to. A ``backward`` automaton reads texts
    from their end: it is unanchored and accepts where a match begins.
    """

    def __init__(self, rules: tuple[Rule, ...], backward: bool = False, heads_only: bool = False):
        nfa = _Parser()
        anchored = not backward
        start = nfa.node()
        finals, begins, runs = {}, {}, {}
        for k, rule in enumerate(rules):
            begin = at = nfa.node()
            nfa.epsilon[start].append(at)
            at = nfa.build(rule.head, at)
            if not heads_only:
                scan = _Parser()
                scan.text, scan.at, scan.fold = rule.tail, 0, False
                wanted = scan.bytes_at()
                # Backward, a rule without a head begins where its whole tail follows; others where one byte of it does.
                least = rule.least if backward and not rule.head else 1
                for n in range(least):
                    to = nfa.node()
                    nfa.moves[at].append((wanted, to))
                    runs[to] = (k, least - 1 - n)
                    at = to
                if not backward:
                    nfa.moves[at].append((wanted, at))
                elif not rule.head:
                    nfa.moves[begin].append((wanted, begin))
                    runs[begin] = (k, least)
            finals[at] = 1 << k
            begins[begin] = 1 << k
        first = {start}
        if backward:
            nfa, first, finals = nfa.reversed(), set(finals), begins
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        classes = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.code = np.array([classes[s] for s in signature], np.uint8)
        members = defaultdict(list)
        for b in range(256):
            members[classes[signature[b]]].append(b)
        self.classes = len(classes)

        def closure(nodes) -> frozenset:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for x in nfa.epsilon[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if not backward:
                return frozenset(seen)
            # Of one rule's tail the longest run says all: it accepts first and ends with the others.
            longest: dict[int, int] = {}
            for x in seen:
                if x in runs:
                    k, n = runs[x]
                    longest[k] = max(longest.get(k, -1), n)
            return frozenset(x for x in seen if x not in runs or runs[x][1] == longest[runs[x][0]])

        start_set = closure(first)
        states, todo, step = {start_set: 0}, [start_set], []
        for now in todo:
            row = []
            for c in range(self.classes):
                b = members[c][0]
                to = {t for x in now for s, t in nfa.moves[x] if b in s} | (set() if anchored else first)
                to = closure(to)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to])
            step.append(row)
        step = np.array(step)
        accept = np.array([sum({finals.get(x, 0) for x in s}) for s in todo], np.int64)
        # Moore's partition refinement: states stay together while their classes' successors do.
        part = np.unique(accept, return_inverse=True)[1]
        while True:
            again = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
            if again.max() == part.max():
                break
            part = again
        order = np.full(part.max() + 1, len(part))
        np.minimum.at(order, part, np.arange(len(part)))
        rank = np.argsort(np.argsort(order))
        keep = np.sort(order)
        self.step = (rank[part[step[keep]]] * self.classes).astype(np.int32).ravel()
        self.accept = accept[keep]
        self.states = len(keep)
        alive = np.zeros(self.states, bool)
        alive[self.accept > 0] = True
        table = self.step.reshape(self.states, -1) // self.classes
        while (more := alive | alive[table].any(1)).sum() > alive.sum():
            alive = more
        self.dead = ~alive
        #: bytes after which the automaton is at its start, whatever came before
        self.resets = (table == 0).all(0)[self.code] if not anchored else np.zeros(256, bool)

    def plain(self) -> tuple[list, list, list, list]:
        """step, code, and by state whether it accepts and is dead, as lists for stepping one byte at a time."""
        if not hasattr(self, "_plain"):
            self._plain = (self.step.tolist(), self.code.tolist(), np.repeat(self.accept > 0, self.classes).tolist(), np.repeat(self.dead, self.classes).tolist())
        return self._plain


class Scanner:
    """All rules compiled: the combined automaton for the byte pass, and small ones that say where a match ends."""

    LANE = 512
    #: Lanes that numpy steps together at least; fewer are stepped one by one.
    FEW = 16

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton(rules, backward=True)
        self.exact = [Automaton((r,)) for r in rules]
        self.heads = [Automaton((r,), heads_only=True) for r in rules]
        if not self.all.resets.any():
            raise ValueError("the rules know every byte; none can part texts")
        self.parting = int(np.flatnonzero(self.all.resets)[0])

    def begins(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions at which matches begin, and the bits of their rules: one pass over the bytes, from the end.

        The pass is cut into lanes at bytes that reset the automaton, and the lanes are stepped together.
        """
        a = self.all
        data = np.ascontiguousarray(data[::-1])
        resets = np.flatnonzero(a.resets[data])
        goals = np.arange(self.LANE, len(data), self.LANE)
        near = np.searchsorted(resets, goals)
        cut = np.unique(np.concatenate([[0], resets[near[near < len(resets)]] + 1, [len(data)]]))
        begin, size = cut[:-1], np.diff(cut)
        order = np.argsort(-size, kind="stable")
        at, size = begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        together = int(np.searchsorted(-active, -self.FEW, side="right"))
        state = np.zeros(len(at), np.int32)
        code = a.code[data]
        accepts = np.repeat(a.accept, a.classes)
        found, bits = [], []
        end = (at + size).tolist()
        for n in active[:together].tolist():
            at, state = at[:n], state[:n]
            state = a.step[state + code[at]]
            good = accepts[state]
            if good.any():
                hit = np.flatnonzero(good)
                found.append(at[hit])
                bits.append(good[hit])
            at = at + 1
        step, marks = a.plain()[0], accepts.tolist()
        for lane in range(int(active[together]) if together < len(active) else 0):
            now, places, hits = int(state[lane]), [], []
            for k, c in enumerate(code[int(at[lane]) : end[lane]].tolist(), int(at[lane])):
                now = step[now + c]
                if marks[now]:
                    places.append(k)
                    hits.append(marks[now])
            found.append(np.array(places, np.int64))
            bits.append(np.array(hits, np.int64))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = len(data) - 1 - np.concatenate(found), np.concatenate(bits)
        order = np.argsort(where)
        return where[order], what[order]

    @staticmethod
    def _walk(a: Automaton, raw: bytes, at: int, stop: int) -> int:
        """End of the longest match at ``at`` that ends by ``stop``, -1 for none."""
        step, code, accept, dead = a.plain()
        state, best = 0, at if accept[0] else -1
        for k in range(at, stop):
            state = step[state + code[raw[k]]]
            if dead[state]:
                break
            if accept[state]:
                best = k + 1
        return best

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Of each row the (start, rule, end) spans in code points, by start and then rule.

        A walk starts only where a match is known to begin and the next one after its end, so the work
        stays in proportion to the text.
        """
        rows = len(bounds) - 1
        out: list[list] = [[] for _ in range(rows)]
        if not len(data):
            return out
        parted = np.insert(data, bounds[1:], self.parting)
        where, bits = self.begins(parted)
        if not len(where):
            return out
        raw = parted.tobytes()
        spans = []
        for k, rule in enumerate(self.rules):
            mine = where[bits >> k & 1 == 1]
            i = 0
            while i < len(mine):
                at = int(mine[i])
                end = self._walk(self.exact[k], raw, at, len(raw))
                head = self._walk(self.heads[k], raw, at, end - 1)
                if end - max(head, at) >= rule.least:
                    spans.append((at, k, end))
                i = int(np.searchsorted(mine, end))
        first = bounds[:-1] + np.arange(rows)
        points = np.concatenate([[0], np.cumsum((parted & 0xC0) != 0x80)])
        for at, k, end in sorted(spans):
            r = int(np.searchsorted(first, at, side="right")) - 1
            before = points[first[r]]
            out[r].append((int(points[at] - before), k, int(points[end] - before)))
        return out


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """Adds the spans of all rules (code points, end exclusive; by start, then in the order of the rules).

    Per rule the matches are leftmost, longest and do not overlap; those with a short tail are dropped
    after they took their text. Null and empty texts have no spans; every row is scanned whole and by
    itself, repeated rows too; an empty table gives an empty one; other columns are carried, and a column named as ``out`` is replaced.
    """
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, text_col])))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    scanner = compiled(rules)

    def run(batches):
        for batch in blocks(batches, text_col):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            found = [[{"kind": rules[k].name, "start": s, "end": e} for s, k, e in spans] for spans in scanner.scan(data, bounds)]
            yield with_columns(batch, keep, {out: pa.array(found, kind)})

    return source.mapInArrow(run, extend(source, keep, [field(out, SPANS)]))


def span_text(spans: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every found span replaced by ``mark``; of overlapping spans the union is replaced."""
    columns = df.columns
    found = find_secrets(df, rules, text_col, columns, "__spans")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    joined = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["text"], F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("text"),
                s["end"].alias("at"),
            )
        ),
    )
    rest = F.substring(F.col(text_col), (joined["at"] + 1).cast("int"), F.length(text_col))
    done = F.when(F.size("__spans") == 0, F.col(text_col)).otherwise(F.concat(joined["text"], rest))
    return found.withColumn(text_col, done).select(columns)
