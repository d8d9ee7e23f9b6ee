"""Literals that every match of a regex holds: a cheap test in front of the regex."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least length of a literal worth testing, a shorter one only where nothing better is there; and most literals of a choice.
LEAST, MOST = 2, 24


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Literals of which every match holds one, and whether case counts; none: the pattern has no such literals."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    folded = bool(flags) and "i" in flags[1]
    try:
        whole, best = _Walk(pattern[flags.end() if flags else 0 :]).alternatives()
    except (ValueError, IndexError):
        # syntax that the walk does not read: no gate
        return (), True
    found = _better([x for x in (whole, best) if x])
    words = {w.lower() if folded else w for w in found}
    return tuple(sorted(w for w in words if not any(x in w for x in words - {w}))), not folded


def lowered(text: Column) -> Column:
    """A text as case-blind gates look at it: in lower case, U+017F as the s that it folds to."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def _better(choices: list[set[str]]) -> set[str]:
    """The choice of literals whose shortest is longest, of fewer literals on ties."""
    good = [x for x in choices if min(map(len, x)) >= LEAST]
    return max(good, key=lambda x: (min(map(len, x)), -len(x)), default=set())


class _Walk:
    """Reads a regex; each part is (all its texts, or None if they are many; literals of which each match holds one)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def here(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def alternatives(self) -> tuple[set[str] | None, set[str]]:
        branches = [self.sequence()]
        while self.here() == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        whole = set().union(*[w for w, _ in branches]) if all(w is not None for w, _ in branches) else None
        each = [_better([x for x in (w, b) if x]) for w, b in branches]
        best = set().union(*each) if all(each) and sum(map(len, each)) <= MOST else set()
        return (whole if whole is not None and len(whole) <= MOST else None), best

    def sequence(self) -> tuple[set[str] | None, set[str]]:
        run, exact, choices = {""}, True, []
        while self.at < len(self.text) and self.here() not in "|)":
            texts, best = self.repeated()
            if texts is not None and len(run) * len(texts) <= MOST:
                run = {a + b for a in run for b in texts}
                continue
            exact = False
            choices.append(run)
            run = {""} if texts is None or len(texts) > MOST else texts
            if best:
                choices.append(best)
        choices.append(run)
        return (run, set()) if exact else (None, _better(choices))

    def repeated(self) -> tuple[set[str] | None, set[str]]:
        texts, best = self.atom()
        sign = self.here()
        if sign not in ("?", "*", "+", "{"):
            return texts, best
        least, most = {"?": (0, 1), "*": (0, 0), "+": (1, 0)}.get(sign, (0, 0))
        self.at += 1
        if sign == "{":
            end = self.text.index("}", self.at)
            least = int(self.text[self.at : end].split(",")[0])
            self.at = end + 1
        if self.here() == "?":
            self.at += 1
        if sign == "?" and texts is not None and len(texts) == 1:
            return texts | {""}, set()
        if least == 0 and most == 0 or sign == "?":
            return None, set()
        return None, _better([x for x in (texts, best) if x])

    def atom(self) -> tuple[set[str] | None, set[str]]:
        c = self.here()
        self.at += 1
        if c == "(":
            if named := re.compile(r"\?(?:P?<[A-Za-z]\w*>|:)").match(self.text, self.at):
                self.at = named.end()
            elif self.here() == "?":
                raise ValueError(f"group of {self.text!r} at {self.at}")
            out = self.alternatives()
            self.at += 1
            return out
        if c == "[":
            return self.members(), set()
        if c in "^$":
            return {""}, set()
        if c == ".":
            return None, set()
        if c == "\\":
            c = self.here()
            self.at += 1
            if c in "bBAzZ":
                return {""}, set()
            if c.isalnum():
                return ({{"n": "\n", "t": "\t", "r": "\r"}[c]} if c in "ntr" else None), set()
        return {c}, set()

    def members(self) -> set[str] | None:
        """The characters of a class, None for many or a negated one."""
        many = self.here() == "^"
        out: set[str] = set()
        first = self.at
        while self.here() != "]" or self.at == first:
            c = self.here()
            self.at += 1
            if c == "\\":
                c = self.here()
                self.at += 1
                many |= c.isalnum()
            if self.here() == "-" and self.here(2) != "-]":
                many = True
                self.at += 1
                if self.here() == "\\":
                    self.at += 1
                self.at += 1
            out.add(c)
        self.at += 1
        return None if many or len(out) > 4 else out


PATTERN = "struct<rank:int,id:string,severity:string,description:string,regex:string,exact:boolean,words:array<string>>"


def pattern_table(patterns, java) -> Column:
    """The patterns (id, severity, description, regex) with their gates, as one constant array."""
    rows = []
    for rank, (pid, severity, description, regex) in enumerate(patterns):
        words, exact = required(regex)
        rows.append({"rank": rank, "id": pid, "severity": severity, "description": description, "regex": java(regex), "exact": exact, "words": list(words)})
    return F.from_json(F.lit(json.dumps(rows)), f"array<{PATTERN}>")


def may_match(pattern: Column, text: Column, low: Column) -> Column:
    """Whether a text can hold a match of a row of ``pattern_table`` at all; ``low`` is the text as ``lowered``."""
    within = F.when(pattern["exact"], text).otherwise(low)
    return (F.size(pattern["words"]) == 0) | F.exists(pattern["words"], lambda w: F.contains(within, w))
