"""PII spans by weak supervision, with DataFrame functions only on the rows.

Candidates come from regexes. Regex, gazetteer and context labelers vote on them, expectation
maximisation over the counts of vote patterns estimates how far each labeler can be trusted, and a
logistic span classifier is trained on the resulting probabilities. Only those counts - one row for
each kind and pattern of five votes, whatever the corpus - reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.text import cut_out, let, pieces_of, running
from quillsieve.llm.common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "tel", "ssn")
#: Java patterns, possessive where that changes nothing, so that long runs need neither stack nor repeats.
#: A match can only begin at the head of a run or where the last match ended: (?:\G|(?<!...)).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold before its pattern is tried; each is part of any match that could be a candidate.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "tel": lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
# Top-level domains, calling codes and issuer digits of the gazetteer, hint words of the context.
DOMAINS = "com org net edu gov mil int info biz io co eu de fr es it uk us ch at be nl pt pl se no dk fi ie ca au br mx jp cn in ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
HINTS = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|payment|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|m[oó]vil)\b",
    "tel": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|m[oó]vil)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}
COUNTER_HINTS = r"(?i)\b(?:version|release|v|isbn|order|invoice|section|build|article|part)\W*$"
LABELERS = ("form", "gazetteer", "context", "counter", "isolated")
#: Code points before a match that the labelers of its surroundings see.
CONTEXT = 40
#: Pseudo-counts that a labeler starts with: votes that are right, none, and votes that are wrong. A form with a check sum
#: or fixed parts says far more than a list of first digits; words around and place mostly say nothing.
TRUST = {"form": (18.0, 2.0, 1.0), "gazetteer": (6.0, 4.0, 3.0), "context": (6.0, 8.0, 1.0), "counter": (6.0, 8.0, 1.0), "isolated": (6.0, 8.0, 1.0)}
CANDIDATE = "struct<kind:string,start:long,end:long,base:boolean,votes:array<int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of ASCII digits holds."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def octets(m: Column) -> Column:
    """Whether every dotted part is at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("000")).cast("int"), F.lit(0)) <= 255))


def is_base(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(m)
    size = F.length(_digits(m))
    if kind == "card":
        return size.between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(False)


def is_candidate(kind: str, m: Column) -> Column:
    size = F.length(_digits(m))
    return {"card": size.between(12, 19), "phone": size.between(7, 15)}.get(kind, F.lit(True))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)


def votes(kind: str, m: Column, near: Column) -> Column:
    """Votes (1: personal data, -1: not, 0: none) of the labelers on a match and the text just before it."""
    digits = _digits(m)
    if kind == "email":
        form, known = m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$"), F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
    elif kind == "ip":
        form, known = octets(m), ~m.rlike(r"^(?:0|127|255)\.|\.0+\.0+\.0+$")
    elif kind == "card":
        form, known = luhn(digits), digits.rlike(ISSUERS)
    elif kind == "ssn":
        form, known = ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit(None).cast("boolean")
    else:
        form = F.length(digits).between(9, 15)
        known = F.regexp_extract(m, r"^\+([0-9]{1,2})", 1).isin(CALLING) | F.regexp_extract(m, r"^\+([0-9])", 1).isin(CALLING) if kind == "phone" else digits.rlike("^[2-9]")
    return F.array(
        _vote(form),
        F.coalesce(_vote(known), F.lit(0)),
        _vote(near.rlike(HINTS[kind]), F.lit(False)),
        _vote(F.lit(False), near.rlike(COUNTER_HINTS)),
        _vote(F.lit(False), near.rlike(r"[\p{L}0-9_]$")),
    )


def matches_of(text: Column, pattern: str) -> Column:
    """array<struct<before, match>>: every match with the text between it and the one before."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    return F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("before"), F.regexp_extract_all(text, whole, F.lit(2)).alias("match"))


def _placed(kind: str, found: Column) -> Column:
    """The candidates among the matches of a kind, with their code points and votes.

    The text before a match reaches back over earlier matches - no match has under five code points - so
    each of a list of numbers is seen in the list's context.
    """
    size = lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("long")

    def use(all_, at):
        def one(x, i):
            last = F.transform(F.slice(all_, F.greatest(i - 8, F.lit(0)) + 1, F.least(i, F.lit(8)) + 1), lambda y: F.struct(F.right(y["before"], F.lit(CONTEXT)).alias("b"), y["match"].alias("m")))
            # all matches but the last with what stands between them
            known = F.transform(last, lambda y, k: F.when(k == F.size(last) - 1, y["b"]).otherwise(F.concat(y["b"], y["m"])))
            start = F.get(at, i) + F.length(x["before"])
            return F.struct(x["match"].alias("match"), F.right(F.array_join(known, ""), F.lit(CONTEXT)).alias("near"), start.alias("start"))

        return F.filter(F.transform(all_, one), lambda x: is_candidate(kind, x["match"]))

    kept = let(found, lambda all_: let(running(F.transform(all_, size), lambda a, x: a + x, F.lit(0).cast("long")), lambda at: use(all_, at)))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), is_base(kind, x["match"]).alias("base"), votes(kind, x["match"], x["near"]).alias("votes")))


def candidates(text: Column) -> Column:
    """The candidates of a text with their code points, by kind and place; null and empty texts have none."""
    none = F.from_json(F.lit("[]"), f"array<{CANDIDATE}>")
    return F.concat(*[F.when(F.coalesce(GATES[kind](text), F.lit(False)), _placed(kind, matches_of(text, PATTERNS[kind])).cast(f"array<{CANDIDATE}>")).otherwise(none) for kind in KINDS])


@dataclass
class SpanModel:
    """weights by (kind or labeler and vote); reliability by (labeler, vote): shares of true and false spans so voted."""

    weights: dict[tuple, float] = field(default_factory=dict)
    reliability: dict[tuple, tuple[float, float]] = field(default_factory=dict)

    def probability(self, kind: str, cast: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get(x, 0.0) for x in _features(kind, cast))))

    def column(self, candidate: Column) -> Column:
        """The classifier as an expression over a candidate."""
        total = F.lit(self.weights.get(("bias",), 0.0))
        for key, w in sorted(self.weights.items(), key=str):
            if key[0] == "kind":
                total = total + F.when(candidate["kind"] == key[1], F.lit(w)).otherwise(0.0)
            elif key[0] == "vote":
                total = total + F.when(F.get(candidate["votes"], F.lit(LABELERS.index(key[1]))) == key[2], F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _features(kind: str, cast: tuple[int, ...]) -> list[tuple]:
    return [("bias",), ("kind", kind)] + [("vote", name, v) for name, v in zip(LABELERS, cast) if v]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50, prior: float = 0.5) -> tuple[list[float], dict]:
    """Posteriors of the vote patterns and the labelers' reliabilities, by expectation maximisation.

    Labelers are taken as independent given the truth. ``TRUST`` starts each of them, so that few
    candidates do not turn labels round.
    """
    values = (-1, 0, 1)
    # (labeler, truth, vote): pseudo-counts
    pseudo = {(n, t, v): TRUST[n][1 - v * (2 * t - 1)] for n in LABELERS for t in (0, 1) for v in values}
    size = {n: sum(TRUST[n]) for n in LABELERS}
    table = {(n, t, v): pseudo[n, t, v] / size[n] for n in LABELERS for t in (0, 1) for v in values}
    share = prior
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for _kind, cast, _n in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for name, v in zip(LABELERS, cast):
                yes += math.log(table[name, 1, v])
                no += math.log(table[name, 0, v])
            post.append(1 / (1 + math.exp(max(-500.0, min(500.0, no - yes)))))
        mass = {t: sum(n * (p if t else 1 - p) for (_, _, n), p in zip(patterns, post)) for t in (0, 1)}
        share = (mass[1] + 5) / (mass[0] + mass[1] + 10)
        for k, name in enumerate(LABELERS):
            for t in (0, 1):
                for v in values:
                    got = sum(n * (p if t else 1 - p) for (_, cast, n), p in zip(patterns, post) if cast[k] == v)
                    # pseudo-counts weigh as much as a tenth of the candidates, so each labeler keeps its sense
                    scale = max(1.0, 0.1 * mass[t] / size[name])
                    table[name, t, v] = (got + scale * pseudo[name, t, v]) / (mass[t] + scale * size[name])
    return post, {(n, v): (table[n, 1, v], table[n, 0, v]) for n in LABELERS for v in values}


def train(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> SpanModel:
    """A logistic classifier of spans on the posteriors, by gradient descent over the counted patterns."""
    post, reliability = estimate(patterns)
    total = sum(n for _, _, n in patterns) or 1
    weights: dict[tuple, float] = {}
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        model = SpanModel(weights)
        for (kind, cast, n), p in zip(patterns, post):
            error = (model.probability(kind, cast) - p) * n / total
            for x in _features(kind, cast):
                slope[x] = slope.get(x, 0.0) + error
        weights = {x: weights.get(x, 0.0) - rate * (g + decay * weights.get(x, 0.0)) for x, g in slope.items()}
    return SpanModel(weights, reliability)


def fit(found: DataFrame, column: str = "candidates") -> SpanModel:
    """Counts the vote patterns of all candidates and trains on them."""
    counts = found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    # at most one row for each kind and pattern of votes
    return train(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts.collect()))


def chosen_spans(model: SpanModel, column: str = "candidates", threshold: float = 0.9) -> Column:
    """Base spans, and others that the classifier is sure of and that overlap no base span; by start, then kind.

    In the order of starts a span meets a base one before it if the largest end so far lies beyond its
    start, and one after it if the least start still to come lies before its end.
    """
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    likely = F.filter(column, lambda c: c["base"] | (model.column(c) >= threshold))
    ordered = F.array_sort(F.transform(likely, lambda c: F.struct(c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    far = F.lit(1 << 62).cast("long")

    def free(all_):
        before = running(F.transform(all_, lambda c: F.when(c["base"], c["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, F.lit(-1).cast("long"))
        after = F.reverse(running(F.reverse(F.transform(all_, lambda c: F.when(c["base"], c["start"]).otherwise(far))), F.least, far))
        return let(before, lambda ends: let(after, lambda starts: F.filter(all_, lambda c, i: c["base"] | ((F.get(ends, i) <= c["start"]) & (F.get(starts, i) >= c["end"])))))

    # of most texts there is nothing to weigh
    kept = F.when(F.forall(likely, lambda c: c["base"]), ordered).otherwise(let(ordered, free))
    return F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """(id, spans) for every row; spans array<struct<kind, start, end, base>> in code points, end exclusive.

    Base spans follow from their patterns and always stay; other candidates are added when the
    trained classifier gives them ``threshold`` or more. Null and empty texts have no spans. Repeated
    rows stay and each counts in the fit; without candidates nothing is learned or added. Other
    columns are not read.
    """
    held = materialize(df.select(F.col(id_col), candidates(F.col(text_col)).alias("candidates")), "candidates")
    model = fit(held)
    return held.select(id_col, chosen_spans(model, "candidates", threshold).alias("spans"))


def redact_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """The rows with each found span replaced by its kind in brackets; overlapping spans by the first kind.

    Null and empty texts stay as they are, and so do texts without a span, all other columns and
    repeated rows; an empty table gives an empty one.
    """
    columns = df.columns
    # the candidates are worked out once: the fit and the replacement read them from the shared folder
    held = materialize(df.withColumn("__candidates", candidates(F.col(text_col))), "candidates")
    found = held.withColumn("__spans", chosen_spans(fit(held, "__candidates"), "__candidates", threshold))

    def joined(spans, pieces):
        def part(at):
            one = lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(cut_out(pieces, F.get(at, i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
            return F.array_join(F.transform(spans, one), "")

        ends = F.transform(spans, lambda s: s["end"])
        done = let(running(ends, F.greatest, F.lit(0).cast("long")), part)
        return F.concat(done, cut_out(pieces, F.array_max(ends), F.length(text_col).cast("long")))

    whole = let(pieces_of(F.col(text_col)), lambda pieces: let(F.col("__spans"), lambda spans: joined(spans, pieces)))
    return found.withColumn(text_col, F.when(F.coalesce(F.size("__spans"), F.lit(0)) <= 0, F.col(text_col)).otherwise(whole)).select(columns)
