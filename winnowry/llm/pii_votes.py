"""Personal data by weak supervision.

Patterns find candidate spans. Five labelers (pattern check, gazetteer, edges, trap words, plausibility) vote
for or against each one or abstain. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is for each kind, and gives every vote pattern a soft label; a logistic classifier over
the candidate's features is trained on these. Spans that pass the pattern check are always kept; a candidate
that only a looser pattern found is added if the classifier accepts it.

Built-in functions only: candidates are stored once, only counts of vote and feature patterns (at most
3 ** 5 votes times 2 ** 5 shapes for each kind) reach the driver, and the trained numbers go back as literals.
A null or empty text has no candidates, empty tables train nothing and give no rows, repeated rows are rated
alike, other columns are left alone.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import matches, rows_of_kind, span_text, whole

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's patterns: equal matches, and no retries in long runs.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# Numbers without a country code: the loose pattern that the votes decide about.
LOOSE_PHONE = "(?<![+0-9(])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])"
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "de", "fr", "es", "io"),
    "ip": ("ip", "host", "server", "address", "from", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "contact", "whatsapp"),
}
TRAP_WORDS = ("version", "id", "isbn", "issn", "order", "sku", "build", "no", "nr", "invoice", "serial")
LABELERS = ("check", "gazetteer", "edges", "trap", "plausible")
CONTEXT = 24
ROUNDS, STEPS, RATE, ACCEPT = 25, 300, 0.5, 0.9
CANDIDATE = (
    "array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,votes:array<int>,shape:array<int>>>"
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes_check(kind: str, s: Column) -> Column:
    """The contract's check of a match."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(s, "\\."), lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        n = F.length(_digits(s))
        return n.between(12, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _sign(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstains."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0).cast("int")


def _rated(kind: str, text: Column, m: Column, loose: bool) -> Column:
    found, start, end = m["found"], m["start"], m["end"]
    size = F.least(start, F.lit(CONTEXT))
    left = F.lower(F.substr(text, (start - size + 1).cast("int"), size.cast("int")))
    right = F.substr(text, (end + 1).cast("int"), F.lit(2))
    words = F.split(F.regexp_replace(left, "[^\\p{L}]+", " "), " ")
    near = F.array(*[F.lit(w) for w in GAZETTEER[kind]])
    traps = F.array(*[F.lit(w) for w in TRAP_WORDS])
    listed = (
        F.substring_index(F.lower(found), ".", -1).isin(list(GAZETTEER[kind])) if kind == "email"
        else F.arrays_overlap(words, near)
    )
    digits = _digits(found)
    plausible = {
        "email": ~found.rlike("^[.]|\\.\\.|\\.@|@-"),
        "ip": ~found.rlike("^0|\\.0[0-9]"),
        "card": found.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": ~digits.rlike("^(.)\\1*$"),
    }[kind]
    ok = F.lit(False) if loose else passes_check(kind, found)
    edges = (left == "") | left.rlike("[^\\p{L}0-9]$")
    edges = edges & ~right.rlike("^[\\p{L}0-9_@]|^[.-][0-9]")
    votes = F.array(
        F.lit(0).cast("int") if loose else _sign(ok),
        _sign(listed, F.lit(False)),
        _sign(edges),
        _sign(F.lit(False), F.arrays_overlap(words, traps)),
        _sign(plausible),
    )
    flag = lambda c: F.when(c, 1).otherwise(0)
    shape = F.array(
        F.lit(int(loose)), flag(found.rlike("[\\x20]")), flag(found.rlike("[()]")), flag(F.length(found) >= 16),
        flag(right.rlike("^[,;:!?)]|^\\.(?![0-9])|^$")),
    )
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
        ok.alias("base"), votes.alias("votes"), shape.alias("shape"),
    )


def candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``_candidates`` in place of the text."""
    t = F.col("_whole")

    def rated(kind, pattern, loose=False):
        return F.transform(matches(t, pattern), lambda m: _rated(kind, t, m, loose)).cast(CANDIDATE)

    found = [rated(k, PATTERNS[k]) for k in KINDS]
    loose = rated("phone", LOOSE_PHONE, True)
    df = documents.withColumn("_whole", whole(F.col(text))).withColumn("_strict", F.concat(*found))
    apart = F.filter(
        loose, lambda x: ~F.exists("_strict", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    )
    return df.withColumn("_candidates", F.concat("_strict", apart)).drop("_strict", "_whole", text)


def pattern_counts(rated: DataFrame) -> list:
    """(kind, votes, shape, n): the counts that training sees, a bounded number of them."""
    rows = rated.select(F.explode("_candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    return [(r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in rows]


def estimate(counts: list) -> tuple[dict, dict]:
    """Expectation-maximisation. Returns soft labels by (kind, votes) and vote rates by (kind, labeler).

    Starts from labelers that are right four times in five, which fixes the meaning of the two classes.
    """
    soft, rates = {}, {}
    for kind in KINDS:
        seen = {}
        for k, votes, _, n in counts:
            if k == kind:
                seen[votes] = seen.get(votes, 0) + n
        if not seen:
            continue
        prior = 0.5
        like = [{1: (0.8, 0.2), -1: (0.2, 0.8), 0: (0.5, 0.5)} for _ in LABELERS]
        for _ in range(ROUNDS):
            post = {}
            for votes in seen:
                yes, no = math.log(prior), math.log(1 - prior)
                for labeler, vote in enumerate(votes):
                    yes, no = yes + math.log(like[labeler][vote][0]), no + math.log(like[labeler][vote][1])
                post[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
            total = sum(seen.values())
            good = sum(n * post[v] for v, n in seen.items())
            prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
            for labeler in range(len(LABELERS)):
                for vote in (1, -1, 0):
                    # Pseudo-counts keep the starting belief where there is little to learn from.
                    own = 0.8 if vote == 1 else 0.2 if vote == -1 else 0.5
                    up = sum(n * post[v] for v, n in seen.items() if v[labeler] == vote)
                    down = sum(n * (1 - post[v]) for v, n in seen.items() if v[labeler] == vote)
                    like[labeler][vote] = ((up + 10 * own) / (good + 15), (down + 10 * (1 - own)) / (total - good + 15))
        soft.update({(kind, v): p for v, p in post.items()})
        rates.update({(kind, name): like[i] for i, name in enumerate(LABELERS)})
    return soft, rates


def train(counts: list, soft: dict) -> dict:
    """Logistic weights for each kind: a constant, the votes, the shape."""
    weights = {}
    for kind in KINDS:
        rows = [((1, *v, *s), soft[kind, v], n) for k, v, s, n in counts if k == kind]
        total = sum(n for _, _, n in rows)
        w = [0.0] * (1 + len(LABELERS) + 5)
        for _ in range(STEPS if rows else 0):
            slope = [0.001 * x for x in w]
            for x, target, n in rows:
                z = max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))
                off = (1 / (1 + math.exp(-z)) - target) * n / total
                slope = [g + off * b for g, b in zip(slope, x, strict=True)]
            w = [a - RATE * g for a, g in zip(w, slope, strict=True)]
        weights[kind] = w
    return weights


def classify(rated: DataFrame, weights: dict) -> DataFrame:
    """``spans``: all that passed the check, and others that the classifier accepts."""

    def chance(c):
        score = F.lit(0.0)
        for kind, w in weights.items():
            own = F.lit(float(w[0]))
            for i in range(len(LABELERS)):
                own = own + F.lit(float(w[1 + i])) * c["votes"][i]
            for i in range(5):
                own = own + F.lit(float(w[1 + len(LABELERS) + i])) * c["shape"][i]
            score = F.when(c["kind"] == kind, own).otherwise(score)
        return 1 / (1 + F.exp(-score))

    # A candidate that failed its check is never added; the votes decide about loose ones.
    kept = F.filter("_candidates", lambda c: c["base"] | ((c["shape"][0] == 1) & (chance(c) >= ACCEPT) & (c["votes"][1] == 1)))
    return rated.withColumn("spans", F.array_sort(kept)).drop("_candidates")


def digest(found: DataFrame, key: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        key,
        *[rows_of_kind(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op2_pii_votes(documents: DataFrame) -> DataFrame:
    rated = materialize(candidates(documents.select("doc_id", "text")), "pii-candidates")
    counts = pattern_counts(rated)
    soft, _ = estimate(counts)
    return digest(classify(rated, train(counts, soft)), "doc_id")
