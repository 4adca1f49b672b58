"""Secrets and personal data against plain regular expressions."""

import hashlib
import re

from pyspark.sql import functions as F

from winnowry.llm import pii_votes, secret_ledger as sl

SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
)


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)


def joined(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def secrets(text):
    return joined((m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, text) if len(m.group(g)) >= n)


def personal(text):
    return joined((m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(PII) for m in re.finditer(p, text) if ok(m.group()))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(rows, texts, plain):
    assert rows
    for r in rows:
        assert r["base_sha256"] == sha(plain(texts[r["doc_id"]])), r


def test_on_documents(docs, texts):
    check(sl.op1_secret_ledger(docs).collect(), texts, secrets)
    check(pii_votes.op2_pii_votes(docs).collect(), texts, personal)


def test_odd_rows(odd):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for op, plain in ((sl.op1_secret_ledger, secrets), (pii_votes.op2_pii_votes, personal)):
        rows = op(odd).collect()
        assert len(rows) == odd.count()
        check(rows, texts, plain)
        assert op(odd.limit(0)).count() == 0


def test_awkward_texts(spark):
    rows = ["a@b.c_d@e.f x@y.z", "1" * 5000, "1-" * 5000 + "1", "a@" + "b." * 4000 + "c", "token=token:abcdef1 secret: 'x' API_KEY=abcdef",
            "007.0255.1.1 1.2.3.4.5.6.7.8", "call 555-867-5309 or tel (555) 867-5309.", "😀 me@x.org 😀 10.1.1.1"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    check(sl.op1_secret_ledger(df).collect(), dict(enumerate(rows)), secrets)
    check(pii_votes.op2_pii_votes(df).collect(), dict(enumerate(rows)), personal)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    """A second run scans new blobs only, a new rule version only its own pairs; findings reach all paths."""
    store = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", "none")], "path string, text string")
    sl.update(first, store, "path")
    assert sl.read_ledger(spark, store).count() == 2
    second = spark.createDataFrame([("d", "token=abcdef"), ("e", "AKIA" + "A" * 16)], "path string, text string")
    named = sl.update(second, store, "path")
    assert sl.read_ledger(spark, store).count() == 3
    found = {r["path"]: len(r["spans"]) for r in sl.findings_by_path(named, sl.read_ledger(spark, store)).collect()}
    assert found == {"d": 1, "e": 1}
    newer = (*sl.RULES, sl.Rule("zip", 2, "[0-9]{5}"))
    todo = sl.unseen(sl.blobs(first), sl.read_ledger(spark, store), "path", newer).collect()
    assert {tuple(r["todo"]) for r in todo} == {("zip@2",)}


def test_votes_learn_which_labelers_to_trust(docs):
    rated = pii_votes.candidates(docs.select("doc_id", "text"))
    counts = pii_votes.pattern_counts(rated)
    soft, rates = pii_votes.estimate(counts)
    assert all(0 <= p <= 1 for p in soft.values())
    assert all(rates[k, "check"][1][0] > rates[k, "check"][1][1] for k in {c[0] for c in counts})
    assert rated.filter(F.size("_candidates") > 0).count() > 0
