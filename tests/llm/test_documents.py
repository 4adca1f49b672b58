"""Rules, shards, near duplicates, URLs, decontamination, mixing and languages against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry.llm import (
    decision_lists, jaccard_join, language_crf, mixing, positional_index as pi, url_models, vector_packing,
)

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def statistics(text):
    words, lines = spaced(text), [x for x in (text or "").split("\n") if spaced(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, texts, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for r in decision_lists.op3_decision_lists(docs, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    rows = decision_lists.op3_decision_lists(odd, labels.limit(0)).collect()
    assert len(rows) == odd.count() and all(r["kept"] != r["base_failed"] for r in rows)
    assert decision_lists.op3_decision_lists(odd.limit(0), labels).count() == 0


def test_words_before_unicode_line_ends(spark):
    """White space is ASCII only: other line ends are words, at the end of a text too."""
    rows = ["a \u2028", "a \u0085", "x y \u2029", "\u2028 a", "a\u2028 \n", " ", "a b c a b c \u0085 a b c", "a a a a a", "\x1c a \x1f"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for r in decision_lists.op3_decision_lists(df, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(rows[r["doc_id"]])


def test_repeated_windows_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [" ".join(rng.choice(["a", "b", "c", "Aa", "BB"], n)) for n in (0, 1, 2, 3, 4, 9, 40, 300, 700)] + ["AaAa BBBB AaBB BBAa " * 3]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    for r in decision_lists.text_statistics(df).collect():
        assert r["n_repeat_words"] == statistics(rows[r["doc_id"]])[4]


def test_rules_are_learned(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("good"), (F.col("id") % 3 == 0).cast("int").alias("part"),
        *[(F.lit(0.0) if s != "symbol_share" else F.when(F.col("id") % 2 == 0, 0.3).otherwise(0.01)).alias(s) for s in decision_lists.STATS],
    )
    rules = decision_lists.learn(df)
    assert [c.stat for c in rules[0]] == ["symbol_share"]
    hit = df.withColumn("rule", decision_lists.decision(rules))
    assert hit.filter("(rule > 0) <> (good = 0)").count() == 0


def test_shards(docs, odd, texts):
    for df in (docs, odd):
        rows = vector_packing.op4_vector_packing(df).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in vector_packing.op4_vector_packing(docs).collect():
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24
    assert vector_packing.op4_vector_packing(odd.limit(0)).count() == 0


def test_equal_texts_share_a_shard(spark):
    """Groups of copies stay whole where a shard has room for them; the law holds for the query's own shards."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = vector_packing.op4_vector_packing(df).collect()
    load, groups = Counter(), defaultdict(lambda: [set(), 0])
    for r in rows:
        load[r["shard"]] += r["size"]
        group = groups[r["text_crc32"], r["size"]]
        group[0].add(r["shard"])
        group[1] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.002 * max(load.values())
    room = sum(load.values()) / 24
    assert all(len(shards) == 1 for shards, size in groups.values() if size <= room)
    # A group that fills several shards is cut into as many pieces.
    copies = spark.range(480).selectExpr("id as doc_id", "if(id < 300, 'same text of some length', concat('text ', id)) as text")
    found = vector_packing.op4_vector_packing(copies).filter("doc_id < 300").select("shard").distinct().count()
    assert 15 <= found <= 24


def test_packing_balances_all_sizes():
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.lognormal(7, 1, 5000), rng.lognormal(5, 1, 5000), np.ones(5000)], 1)
    shard = vector_packing.pack(sizes, sizes.sum(0)[:, None] / 24 * np.ones(24))
    for k, most in enumerate((1.001, 1.1, 1.1)):
        load = np.bincount(shard, sizes[:, k], 24)
        assert load.max() / load.mean() < most


def test_written_shards(docs, tmp_path):
    counts = vector_packing.write_shards(docs, str(tmp_path / "out"), shards=5)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count() == sum(r["rows"] for r in counts.collect())


def shingles(text):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(texts):
    sets, up = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_near_duplicates(spark, docs, texts, odd):
    want = plain_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_jaccard_join(docs).collect()} == want
    rows = jaccard_join.op5_jaccard_join(odd).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd.count() and got[5] == 4 and got[9] == 7 and got[2] == 2 and got[3] == 3
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert jaccard_join.op5_jaccard_join(odd.limit(0)).count() == 0


def test_group_of_near_copies_and_a_common_passage(spark):
    """Many near copies are one component, and texts that only share a passage stay apart."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = {}
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = word()
        rows[i] = " ".join(w)
    for i in range(60, 100):
        rows[i] = " ".join([word() for _ in range(70)] + passage)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_jaccard_join(df).collect()}
    assert got == plain_components(rows)


def test_jaccard_join_against_brute_force(spark):
    """All documents of the larger table, and a crowd of unconnected texts that share most of a passage."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    passage = [word() for _ in range(86)]
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    for i in range(300):
        rows[10**6 + i] = " ".join(passage + [word() for _ in range(int(rng.integers(8, 16)))])
    both = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_jaccard_join(both).collect()}
    assert got == plain_components(rows)


def test_blocks_of_common_columns(spark, monkeypatch):
    """The same with few counters, so that every column is common, and blocks of a handful of rows."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(400)]
    rows = {}
    for g in range(12):
        base = list(rng.choice(words, 40))
        for k in range(12):
            w = list(base)
            for at in rng.integers(0, 40, int(rng.integers(0, 3))):
                w[at] = str(rng.choice(words))
            rows[100 * g + k] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "LEAST_COUNTERS", 1)
    monkeypatch.setattr(jaccard_join, "TEXT_A_COUNTER", 1 << 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_jaccard_join(df).collect()}
    assert got == plain_components(rows)


def test_column_counts_stay_small_on_the_driver(spark, docs, monkeypatch):
    """The counts are read as they come, not as a double for each; their levels are those of plain counting."""
    import tracemalloc

    from winnowry.llm.shingles import distinct_shingles

    monkeypatch.setattr(jaccard_join, "LEAST_COUNTERS", 1 << 20)
    jaccard_join.column_levels(docs, "text")
    tracemalloc.start()
    levels, common = jaccard_join.column_levels(docs, "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.zeros(1 << 20)
    for s in distinct_shingles((r["text"] or "").encode() for r in docs.select("text").collect()):
        np.add.at(counts, (s & np.uint64((1 << 20) - 1)).astype(np.int64), 1)
    usual = max(1.0, counts.mean()) + 3 * max(1.0, counts.mean()) ** 0.5
    assert (levels == np.clip(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0, 60)).all() and common > 0
    assert peak < 8 << 20


def test_pairs_come_once_for_a_run_of_shared_columns(spark, monkeypatch):
    """Texts that share passages of many common columns: what leaves the blocks does not grow with the length of a passage."""
    from pyspark.sql import GroupedData

    rng = np.random.default_rng(17)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    passages = [[word() for _ in range(150)] for _ in range(3)]
    rows = {}
    for i in range(24):
        own = [word() for _ in range(int(rng.integers(60, 90)))]
        rows[i] = " ".join(own + [w for k, p in enumerate(passages) if (i >> k) & 1 for w in p])
    rows[24] = rows[23] + " last"
    seen, plain = [], GroupedData.applyInArrow

    def counted(self, func, schema):
        found = plain(self, func, schema)
        if "rest" in schema:
            seen.append((found.filter("a is not null").count(), found.filter("a is not null").select("a", "b").distinct().count()))
        return found

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    monkeypatch.setattr(jaccard_join, "LEAST_COUNTERS", 1)
    monkeypatch.setattr(jaccard_join, "TEXT_A_COUNTER", 1 << 20)
    for block in (4096, 5):
        seen.clear()
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_jaccard_join(df).collect()}
        assert got == plain_components(rows) and got[24][1] == 23
        assert any(pairs for _, pairs in seen) and all(made <= 4 * pairs for made, pairs in seen)


def test_urls(spark):
    urls = ["http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "https://a.org", "x", None, "http://b.com/fr/1", "ftp://b.com/de/2#z", "http://c.net/q"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_models.op6_url_models(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][:3] == ("a.org", "", None) and got[3][:3] == got[4][:3] == ("", "", None)
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and len(got) == len(urls)
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_models.op6_url_models(df.limit(0)).count() == 0


def test_url_models_tell_languages_apart(spark):
    rows = [(i, f"http://h{i}.example.{e}/{i}") for i in range(300) for e in ("org/x", "com/de/y", "net/x", "net/de/y")]
    df = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)], "page_id bigint, url string")
    got = url_models.judge(df).filter("rule is null")
    right = got.filter("(path like '/x/%') = (verdict = 'allow')").count()
    assert right >= 0.9 * got.count()


def normal(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def plain_hits(words, items, window=13):
    hit, found = set(), set()
    for item, w in items:
        for s in range(max(0, len(w) - window) + 1 if w else 0):
            part = w[s : s + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(item)
    return len(words), len(hit), len(found)


def test_contamination(spark, docs, odd, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r["item_id"], normal(r["text"])) for r in bench.collect()]
    for r in pi.op7_positional_index(docs.filter("doc_id % 4 = 0"), bench).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"]) == plain_hits(normal(texts[r["doc_id"]]), items)
    few = spark.createDataFrame([(1, "TWO three"), (2, None), (None, "word"), (3, "é")], "item_id bigint, text string")
    items = [(r["item_id"], normal(r["text"])) for r in few.collect()]
    rows = pi.op7_positional_index(odd, few).collect()
    by_id = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"]) == plain_hits(normal(by_id[r["doc_id"]]), items)
    assert pi.op7_positional_index(odd, few.limit(0)).filter("n_hit > 0").count() == 0
    assert pi.op7_positional_index(odd.limit(0), few).count() == 0
    assert pi.drop_contaminated(odd, few).columns == odd.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    index = pi.build_index(docs, pi.vocabulary(items), "doc_id")
    phrases = pi.phrases_of(items, "item_id")
    near = lambda slop: {r["_key"] for r in pi.proximity_matches(index, phrases, slop).collect()}
    assert near(0) == {2} and near(2) == {1, 2}


@pytest.mark.parametrize("name", ["small", "odd"])
def test_mixing(spark, docs, odd, tmp_path, name):
    df = docs if name == "small" else odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    df.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cursor = con.execute(mixing.SQL)
    names = [c[0] for c in cursor.description]
    want = Counter(map(str, cursor.fetchall()))
    assert Counter(str(tuple(r[c] for c in names)) for r in mixing.op8_mixing(df).collect()) == want


def test_mixing_odd_rows(odd):
    assert mixing.op8_mixing(odd).filter("taken > tokens or taken < 1").count() == 0
    assert mixing.op8_mixing(odd.limit(0)).count() == 0
    once = mixing.mix(odd.withColumn("domain", F.lit("d")), max_epochs=1)
    assert once.filter("text is null or text = ''").count() == 0 and once.count() > 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 500), ("b", "y", "3", 500)], "domain string, lang string, source string, tokens bigint")
    rows = mixing.leaf_budgets(leaves, F.lit(400).cast("bigint"), {}, 1).collect()
    assert {r["source"]: r["budget"] for r in rows} == {"1": 10, "2": 190, "3": 200}


def test_texts_without_letters_and_shared_ids(spark):
    """Numerals are no letters; rows that share an id are drawn for training one by one."""
    rows = [(i, t) for i, t in enumerate(["½ ²", "Ⅷ", "①", "12 34", "", None, "½a", "٣", "一"])]
    train = [(None, f"the cat sat here {i}" if i % 2 else f"le chat est assis {i}", "en" if i % 2 else "fr") for i in range(2000)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows] + train, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.op9_language_crf(df).filter("doc_id is not null").collect()}
    assert all(got[i] == "und" for i in (0, 1, 2, 3, 4, 5, 7)) and got[6] in ("en", "fr") and got[8] in ("en", "fr")
    right = language_crf.op9_language_crf(df.filter("doc_id is null").withColumn("doc_id", F.lit(next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)).cast("bigint")))
    assert right.filter("lang_pred = 'und'").count() == 0


def test_long_texts_change_language_where_the_words_do(docs):
    """Labels over the end of a span equal those of the same words in one chain."""
    model = language_crf.fit(docs, "doc_id")
    by_lang = {}
    for r in docs.filter("lang is not null and text is not null").collect():
        by_lang.setdefault(r["lang"], []).extend(language_crf.words_of(r["text"]))
    a, b = sorted(by_lang)[:2]
    words = by_lang[a][: language_crf.SPAN - 3] + by_lang[b][:200]
    labeler = language_crf.Labeler(model)
    post = labeler.probabilities([words])
    ids = labeler._ids([words])
    whole, _, _ = language_crf.forward_backward(labeler.scores[ids][None].astype(float), np.array([len(words)]), model["moves"])
    assert post.shape == whole[0].shape and np.abs(post - whole[0]).max() < 1e-3


def test_languages(docs, odd):
    rows = language_crf.op9_language_crf(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    got = language_crf.op9_language_crf(odd).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3))
    none = language_crf.op9_language_crf(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_crf.op9_language_crf(odd.limit(0)).count() == 0
    assert language_crf.keep_known(odd).columns == odd.columns


def test_switched_words(docs):
    model = language_crf.fit(docs, "doc_id")
    first = {lang: language_crf.words_of(docs.filter(f"lang = '{lang}' and length(text) > 800").first()["text"])[:20] for lang in ("de", "es")}
    names = model["languages"]
    best = language_crf.Labeler(model).probabilities([first["de"] + first["es"]]).argmax(1)
    want = [names.index("de")] * 20 + [names.index("es")] * 20
    assert (best == want).mean() >= 0.9


def test_forward_backward_is_exact():
    """Against the sum over all label sequences."""
    import itertools

    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    paths = {p: sum(scores[0, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=4)}
    z = sum(np.exp(v) for v in paths.values())
    post, pairs, logz = language_crf.forward_backward(scores, np.array([4]), moves)
    want = np.zeros((4, 3))
    for p, v in paths.items():
        want[range(4), p] += np.exp(v) / z
    assert np.allclose(post[0], want) and np.isclose(logz, np.log(z)) and np.isclose(pairs.sum(), 3)


def test_columns_that_clash_with_our_own(odd):
    """Columns named like the steps' own go through unharmed."""
    names = {"_d": "a", "_k": "b", "_digest": "c", "_h": "d", "_id": "e", "_row": "f", "_text": "g", "_own": "h", "_hash": "i", "epoch": "j"}
    df = odd.withColumns({n: F.lit(v) for n, v in names.items()}).withColumn("domain", F.lit("x"))
    items = odd.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 9")
    for out in (mixing.mix(df, levels=("domain",), weights={}), pi.drop_contaminated(df, items), language_crf.keep_known(df), jaccard_join.keep_one(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert all(r[n] == v for r in rows for n, v in names.items())
    assert pi.drop_contaminated(df, items).count() < df.count()
