"""Token files as exact round trips, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from winnowry.llm import mixing_coder, token_files


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=600), max_size=5))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    back = mixing_coder.decode(mixing_coder.encode(blocks))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))


def test_blocks_are_independent_checked_and_smaller():
    rng = np.random.default_rng(1)
    blocks = [np.minimum(49407, rng.zipf(1.4, 3000)).astype(np.int64), np.arange(40)]
    codes = mixing_coder.encode(blocks)
    assert [mixing_coder.encode([b])[0] for b in blocks] == codes
    assert (mixing_coder.decode(codes[1:])[0] == blocks[1]).all() and len(codes[0]) < 2 * 3000
    broken = bytearray(codes[0])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        mixing_coder.decode([bytes(broken)])


def plain(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
    for key, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def shown(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


def test_token_files(docs, odd):
    some = docs.filter("doc_id < 60")
    assert shown(token_files.op10_token_files(some)) == plain([(r["doc_id"], r["text"]) for r in some.orderBy("doc_id").collect()])
    one = odd.dropDuplicates(["doc_id", "text"])
    rows = sorted([(r["doc_id"], r["text"]) for r in one.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert shown(token_files.op10_token_files(one)) == plain(rows)
    assert token_files.op10_token_files(odd).count() == odd.count()
    assert token_files.op10_token_files(odd.limit(0)).count() == 0


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["It's a <|endoftext|> test, isn't it?! é ́x ab cd   1234.5 a.b.c... 'll 're", "", " \n ", "ÉTÉ\u0085x Σας ΣΑΣ. İstanbul, ok;"]
    coder = token_files.TextEncoder(path)
    for text, ids in zip(texts, coder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


AWKWARD = st.text(st.sampled_from("aZ9 .,!?;:'’\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\u200bİıßΣσςée\u0301½Ⅷ①一٣\U0001d7d8<|endoftext|>lsvdmtr\ufeff"), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(AWKWARD, st.text(max_size=30)), min_size=1, max_size=6), st.sampled_from([" ", "", "\n"]))
def test_ids_of_any_text(parts, between):
    tokenizer, coder = _both()
    text = between.join(parts)
    (ids,) = coder.ids([text])
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_beside_every_code_point():
    tokenizer, coder = _both()
    texts = [f"a{chr(c)}. {chr(c)}b 9{chr(c)}!" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 13 == 0)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.by_chunk and [np.frombuffer(x, "<u4").tolist() for x in coder.ids(texts)] == want


_HELD = []


def _both():
    from tokenizers import Tokenizer

    if not _HELD:
        path = token_files.tokenizer_path()
        _HELD.extend((Tokenizer.from_file(path), token_files.TextEncoder(path)))
    return _HELD


def test_other_tokenizers_get_whole_texts():
    coder = token_files.TextEncoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    assert not coder.by_chunk
    assert np.frombuffer(coder.ids(["two  words"])[0], "<u4").tolist() == coder.tokenizer.encode("two  words", add_special_tokens=False).ids


def test_ids_too_large_are_refused():
    with pytest.raises(ValueError):
        mixing_coder.encode([np.array([1, 1 << 16])])


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    from test_documents import SMALL, normal, plain_components, plain_hits

    held, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "token_id_output":
            assert after.columns == docs.columns
        frames[name], held = (held, after), after
    before, after = frames["ngram_jaccard_join"]
    want = plain_components({r["doc_id"]: r["text"] for r in before.collect()})
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    before, after = frames["benchmark_decontamination"]
    items = [(r["item_id"], normal(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = []
    for r in before.collect():
        n, hit, _ = plain_hits(normal(r["text"]), items)
        if not (hit and 20 * hit >= n):
            clean.append(r["doc_id"])
    assert sorted(clean) == sorted(r["doc_id"] for r in after.collect())
    before, after = frames["mixing_to_weights"]
    assert 0 < after.count() <= before.count() and after.subtract(before).count() == 0
    before, after = frames["token_id_output"]
    assert shown(after) == plain([(r["doc_id"], r["text"]) for r in before.orderBy("doc_id").collect()])


def test_long_documents_span_blocks(spark, tmp_path):
    """Documents of many blocks come back whole, between short ones and at the end."""
    texts = {1: "one two", 2: "alpha beta 12 " * 9000, 3: None, 4: "x", 5: "gamma, delta. " * 7000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    path = str(tmp_path / "long")
    token_files.write_blocks(df.repartition(2), path, "doc_id")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    want = {k: t.encode(v or "", add_special_tokens=False).ids + [2] for k, v in texts.items()}
    got = {r["key"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_blocks(spark, path).collect()}
    assert got == want and max(map(len, want.values())) > 2 * token_files.BLOCK_IDS
    start = 0
    for r in token_files.summary(spark, path).orderBy("key").collect():
        assert (r["start"], r["n_tokens"]) == (start, len(want[r["key"]]))
        start += r["n_tokens"]
    assert spark.read.parquet(path).filter("begin is not null").count() > 4


def test_new_words_share_a_text():
    """New words go to the tokenizer many at a time, known ones not at all."""
    _, coder = _both()
    asked = []

    class Asked:
        def __init__(self, own):
            self.__dict__["own"] = own

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    coder = token_files.TextEncoder(token_files.tokenizer_path())
    for name in {"tokenizer", "words"}.intersection(vars(coder)):
        setattr(coder, name, Asked(getattr(coder, name)))
    words = [f"{a}{b}é{c}" for a in "klmnopqrst" for b in "aeiou" for c in "bcdfghjklm"] + [a + b + c + "q" for a in "klmnopqrst" for b in "aeiou" for c in "bcdfghjklm"]
    text = " ".join(w + mark for w in words for mark in ("", ",", "***"))
    (first,) = coder.ids([text])
    assert len(asked) < len(words) // 10
    asked.clear()
    assert coder.ids([text.upper()]) == [first] and not asked


def test_parts_are_forgotten_and_met_again(monkeypatch):
    tokenizer, _ = _both()
    coder = token_files.TextEncoder(token_files.tokenizer_path())
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 30)
    for i in [*range(40), *range(40)]:
        text = f"the word{i} {i} wörd{i}x ab{chr(97 + i % 26)}c... é{i}"
        assert np.frombuffer(coder.ids([text, "", text])[2], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(coder.parts) < 60


def test_coder_carries():
    """Many blocks of ids that are all but sure, so that carries run through words already made."""
    rng = np.random.default_rng(7)
    blocks = [np.where(rng.random(n) < 0.002, 65535, top).astype(np.int64) for n in (300, 1100, 5000, 17000) for top in (0, 1, 65535) for _ in range(4)]
    back = mixing_coder.decode(mixing_coder.encode(blocks))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))


def test_steps_do_not_follow_the_longest_block(monkeypatch):
    """A long block beside short ones is coded in lanes side by side, in groups of bounded size."""
    widths = []
    learn = mixing_coder._Guesses.learn
    monkeypatch.setattr(mixing_coder._Guesses, "learn", lambda self, x, *more: widths.append(np.shape(x)[-1]) or learn(self, x, *more))
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 900, n) for n in (9000, *range(40), 1025, 700)]
    back = mixing_coder.decode(mixing_coder.encode(blocks))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    assert len(widths) <= 2 * 1024
    monkeypatch.setattr(mixing_coder, "GROUP", 8)
    codes = mixing_coder.encode(blocks)
    widths.clear()
    assert mixing_coder.encode(blocks) == codes and max(widths) <= 8
    back = mixing_coder.decode(codes)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True)) and max(widths) <= 8


def test_any_broken_byte_is_noticed():
    (code,) = mixing_coder.encode([np.arange(1500) % 70])
    for at in [*range(20), len(code) // 2, len(code) - 1]:
        broken = bytearray(code)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            mixing_coder.decode([bytes(broken)])
    with pytest.raises(ValueError):
        mixing_coder.decode([code[:-1]])


def test_remembered_parts_take_little_memory():
    """Parts are held as bytes in a row, not as objects of Python, so that many are remembered."""
    coder = token_files.TextEncoder(token_files.tokenizer_path())
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in "aeiou" for c in "npqrstvwxz" for d in "aeiou"]
    (first,) = coder.ids([" ".join(words)])
    assert len(coder.parts) >= len(words) and coder.parts.nbytes < 16 * len(coder.parts)
    assert coder.ids([" ".join(words)]) == [first]
