"""Language identification by a linear-chain conditional random field over words.

Every word is labelled with a language from its affixes, character trigrams and learned word lists; learned
transitions say how likely neighbors differ, so code-switched text gets labels that change where the words
do. Forward-backward gives each word's label probabilities; a text takes the language of the highest mean.

Trained on a bounded sample of labelled rows: about ``SAMPLE_ROWS`` for each language, of each at most
``SAMPLE_CHAINS`` chains of ``CHAIN`` words, evenly spread; a part of the chains is spliced from two
languages, which teaches the transitions. Prediction reads whole texts, ``SPAN`` words at a time, each with
``CONTEXT`` words before and behind it, so transitions count over the ends of spans too.

A null text or one without a letter is ``und`` with score 0; with no labelled row all texts are. Repeated
rows are labelled alike, ties go to the first language by name, rows with null languages train nothing, empty
tables give no rows, other columns are kept by ``keep_known``.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .common import packed

CHAIN = 64
SPAN, CONTEXT = 128, 16
SAMPLE_ROWS, SAMPLE_CHAINS, SAMPLE_LIMIT = 250, 6, 20_000
FEATURES = 1 << 16
EPOCHS, RATE, DECAY, SPLICED = 25, 0.3, 1e-3, 0.25
LEXICON_WORDS, LEXICON_SHARE = 2_000, 0.8
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19
# Texts of a batch that are held as strings at a time.
TEXTS = 512
KNOWN_WORDS = 300_000
LEAST_SCORE = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and numerals with a letter among them, in lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def _hash(s: str) -> int:
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % FEATURES


def features(word: str, lexicon: dict) -> list[int]:
    """Hashed affixes of one to three characters, trigrams over the word's edges, and its word lists."""
    edged = f"^{word}$"
    named = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    named += [f"g{edged[i : i + 3]}" for i in range(len(edged) - 2)] + [f"l{x}" for x in lexicon.get(word, ())]
    return [_hash(x) for x in named]


def emissions(words: list[str], weights: np.ndarray, lexicon: dict) -> np.ndarray:
    each = [features(w, lexicon) for w in words]
    ends = np.cumsum([0] + [len(x) for x in each])
    return np.add.reduceat(weights[np.array([i for x in each for i in x])], ends[:-1], axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Label probabilities of chains [chain, place, label], and the expected label pairs summed over all.

    Also returns the summed log partition, for training.
    """
    n, steps, labels = scores.shape
    top = scores.max(2, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(transitions)
    alpha, scale = np.empty_like(e), np.ones((n, steps))
    for t in range(steps):
        now = e[:, t] if t == 0 else (alpha[:, t - 1] @ a) * e[:, t]
        total = now.sum(1, keepdims=True)
        live = (t < lengths)[:, None]
        alpha[:, t] = np.where(live, now / total, alpha[:, t - 1] if t else now / total)
        scale[:, t] = np.where(live[:, 0], total[:, 0], 1.0)
    beta = np.ones((n, labels))
    post, pairs = np.empty_like(e), np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        post[:, t] = alpha[:, t] * beta
        if t:
            live = t < lengths
            next_ = e[:, t] * beta / scale[:, t][:, None]
            pairs += a * (alpha[live, t - 1].T @ next_[live])
            beta = np.where(live[:, None], next_ @ a.T, beta)
    mask = np.arange(steps)[None, :] < lengths[:, None]
    logz = float(np.log(scale).sum() + (top[:, :, 0] * mask).sum())
    return post, pairs, logz


def train(rows: list[tuple[str, str]], seed: int = 5) -> dict | None:
    """A model from (text, language) rows; None without rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    chains, labels, counts = [], [], {}
    for text, lang in rows:
        w = words_of(text)
        parts = [w[i : i + CHAIN] for i in range(0, len(w), CHAIN)]
        for i in sorted({int(x) for x in np.linspace(0, len(parts) - 1, SAMPLE_CHAINS)}) if parts else []:
            chains.append(parts[i])
            labels.append([languages.index(lang)] * len(parts[i]))
        for x in set(w):
            counts.setdefault(x, np.zeros(len(languages)))[languages.index(lang)] += 1
    if not chains:
        return None
    lexicon = {}
    for k, lang in enumerate(languages):
        own = sorted((w for w, c in counts.items() if c[k] >= LEXICON_SHARE * c.sum() and c[k] > 1), key=lambda w: (-counts[w][k], w))
        for w in own[:LEXICON_WORDS]:
            lexicon[w] = (lang,)
    # Spliced chains: the start of one and the end of another.
    for _ in range(int(SPLICED * len(chains))):
        i, j = rng.integers(len(chains), size=2)
        x, y = int(rng.integers(1, len(chains[i]) + 1)), int(rng.integers(0, len(chains[j])))
        chains.append((chains[i][:x] + chains[j][y:])[:CHAIN])
        labels.append((labels[i][:x] + labels[j][y:])[:CHAIN])
    types = sorted({w for c in chains for w in c})
    place = {w: i for i, w in enumerate(types)}
    each = [features(w, lexicon) for w in types]
    ends = np.cumsum([0] + [len(x) for x in each])
    flat = np.array([i for x in each for i in x])
    of = np.repeat(np.arange(len(types)), np.diff(ends))
    lengths = np.array([len(c) for c in chains])
    ids, gold = np.zeros((len(chains), CHAIN), np.int64), np.zeros((len(chains), CHAIN), np.int64)
    for i, (c, y) in enumerate(zip(chains, labels, strict=True)):
        ids[i, : len(c)], gold[i, : len(c)] = [place[w] for w in c], y
    mask = np.arange(CHAIN)[None, :] < lengths[:, None]
    k = len(languages)
    seen = np.zeros((len(types), k))
    np.add.at(seen, (ids[mask], gold[mask]), 1)
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    weights, moves = np.zeros((FEATURES, k)), np.zeros((k, k))
    past_w, past_m = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    words = mask.sum()
    for _ in range(EPOCHS):
        scores = np.add.reduceat(weights[flat], ends[:-1], axis=0)
        post, pairs, _ = forward_backward(scores[ids], lengths, moves)
        expected = np.stack([np.bincount(ids[mask], post[..., j][mask], len(types)) for j in range(k)], 1)
        slope = np.stack([np.bincount(flat, (seen - expected)[of, j], FEATURES) for j in range(k)], 1) / words - DECAY * weights / FEATURES
        slope_m = (seen_pairs - pairs) / words
        past_w += slope**2
        past_m += slope_m**2
        weights += RATE * slope / np.sqrt(past_w)
        moves += RATE * slope_m / np.sqrt(past_m)
    return {"languages": languages, "weights": weights.astype(np.float32), "moves": moves, "lexicon": lexicon}


class Labeler:
    """Applies a model to texts; word scores are remembered, up to KNOWN_WORDS of them."""

    def __init__(self, model: dict):
        self.model, self.place, self.scores = model, {}, np.empty((0, len(model["languages"])), np.float32)

    def _ids(self, lists):
        new = sorted({w for x in lists for w in x}.difference(self.place))
        if len(self.place) + len(new) > KNOWN_WORDS:
            self.place, self.scores = {}, self.scores[:0]
            new = sorted({w for x in lists for w in x})
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, emissions(new, self.model["weights"], self.model["lexicon"]).astype(np.float32)])
        at = self.place
        return np.array([at[w] for x in lists for w in x], np.int64)

    def probabilities(self, lists: list[list[str]]) -> np.ndarray:
        """Label probabilities for all words, one row each, in order."""
        sizes = np.array([len(x) for x in lists])
        ids = self._ids(lists)
        if not len(ids):
            return np.empty((0, len(self.model["languages"])))
        starts = np.cumsum(sizes) - sizes
        begin = np.concatenate([np.arange(s, s + n, SPAN) for s, n in zip(starts, sizes, strict=True) if n])
        first, stop = np.repeat(starts, -(-sizes // SPAN)), np.repeat(starts + sizes, -(-sizes // SPAN))
        low, high = np.maximum(begin - CONTEXT, first), np.minimum(begin + SPAN + CONTEXT, stop)
        place = low[:, None] + np.arange(int((high - low).max()))[None, :]
        inside = place < high[:, None]
        scores = self.scores[ids[np.where(inside, place, 0)]].astype(np.float64)
        post, _, _ = forward_backward(scores, high - low, self.model["moves"])
        return post[(place >= begin[:, None]) & (place < np.minimum(begin + SPAN, stop)[:, None])]

    def chunks(self, texts):
        """(word lists, probabilities) for texts, a bounded number of characters at a time."""
        held, size = [], 0
        for t in texts:
            held.append(words_of(t or ""))
            size += len(t or "")
            if size >= CHUNK_CHARS:
                yield held, self.probabilities(held)
                held, size = [], 0
        if held:
            yield held, self.probabilities(held)

    def languages(self, texts):
        for lists, post in self.chunks(texts):
            at = 0
            for x in lists:
                if not x:
                    yield UNKNOWN, 0.0
                    continue
                mean = post[at : at + len(x)].mean(0)
                at += len(x)
                best = int(mean.argmax())
                yield self.model["languages"][best], min(1.0, max(0.0, float(mean[best])))


def texts_of(column):
    """The texts of an Arrow column, some at a time."""
    for i in range(0, len(column), TEXTS):
        yield from column.slice(i, TEXTS).to_pylist()


def held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame, key: str, text: str = "text", lang: str = "lang") -> dict | None:
    """A model from a bounded sample of the labelled rows that are not held out."""
    known = documents.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().collect()
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(lang) == r[lang], min(1.0, SAMPLE_ROWS / r["count"])).otherwise(rate)
    # By id and text, so rows that share an id, or have none, are drawn one by one.
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string"), text), F.lit(1_000_000)) < rate * 1_000_000
    rows = known.filter(draw).select(text, lang, F.xxhash64(F.col(key).cast("string"), text).alias("_o"))
    rows = rows.orderBy("_o", text).limit(SAMPLE_LIMIT).collect()
    return train([(r[text], r[lang]) for r in rows])


def predict(documents: DataFrame, model: dict | None, key: str, text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    if model is None:
        return documents.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([documents.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches):
        labeler = Labeler(shared.value)
        for batch in batches:
            found = list(labeler.languages(texts_of(batch.column(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names
            )

    return documents.select(key, text).mapInArrow(label, schema)


def label_words(documents: DataFrame, model: dict, key: str, text: str = "text") -> DataFrame:
    """(key, words): the words of each text with label and probability."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    word = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([documents.schema[key], T.StructField("words", T.ArrayType(word))])

    def label(batches):
        labeler = Labeler(shared.value)
        names = shared.value["languages"]
        for batch in batches:
            out = []
            for lists, post in labeler.chunks(texts_of(batch.column(text))):
                best, at = post.argmax(1), 0
                for x in lists:
                    out.append([{"word": w, "lang": names[best[at + i]], "p": float(post[at + i].max())} for i, w in enumerate(x)])
                    at += len(x)
            kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], names=schema.names)

    return documents.select(key, text).mapInArrow(label, schema)


def keep_known(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is known with at least the given score."""
    own = F.to_json(F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    held = packed(documents, _id=own, _text=F.col(text))
    found = predict(held.select("_id", "_text"), fit(documents, key, text, lang), "_id", "_text")
    bad = found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("_id").distinct()
    # Few are rejected: their ids meet the documents, which are not sent through Python as a whole.
    bad = materialize(bad, "language-rejects")
    return held.join(bad, "_id", "left_anti").select("_row.*")


def op9_language_crf(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text", "lang")
    found = predict(rows, fit(rows, "doc_id"), "doc_id")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
