"""Token-id output: texts to ids, ids to coded blocks in files, and back.

Documents are put in order of their ids, encoded with a tokenizer, closed with an end id and packed into
blocks of at most ``BLOCK_IDS`` ids (a longer document is cut into blocks of its own), which the context-mixing
range coder writes. A row of the file holds one block: the part of the order it belongs to, the ids before it in
that part, where the document begins that it is a piece of (else null), the documents in it with their lengths,
and the coded bytes with their checksum.

A null or empty text is its end id alone. Rows with equal ids follow each other in the order of their text
digests; null ids come first. An empty table gives an empty file and no rows. Other columns are not stored.
"""

import json
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import BATCH_ROWS, scratch_path, small_batches
from .common import whole
from .mixing_coder import BLOCK_IDS, GROUP_IDS, decode, encode

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# How the tokenizer that can be given chunks splits a text, and characters for which that is plain.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = "".join(x for x in string.punctuation if x not in "'<>")
# Letters that no normalizing of a text but lower case changes, alone or before what TAIL holds.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
WORD, WORD_END = rf"\A[{LATIN}]+\z", rf"[{LATIN}0-9]\z"
KNOWN_PARTS, WORDS_A_TEXT = 800_000, 64
TEXT_BYTES = 1 << 21
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[9, 10, 13]] = 32


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_blanks(tokenizer: dict) -> bool:
    """Whether the ids of a text are those of its parts between blanks, by the tokenizer's own steps.

    So it is where normalizing never looks over a blank (NFC, runs of white space to one, lower case), where the first
    step after it keeps only matches of LETTERS, none of which holds white space, and where no other token does.
    """
    steps = lambda x, name: x[name] if x and x["type"] == "Sequence" else [x] if x else []
    normal, before = steps(tokenizer["normalizer"], "normalizers"), steps(tokenizer["pre_tokenizer"], "pretokenizers")
    local = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in normal)
    parted = len(before) == 2 and before[0] == {"type": "Split", "pattern": {"Regex": LETTERS}, "behavior": "Removed", "invert": True}
    bytewise = parted and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
    alone = all(not re.search(r"\s", t["content"]) and not t["single_word"] and t["content"][-1] not in TAIL for t in tokenizer["added_tokens"])
    return local and bytewise and alone and tokenizer["post_processor"] is None


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large strings."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    own = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], own[offsets[0] : offsets[-1]]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, one behind the other."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _distinct(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = texts.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class TextEncoder:
    """Texts to the ids that the tokenizer gives the whole text.

    Where ``splits_at_blanks`` holds, the different chunks between blanks are encoded once; marks of TAIL behind a plain
    letter or digit are a match of their own there, and encoded apart. Words of LATIN letters go to the tokenizer's model
    many in one text, without the steps that leave them as they are; each ends at its only token with the model's mark
    for ends. The ids of the last KNOWN_PARTS parts or so are remembered. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.by_chunk, suffix = splits_at_blanks(described), described["model"].get("end_of_word_suffix")
        self.by_word = self.by_chunk and described["model"]["type"] == "BPE" and bool(suffix)
        if self.by_word:
            self.lower = '{"type": "Lowercase"}' in json.dumps(described["normalizer"])
            self.words = Tokenizer(self.tokenizer.model)
            # Letters of ASCII are their own marks for bytes.
            split, to_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.steps = {True: split, False: pre_tokenizers.Sequence([split, to_bytes])}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # Parts in order of their places, where the ids of a place begin and end, and the ids.
        self.parts, self.at, self.held = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of them for each."""
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of LATIN letters, all or none of ASCII."""
        joined = [" ".join(words[i : i + WORDS_A_TEXT]) for i in range(0, len(words), WORDS_A_TEXT)]
        self.words.pre_tokenizer = self.steps[words[0].isascii()]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(joined, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        # A model without all of the letters leaves some out.
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self._encode(words)

    def _places(self, parts: pa.Array) -> np.ndarray:
        """The places of different parts among those remembered; new ones are encoded."""
        if len(self.parts) > KNOWN_PARTS:
            # The older half is forgotten.
            half = len(self.parts) // 2
            first = self.at[half]
            self.parts, self.at, self.held = pa.concat_arrays([self.parts[half:]]), self.at[half:] - first, self.held[first:].copy()
        # The look-up is built from the parts asked for, as those remembered are more.
        asked = pc.fill_null(pc.index_in(self.parts, value_set=parts), -1).to_numpy()
        met, place = np.flatnonzero(asked >= 0), np.full(len(parts), -1, np.int64)
        place[asked[met]] = met
        new = np.flatnonzero(place < 0)
        some, kind = parts.take(pa.array(new)), np.zeros(len(new), np.int8)
        if self.by_word:
            kind = pc.match_substring_regex(some, WORD).to_numpy(zero_copy_only=False) * (1 + pc.string_is_ascii(some).to_numpy(zero_copy_only=False))
        for k, encode in enumerate((self._encode, self._encode_words, self._encode_words)):
            own = np.flatnonzero(kind == k)
            if len(own):
                place[new[own]] = len(self.parts) + np.arange(len(own))
                chosen = some.take(pa.array(own))
                ids, sizes = encode(chosen.to_pylist())
                self.parts = pa.concat_arrays([self.parts, chosen])
                self.held, self.at = np.concatenate([self.held, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return place

    def ids(self, texts) -> list[bytes]:
        if not self.by_chunk:
            ids, sizes = self._encode(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
            return self._cut(ids, np.cumsum(sizes))
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        begins, data = _bytes_of(texts)
        data = BLANKS[data]
        # A chunk takes the blank behind it along.
        cut = np.zeros(len(data) + 1, bool)
        cut[1:] = data == 32
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        of_chunk, chunks = _distinct(_strings(cuts, data))
        chunks = pc.ascii_rtrim(chunks, " ")
        core = pc.ascii_rtrim(chunks, TAIL)
        core = pc.if_else(pc.match_substring_regex(core, WORD_END), core, chunks)
        offsets, data = _bytes_of(chunks)
        long = pc.binary_length(core).to_numpy()
        rest = np.diff(offsets) - long
        tails = _strings(np.concatenate([[0], np.cumsum(rest)]), _runs(data, offsets[:-1] + long, rest))
        if self.by_word and self.lower:
            core = pc.if_else(pc.match_substring_regex(core, WORD), pc.utf8_lower(core), core)
        of_part, parts = _distinct(pa.concat_arrays([core, tails]))
        place = self._places(parts)[of_part]
        start, size = self.at[place], self.at[place + 1] - self.at[place]
        # The ids of a chunk: those of its core, then of its tail.
        n = len(chunks)
        pair = np.arange(2 * n).reshape(2, n).T.ravel()
        own, sizes = _runs(self.held, start[pair], size[pair]), size[:n] + size[n:]
        begin, size = (np.cumsum(sizes) - sizes)[of_chunk], sizes[of_chunk]
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts[:-1], begins[1:])]
        return self._cut(_runs(own, begin, size), ends)

    @staticmethod
    def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        code, ends = ids.tobytes(), (4 * ends).tolist()
        return [code[a:b] for a, b in zip([0, *ends], ends)]


def _encoder(path: str) -> TextEncoder:
    import os
    import sys

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the cores
    # The package's functions travel with each task; what a worker process has learned must outlast a task.
    held = vars(sys).setdefault("_text_encoders", {})
    if path not in held:
        held[path] = TextEncoder(path)
    return held[path]


def _by_load(batches, *columns: str):
    """Columns of the batches, the last of texts, anew: of about TEXT_BYTES of texts, a single row may have more."""
    held, size = [], 0
    for batch in batches:
        load = np.cumsum(pc.binary_length(batch.column(columns[-1])).to_numpy(), dtype=np.int64) // TEXT_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(load)]
        for i, j in zip(bounds, bounds[1:]):
            piece = batch.slice(i, j - i)
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column(columns[-1]))).as_py() or 0
            if size >= TEXT_BYTES:
                yield [pa.concat_arrays([x.column(c) for x in held]) for c in columns]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays([x.column(c) for x in held]) for c in columns]


def _schema(key: T.StructField) -> T.StructType:
    return T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()),
         T.StructField("begin", T.LongType()), T.StructField("keys", T.ArrayType(key.dataType)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType())]
    )


def write_blocks(documents: DataFrame, path: str, key: str, text: str = "text", tokenizer: str | None = None) -> None:
    """Encode the texts in order of ``key`` and write the file."""
    where = tokenizer or tokenizer_path()
    schema = _schema(documents.schema[key])
    end = np.array([END_ID], "<u4").tobytes()
    t = whole(F.col(text))
    ordered = documents.select(F.col(key).alias("k"), t.alias("t")).repartitionByRange("k").sortWithinPartitions("k", F.md5("t"))

    def make(batches):
        coder = _encoder(where)
        part = TaskContext.get().partitionId()
        blocks, keys, lengths, begins, at, number, placed, waiting = [], [], [], [], 0, 0, 0, 0
        own, own_keys, own_lengths, size = [], [], [], 0

        def close(begin=None):
            nonlocal own, own_keys, own_lengths, size, waiting
            begins.append(begin)
            blocks.append(np.frombuffer(b"".join(own), "<u4"))
            keys.append(own_keys)
            lengths.append(own_lengths)
            waiting += size
            own, own_keys, own_lengths, size = [], [], [], 0

        def flush():
            nonlocal at, number, blocks, keys, lengths, begins, waiting
            sizes = [len(b) for b in blocks]
            before = (at + np.cumsum([0] + sizes))[:-1]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blocks), pa.int32()), pa.array(range(number, number + len(blocks)), pa.int32()), pa.array(before, pa.int64()),
                 pa.array(begins, pa.int64()), pa.array(keys, pa.list_(kind)), pa.array(lengths, pa.list_(pa.int32())), pa.array(encode(blocks), pa.binary())], names=schema.names
            )
            at, number = at + sum(sizes), number + len(blocks)
            blocks, keys, lengths, begins, waiting = [], [], [], [], 0
            return batch

        for names, texts in _by_load(batches, "k", "t"):
            kind = names.type
            for k, ids in zip(names.to_pylist(), coder.ids(texts), strict=True):
                n = len(ids) // 4 + 1
                if size and size + n > BLOCK_IDS:
                    close()
                ids += end
                for first in range(0, n, BLOCK_IDS):
                    own.append(ids[4 * first : 4 * (first + BLOCK_IDS)])
                    own_keys.append(k)
                    own_lengths.append(len(own[-1]) // 4)
                    size += own_lengths[-1]
                    if n > BLOCK_IDS:
                        close(placed)
                    if waiting >= GROUP_IDS:
                        yield flush()
                placed += n
        if size:
            close()
        if blocks:
            yield flush()

    with small_batches(documents.sparkSession):
        ordered.mapInArrow(make, schema).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, before, key, ids) of every document in the file; ids as little-endian bytes."""
    rows = spark.read.parquet(path)
    key = rows.schema["keys"].dataType.elementType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("begin", T.LongType()),
         T.StructField("key", key), T.StructField("ids", T.BinaryType())]
    )

    def restore(batches):
        for batch in batches:
            counts, lengths = pc.list_value_length(batch.column("lengths")).to_numpy(), batch.column("lengths").flatten().to_numpy()
            sizes = np.diff(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])])
            load = np.cumsum(sizes) // GROUP_IDS
            bounds = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(batch)]
            for i, j in zip(bounds, bounds[1:]):
                yield from restored(batch.slice(i, j - i), counts[i:j])

    def restored(some, counts):
        ids = np.concatenate([np.zeros(0, np.uint32), *decode(some.column("code").to_pylist())]).astype("<u4", copy=False)
        lengths = some.column("lengths").flatten().to_numpy()
        ends = np.cumsum(lengths, dtype=np.int64)
        if len(ends) and ends[-1] != len(ids):
            raise ValueError("the lengths of documents are not those of their blocks")
        block = np.repeat(np.arange(len(some)), counts)
        # Where a document begins in its block.
        inside = ends - lengths
        inside = inside - inside[(np.cumsum(counts) - counts)[block]]
        offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
        before = some.column("before").to_numpy()[block] + inside
        texts = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
        taken = [some.column(c).take(pa.array(block)) for c in ("part", "begin")]
        out = pa.RecordBatch.from_arrays([taken[0], pa.array(before, pa.int64()), taken[1], some.column("keys").flatten(), texts], names=schema.names)
        for i in range(0, len(out), BATCH_ROWS):
            yield out.slice(i, BATCH_ROWS)

    short = rows.filter("begin is null").mapInArrow(restore, schema).select("part", "before", "key", "ids")
    # Each block is restored once; only the pieces of long documents meet by a shuffle.
    pieces = rows.filter("begin is not null").mapInArrow(restore, schema).repartition("part", "begin").sortWithinPartitions("part", "begin", "before")

    def join(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for part, begin, key, ids in zip(*(batch.column(c) for c in ("part", "begin", "key", "ids")), strict=True):
                place = (part.as_py(), begin.as_py())
                if now is not None and place != now[:2]:
                    out.append((*now, b"".join(held)))
                    held = []
                now = (*place, key.as_py())
                held.append(ids.as_py())
            yield made(out, batch)
        if now is not None:
            yield made([(*now, b"".join(held))], batch)

    def made(rows, like):
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int32(), pa.int64(), like.schema.field("key").type, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "before", "key", "ids"])

    long = pieces.mapInArrow(join, T.StructType([schema["part"], schema["before"], schema["key"], schema["ids"]]))
    return short.unionByName(long)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, start): ids in all parts before, one row for each part."""
    sizes = spark.read.parquet(path).select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    return sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the file."""
    found = read_blocks(spark, path)
    # The ids stay in the task that restores them.
    small = found.select("part", "before", "key", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return small.join(part_starts(spark, path), "part").select("key", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write_blocks(documents.select("doc_id", "text"), path, "doc_id")
    return summary(spark, path).withColumnRenamed("key", "doc_id")
