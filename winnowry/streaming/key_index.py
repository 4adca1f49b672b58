"""Which keys a store holds, without reading them all.

Digests of keys (hex SHA-1) are kept in parts beside the records, in hidden folders. A part is divided by the first
digits of the digest into buckets of about ``BUCKET_KEYS`` keys, so a larger part has more buckets, not larger ones.
Each bucket has a Bloom filter; a look-up tests its digests on the filters of the buckets they fall in and opens only
the buckets that may hold one. So what a batch reads depends on the batch, and on repeats it really has, and not on
the store. Every batch adds a part; FAN_OUT parts of one level are merged into one of the next, so there are
about FAN_OUT parts for each power of FAN_OUT in the number of batches.

A part counts once its filters are complete, which are written last; a merged part names those it replaces, so a
merge that breaks off changes nothing and its leftovers are overwritten. A batch that runs again replaces its part. Batches
and merges of one store must follow one another; several streams may share a store if they take turns.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import delete_path, list_names, path_exists

BUCKET_KEYS = 65_536
FAN_OUT = 8
BITS_A_KEY, HASHES = 12, 8
# A digest's first digits choose the bucket, so the filter uses later ones.
_FIRST, _SECOND = (10, 15), (25, 15)
MOST_DIGITS = 6


def depth_of(keys: int, bucket_keys: int = BUCKET_KEYS) -> int:
    """Digits by which so many keys are divided."""
    return min(MOST_DIGITS, max(0, math.ceil(math.log(max(1, keys / bucket_keys), 16))))


def _positions(digests: list[str], bits: int) -> np.ndarray:
    """Bits of the filter that stand for each digest."""
    part = lambda at: np.array([int(d[at[0] - 1 : at[0] - 1 + at[1]], 16) for d in digests], np.uint64)
    step = part(_SECOND) | np.uint64(1)
    return (part(_FIRST)[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


class KeyIndex:
    """The digests of one store, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.bucket_keys = spark, bucket_keys
        self.keys, self.filters = f"{root.rstrip('/')}/_keys", f"{root.rstrip('/')}/_filters"

    def parts(self) -> list[str]:
        """Names of the parts that count."""
        names = [n for n in list_names(self.spark, self.filters) if path_exists(self.spark, f"{self.filters}/{n}/_SUCCESS")]
        if not names:
            return []
        merged = [n for n in names if not n.startswith("part=l0-")]
        gone = set()
        if merged:
            rows = self.spark.read.parquet(*[f"{self.filters}/{n}" for n in merged]).select(F.explode("replaces").alias("r")).distinct()
            # As many names as parts were merged.
            gone = {r["r"] for r in rows.collect()}
        return sorted(n for n in names if n not in gone)

    def add(self, digests: DataFrame, name: str, level: int = 0, replaces: tuple = ()) -> None:
        """Store a column of distinct digests as a part."""
        part = f"part=l{level}-{name}"
        depth = depth_of(digests.count(), self.bucket_keys)
        bucketed = digests.select("digest", F.concat(F.lit("b"), F.substring("digest", 1, depth)).alias("bucket"))
        dealt = bucketed.repartition("bucket").sortWithinPartitions("bucket", "digest")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.keys}/{part}")

        def filter_of(table: pa.Table) -> pa.Table:
            own = table.column("digest").to_pylist()
            bits = max(64, BITS_A_KEY * len(own))
            held = np.zeros(-(-bits // 8) * 8, np.uint8)
            held[_positions(own, bits).ravel().astype(np.int64)] = 1
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([bits], pa.int64()), "filter": pa.array([np.packbits(held).tobytes()], pa.binary())})

        stored = self.spark.read.schema("digest string, bucket string").parquet(f"{self.keys}/{part}")
        made = stored.groupBy("bucket").applyInArrow(filter_of, "bucket string, bits bigint, filter binary")
        made = made.withColumns({"part": F.lit(part), "replaces": F.array(*[F.lit(r) for r in replaces]).cast("array<string>")})
        made.write.mode("overwrite").parquet(f"{self.filters}/{part}")

    def candidates(self, digests: DataFrame, without: str | None = None) -> list[str]:
        """Folders of the buckets that may hold one of the digests, by their filters; ``without``: a batch's own part."""
        parts = [p for p in self.parts() if p != f"part=l0-{without}"]
        if not parts:
            return []
        filters = self.spark.read.parquet(*[f"{self.filters}/{p}" for p in parts])
        depths = [r["n"] - 1 for r in filters.select(F.length("bucket").alias("n")).distinct().collect()]
        # So many shares of a bucket's digests that none is larger than a bucket.
        n = digests.count()
        shares = {d: 1 + n // (self.bucket_keys * 16**d) for d in depths}
        places = [F.struct(F.concat(F.lit("b"), F.substring("digest", 1, d)).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(shares[d])).alias("share")) for d in depths]
        asked = digests.select("digest", F.explode(F.array(*places)).alias("p")).select("digest", "p.bucket", "p.share")
        share = F.lit(0)
        for d in depths:
            share = F.when(F.length("bucket") == d + 1, shares[d] - 1).otherwise(share)
        filters = filters.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), share.cast("bigint"))))

        def may_hold(own: pa.Table, filters: pa.Table) -> pa.Table:
            found = []
            texts = own.column("digest").to_pylist()
            for row in filters.to_pylist() if texts else ():
                held = np.unpackbits(np.frombuffer(row["filter"], np.uint8))
                if held[_positions(texts, row["bits"]).astype(np.int64)].all(1).any():
                    found.append(f"{row['part']}/bucket={row['bucket']}")
            return pa.table({"folder": pa.array(found, pa.string())})

        hits = asked.groupBy("bucket", "share").cogroup(filters.groupBy("bucket", "share")).applyInArrow(may_hold, "folder string")
        # As many names as there are buckets at most.
        return sorted(f"{self.keys}/{r['folder']}" for r in hits.distinct().collect())

    def known(self, digests: DataFrame, without: str | None = None) -> DataFrame:
        """The stored digests among which every one of ``digests`` is that the store holds."""
        folders = self.candidates(digests, without)
        if not folders:
            return self.spark.createDataFrame([], "digest string")
        return self.spark.read.schema("digest string").parquet(*folders)

    def stored(self, parts: list[str]) -> DataFrame:
        """All digests of some parts."""
        return self.spark.read.schema("digest string").option("recursiveFileLookup", True).parquet(*[f"{self.keys}/{p}" for p in parts])

    def merge(self) -> None:
        """Merge the parts of every level that has FAN_OUT of them."""
        by_level = {}
        for p in self.parts():
            by_level.setdefault(int(p.split("-", 1)[0][len("part=l") :]), []).append(p)
        for level, parts in sorted(by_level.items()):
            if len(parts) >= FAN_OUT:
                digests = self.stored(parts).distinct()
                name = parts[-1].split("-", 1)[1]
                self.add(digests, name, level + 1, tuple(parts))
                for p in parts:
                    # The filters go first: without them a part does not count.
                    delete_path(self.spark, f"{self.filters}/{p}")
                    delete_path(self.spark, f"{self.keys}/{p}")
