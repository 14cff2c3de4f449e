"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint takes one bit of each shingle's hash by majority. Two fingerprints
at distance r or less share a variant within r/2 flipped bits, so each distinct
fingerprint emits its ball of radius r/2; equal variants meet in one shuffle.
With one lane as wide as the fingerprint all members of a bucket lie within r of
each other and a bucket holds at most bits + 1 distinct fingerprints, whatever
the data: linking each to its successor loses no component. With several lanes
(long fingerprints, larger distances) a bucket is a candidate group; all pairs of
its members that aren't joined already are compared by the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import materialise, slices, small_batches, table
from ..operators.components import components

CHUNK = 1 << 16


@dataclass(frozen=True)
class SimHashParams:
    """words: of a shingle. longs: 64-bit parts of a fingerprint. lane_bits: 64, or at most 32 for
    candidate lanes, cut from the fingerprint's bits in turn. ball: flipped bits in each lane (half the lane's radius). distance: of
    the whole fingerprints at most. similarity: of the two sets of shingles (Jaccard) at least,
    verified on the sets themselves; 0 leaves it at the distance."""

    words: int = 3
    longs: int = 1
    lane_bits: int = 64
    ball: int = 1
    distance: int = 2
    similarity: float = 0.0

    def __post_init__(self):
        if not (self.lane_bits == 64 or 1 <= self.lane_bits <= 32) or self.ball not in (0, 1) or self.longs < 1 or self.words < 1:
            raise ValueError("lane_bits is 64 or 1 to 32, ball 0 or 1, words and longs at least 1")
        if self.longs == 1 and self.lane_bits == 64 and self.distance > 2 * self.ball:
            raise ValueError("a single lane finds no distance above twice its ball")


#: The contract of the query: 3-word shingles, 64 bits, links at 2 bits or fewer.
CONTRACT = SimHashParams()
#: Five words and a similarity of 0.8: fingerprints of 512 bits in 17 lanes of 30. Sets of similarity 0.8
#: have a cosine of 8/9, so each bit differs with probability acos(8/9)/pi = 0.15, 78 bits of 512
#: (deviation 8); unrelated texts differ in 256 (deviation 11). Such a pair meets in a lane (2 bits differ at most) with
#: probability 0.146, in one of 17 with 0.93; at similarity 0.85 with 0.99.
SIMILAR_08 = SimHashParams(words=5, longs=8, lane_bits=30, ball=1, distance=98, similarity=0.8)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash from a hash (a multiply-xorshift finaliser)."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """A 64-bit hash of each shingle. Bytes are split on the six ASCII spaces and only A-Z is lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    flat = b" ".join(w)
    starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) + 1))
    ends = np.append(starts[1:] - 1, len(flat))
    n = max(1, len(w) - words + 1)
    first, last = starts[:n], ends[min(words, len(w)) - 1 :][:n]
    out, digest = np.empty(n, np.uint64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        a, b = first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist()
        out[at : at + CHUNK] = np.fromiter((digest(flat[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
    return out


def _print(hashes: np.ndarray, longs: int) -> list[int]:
    """Signed 64-bit parts: each bit by majority of the shingles."""
    n, ones = len(hashes), np.zeros((longs, 64), np.int64)
    for at in range(0, n, CHUNK):
        h = hashes[at : at + CHUNK]
        for k in range(longs):
            bits = np.unpackbits(np.ascontiguousarray(_mix(h, k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: str | None, words: int = 3, longs: int = 1) -> list[int]:
    return _print(shingles(text, words), longs)


def _same(unique: np.ndarray) -> int:
    """One signed hash of a sorted set: equal sets, equal hashes."""
    h = xxhash.xxh3_64_intdigest(unique.tobytes())
    return h - (1 << 64) if h >> 63 else h


def fingerprints(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, f0, .., same): no other column is read. same is a hash of the set of shingles, 0 if none is verified."""
    names = [f"f{k}" for k in range(params.longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = np.zeros((b.num_rows, params.longs + 1), np.int64)
            for row, t in zip(f, b.column(1).to_pylist()):
                h = shingles(t, params.words)
                row[:-1] = _print(h, params.longs)
                row[-1] = _same(np.unique(h)) if params.similarity else 0
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(params.longs + 1))], ["doc_id", *names, "same"])

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ["doc_id", *names, "same"]])
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def verified(near: DataFrame, docs: DataFrame, distinct: DataFrame, params: SimHashParams) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity. Only the sets of nodes in a pair are made."""
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = distinct.join(nodes, "node", "left_semi").select("node", "same")
    few = small_batches(docs).select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            sets = [np.unique(shingles(t, params.words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_same(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "same", "hashes"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= params.similarity * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    # a node's rows: its own set only, once, where a doc_id comes with several texts
    sets = materialise(few.mapInArrow(run, "node long, same long, hashes binary").join(wanted, ["node", "same"], "left_semi").dropDuplicates(["node", "same"]), "simhash-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}set")) for x in "ab")
    return near.join(left, "a").join(right, "b").select("a", "b", "aset", "bset").mapInArrow(least, "a long, b long").distinct()


def _lanes(params: SimHashParams) -> list:
    """(lane key without flips) for each lane; bits that don't fill a last lane are left out."""
    if params.lane_bits == 64:
        return [F.col(f"f{k}") for k in range(params.longs)]
    out = []
    for lane in range(64 * params.longs // params.lane_bits):
        k, at = divmod(lane * params.lane_bits, 64)
        bits = F.shiftrightunsigned(f"f{k}", at)
        if at + params.lane_bits > 64:
            bits = bits.bitwiseOR(F.shiftleft(f"f{k + 1}", 64 - at))
        out.append(bits.bitwiseAND((1 << params.lane_bits) - 1).bitwiseOR(F.lit(lane << 32)))
    return out


def links(prints: DataFrame, params: SimHashParams, verify: Callable[[DataFrame], DataFrame] = lambda near: near) -> DataFrame:
    """Distinct fingerprints (f0, .., node) -> (a, b): nodes whose fingerprints are close.

    The balls carry a key and a node only; keys of a single node are left out. In a bucket each node is first paired
    with the next one, which joins all of a bucket of a single lane. Where a bucket is only a candidate group, all its
    pairs that these links haven't joined yet are compared too, so near copies aren't compared all with all.
    verify keeps those of the close pairs that are links.
    """
    names = [f"f{k}" for k in range(params.longs)]
    flips = [0] + ([1 << i if i < 63 else -(1 << 63) for i in range(params.lane_bits)] if params.ball else [])
    keys = F.array(*_lanes(params))
    balls = (
        prints.select("node", F.explode(keys).alias("lane"))
        .withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
        .select(F.col("lane").bitwiseXOR(F.col("flip")).alias("key"), "node")
    )
    w = Window.partitionBy("key").orderBy("node")
    met = balls.select("key", "node", F.lag("node").over(w).alias("last"), F.lead("node").over(w).alias("next"))
    left = prints.select(F.col("node").alias("a"), *[F.col(n).alias(f"a{n}") for n in names])
    right = prints.select(F.col("node").alias("b"), *[F.col(n).alias(f"b{n}") for n in names])
    distance = sum((F.bit_count(F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}"))) for n in names), F.lit(0))
    single = params.longs == 1 and params.lane_bits == 64
    if not single:
        met = materialise(met.where("last is not null or next is not null"), "simhash-met")
    pairs = met.where("last is not null").select(F.col("last").alias("a"), F.col("node").alias("b")).distinct()
    near = pairs.join(left, "a").join(right, "b").where(distance <= params.distance).select("a", "b")
    if single:
        return near
    near = materialise(verify(near), "simhash-near")
    crowded = met.groupBy("key").count().where("count > 2").select("key")
    rest = met.join(crowded, "key", "left_semi").select("key", "node").join(components(near), "node", "left").withColumn("group", F.coalesce("component", "node"))
    side = lambda x: rest.join(left if x == "a" else right, rest.node == F.col(x)).select("key", F.col("group").alias(f"{x}group"), x, *[f"{x}{n}" for n in names])
    more = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("agroup") != F.col("bgroup")) & (distance <= params.distance))
    tried = pairs.select("a", "b")
    return near.unionByName(verify(materialise(more.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "simhash-more")))


def near_duplicates(docs: DataFrame, params: SimHashParams = CONTRACT) -> DataFrame:
    """(doc_id, f0, .., component_id) for each row of docs.

    component_id is the smallest doc_id that links reach. A null or empty text has
    fingerprint zero and is linked like any other; a null doc_id keeps its row, with
    itself (null) as component unless its fingerprint's group has an id. Repeated rows stay. Texts of any length are
    hashed whole; ties don't arise. Only doc_id and text are read, so other columns are no matter. An empty table gives none.
    """
    names = [*(f"f{k}" for k in range(params.longs)), "same"]
    prints = materialise(fingerprints(docs, params), "simhash")
    distinct = materialise(prints.groupBy(*names).agg(F.min("doc_id").alias("node")), "simhash-distinct")
    known = distinct.where("node is not null")
    verify = (lambda near: verified(near, docs, known, params)) if params.similarity else (lambda near: near)
    found = components(links(known, params, verify))
    group = distinct.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.join(group, names).select("doc_id", *names[:-1], "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document stays, that with the smallest doc_id.

    Columns, also of names as used here, pass through. Null and empty texts are alike: one of them stays. Rows of null
    doc_id stay; rows that repeat a kept doc_id stay, too. Texts of any length are hashed whole. Empty in, empty out.
    """
    kept = near_duplicates(docs, SIMILAR_08).where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
