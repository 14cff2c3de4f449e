"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass finds the n-grams of the test items in each document, clusters them by item
and diagonal, and aligns the item to the passage around a cluster by words; the score
is the alignment's share of what a full match would give, so edited and paraphrased
copies count. Every n-gram is a seed, however common: a passage is only left unaligned
if too few of the item's words occur in it for the score, which is exact.

Benchmarks are small and their size is checked: seeds are broadcast in blocks of
at most `block` n-grams (one pass over the documents per block), so a benchmark of
any size runs. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, small_batches, table

#: ASCII bytes other than a-z and 0-9 end a word.
KEEP = bytes(c if c >= 128 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
TABLE_BITS = 20


@dataclass(frozen=True)
class DecontaminationParams:
    """n: words of a seed. rare: of no effect, n-grams are seeds in however many documents they are;
    kept for callers that give it. score: contaminated from this share of a full
    alignment. match, mismatch, gap: of words. block: n-grams per broadcast."""

    n: int = 4
    rare: int = 1000
    score: float = 0.6
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    block: int = 2_000_000


def normal(text: str | None) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(KEEP).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = base, inverse
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = _powers(1 << 12)


def word_hashes(flat: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose words are joined by single spaces: differences of
    polynomial prefix hashes (modulo 2**64), mixed. Equal words have equal hashes at every place."""
    global _POWERS
    b = np.frombuffer(flat, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    if len(_POWERS[0]) < len(b) + 1:
        _POWERS = _powers(2 * len(b))
    up, down = _POWERS
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=prefix[1:])
        gaps = np.flatnonzero(b == 32)
        s, e = np.concatenate(([0], gaps + 1)), np.append(gaps, len(b))
        h = (prefix[e] - prefix[s]) * down[s]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : len(words) - n + 1 + k]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class Lookup:
    """Members of a sorted array of hashes, most misses decided by a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - TABLE_BITS)
        self.some = np.zeros(1 << TABLE_BITS, bool)
        self.some[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, index of the key there)."""
        at = np.flatnonzero(self.some[(h >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        ok = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == h[at])
        return at[ok], k[ok]


def align(item: np.ndarray, passage: np.ndarray, p: DecontaminationParams) -> tuple[float, int, int]:
    """Smith-Waterman over word hashes: (best score / score of a full match, start, end in passage).

    Row by row over the item; the gaps along the passage are a running maximum.
    """
    m = len(passage)
    ramp = np.arange(m + 1) * -p.gap
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, where = 0, (0, 0)
    for w in item:
        step = np.where(passage == w, p.match, p.mismatch)
        diag, up = row[:-1] + step, row[1:] + p.gap
        cell = np.maximum(np.maximum(diag, up), 0)
        origin = np.where(cell == 0, np.arange(1, m + 1), np.where(diag >= up, start[:-1], start[1:]))
        full = np.concatenate(([0], cell))
        lifted = np.maximum.accumulate(full + ramp)
        source = np.maximum.accumulate(np.where(full + ramp == lifted, np.arange(m + 1), 0))
        row = lifted - ramp
        start = np.concatenate(([0], origin))[source]
        j = int(row.argmax())
        if row[j] > best:
            best, where = int(row[j]), (int(start[j]), j)
    return best / (p.match * max(1, len(item))), *where


def _items(benchmark: DataFrame, p: DecontaminationParams) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks: a block's n-grams are bounded, the benchmark isn't."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if block and size + n > p.block:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, score, start, end, n_words) of each pair of a document and an item it has: the
    best alignment, with its place in the document's normalised words.

    Items of fewer than n words seed with all their words. Null and empty texts have none.
    Repeated rows of docs give repeated rows, repeated items one. Rows of null item_id count as items.
    """
    found = None
    for block in _items(benchmark, params):
        part = _block(docs, block, params)
        found = part if found is None else found.unionByName(part)
    schema = "doc_id long, item_id long, score double, start int, end int, n_words int"
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _block(docs: DataFrame, block: list[tuple[int, str]], p: DecontaminationParams) -> DataFrame:
    spark = docs.sparkSession
    words = [word_hashes(b" ".join(normal(t))) for _, t in block]
    keep = [k for k, w in enumerate(words) if len(w)]
    ids, words = [block[k][0] for k in keep], [words[k] for k in keep]
    sizes = [min(p.n, len(w)) for w in words]
    grams = [gram_hashes(w, n) for w, n in zip(words, sizes)]
    lengths = sorted(set(sizes))
    thin = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeds: dict[int, list] = {n: [] for n in lengths}
    for item, (g, n) in enumerate(zip(grams, sizes)):
        seeds[n] += [(int(h), item, at) for at, h in enumerate(g)]
    pack = {}
    for n, rows in seeds.items():
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        pack[n] = (*np.unique(h, return_index=True), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    shared = spark.sparkContext.broadcast((pack, words, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, words, ids = shared.value
        looks = {n: Lookup(x[0]) for n, x in pack.items()}
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_hashes(b" ".join(normal(t)))
                hits: dict[int, list[int]] = {}
                for n, look in looks.items():
                    at, k = look.find(gram_hashes(w, n))
                    first, item, place = pack[n][1:]
                    end = np.append(first[1:], len(item))
                    for x, j in zip(at.tolist(), k.tolist()):
                        for y in range(first[j], end[j]):
                            hits.setdefault(int(item[y]), []).append(x - int(place[y]))  # where the item would start
                known = np.unique(w) if hits else w
                for item, starts in hits.items():
                    size, best = len(words[item]), (0.0, 0, 0)
                    if not _can_score(words[item], known, p):
                        continue
                    slack = size // 2 + 2
                    for lo, hi in _clusters(sorted(starts), slack):
                        a, z = max(0, lo - slack), min(len(w), hi + size + slack)
                        if not _can_score(words[item], np.unique(w[a:z]), p):
                            continue
                        score, s, e = align(words[item], w[a:z], p)
                        best = max(best, (score, -(a + s), a + e))
                    if best[0] >= p.score:
                        rows.append((d, ids[item], best[0], -best[1], best[2], len(w)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "score", "start", "end", "n_words"])

    return thin.mapInArrow(scan, "doc_id long, item_id long, score double, start int, end int, n_words int")


def _can_score(item: np.ndarray, known: np.ndarray, p: DecontaminationParams) -> bool:
    """Whether so many of the item's words are among a passage's (sorted) that an alignment may reach the score: it
    matches no other words, and mismatches and gaps add nothing."""
    if max(p.mismatch, p.gap) > 0:
        return True
    found = known[np.minimum(np.searchsorted(known, item), len(known) - 1)] == item
    return int(found.sum()) / len(item) >= p.score


def _clusters(starts: list[int], slack: int) -> list[tuple[int, int]]:
    out = [[starts[0], starts[0]]]
    for x in starts[1:]:
        if x - out[-1][1] <= slack:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that have a test item go.

    Columns, also of names as used here, pass through. Null and empty texts have no item and stay; rows of null doc_id go
    if one of them has an item, as rows of any one doc_id do. Texts of any length are read whole. Empty in, empty out.
    """
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad.doc_id), "left_anti")
