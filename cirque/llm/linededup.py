"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

Each text is a sequence of units: its lines, cut again after sentence ends, so that a
passage pasted into the middle of a line is still a run of whole units. Its suffixes are sorted by
their first 2, 4, 8, .. units: a round sorts the pairs (rank, rank 2^k units on) of all live suffixes over
ranges of the whole corpus, the place in that order is the next rank, and a suffix whose rank is its own
is dropped. Suffixes that are equal in their first m units stand together: an interval of the array
whose longest common prefixes are m units at least. Any m between 2^k and 2^(k+1) is looked up in the same sort,
by the two ranks that cover it; up to 8 units, by a hash. In each interval the first suffix is the first copy, the others are later ones.

Maximal repeated runs of `min_words` words are unions of minimal ones (from each start the shortest, to each end the
shortest), so intervals of these lengths tell all that is deleted, and no round goes beyond `min_words` units.

Sorts are by range with the place as last key, so an interval with a third of all rows is spread over partitions;
what crosses a partition's end is settled from one row per partition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_rows, materialise, slices, small_batches, table, words_of

#: Units keep their separator at their end: joined they are the text.
CUT = re.compile(rb"(?<=\n)|(?<=[.!?] )")
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class LineDedupParams:
    """min_words: a repeated run is deleted from this many words (1 to 62). A passage of over 50 words that was
    pasted into the middle of lines has only its whole sentences in common, hence the lower bound."""

    min_words: int = 16

    def __post_init__(self):
        if not 1 <= self.min_words <= 62:
            raise ValueError("min_words is 1 to 62")


def units_of(text: bytes) -> list[bytes]:
    """As CUT.split(text), by marks where no mark is in the text already."""
    if b"\0" in text:
        return CUT.split(text)
    for end in (b"\n", b". ", b"! ", b"? "):
        text = text.replace(end, end + b"\0")
    return text.split(b"\0")


def wanted(w: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, need) for each unit, of w words and in the document doc (equal numbers side by side). Bit m of bits: the run of
    m units from here is a minimal one, that is, the shortest from its start or to its end with min_words words. Bit k of need:
    the rank of the first 2^k units from here (k at least 3) names a longer such run, by itself or by ranks made of it."""
    n, i = len(w), np.arange(len(w))
    bits, need = np.zeros(n, np.int64), np.zeros(n, np.int8)
    if not n:
        return bits, need
    total = np.concatenate(([0], np.cumsum(w)))
    ends = np.searchsorted(total, total[:-1] + min_words)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    fwd = (ends <= n) & (doc[np.minimum(ends, n) - 1] == doc)
    bwd = (starts >= 0) & (doc[np.maximum(starts, 0)] == doc)
    s, length = np.concatenate((i[fwd], starts[bwd])), np.concatenate(((ends - i)[fwd], (i + 1 - starts)[bwd]))
    runs = {m: s[length == m] for m in np.unique(length).tolist()}
    for m, at in runs.items():
        bits[at] |= 1 << m
    above = np.zeros(0, np.int64)  # starts whose first 2^(k+1) units want a rank
    for k in range(max([2, *runs]).bit_length(), FIRST.bit_length() - 2, -1):
        at = [x for m, found in runs.items() if 1 << k < m <= 2 << k for x in (found, found + m - (1 << k))]
        above = np.unique(np.concatenate([*at, above, above + (1 << k)]).astype(np.int64))
        need[above] |= np.int8(1 << k)
    return bits, need


ROWS = "a long, b long, m byte, doc_id long, th int, pos int, bits long, need byte"


def _rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "m", "doc_id", "th", "pos", "bits", "need"])


def units(docs: DataFrame, params: LineDedupParams) -> DataFrame:
    """Rows of the first sort: each minimal run of m units up to FIRST, and each FIRST units whose rank is needed; a is
    their hash. th is half of the text's hash; rows of equal doc_id and text are one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, th_of = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for b in slices(batches):
            ids, texts, lids, words, counts, hashes = b.column(0).fill_null(NO_ID).to_numpy(), b.column(1).to_pylist(), [], [], [], []
            for t in texts:
                found = [(u, n) for u in units_of(t) if (n := len(u.split()))] if t else []
                lids += [h(u.strip()) for u, _ in found]
                words += [n for _, n in found]
                counts.append(len(found))
                hashes.append(th_of(t, 42) if found else 0)
            lid, w, number = np.array(lids, np.uint64), np.array(words, np.int64), np.repeat(np.arange(len(texts)), counts)
            pos = np.arange(len(lid)) - np.repeat(np.cumsum(counts) - counts, counts)
            bits, need = wanted(w, number, params.min_words)
            th = np.array(hashes, np.uint64).view(np.int64) >> 32  # the upper half of Spark's xxhash64()
            parts, name, n = [], lid, len(lid)
            for m in range(1, FIRST + 1):
                at = np.flatnonzero((bits >> m & 1) | (need >> LEVEL[m] & 1))
                parts.append((name[at].view(np.int64), np.zeros(len(at), np.int64), np.full(len(at), m, np.int8), ids[number[at]], th[number[at]].astype(np.int32), pos[at].astype(np.int32), bits[at], need[at] if m == FIRST else np.zeros(len(at), np.int8)))
                with np.errstate(over="ignore"):  # names of one unit more; those beyond a document's end are never used
                    name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.append(lid[m:], np.zeros(min(m, n), np.uint64))))
            yield _rows(*(np.concatenate(c) for c in zip(*parts)))

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8")).mapInArrow(run, ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Units whose order is by a hash; rounds double from there.
FIRST = 8
PLACED = "part int, start long, head boolean, edge byte, m byte, doc_id long, th int, pos int, bits long, need byte, note string"
#: k by m = 2^k units, 7 for other lengths: no rank is needed of those.
LEVEL = np.array([m.bit_length() - 1 if m > 1 and m & (m - 1) == 0 else 7 for m in range(64)], np.int8)


def ranked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None, Ends]:
    """Sorts the rows by (a, b, m) over ranges; those with equal keys are an interval. Intervals of one row go. Gives
    (later copies: doc_id, th, pos, m; suffixes whose rank is needed: doc_id, th, pos, bits, need, part, start, or None; what
    makes ranks of part and start)."""
    keys = ["a", "b", "m", "doc_id", "th", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None  # the last row: whether its interval goes on isn't known yet
        first = last = None
        count = start = going = 0

        def emit(cols: list[np.ndarray], at_end: bool) -> pa.RecordBatch:
            """All rows but the last, which is held back, or all of them at the partition's end."""
            nonlocal start, last, count, going
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
            # one document may come in several rows of the table: its suffix is one
            twin = same & (cols[3][1:] == cols[3][:-1]) & (cols[4][1:] == cols[4][:-1]) & (cols[5][1:] == cols[5][:-1])
            if twin.any():
                stay = np.append(~twin, True)
                cols = [c[stay] for c in cols]
                same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
            size = len(cols[0]) if at_end else len(cols[0]) - 1
            key = tuple(int(c[0]) for c in cols[:3])
            head = np.append(last != key, ~same)[:size] if len(cols[0]) else np.zeros(0, bool)
            after = np.append(same, False)[:size]
            index = count + np.arange(size)
            begin = np.maximum(np.maximum.accumulate(np.where(head, index, -1)), start) if size else index
            if size:
                start, last = int(begin[-1]), tuple(int(c[size - 1]) for c in cols[:3])
            alone = head & ~after
            edge = np.where(alone, (index == 0) + 2 * ((index == count + size - 1) & at_end), 0)
            count += size
            on = (cols[7][:size] >> LEVEL[cols[2][:size]]) & 1 == 1
            use = (~alone | (edge > 0)) & (((cols[6][:size] >> cols[2][:size]) & 1 == 1) | on)
            going += int((use & on).sum())
            arrays = [np.full(int(use.sum()), part), begin[use], head[use], edge[use], *(c[:size][use] for c in cols[2:])]
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int8(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8())
            return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(arrays, kinds)), pa.nulls(int(use.sum()), pa.string())], NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in range(8)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            first = first or tuple(int(c[0]) for c in cols[:3])
            out = emit(cols, False)
            held = [c[-1:] for c in cols]
            yield out
        if held is not None:
            out = emit(held, True)
            yield out
            note = json.dumps([count, first, last, start, going])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.nulls(1, out.schema.field(k).type) for k in range(1, 10)), pa.array([note])], NAMES)

    NAMES = ["part", "start", "head", "edge", "m", "doc_id", "th", "pos", "bits", "need", "note"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)  # later rounds are small: AQE joins their ranges
    placed = materialise(ordered.mapInArrow(run, PLACED), name)
    ends, going = _ends(placed)
    d = placed.where("note is null")
    goes_on = (F.col("start") == 0) & F.col("part").isin(ends.joins_last)
    alive = (F.col("edge") == 0) | goes_on | ((F.col("edge") >= 2) & F.col("part").isin(ends.joins_next))
    mine = F.expr("shiftright(bits, m) & 1") == 1
    later = d.where(mine & (~F.col("head") | goes_on)).select("doc_id", "th", "pos", "m")
    on = F.lit(False)
    for m, k in enumerate(LEVEL.tolist()):
        on = on | (F.col("m") == m) & (F.col("need").bitwiseAND(1 << k) != 0) if k < 7 else on
    longer = d.where(alive & on).select("doc_id", "th", "pos", "bits", "need", "part", "start")
    return later, longer if going else None, ends


@dataclass(frozen=True)
class Ends:
    """What crosses the ends of partitions, a few numbers for each: the rank of a partition's first interval and of the
    others' start 0; the partitions whose first interval goes on from the one before, and whose last one goes on."""

    first: np.ndarray
    base: np.ndarray
    joins_last: list[int]
    joins_next: list[int]

    def rank(self, part: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.where(start == 0, self.first[part], self.base[part] + start)


def _ends(placed: DataFrame) -> tuple[Ends, int]:
    """(ends, rows that go on at most) from the partitions' notes: one row each comes to the driver."""
    notes = sorted((r["part"], *json.loads(r["note"])) for r in placed.where("note is not null").select("part", "note").collect())
    size = notes[-1][0] + 1 if notes else 0
    ends = Ends(np.zeros(size, np.int64), np.zeros(size, np.int64), [], [])
    count_so_far, last_key, last_part, last_rank, on = 0, None, 0, 0, 0
    for part, count, first, last, start, going in notes:
        if first == last_key:
            ends.joins_next.append(last_part)
            ends.joins_last.append(part)
        ends.base[part], ends.first[part] = count_so_far, last_rank if first == last_key else count_so_far
        last_key, last_part, last_rank = last, part, int(ends.first[part]) if start == 0 else count_so_far + start
        count_so_far, on = count_so_far + count, on + going
    return ends, on


def doubled(longer: DataFrame, units_ranked: int, ends: Ends) -> DataFrame:
    """Rows of the next sort from suffixes ranked by their first so many units: pairs of ranks for twice as many, and for
    each wanted run of a length between."""
    size = units_ranked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(doc, th, pos, bits, need, part, begin):
            rank = ends.rank(part, begin)
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
            place = np.cumsum(new) << 32 | pos  # ascending: rows are sorted by document and place
            parts = []
            for m in range(size + 1, min(2 * size, 62) + 1):
                start = np.flatnonzero((bits >> m & 1) | (need >> LEVEL[m] & 1))
                if len(start):
                    to = place[start] + (m - size)
                    k = np.minimum(np.searchsorted(place, to), len(place) - 1)
                    ok = place[k] == to
                    start, k = start[ok], k[ok]
                    parts.append((rank[start], rank[k], np.full(len(start), m), doc[start], th[start], pos[start], bits[start], need[start] if m == 2 * size else np.zeros(len(start), np.int8)))
            return _rows(*(np.concatenate(c) for c in zip(*parts))) if parts else None

        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(k).to_numpy() for k in range(7)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            open_ = (part[0] == part[0][-1]) & (part[1] == part[1][-1])  # the last document may go on
            cut = int(len(open_) - np.argmin(open_[::-1])) if not open_.all() else 0
            rest = [x[cut:] for x in part]
            if cut and (out := emit(*(x[:cut] for x in part))) is not None:
                yield out
        if rest is not None and (out := emit(*rest)) is not None:
            yield out

    by_doc = longer.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "pos")
    return by_doc.mapInArrow(run, ROWS)


def deletions(docs: DataFrame, params: LineDedupParams) -> DataFrame:
    """(doc_id, th, gone): for each document with later copies, their places, times 64, plus their units."""
    first, size = materialise(units(docs, params), "line-units"), FIRST
    with arrow_rows(docs.sparkSession, 10_000):  # the rounds run here
        later, longer, ends = ranked(first, "line-ranks")
        while longer is not None:
            more, longer, ends = ranked(doubled(longer, size, ends), "line-ranks")
            later, size = later.unionByName(more), 2 * size
    run = F.shiftleft(F.col("pos").cast("long"), 6).bitwiseOR(F.col("m").cast("long"))
    return later.groupBy("doc_id", "th").agg(F.collect_list(run).alias("gone"))  # bounded by the document's units


def cleaned(text: str, gone: list) -> tuple[str, int, int]:
    """The text without the units in gone, how many, and their words."""
    drop: set[int] = set()
    for g in set(gone):
        drop.update(range(g >> 6, (g >> 6) + (g & 63)))
    out, k, lost, dropped = [], 0, 0, False
    for u in units_of(text.encode()):
        w = len(u.split())
        if w:
            dropped = k in drop
            lost += w * dropped
            k += 1
        if not dropped:
            out.append(u)
        elif u.endswith(b"\n") and out and not out[-1].endswith(b"\n"):
            out.append(b"\n")  # the line that began before the run still ends
    return b"".join(out).decode().rstrip("\n ") if lost else text, len(drop), lost


def dedup(docs: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """docs with `text` cleaned and the columns n_deleted (units) and words_deleted.

    "First" is by (doc_id, place): of equal runs that with the smallest doc_id stays; a null
    doc_id counts as smallest. Rows of equal doc_id and text are one document and get the
    same text. Null and empty texts stay as they are. Other columns pass through, also those
    named like this operator's own (except n_deleted and words_deleted, which are replaced).
    """
    gone = deletions(docs, params).select(F.col("doc_id").alias("__ld_id"), F.col("th").alias("__ld_th"), F.col("gone").alias("__ld_gone"))
    keep = [c for c in docs.columns if c not in ("n_deleted", "words_deleted")]
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__ld_id"), F.shiftright(F.xxhash64("text"), 32).cast("int").alias("__ld_th")
    )
    joined = keyed.join(gone, ["__ld_id", "__ld_th"], "left")

    @F.pandas_udf("text string, n_deleted int, words_deleted int")
    def clean(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if g is None else cleaned(t, g.tolist()) for t, g in zip(text, gone)]
        return pd.DataFrame(rows, columns=["text", "n_deleted", "words_deleted"])

    touched = F.col("__ld_gone").isNotNull()
    out = joined.withColumn("__ld", clean(F.when(touched, F.col("text")), "__ld_gone"))  # other texts stay in the JVM
    columns = [F.when(touched, F.col("__ld.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in keep]
    return out.select(*columns, F.col("__ld.n_deleted").alias("n_deleted"), F.col("__ld.words_deleted").alias("words_deleted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted", "words_deleted")


#: A document of which less than this share of words is left is a copy with a few sentences changed: it goes.
LEAST_LEFT = 0.2


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: cleaned texts with their new n_chars (if docs have it); documents that lost text and have less than
    LEAST_LEFT of their words left go.

    Columns, also of names as used here, pass through. Null and empty texts stay as they are. Rows of equal doc_id and
    text are one document; ties go to the smallest doc_id, null first. Texts of any length are cut whole. Empty in, empty out.
    """
    out = dedup(docs)
    left = F.size(words_of(F.col("text")))
    out = out.where((F.col("n_deleted") == 0) | ((left > 0) & (left >= LEAST_LEFT * (left + F.col("words_deleted")))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
