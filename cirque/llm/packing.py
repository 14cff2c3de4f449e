"""Pattern packing: documents as token pieces, packed into sequences of a fixed length.

Pieces are counted by length (a histogram of at most `capacity` bins, whatever the
corpus). Patterns of one to three lengths that fill a sequence are enumerated,
repeat counts are fitted to the histogram by non-negative least squares, rounded
down and held to what is there; residuals are packed by best fit over the
histogram, also as repeated patterns. The plan is therefore bounded by the capacity,
and each piece finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, slices, small_batches, table
from .sharding import ranked

#: ASCII punctuation but the apostrophe, which begins contractions.
TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Kinds of bytes: 1 a-z and 0-9, 2 common marks after a word, 4 ASCII white space.
KIND = np.zeros(256, np.uint8)
KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")], KIND[list(b".,;:!?)")], KIND[list(b" \t\n\x0b\x0c\r")] = 1, 2, 4
#: Chunks that a worker remembers at most, from task to task (some 40 bytes each), in a table of 2 ** TABLE_BITS places.
CACHE, TABLE_BITS = 700_000, 21
#: Bytes of text that are cut, hashed and looked up at once.
BLOCK = 1 << 18


@dataclass(frozen=True)
class PackParams:
    """capacity: tokens of a sequence. tokenizer: path of a tokenizers file whose pre-tokenizer
    never joins across white space. separator: id after each document. step: of the second
    length in patterns of three. rounds: of the least-squares fit."""

    tokenizer: str
    capacity: int = 2048
    separator: int = 0
    step: int = 16
    rounds: int = 400


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Cutter:
    """Where the chunks of a text are, and a 64-bit hash of each: differences of polynomial prefix hashes modulo 2**64,
    mixed with the length. Chunks end at white space, and before a single mark that stands between a letter or digit and
    white space: there the pre-tokenizer always cuts, and words with and without marks are the same chunk."""

    def __init__(self):
        self.up, self.down = _powers(BLOCK + 1)

    def cut(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of a text's bytes, which end with white space."""
        kind = KIND[text]
        word, mark = kind != 4, np.zeros(len(text), bool)
        mark[1:-1] = (kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 4)
        edge = np.empty(len(text), bool)
        edge[0], edge[1:] = True, ~word[:-1]
        starts = np.flatnonzero(word & (edge | mark))
        edge[-1], edge[:-1] = True, ~word[1:] | mark[1:]
        ends = np.flatnonzero(word & edge) + 1
        return starts, ends, self.hash(text, starts, ends)

    def hashes(self, chunks: list[bytes]) -> np.ndarray:
        """Of chunks as they are."""
        out = [np.zeros(0, np.uint64)]
        for at in range(0, len(chunks), 1 << 14):
            ends = np.cumsum(np.fromiter(map(len, chunks[at : at + (1 << 14)]), np.int64))
            out.append(self.hash(np.frombuffer(b"".join(chunks[at : at + (1 << 14)]), np.uint8), np.concatenate(([0], ends[:-1])), ends))
        return np.concatenate(out)

    def hash(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(text) >= len(self.up):
            self.up, self.down = _powers(len(text) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(text) + 1, np.uint64)
            np.cumsum((text + np.uint64(1)) * self.up[: len(text)], out=prefix[1:])
            h = (prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.maximum(h, np.uint64(1))  # 0 marks a free place


class Encoder:
    """Token ids of a text, by chunk between ASCII spaces; chunks are known by their hashes, up to a bound.

    The normaliser maps white space to one space, the pre-tokenizer drops it and no rule crosses it, so ids of chunks
    one after another are those of the text (but for a collision of 64-bit hashes among the chunks a worker remembers).
    Texts with what may be a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cutter = Tokenizer.from_file(path), Cutter()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.letters, self.others = set("abcdefghijklmnopqrstuvwxyz"), set()
        self.keys, self.codes = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.flat, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.forget()

    def forget(self) -> None:
        """ids of the chunk of a code are flat[first[code]:][:size[code]]."""
        self.keys[:] = 0
        self.known = self.used = 0

    def spelt(self, text: str) -> bool:
        """Whether each character, once normalised, is letters alone to this pre-tokenizer: it ends apart from
        punctuation after it and joins a letter before it. (Lower case or composition may turn a letter into others.)"""
        if not self.letters.issuperset(text):
            for char in set(text) - self.letters - self.others:
                normal = self.tokenizer.normalizer.normalize_str(char)
                cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
                letter = bool(normal.strip()) and len(cut("a" + normal)) == 1 and len(cut("a" + normal + ".")) == 2
                (self.letters if letter else self.others).add(char)
            return self.letters.issuperset(text)
        return True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Codes, -1 where unknown: linear probing."""
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == hashes, self.codes[at], np.int32(-1)).astype(np.int64)
        todo = np.flatnonzero((seen != hashes) & (seen != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << TABLE_BITS) - 1)
            seen, mine = self.keys[at], hashes[todo]
            hit = seen == mine
            out[todo[hit]] = self.codes[at[hit]]
            on = ~hit & (seen != 0)
            todo, at = todo[on], at[on]
        return out

    def add(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Different chunks with their ids."""
        n, ids = len(hashes), len(flat)
        while self.known + n > len(self.first):
            self.first, self.size = np.concatenate((self.first, self.first)), np.concatenate((self.size, self.size))
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        code = np.arange(self.known, self.known + n, dtype=np.int32)
        self.first[code], self.size[code] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + ids] = flat
        self.known, self.used = self.known + n, self.used + ids
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(code):
            free = self.keys[at] == 0
            self.keys[at[free]], self.codes[at[free]] = hashes[free], code[free]  # of several for a place one gets it
            on = self.keys[at] != hashes
            hashes, code, at = hashes[on], code[on], (at[on] + 1) & ((1 << TABLE_BITS) - 1)

    def add_each(self, chunks: list[bytes]) -> None:
        ids = [self.tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in chunks]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.add(self.cutter.hashes(chunks), np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def add_words(self, words: list[bytes]) -> None:
        """Words of letters alone are one pre-token each: many are encoded as one text, whose tokens
        that end a word part it again. Where the count of these differs, each word is encoded alone."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self.add(self.cutter.hashes(part), ids, np.diff(ends, prepend=0))
            else:
                self.add_each(part)

    def learn(self, chunks: list[bytes]) -> None:
        """ASCII punctuation (but apostrophes) after a letter is always one pre-token apart from what is before."""
        core_of = {c: core for c in chunks if c[-1] in TAIL and (core := c.rstrip(TAIL)) and self.spelt(core.decode()[-1])}
        alone = list(dict.fromkeys(chain((c for c in chunks if c not in core_of), core_of.values(), (c[len(core) :] for c, core in core_of.items()))))
        alone = [c for c, k in zip(alone, self.find(self.cutter.hashes(alone)).tolist()) if k < 0]
        words = [self.spelt(c.decode()) for c in alone]
        self.add_words([c for c, w in zip(alone, words) if w])
        self.add_each([c for c, w in zip(alone, words) if not w])
        if core_of:
            code = self.find(self.cutter.hashes([x for c, core in core_of.items() for x in (core, c[len(core) :])]))
            self.add(self.cutter.hashes(list(core_of)), self.joined(code), self.size[code].reshape(-1, 2).sum(1))

    def chunks(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(starts, codes) of the chunks of a text that ends with white space, block by block."""
        starts, codes, at = [], [], 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:
                space = [text.rfind(c, at, at + BLOCK) for c in (b" ", b"\n")]
                if max(space) < 0:  # no space in a block's length: up to the next one
                    space = [min((k for k in (text.find(c, at + BLOCK) for c in (b" ", b"\n")) if k >= 0), default=end - 1)]
                end = max(space) + 1
            block = np.frombuffer(text, np.uint8, end - at, at)
            s, e, h = self.cutter.cut(block)
            code = self.find(h)
            new = np.flatnonzero(code < 0)
            if len(new):
                once = new[np.unique(h[new], return_index=True)[1]]
                self.learn([text[at + i : at + j] for i, j in zip(s[once].tolist(), e[once].tolist())])
                code[new] = self.find(h[new])
            starts.append(s + at)
            codes.append(code)
            at = end
        return (np.concatenate(starts), np.concatenate(codes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        if self.known > CACHE:
            self.forget()
        # the normaliser lower-cases; doing so for A-Z beforehand makes fewer different chunks. Not where marks (U+0300 to
        # U+036F) may follow: some compose with one case of a letter only, and the normaliser composes first
        low = [b"" if b"<|" in t else t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        starts, code = self.chunks(b"".join(x for t in low for x in (t, b"\n")))
        ids = self.joined(code)
        size = np.concatenate(([0], np.cumsum(self.size[code])))
        cuts = size[np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in low)]))].tolist()
        return [self.whole(t) if b"<|" in t else ids[a:b] for t, a, b in zip(texts, cuts, cuts[1:])]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def joined(self, code: np.ndarray) -> np.ndarray:
        size = self.size[code]
        end = np.cumsum(size)
        at = np.repeat(self.first[code] - (end - size), size)
        return self.flat[at + np.arange(len(at))]


_ENCODERS: dict[str, Encoder] = {}  # of this worker process


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a block's bytes in all, or of one longer text."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > BLOCK:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def pieces(docs: DataFrame, params: PackParams) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a null or empty text is the separator alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cap = encoder(params.tokenizer), params.capacity
        for b in slices(batches):
            rows: list[tuple] = []
            ids_of, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            for at, to in together(texts):
                for doc, ids in zip(ids_of[at:to], enc.batch(texts[at:to])):
                    ids = np.append(ids, np.uint32(params.separator)).astype("<u4")
                    rows += [(doc, k, s, len(ids[s : s + cap]), zlib.crc32(ids[s : s + cap].tobytes())) for k, s in enumerate(range(0, len(ids), cap))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int, step: int) -> np.ndarray:
    """Rows of up to three present lengths (descending, 0: none) that fill a sequence exactly."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [(capacity, 0, 0)] if have[capacity] else []
    a = np.arange(1, capacity)
    two = a[have[a] & have[capacity - a] & (a >= capacity - a)]
    out += [(x, capacity - x, 0) for x in two.tolist()]
    small = [b for b in lengths.tolist() if b % step == 0 or b <= step]
    for b in small:
        x = a[(a >= b) & (capacity - a - b >= 1) & have[a]]
        x = x[have[capacity - x - b] & (x >= capacity - x - b)]
        out += [(int(v), *sorted((b, capacity - int(v) - b), reverse=True)) for v in x.tolist()]
    return np.array(sorted(set(out), reverse=True), np.int64).reshape(-1, 3)


def fit(pats: np.ndarray, histogram: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: counts x of the patterns so
    that the lengths they use come near the histogram. Long lengths weigh more: a short piece
    left over fits in elsewhere, a long one needs a sequence of its own."""
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0
    use = lambda x: np.bincount(pats.ravel(), np.repeat(x, 3), size)
    target, w2 = histogram.astype(float), weight**2
    # the largest eigenvalue of A'WA by power iteration
    v = np.ones(len(pats))
    for _ in range(20):
        v = (w2 * use(v))[pats].sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        x1 = np.maximum(0, y - (w2 * (use(y) - target))[pats].sum(1) / (1.05 * top))
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = x1, x1 + (t - 1) / t1 * (x1 - x), t1
    return x


def plan(histogram: np.ndarray, params: PackParams) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """[(lengths of a sequence, how many such sequences)], and how many sequences in all."""
    left, out = histogram.astype(np.int64).copy(), []
    pats = patterns(np.flatnonzero(left), params.capacity, params.step)
    if len(pats):
        x = np.floor(fit(pats, left, params.rounds) + 1e-6).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            used = {v: c for v, c in zip(*np.unique(pats[p][pats[p] > 0], return_counts=True))}
            n = int(min([x[p], *(left[v] // c for v, c in used.items())]))
            if n > 0:
                out.append((tuple(int(v) for v in pats[p] if v), n))
                for v, c in used.items():
                    left[v] -= c * n
    # residuals: best fit, the longest piece first; a composition repeats while its lengths last
    while left.any():
        room, use = params.capacity, {}
        parts = []
        free = left.copy()
        while True:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            parts.append(v)
            free[v] -= 1
            use[v] = use.get(v, 0) + 1
            room -= v
        n = min(int(left[v] // c) for v, c in use.items())
        for v, c in use.items():
            left[v] -= c * n
        out.append((tuple(parts), n))
    return out, sum(n for _, n in out)


def placements(made: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: pieces of that length
    with ranks from there on go, one each, to consecutive sequences at that offset."""
    rows, next_rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for parts, n in made:
        offset = 0
        for v in parts:
            rows.append((v, int(next_rank[v]), sequence, offset))
            next_rank[v] += n
            offset += v
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the separator alone. Repeated rows and rows of null doc_id are packed each; ties in length
    go by doc_id, then piece. Very long texts are encoded whole and cut after. Only doc_id and text are read, so other
    columns (of clashing names, too) are no matter. An empty table gives an empty result.
    """
    found = materialise(pieces(docs, params), "pack-pieces")
    bins = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(params.capacity + 1, np.int64)
    for r in bins:
        histogram[r["length"]] = r["n"]
    made, _ = plan(histogram, params)
    where = placements(made, params.capacity)
    first = np.concatenate(([0], np.cumsum(histogram)))[: params.capacity + 1]  # rank of the first piece of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = where[:, 0] << 44 | where[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            rank = rank - first[length]
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            cols = [b.column(b.schema.names.index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            seq, off = (where[at, 2] + rank - where[at, 1], where[at, 3]) if len(where) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = ranked(found, ["length", "doc_id", "piece", "ids_crc32"], "pack-order")
    return order.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def default_params() -> PackParams:
    import public_tokenizers

    return PackParams(tokenizer=str(public_tokenizers.path("word_bpe_49k.json")))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_params())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the pieces of pack() with its columns; what it does with nulls, ties and the rest, so does this."""
    return pack(docs, default_params())
