"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
tabs. A batch of texts becomes one buffer in which one blank follows each word; a prefix polynomial over its bytes (numpy,
modulo 2^64) gives the fingerprint of every run of words as a difference of two places, whatever the run's length.

Three passes over the texts, each with map-side sums before the shuffle:

1. fingerprints of single words and pairs; those that reach ``least`` are kept;
2. fingerprints of longer runs all of whose pairs were kept, as a run is never more frequent than a part of it;
3. occurrences with a kept fingerprint. Their occurrence pointers are byte ranges in the batch at hand: equal
   fingerprints are compared byte by byte with the text at the first pointer, and what differs is counted on its
   own. One text per batch and fingerprint is shuffled, and sums are by text. So collisions can only let a rare
   phrase into this pass, which the exact count then drops.

What was kept is known to tasks as a bit map of at most ``MOST_BITS``. It may hold more than was kept, never less:
beyond that size passes 2 and 3 ship more, and results stay the same.

Null texts are empty, a null ``lang`` is ``und``; repeated rows count each time; other columns are ignored; an empty
table gives an empty result. Long texts are worked on in blocks that overlap by the words a run may go on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagledger.llm.shared import map_batches, store

#: Bytes of text in a block; a longer word makes it longer.
BLOCK = 2 << 20
#: Bits per kept fingerprint, and the most bits there are (32 MB, which bounds what is broadcast).
BITS_EACH = 16
MOST_BITS = 1 << 28
#: Groups that a language's candidates are ranked in first, so that no task ranks all of them.
RANK_GROUPS = 64
#: Bytes to lower-case letters, blanks and piece ends.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_DIGITS = np.random.default_rng(17).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(size: int):
    """Powers of the base and of its inverse; a worker keeps them up to the longest block so far."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS.clear()
        size = max(size, BLOCK + BLOCK // 8)
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


class Words:
    """The words of a block. Those that begin before ``own`` are its own; the rest follow in the next one."""

    def __init__(self, data: bytes, own: int, places: list[int], langs: list[str]):
        raw = np.frombuffer(data, np.uint8)
        word = (raw != 32) & (raw != 10)
        after = np.zeros_like(word)
        after[1:] = word[:-1]
        starts, ends = np.flatnonzero(word & ~after), np.flatnonzero(~word & after)
        kept = word | after
        at = np.cumsum(kept, dtype=np.int64) - 1
        self.bytes = np.zeros(int(kept.sum()) + 8, np.uint8)  # room for reading eight at a time
        self.bytes[:-8] = raw[kept]
        self.start, self.end = at[starts], at[ends]
        self.bytes[self.end] = 32
        self.piece = np.cumsum(raw == 10)[starts]
        self.own = int(np.searchsorted(starts, own))
        self.names, text_lang = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = text_lang[np.searchsorted(np.array(places), starts, "right") - 1]
        self.seed = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in self.names], np.uint64)
        size = len(self.bytes) - 8
        up, down = _powers(size)
        self.prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(_DIGITS[self.bytes[:-8]] * up[:size], dtype=np.uint64, out=self.prefix[1:])
        self.down = down

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of n words that stand in one piece."""
        last = len(self.start) - n + 1
        own = min(self.own, max(last, 0))
        return np.flatnonzero(self.piece[:own] == self.piece[n - 1:n - 1 + own])

    def fingerprints(self, first: np.ndarray, n: int) -> np.ndarray:
        start = self.start[first]
        found = (self.prefix[self.end[first + (n - 1)]] - self.prefix[start]) * self.down[start] ^ self.seed[self.lang[first]]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        return found ^ found >> np.uint64(29)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the runs that begin at words a and b (of n words each) of one language and equal byte by byte?"""
        size = self.end[a + n - 1] - self.start[a]
        equal = (size == self.end[b + n - 1] - self.start[b]) & (self.lang[a] == self.lang[b])
        eights = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes.data, strides=(1,))
        left, at = np.flatnonzero(equal), 0
        while len(left):
            more = size[left] - at
            apart = eights[self.start[a[left]] + at] ^ eights[self.start[b[left]] + at]
            unseen = (8 - np.minimum(more, 8)).astype(np.uint64) * np.uint64(8)
            equal[left[apart << unseen != 0]] = False
            at += 8
            left = left[(size[left] > at) & equal[left]]
        return equal

    def texts(self, first: np.ndarray, n: np.ndarray) -> pa.StringArray:
        start = self.start[first]
        sizes = self.end[first + n - 1] - start
        stops = np.cumsum(sizes)
        where = np.arange(int(sizes.sum())) + np.repeat(start - (stops - sizes), sizes)
        offsets = np.concatenate([[0], stops]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self.bytes[where]))


def _blocks(batches, longest: int):
    """Words of batches of (text as bytes, lang)."""
    ahead = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % (longest - 1))
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        held, names, places, size = [], [], [], 0
        for text, lang in zip(texts, langs):
            if held and size + len(text) > BLOCK:
                yield Words(b"".join(held).translate(_TABLE), size, places, names)
                held, names, places, size = [], [], [], 0
            if len(text) <= BLOCK:
                places.append(size)
                names.append(lang)
                held += [text, b"\n"]
                size += len(text) + 1
                continue
            data, at = text.translate(_TABLE) + b"\n", 0
            while at < len(data):
                ends = [p for p in (data.find(b" ", at + BLOCK), data.find(b"\n", at + BLOCK)) if p >= 0]
                stop = min(ends, default=len(data) - 1) + 1
                yield Words(data[at:ahead.match(data, stop).end()] + b"\n", stop - at, [0], [lang])
                at = stop
        if held:
            yield Words(b"".join(held).translate(_TABLE), size, places, names)


class Kept:
    """A bit map of kept fingerprints, by their leading bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def has(self, found: np.ndarray) -> np.ndarray:
        place = found >> self.shift
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _kept(heavy: DataFrame):
    """The bit map of a stored table of fingerprints, built by executors in parts of 32,768 bits."""
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS_EACH * heavy.count()):
        bits *= 2
    place = F.shiftrightunsigned("fp", 64 - (bits.bit_length() - 1)) + 1
    parts = heavy.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most MOST_BITS in all
        out[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return heavy.sparkSession.sparkContext.broadcast(out)


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def _heavy(docs: DataFrame, longest: int, least: int, sizes, kept=None) -> DataFrame:
    """Fingerprints of runs of the given sizes that reach ``least``, stored. With ``kept``, only runs whose pairs of
    words are all kept are looked at."""
    def run(batches):
        known = Kept(kept.value) if kept else None
        for words in _blocks(batches, longest):
            found = []
            pairs = np.zeros(len(words.start) + 1, bool)
            if known:
                for first in np.array_split(np.arange(max(len(words.start) - 1, 0)), 4):
                    one = first[words.piece[first] == words.piece[first + 1]]
                    pairs[one] = known.has(words.fingerprints(one, 2))
            for n in sizes:
                first = words.runs(n)
                if known:
                    for k in range(n - 1):
                        first = first[pairs[first + k]]
                found.append(words.fingerprints(first, n))
            prints, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts, pa.int64())], names=["fp", "c"])

    seen = map_batches(_picked(docs), run, "fp long, c long")
    return store(seen.groupBy("fp").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("fp"), "fingerprints")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, n, phrase, f): every run of 1 to ``longest`` words that occurs ``least`` times or more in its language;
    and for each language a row with n = 0 and phrase '' that counts all its words."""
    docs = _picked(docs)
    short = _heavy(docs, longest, least, range(1, min(longest, 2) + 1))
    heavy = short
    if longest > 2:
        heavy = short.unionByName(_heavy(docs, longest, least, range(3, longest + 1), _kept(short)))
    kept = _kept(heavy)

    def run(batches):
        known = Kept(kept.value)
        for words in _blocks(batches, longest):
            firsts, prints, sizes = [], [], []
            for n in range(1, longest + 1):
                first = words.runs(n)
                found = words.fingerprints(first, n)
                hit = known.has(found)
                firsts.append(first[hit])
                prints.append(found[hit])
                sizes.append(np.full(len(firsts[-1]), n))
            first, found, size = np.concatenate(firsts), np.concatenate(prints), np.concatenate(sizes)
            order = np.argsort(found, kind="stable")
            first, found, size = first[order], found[order], size[order]
            while len(first):  # again only for collisions
                new = np.concatenate([[True], found[1:] != found[:-1]])
                pointer = np.flatnonzero(new)[np.cumsum(new) - 1]
                same = (size == size[pointer])
                same[same] = words.same(first[same], first[pointer][same], size[same])
                at = np.flatnonzero(new)
                counts = np.add.reduceat(same.astype(np.int64), at)
                langs = pa.array(words.names, pa.string())
                yield pa.RecordBatch.from_arrays([
                    langs.take(pa.array(words.lang[first[at]])), pa.array(size[at], pa.int32()),
                    words.texts(first[at], size[at]), pa.array(counts)], names=["lang", "n", "phrase", "c"])
                first, found, size = first[~same], found[~same], size[~same]
            own = np.bincount(words.lang[:words.own], minlength=len(words.names))
            yield pa.RecordBatch.from_arrays([
                pa.array(words.names, pa.string()), pa.array(np.zeros(len(own)), pa.int32()), pa.array([""] * len(own)),
                pa.array(own, pa.int64())], names=["lang", "n", "phrase", "c"])

    seen = map_batches(docs, run, "lang string, n int, phrase string, c long")
    return store(seen.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))
                 .where((F.col("n") == 0) | (F.col("f") >= least)), "phrases")


def _part(first, size) -> F.Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: (lang, rank, phrase, a, l, r, n, score).

    a, l and r count the phrase and the two parts of its lowest-scoring cut (the earliest of equal ones), n all words of
    the language; the score is floor(2,000,000 a / (l + r)). Dropped are phrases inside a longer one of at least
    ``share`` per cent of their count. Order: score, a (both descending), phrase by its UTF-8 bytes. Products are decimals."""
    counts = phrase_counts(docs, least, longest)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = counts.where("n >= 2").withColumn("words", F.split("phrase", " "))
    parts = counts.where("n >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("times"))
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, n - 1)"))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("left"),
        _part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    valued = cuts.join(parts.withColumnsRenamed({"part": "left", "times": "l"}), ["lang", "left"]) \
        .join(parts.withColumnsRenamed({"part": "right", "times": "r"}), ["lang", "right"]) \
        .withColumn("score", F.expr("cast(2000000 AS decimal(10,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    lowest = valued.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where("n >= 3").withColumn("size", F.explode(F.expr("sequence(2, n - 1)"))) \
        .withColumn("first", F.explode(F.expr("sequence(1, n - size + 1)"))) \
        .select("lang", _part(F.col("first"), F.col("size")).alias("phrase"), "f") \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (100 * wide("longer") < share * wide("a"))) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    group = f"pmod(xxhash64(phrase), {RANK_GROUPS})"
    best = left.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, {group} {order})")).where(F.col("place") <= top) \
        .withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= top)
    total = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
