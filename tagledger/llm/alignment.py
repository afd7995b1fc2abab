"""Alignment of two tokenizers' ids over the same text, and counts of the id pairs it links.

A text is encoded by a byte-level BPE (A, of the tokenizers library, with a blank put before the text) and by
a sentencepiece model (B, which adds that blank itself). Where a token of A and one of B end at the same
byte, both can be cut. The cuts are found by divide and conquer: from the middle of a stretch outwards,
ends of A are looked up among the ends of B by bisection until one is common; both halves are done in the
same way, and a stretch without a cut is a group. All stretches of a batch of texts are halved
together, in numpy, so that there are about log2(tokens) rounds, not one step per group.

Every token of A in a group is linked with every token of B in it. How many documents hold an id pair linked is
counted over the whole corpus. Texts are taken in chunks of bounded size; a chunk is one row: its distinct id
pairs, once, and per document places in them. Only the pairs are shuffled: pre-aggregated to be counted,
then joined with their counts and brought back to their chunk.

Texts that are null or empty, or that either vocabulary does not give back byte by byte, have no
tokens: zeros, and '' for the groups. Rows are documents, repeated and null ids too; other columns are
ignored; an empty table gives an empty result. A group's links are kept as distinct ids with their
multiplicities, so one long stretch without a cut needs room for its distinct id pairs only.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagledger.llm.pieces import cut_pieces
from tagledger.llm.shared import map_batches, store

#: Characters, and texts, in a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 2 << 20
CHUNK_TEXTS = 4000
#: Characters of pieces that a worker remembers, before it starts anew.
REMEMBERED = 4 << 20
#: Pieces that the libraries encode at a time.
LEARNED = 10_000
#: Links of a group from which on its ids are made distinct before they are paired.
WIDE = 256
_COMMA, _BAR, _SEMICOLON = b",|;"
#: What sentencepiece writes a blank as.
BLANK = "▁"
_ENCODERS: dict[tuple[str, str], "PairEncoder"] = {}


class PairEncoder:
    """Ids of both vocabularies, by blank-led pieces, which both encode on their own."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]
        byte = {x: i for c in map(chr, signs) for x, i in zip(plain.pre_tokenize_str(c)[0][0], c.encode())}
        entries = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(entries.values(), default=0))
        for name, number in entries.items():
            self.bytes_a[number] = bytes(byte.get(x, 0xFF) for x in name)  # the rest never stand in UTF-8
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                        b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(BLANK, " ").encode()
                        for i, p in pieces]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.held = 0

    @classmethod
    def of(cls, a: str, b: str) -> "PairEncoder":
        if (a, b) not in _ENCODERS:
            _ENCODERS[a, b] = cls(a, b)
        return _ENCODERS[a, b]

    def _learn(self, pieces: list[str]) -> None:
        alone = [self.b.piece_to_id(BLANK)]
        for i in range(0, len(pieces), LEARNED):
            part = pieces[i:i + LEARNED]
            ids_a = [x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
            ids_b = self.b.encode([p[1:] for p in part], num_threads=1)
            ids_b = [b if p != " " else alone for p, b in zip(part, ids_b)]
            written = [p.encode() for p in part]
            same = self._same(written, ids_a, self.bytes_a) & self._same(written, ids_b, self.bytes_b)
            for piece, a, b, ok in zip(part, ids_a, ids_b, same.tolist()):
                self.known[piece] = (array("I", a).tobytes(), array("I", b).tobytes()) if ok else None
        self.held += sum(map(len, pieces))

    @staticmethod
    def _same(written: list[bytes], ids: list[list[int]], entries: list[bytes]) -> np.ndarray:
        """Which of the pieces their tokens' bytes give back; all at once where all do."""
        found = [entries[i] for piece in ids for i in piece]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        stops = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        ends = np.concatenate([[0], np.cumsum(sizes)])[stops]
        if b"".join(found) == b"".join(written) and np.array_equal(ends, np.cumsum([len(w) for w in written])):
            return np.ones(len(ids), bool)
        return np.array([b"".join([entries[i] for i in piece]) == w for piece, w in zip(ids, written)])

    def encode(self, texts: list[str]):
        """Ids of A and of B, one text after another, and how many each text has."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        cut = [cut_pieces(" " + t) if t else [] for t in texts]
        known = self.known
        if missing := list({p for pieces in cut for p in pieces if p not in known}):
            self._learn(missing)
        ids_a, ids_b = [], []
        for pieces in cut:
            found = [known[p] for p in pieces]
            if None in found:
                found = []
            ids_a.append(b"".join([f[0] for f in found]))
            ids_b.append(b"".join([f[1] for f in found]))
        return (np.frombuffer(b"".join(ids_a), np.uint32), np.frombuffer(b"".join(ids_b), np.uint32),
                np.array([len(x) // 4 for x in ids_a]), np.array([len(x) // 4 for x in ids_b]))


def _ranges(first: np.ndarray, stop: np.ndarray):
    """The numbers of many ranges in a row, and of which range each is."""
    sizes = np.maximum(stop - first, 0)
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes), owner


def _near_middle(ends_a, ends_b, low, high):
    """For each stretch of A's tokens [low, high) the place, nearest to its middle, of a token before the
    last that ends where one of B ends, found by bisection; -1 where there is none. The distances tried
    double from round to round."""
    middle, place = (low + high) // 2 - 1, np.full(len(low), -1)
    open_, near, far = np.arange(len(low)), 0, 1
    while len(open_):
        m, lo, hi = middle[open_], low[open_], high[open_] - 1
        tried, owner = _ranges(np.stack([np.maximum(m - far + 1, lo), np.maximum(m + max(near, 1), lo)], 1).ravel(),
                               np.stack([np.minimum(m - near + 1, hi), np.minimum(m + far, hi)], 1).ravel())
        owner //= 2
        end = ends_a[tried]
        hit = ends_b[np.minimum(np.searchsorted(ends_b, end), len(ends_b) - 1)] == end
        tried, owner = tried[hit], owner[hit]
        order = np.lexsort((np.abs(tried - m[owner]), owner))
        owner, first = np.unique(owner[order], return_index=True)
        place[open_[owner]] = tried[order][first]
        spent = (m - far + 1 <= lo) & (m + far >= hi)
        open_ = open_[(place[open_] < 0) & ~spent]
        near, far = far, 2 * far
    return place


def shared_cuts(ends_a, ends_b, stops_a, stops_b):
    """Groups of texts whose tokens' ends are given in bytes, texts in a row: the token of A and the token of
    B after each group, in order. ``stops``: the tokens after each text, where both end."""
    low, low_b = (np.concatenate([[0], s[:-1]]) if len(s) else s for s in (stops_a, stops_b))
    high, high_b = stops_a, stops_b
    cuts_a, cuts_b = [stops_a[high > low]], [stops_b[high > low]]
    while True:
        more = (high - low > 1) & (high_b - low_b > 1)
        low, high, low_b, high_b = low[more], high[more], low_b[more], high_b[more]
        place = _near_middle(ends_a, ends_b, low, high)
        found = place >= 0
        if not found.any():
            break
        low, high, low_b, high_b, cut = low[found], high[found], low_b[found], high_b[found], place[found]
        cut_b = np.searchsorted(ends_b, ends_a[cut]) + 1
        cut = cut + 1
        cuts_a.append(cut)
        cuts_b.append(cut_b)
        low, high = np.stack([low, cut], 1).ravel(), np.stack([cut, high], 1).ravel()  # in order, as lookups then are
        low_b, high_b = np.stack([low_b, cut_b], 1).ravel(), np.stack([cut_b, high_b], 1).ravel()
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _starts(stops):
    return np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops.astype(np.int64)


class Chunk:
    """Texts in a row: ids of both vocabularies, groups, and which text each group is of."""

    def __init__(self, encoder: PairEncoder, texts: list[str]):
        self.a, self.b, self.n_a, self.n_b = encoder.encode(texts)
        self.stops_a, self.stops_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        kind = np.int32 if sum(map(len, texts)) < 1 << 28 else np.int64  # up to four bytes a character, and a blank
        self.cuts_a, self.cuts_b = shared_cuts(np.cumsum(encoder.sizes_a[self.a], dtype=kind),
                                               np.cumsum(encoder.sizes_b[self.b], dtype=kind), self.stops_a, self.stops_b)
        self.starts_a, self.starts_b = _starts(self.cuts_a), _starts(self.cuts_b)
        self.text = np.searchsorted(self.stops_a, self.cuts_a)
        self.n_groups = np.bincount(self.text, minlength=len(texts))
        self.links = (self.cuts_a - self.starts_a) * (self.cuts_b - self.starts_b)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as written in decimal; '' without tokens."""
        ids = np.empty(len(self.a) + len(self.b), np.uint32)
        mark = np.full(len(ids), _COMMA, np.uint8)
        group = np.repeat(np.arange(len(self.cuts_a)), self.cuts_a - self.starts_a)
        ids[np.arange(len(self.a)) + self.starts_b[group]] = self.a
        group = np.repeat(np.arange(len(self.cuts_b)), self.cuts_b - self.starts_b)
        ids[np.arange(len(self.b)) + self.cuts_a[group]] = self.b
        mark[self.cuts_a + self.starts_b - 1] = _BAR
        mark[self.cuts_a + self.cuts_b - 1] = _SEMICOLON
        width = len(str(int(ids.max()))) if len(ids) else 1
        shown = np.empty((len(ids), width + 1), np.uint8)
        kept = np.ones(shown.shape, bool)
        for k in range(width):
            above = ids // np.uint32(10 ** (width - 1 - k))
            shown[:, k] = above % 10 + 48
            if k < width - 1:
                kept[:, k] = above > 0
        shown[:, width] = mark
        stops = np.concatenate([[0], np.cumsum(kept.sum(1))])[self.stops_a + self.stops_b].tolist()
        data, out, at = shown[kept].tobytes(), [], 0
        for stop in stops:
            out.append(hashlib.sha256(data[at:stop - 1]).hexdigest() if stop > at else "")
            at = stop
        return out

    def _linked(self):
        """(text, id pair as one number, how many links) of all groups; a pair may come again."""
        small = np.flatnonzero(self.links < WIDE)
        each, owner = _ranges(np.zeros(len(small), np.int64), self.links[small])
        g = small[owner]
        wide_b = self.cuts_b[g] - self.starts_b[g]
        texts = [self.text[g]]
        keys = [self.a[self.starts_a[g] + each // wide_b].astype(np.uint64) << np.uint64(32)
                | self.b[self.starts_b[g] + each % wide_b]]
        times = [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(self.links >= WIDE):
            a, n_a = np.unique(self.a[self.starts_a[g]:self.cuts_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.starts_b[g]:self.cuts_b[g]], return_counts=True)
            keys.append((a.astype(np.uint64)[:, None] << np.uint64(32) | b).ravel())
            times.append(np.outer(n_a, n_b).ravel())
            texts.append(np.full(len(keys[-1]), self.text[g]))
        return np.concatenate(texts), np.concatenate(keys), np.concatenate(times)

    def uses(self):
        """The distinct id pairs, how many texts hold each, and per text, in order: the pairs' places and
        how often it links them; with the number of pairs of each text."""
        text, keys, times = self._linked()
        pairs, place = np.unique(keys, return_inverse=True)
        held, where = np.unique(text * max(len(pairs), 1) + place, return_inverse=True)
        total = np.bincount(where, weights=times, minlength=len(held)).astype(np.int64)  # below 2^53, so exact
        text, place = np.divmod(held, max(len(pairs), 1))
        return pairs, np.bincount(place, minlength=len(pairs)), place, total, np.bincount(text, minlength=len(self.n_a))


def _chunks(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            if i > at and (size + len(text) > CHUNK_CHARS or i - at >= CHUNK_TEXTS):
                yield ids[at:i], texts[at:i]
                at, size = i, 0
            size += len(text)
        if at < len(texts):
            yield ids[at:], texts[at:]


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): the ids of both, and how many of them stand
    before the end of each group."""
    def run(batches):
        encoder = PairEncoder.of(a, b)
        for ids, texts in _chunks(batches):
            c = Chunk(encoder, texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), _lists(c.a, c.n_a, pa.int32()), _lists(c.b, c.n_b, pa.int32()),
                _lists(c.cuts_a - _starts(c.stops_a)[c.text], c.n_groups, pa.int32()),
                _lists(c.cuts_b - _starts(c.stops_b)[c.text], c.n_groups, pa.int32())],
                names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return map_batches(_picked(docs), run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


CHUNK = ("chunk long, a array<int>, b array<int>, n array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, "
         "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, uses binary")


def _chunk_rows(docs: DataFrame, a: str, b: str) -> DataFrame:
    def run(batches):
        encoder, task = PairEncoder.of(a, b), TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_chunks(batches)):
            c = Chunk(encoder, texts)
            pairs, n, place, times, each = c.uses()
            links = np.bincount(c.text, weights=c.links, minlength=len(texts)).astype(np.int64)
            steps = np.diff(place, prepend=0)
            uses = zlib.compress(np.concatenate([each, steps, times]).astype("<i4").tobytes(), 1)
            row = {"chunk": task << 32 | number, "a": (pairs >> np.uint64(32)).astype(np.int32),
                   "b": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), "n": n.astype(np.int32), "doc_id": ids,
                   "n_a": c.n_a, "n_b": c.n_b, "n_groups": c.n_groups, "n_links": links,
                   "groups_sha256": c.digests(), "uses": uses}
            kinds = {"chunk": pa.int64(), "uses": pa.binary(), "groups_sha256": pa.list_(pa.string()),
                     "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()],
                                             names=list(row))

    return store(map_batches(_picked(docs), run, CHUNK), "aligned")


def _pairs(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "pair")) \
        .select("chunk", "place", "pair.a", "pair.b", "pair.n")


def _counted(chunks: DataFrame) -> DataFrame:
    return store(_pairs(chunks).groupBy("a", "b").agg(F.sum("n").alias("n_docs")), "pairs")


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n_docs): how many documents hold the id pair linked."""
    return _counted(_chunk_rows(docs, a, b))


def linked_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document its tokens, groups and links, and over its links how many have the corpus-wide highest
    count of their A id (``n_best``) and the sum of their counts (``count_sum``)."""
    chunks = _chunk_rows(docs, a, b)
    counts = _counted(chunks)
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row per entry of vocabulary A at most
    valued = counts.join(F.broadcast(best), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    values = _pairs(chunks).drop("n").join(valued, ["a", "b"]).groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("place", "n_docs", "best"))).alias("found"))

    def run(batches):
        for batch in batches:
            found = batch.column(7)
            for i in range(batch.num_rows):
                ids, n_a, n_b, n_groups, n_links, digests = (batch.column(k).slice(i, 1).flatten() for k in range(6))
                numbers = np.frombuffer(zlib.decompress(batch.column(6)[i].as_py()), "<i4").astype(np.int64)
                each, rest = numbers[:len(ids)], numbers[len(ids):]
                place, times = np.cumsum(rest[:len(rest) // 2]), rest[len(rest) // 2:]
                known = found.slice(i, 1).flatten()
                n = known.field(1).to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, np.int64)
                best = known.field(2).to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, bool)
                stops = np.cumsum(each)
                sums = [np.concatenate([[0], np.cumsum(times * v[place])]) for v in (best.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [ids, n_a, n_b, n_groups, n_links, *[pa.array(s[stops] - s[stops - each]) for s in sums], digests],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    told = chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "uses") \
        .join(values, "chunk", "left").drop("chunk")
    return map_batches(told, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                  "count_sum long, groups_sha256 string", 1)
