"""Removal of repeated byte strings by a logarithmic family of suffix indexes.

A string of LENGTH bytes is found through its anchor: of the places in it where
GRAM bytes start, the one with the smallest hash. Equal strings have equal anchors
at equal distance, so an index of the suffixes at anchors finds every match, with
about one suffix in 35 bytes. Consecutive strings with one anchor are one entry:
the hash of its first GRAM bytes (the order of the index), a hash of all
bytes that its strings cover, and its place. Only equality matters here, so suffixes are
ordered by hash, not by letter.

Each batch of documents becomes a sorted run per hash range. Where a range's runs meet, a new run is
merge-scanned against the levels kept so far, and levels of like size merge, so that a
range holds few of them. An entry that meets an equal one goes: all strings
of the later one are repeats. What stays under one anchor with different surroundings
(the edges of matches) is looked at string by string: the bytes are fetched from the texts, and
equal strings of one anchor are found by hash; anchors with very many surroundings go through
another family of indexes, keyed by the strings themselves, so that no group meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tagledger.llm.shared import TEXTS, map_batches, store

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Bytes that are hashed together; longer documents are cut into overlapping slices.
BUFFER = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Entries of one anchor above which their strings are spread over tasks one by one.
CROWD = 64
#: Hash ranges per shuffle partition, which evens them out.
RANGES = 8
NO_ID = -(1 << 63)
_SEED = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _SEED.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(int(_SEED.integers(0, 1 << 64, dtype=np.uint64)) | 5)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BUFFER + LENGTH, _BASE)]))
_UNDO = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BUFFER + LENGTH, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
ENTRY = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i8"), ("n", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWER[: len(data)], out=out[1:])
    return out


def _stretch(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (sums[stop] - sums[start]) * _UNDO[start]


def _buffer_entries(data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """(anchor, whole, slice, offset in the slice, strings) for slices laid end to end."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return None
    sums = _sums(data)
    grams = len(data) - GRAM + 1
    hashes = _mix((sums[GRAM:] - sums[:-GRAM]) * _UNDO[:grams])
    low = (hashes & ~PLACE) | np.arange(grams, dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size:])
    anchor = (low[:n] & PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    long = stops - starts >= LENGTH
    edge[starts[long]] += 1
    edge[stops[long] - LENGTH + 1] -= 1
    places = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(places):
        return None
    chosen = anchor[places]
    heads = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (chosen[1:] != chosen[:-1])]))
    first = places[heads]
    count = np.diff(np.append(heads, len(places)))
    whole = _mix(_stretch(sums, first, first + count - 1 + LENGTH) + count.astype(np.uint64) * _BASE)
    owner = np.searchsorted(starts, first, side="right") - 1
    return hashes[chosen[heads]], whole, owner, first - starts[owner], count


def entries(texts: list[bytes], docs: list[int], marks: list[int]) -> np.ndarray:
    """The index entries of whole texts."""
    out, slices, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(s[0] for s in slices), np.uint8)
        stops = np.cumsum([len(s[0]) for s in slices])
        starts = stops - np.array([len(s[0]) for s in slices])
        found = _buffer_entries(data, starts, stops)
        if found is not None:
            anchor, whole, owner, offset, count = found
            part = np.empty(len(anchor), ENTRY)
            part["anchor"], part["whole"], part["n"] = anchor, whole >> np.uint64(16), count
            for k, name in enumerate(("doc", "mark", "at"), 1):
                part[name] = np.array([s[k] for s in slices], np.int64)[owner]
            part["at"] += offset
            out.append(part)

    for text, doc, mark in zip(texts, docs, marks):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, BUFFER // 2):
            piece = text if len(text) <= BUFFER // 2 + LENGTH - 1 else text[at:at + BUFFER // 2 + LENGTH - 1]
            if slices and size + len(piece) > BUFFER:
                flush()
                slices, size = [], 0
            slices.append((piece, doc, mark, at))
            size += len(piece)
            if len(piece) == len(text):
                break
    if slices:
        flush()
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each class in order of anchor, entries that repeat an earlier one)."""
    both = np.concatenate([a, b])
    both = both[np.argsort(both["anchor"], kind="stable")]
    same = both["anchor"][1:] == both["anchor"][:-1]
    shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if not len(shared):
        return both, both[:0]
    group = both[shared]
    order = np.lexsort((group["at"], group["mark"], group["doc"], group["whole"], group["anchor"]))
    group = group[order]
    both[shared] = group
    again = np.concatenate([[False], (group["anchor"][1:] == group["anchor"][:-1]) & (group["whole"][1:] == group["whole"][:-1])])
    place = again.copy()
    for name in ("doc", "mark", "at"):
        place[1:] &= group[name][1:] == group[name][:-1]
    keep = np.ones(len(both), bool)
    keep[shared[again]] = False
    return both[keep], group[again & ~place]


class Levels:
    """Sorted runs whose sizes fall geometrically; equal entries leave as they meet."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> Iterator[np.ndarray]:
        while self.runs and len(self.runs[-1]) <= 2 * len(run):
            run, repeats = merge(self.runs.pop(), run)
            yield repeats
        self.runs.append(run)

    def close(self) -> Iterator[np.ndarray]:
        while len(self.runs) > 1:
            run, repeats = merge(self.runs.pop(), self.runs.pop())
            self.runs.append(run)
            yield repeats


def pack(run: np.ndarray) -> bytes:
    """Columns byte by byte, so that what the numbers have in common packs away."""
    low = int(run["doc"].min()) if len(run) else 0
    head = np.array([len(run), low], "<i8").tobytes()
    body = []
    for column in (run["anchor"], run["whole"], (run["doc"] - low).view("<u8"), run["mark"].view("<u8"), run["at"].astype("<u8"), run["n"].astype("<u8")):
        planes = np.ascontiguousarray(column.astype("<u8")).view(np.uint8).reshape(-1, 8).T
        used = max([k + 1 for k in range(8) if planes[k].any()], default=0)
        body.append(bytes([used]) + planes[:used].tobytes())
    return head + b"".join(body)


def unpack(data: bytes) -> np.ndarray:
    n, low = np.frombuffer(data, "<i8", 2).tolist()
    out, at = np.empty(n, ENTRY), 16
    for name in ENTRY.names:
        used = data[at]
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(data, np.uint8, used * n, at + 1).reshape(used, n)
        at += 1 + used * n
        out[name] = np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(out.dtype[name])
    out["doc"] += low
    return out


MESSAGE = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
                     ("anchor", pa.int64()), ("data", pa.binary()), ("mark", pa.int64())])
MESSAGE_DDL = "key long, doc long, at long, n long, anchor long, data binary, mark long"
#: anchor is null for covered stretches; crowded is of entries whose anchor has very many surroundings.
FOUND_DDL = "doc long, at long, n long, anchor long, crowded boolean, mark long"
FOUND = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("crowded", pa.bool_()),
                   ("mark", pa.int64())])


def _joined(found: np.ndarray) -> np.ndarray:
    """Stretches in order of place, where overlapping strings of one text are one entry."""
    if not len(found):
        return found
    found = found[np.lexsort((found["at"], found["mark"], found["doc"]))]
    stop = found["at"] + found["n"]
    new = np.concatenate([[True], (found["doc"][1:] != found["doc"][:-1])
                          | (found["mark"][1:] != found["mark"][:-1]) | (found["at"][1:] > stop[:-1])])
    heads = np.flatnonzero(new)
    out = found[heads].copy()
    out["n"] = np.maximum.reduceat(stop, heads) - out["at"]
    return out


def _runs_of(firsts: np.ndarray, ranges: int):
    """(range, packed run) of each hash range that has entries."""
    part = ((firsts["anchor"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    return [(p, pack(firsts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]


def _messages(firsts: np.ndarray, repeats: np.ndarray, ranges: int) -> pa.RecordBatch:
    runs, gone = _runs_of(firsts, ranges), _joined(repeats)
    r, g = len(runs), len(gone)
    return pa.RecordBatch.from_arrays([
        pa.array([p for p, _ in runs] + (gone["doc"] % max(1, ranges)).tolist(), pa.int64()),
        pa.array([None] * r + gone["doc"].tolist(), pa.int64()), pa.array([None] * r + gone["at"].tolist(), pa.int64()),
        pa.array([None] * r + gone["n"].tolist(), pa.int64()), pa.nulls(r + g, pa.int64()),
        pa.array([d for _, d in runs] + [None] * g, pa.binary()),
        pa.array([None] * r + gone["mark"].tolist(), pa.int64())], schema=MESSAGE)


def _extract(ranges: int):
    def run(batches):
        for batch in batches:
            ids = [NO_ID if d is None else d for d in batch.column(0).to_pylist()]
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            marks = [mark_of(t) for t in texts]
            firsts, repeats = merge(entries(texts, ids, marks), np.empty(0, ENTRY))
            yield _messages(firsts, repeats, ranges)

    return run


def mark_of(text: bytes) -> int:
    """Tells texts with one doc_id apart. Signed 64 bits."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _found(repeats: np.ndarray, anchors=None, crowded=None) -> pa.RecordBatch:
    n = len(repeats)
    return pa.RecordBatch.from_arrays([
        pa.array(repeats["doc"]), pa.array(repeats["at"]), pa.array(repeats["n"]),
        pa.nulls(n, pa.int64()) if anchors is None else pa.array(anchors.view(np.int64)),
        pa.nulls(n, pa.bool_()) if crowded is None else pa.array(crowded), pa.array(repeats["mark"])], schema=FOUND)


def _passed_on(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Stretches that were found before the shuffle."""
    keep = batch.filter(pc.and_(pc.is_valid(batch.column(1)), pc.is_null(batch.column(4))))
    n = keep.num_rows
    return pa.RecordBatch.from_arrays(
        [keep.column(1), keep.column(2), keep.column(3), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), keep.column(6)],
        schema=FOUND)


def _index(batches):
    """The levels of the hash ranges of a task: repeats as they are met, and in the end
    the entries whose anchor has several surroundings."""
    levels = Levels()
    for batch in batches:
        yield _passed_on(batch)
        for data in batch.column(5).drop_null().to_pylist():
            for repeats in levels.add(unpack(data)):
                yield _found(_joined(repeats))
    for repeats in levels.close():
        yield _found(_joined(repeats))
    if levels.runs:
        run = levels.runs[0]
        cuts = np.flatnonzero(np.concatenate([[True], run["anchor"][1:] != run["anchor"][:-1]]))
        size = np.diff(np.append(cuts, len(run)))
        each = np.repeat(size, size)
        for at in range(0, len(run), 100_000):
            part, count = run[at:at + 100_000], each[at:at + 100_000]
            several = count > 1
            yield _found(part[several], part["anchor"][several], count[several] > CROWD)


def _window_entries(context: list[bytes], docs, ats, counts, anchors, marks) -> np.ndarray:
    """An entry per string of contexts: classed by the string, whole is its anchor."""
    out = []
    for at in range(0, len(context), 2000):
        part = context[at:at + 2000]
        data = np.frombuffer(b"".join(part), np.uint8)
        n = np.array(counts[at:at + 2000], np.int64)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(begin, n) + inner
        made = np.empty(len(place), ENTRY)
        made["anchor"] = _mix(_stretch(_sums(data), place, place + LENGTH))
        made["whole"] = np.repeat(np.array(anchors[at:at + 2000], np.int64).view(np.uint64), n) >> np.uint64(16)
        made["doc"] = np.repeat(np.array(docs[at:at + 2000], np.int64), n)
        made["mark"] = np.repeat(np.array(marks[at:at + 2000], np.int64), n)
        made["at"] = np.repeat(np.array(ats[at:at + 2000], np.int64), n) + inner
        made["n"] = 1
        out.append(made)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def _fetch(ranges: int):
    """Over (doc, mark, text, edges): the bytes of each edge, or for crowded anchors runs of their strings."""
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            plain, crowd = [], []
            for doc, mark, packed, edges in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unzip.decompress(packed)
                for e in edges:
                    row = (doc, e["at"], e["n"], e["anchor"], text[e["at"]:e["at"] + e["n"] - 1 + LENGTH], mark)
                    (crowd if e["crowded"] else plain).append(row)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[3] for r in plain], pa.int64()), pa.array([r[0] for r in plain], pa.int64()),
                pa.array([r[1] for r in plain], pa.int64()), pa.array([r[2] for r in plain], pa.int64()),
                pa.array([r[3] for r in plain], pa.int64()), pa.array([r[4] for r in plain], pa.binary()),
                pa.array([r[5] for r in plain], pa.int64())], schema=MESSAGE)
            if crowd:
                made = _window_entries([r[4] for r in crowd], *([r[k] for r in crowd] for k in (0, 1, 2, 3, 5)))
                yield _messages(*merge(made, np.empty(0, ENTRY)), ranges)

    return run


def _compare(batches):
    """Equal strings of one anchor, and the levels of crowded ones."""
    levels, edges = Levels(), Levels()
    for batch in batches:
        yield _passed_on(batch)
        runs = batch.filter(pc.is_null(batch.column(1)))
        for data in runs.column(5).to_pylist():
            for repeats in levels.add(unpack(data)):
                yield _found(_joined(repeats))
        plain = batch.filter(pc.is_valid(batch.column(4)))
        if plain.num_rows:
            made = _window_entries(plain.column(5).to_pylist(), *(plain.column(i).to_pylist() for i in (1, 2, 3, 4, 6)))
            made, repeats = merge(made, np.empty(0, ENTRY))
            yield _found(_joined(repeats))
            for repeats in edges.add(made):
                yield _found(_joined(repeats))
    for family in (levels, edges):
        for repeats in family.close():
            yield _found(_joined(repeats))


def _zipped(batches):
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], pa.int64()),
            pa.array([mark_of(t) for t in texts], pa.int64()),
            pa.array([packer.compress(t) for t in texts], pa.binary())], names=["doc", "mark", "packed"])


def cut(text: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, what is left) for stretches of string starts (at, n)."""
    kept, upto, spans = [], 0, []
    for at, n in sorted(stretches):
        stop = at + n - 1 + LENGTH
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([at, stop])
    for a, b in spans:
        kept.append(text[upto:a])
        upto = b
    kept.append(text[upto:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut_all(keep_text: bool):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, covered in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                text = unzip.decompress(packed)
                removed, spans, kept = cut(text, [(c["at"], c["n"]) for c in covered or []])
                rows.append((None if doc == NO_ID else doc, len(text), removed, spans,
                             kept if keep_text else hashlib.sha256(kept).digest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _by_text(found: DataFrame, *columns: str) -> DataFrame:
    return found.select("doc", "mark", F.struct(*columns).alias("x")).groupBy("doc", "mark").agg(F.collect_list("x").alias("x"))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of documents; kept is the remaining bytes, or
    their SHA-256. A byte goes if a string of 100 bytes over it also starts earlier: in a smaller
    doc_id, or earlier in the same text. Null ids come first; different texts under one id are in the order of a
    hash; rows that repeat both id and text are one document, and each gets its result."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = store(map_batches(map_batches(texts, _extract(ranges), MESSAGE_DDL, 4 * TEXTS).repartition("key"), _index, FOUND_DDL), "index")
    packed = map_batches(texts, _zipped, "doc long, mark long, packed binary", TEXTS)
    edges = _by_text(found.where("anchor IS NOT NULL"), "at", "n", "anchor", "crowded")
    fetched = packed.join(edges, ["doc", "mark"]).select("doc", "mark", "packed", "x")
    compared = store(map_batches(map_batches(fetched, _fetch(ranges), MESSAGE_DDL, 2 * TEXTS).repartition("key"), _compare, FOUND_DDL), "edges")
    covered = _by_text(found.where("anchor IS NULL").unionByName(compared), "at", "n")
    return map_batches(packed.join(covered, ["doc", "mark"], "left").select("doc", "packed", "x"), _cut_all(keep_text), OUT_DDL, TEXTS)
