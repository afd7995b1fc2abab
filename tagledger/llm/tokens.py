"""Token ids of documents in binary files, packed with Simple-8b.

Documents are range-partitioned by doc_id, so the files in order of their names
hold them in ascending order. A task writes files of a bounded count of ids under
temporary names and renames each when it is whole, always to the same name: a
task that runs twice leaves the same files. The files lie in the shared folder,
which has to be one that ``pyarrow.fs`` opens (file, hdfs, s3, gs).

A file is little-endian: the magic, five LONGs (ids before it in its part, ids,
documents, blocks, ids per block), the block offsets (in words, one more than
blocks), the words, and of each document doc_id LONG, known BYTE, length LONG.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagledger.llm import simple8b
from tagledger.llm.shared import TEXTS, map_batches, store, work_path

MAGIC = b"TLS8BIT1"
END_ID = 0
#: Ids after which a file is closed, which bounds a task's memory.
FILE_IDS = 2_000_000
#: Most tasks that read files.
READ_TASKS = 10_000
#: Units of text whose ids a worker remembers.
REMEMBERED = 200_000
#: Bytes of text that are encoded at a time.
PORTION = 4 << 20
#: Ids that are packed, or unpacked, at a time.
PACKED = 64 * simple8b.BLOCK
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space that a cut before a blank would tear apart.
TORN = rf"{_SPACE} ({_SPACE}|\z)"
#: Words that ``UNIT`` splits as the library does, as the Unicode classes of their characters are fixed.
USUAL = rf"\A[\t\n\r!-~{_LETTERS}]*[!-~{_LETTERS}]\z"
#: The units of the usual byte-level split, over the characters of ``USUAL``.
UNIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_TOKENIZERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts. A cut before a blank that touches a character that is not white
    space never changes the ids, as the vocabulary's own split of the text cuts there
    too. So texts are cut at their blanks, each distinct word of a batch is split into the units of
    that split, and the library merges all units that are not remembered in one call; how many bytes
    each id stands for tells whose it is. Words with characters beyond Latin letters and ASCII go
    through the library's own split. Texts that a cut could change go through whole, as do those that hold
    the string of an added token, which has an id of its own there, and all texts where the
    vocabulary is no byte-level one with the usual split."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocab, split, merge = self.model.get_vocab(with_added_tokens=False), self.model.pre_tokenizer, self.model.model
        self.usual = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space \
            and isinstance(merge, models.BPE) and not any((
                merge.dropout, merge.continuing_subword_prefix, merge.end_of_word_suffix,
                self.model.normalizer, self.model.truncation, self.model.padding)) \
            and set(pre_tokenizers.ByteLevel.alphabet()) <= vocab.keys()
        if not self.usual:
            return
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = list(map(len, vocab))
        # as what bytes are written; the zero byte, which no unit holds, ends a unit
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(b): x for c in map(chr, range(0x250)) for b, x in zip(
            c.encode().decode("latin-1"), plain.pre_tokenize_str(c)[0][0])} | {0: " "}
        self.merged = Tokenizer(merge)
        self.merged.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.units: dict[str, bytes] = {}
        self.seen, self.marks = bytearray(1 << 20), 0

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, units: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """From its second time on, as most units never come again."""
        known = self.units
        if len(known) >= REMEMBERED:
            return
        data, at = ids.tobytes(), 0
        for unit, stop in zip(units, (4 * stops).tolist()):
            place = hash(unit) & 0xFFFFF
            if self.seen[place]:
                if len(known) < REMEMBERED:
                    known[unit] = data[at:stop]
            else:
                self.seen[place] = 1
                self.marks += 1
            at = stop
        if self.marks > 300_000:
            self.seen, self.marks = bytearray(1 << 20), 0

    def _merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after another, and where each unit's end."""
        written = "\0".join(units).encode().decode("latin-1").translate(self.written)
        encoded, = self.merged.encode_batch_fast([written], add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        return ids, self._stops(ids, np.array([len(u.encode()) for u in units], np.int64))

    def _stops(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of texts of ``sizes`` bytes end."""
        return np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of blank-led words of the usual characters, one after another, and how many each has."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                                pa.scalar(" ", words.type))[0].as_py()
        coded = pa.array(UNIT.findall(" " + joined), pa.string()).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.units.get, units))
        known = [f for f in found if f is not None]
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.array(list(map(len, known)), np.int64) // 4
        place = np.arange(len(units))
        if fresh := [u for u, f in zip(units, found) if f is None]:
            merged, stops = self._merge(fresh)
            self._remember(fresh, merged, stops)
            ids, sizes = np.concatenate([ids, merged]), np.concatenate([sizes, np.diff(stops, prepend=0)])
            new = np.array([f is None for f in found])
            place = np.where(new, len(known) + np.cumsum(new), np.cumsum(~new)) - 1
        out, _ = _gathered(ids, sizes, place[coded.indices.to_numpy()])
        return out, np.diff(self._stops(out, pc.binary_length(words).to_numpy().astype(np.int64) + 1), prepend=0)

    def _cut(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds, parts = bounds - bounds[0], cut.flatten()
        first = np.zeros(len(parts), bool)  # what no blank leads
        first[bounds[:-1]] = True
        coded = parts.filter(pa.array(~first)).dictionary_encode()
        words, number = coded.dictionary, np.empty(len(parts), np.int64)
        number[~first] = coded.indices.to_numpy()
        number[first] = len(words) + np.arange(len(texts))
        usual = pc.match_substring_regex(words, USUAL)
        ids, sizes = self._words(words.filter(usual))
        others = self._plain([" " + w for w in words.filter(pc.invert(usual)).to_pylist()]
                             + parts.filter(pa.array(first)).to_pylist())
        usual = usual.to_numpy(zero_copy_only=False)
        place = np.empty(len(words) + len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(usual), np.flatnonzero(~usual),
                              len(words) + np.arange(len(texts))])] = np.arange(len(place))
        ids, stops = _gathered(np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")]),
                               np.concatenate([sizes, np.array([len(o) // 4 for o in others], np.int64)]), place[number])
        data, ends = ids.tobytes(), (4 * stops[bounds[1:] - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.usual:
            return self._plain(texts.to_pylist())
        whole = pc.match_substring_regex(texts, TORN)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        plain, cut = iter(self._plain(texts.filter(whole).to_pylist())), iter(self._cut(texts.filter(pc.invert(whole))))
        return [next(plain if w else cut) for w in whole.to_pylist()]


def _gathered(ids: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entry after entry by their numbers, and where each ends; entry i has ``sizes[i]`` of ``ids``."""
    counts = sizes[number]
    stops = np.cumsum(counts)
    before = (np.cumsum(sizes) - sizes)[number] - stops + counts
    at = np.repeat(before, counts)
    at += np.arange(len(at))
    return ids[at], stops


def _portions(texts: pa.Array):
    """The texts in turn, some ``PORTION`` bytes at a time."""
    place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // PORTION
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        yield a, texts.slice(a, b - a)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def file_bytes(before: int, doc_ids: list[int | None], payloads: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(payloads), "<u4")
    parts = [simple8b.encode(ids[i:i + PACKED]) for i in range(0, len(ids), PACKED)]
    words = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    ends = np.cumsum([0] + [len(p[0]) for p in parts])
    offsets = np.concatenate([p[1][:-1] + e for p, e in zip(parts, ends)] + [ends[-1:]])
    head = np.array([before, len(ids), len(doc_ids), len(offsets) - 1, simple8b.BLOCK], "<i8")
    return b"".join([
        MAGIC, head.tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        np.array([len(p) // 4 for p in payloads], "<i8").tobytes()])


def parse(content: bytes):
    """(ids before the file, doc ids, lengths, ids)."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    before, n_ids, n_docs, blocks, size = np.frombuffer(content, "<i8", 5, 8).tolist()
    if size != simple8b.BLOCK:
        raise ValueError("another block size")
    at = 48
    offsets = np.frombuffer(content, "<i8", blocks + 1, at)
    at += 8 * (blocks + 1)
    words = np.frombuffer(content, "<u8", int(offsets[-1]), at)
    at += 8 * len(words)
    doc_ids = np.frombuffer(content, "<i8", n_docs, at).tolist()
    known = np.frombuffer(content, "u1", n_docs, at + 8 * n_docs).tolist()
    lengths = np.frombuffer(content, "<i8", n_docs, at + 9 * n_docs)
    ids, step = np.empty(n_ids, "<u4"), PACKED // size
    for i in range(0, blocks, step):
        part, few = offsets[i:i + step + 1], ids[i * size:(i + step) * size]
        few[:] = simple8b.decode(words[part[0]:part[-1]], part - part[0], len(few))
    return before, [d if k else None for d, k in zip(doc_ids, known)], lengths, ids


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents and return the manifest, one row per file, which is stored."""
    def run(batches):
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        number, before, ids, payloads, size = 0, 0, [], [], 0

        def close():
            name = f"{base}/part-{part:06d}-{number:06d}.bin"
            draft = f"{name}.{uuid.uuid4().hex}.tmp"
            with filesystem.open_output_stream(draft) as out:
                out.write(file_bytes(before, ids, payloads))
            filesystem.move(draft, name)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "file": number, "path": name, "n_docs": len(ids), "n_ids": size}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()),
                                  ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, texts in _portions(batch.column(1)):
                for d, payload in zip(doc_ids[i:], encoder.encode(texts)):
                    ids.append(d)
                    payloads.append(payload + end)
                    size += len(payload) // 4 + 1
                    if size >= FILE_IDS:
                        yield close()
                        number, before, ids, payloads, size = number + 1, before + size, [], [], 0
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return store(map_batches(ordered, run, MANIFEST, TEXTS), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The ids of a
    part before others are few numbers, one per writing task."""
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]

    def run(batches):
        _TOKENIZERS.clear()  # a worker that has written files needs its memory for reading
        filesystem, _ = _filesystem(folder)
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with filesystem.open_input_stream(path) as source:
                    before, doc_ids, lengths, ids = parse(source.read())
                stops = np.cumsum(lengths)
                begin = stops - lengths
                data = ids.tobytes()
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(begin + before + starts[part]),
                    pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a stated number of tasks, as Spark would merge rows this small into one
    files = manifest.repartition(min(max(1, manifest.count()), READ_TASKS), "part", "file")
    return map_batches(files.select("part", "path"), run,
                       "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the files, read them back. Empty texts have the end id alone; rows that repeat a
    doc_id follow one another; null doc_ids come first."""
    folder = work_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, vocabulary), folder)
