"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has one encoding per string, and a sequence of tokens is that encoding
exactly if every two neighbours are (the encoding of their joined bytes is the two of them). So the last
token of a prefix is the only vocabulary entry that ends there, is an encoding of its own and fits
behind the last token of the prefix before it, and the count is that prefix's count and one. An
Aho-Corasick automaton over the vocabulary gives the entries that end at each byte.

The dynamic program runs over the units that the vocabulary's own split makes of a
text. A prefix splits as its text does, but for two cases: white space at the prefix's
end is one unit, and a contraction of which the last letter is missing is an apostrophe and a letter.

A document's counts are stored as differences from each code point to the next: a byte with the
width (1, 2 or 4), then one little-endian signed number of that width per code point. Counts of any
prefix, the longest prefix within a budget and the cut text follow without encoding anything again.

Null texts are empty (no tokens, no differences); repeated rows and null ids are documents of
their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagledger.llm.pieces import Memory, cut_pieces
from tagledger.llm.shared import map_batches

#: Texts in hand at a time.
BATCH = 500
#: Pieces and units that a worker remembers in a generation.
REMEMBERED = 200_000
#: Pairs of tokens of which a worker remembers whether they fit.
FITS = 2_000_000
#: Code points of a piece whose differences surely fit 16 bits (four tokens a code point at most).
SHORT = 8000
SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefixes binary"
#: White space as the vocabulary's split has it (Python adds four control characters).
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
#: Contractions of the split that lose their form with the last letter.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: A word of Latin letters with marks behind it: two units, whatever the vocabulary's own split.
LATIN = re.compile("( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]*)")
_COUNTERS: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Prefix counts for one byte-level BPE vocabulary (a ``.json`` file of the tokenizers library)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        if kind["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or kind.get("normalizer") \
                or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"not a byte-level BPE vocabulary with the usual split: {path}")
        model = Tokenizer.from_file(path)
        self.split, self.merge = model.pre_tokenizer.pre_tokenize_str, model.model.tokenize
        added = sorted((t.content for t in model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.tokens = ahocorasick.Automaton()
        self.names = {}
        for name, number in model.get_vocab(with_added_tokens=False).items():
            if self._encoded(name) == [number]:
                self.tokens.add_word(name, (number, len(name)))
                self.names[number] = name
        self.tokens.make_automaton()
        # as what bytes are written, and those of them (0x80 to 0xBF) that begin no code point
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        written = plain.pre_tokenize_str("".join(map(chr, range(0x80, 0xC0))))[0][0]
        self.inner = frozenset(written[1::2])
        self.written = {ord(b): x for c in map(chr, range(0x250)) for b, x in zip(
            c.encode().decode("latin-1"), plain.pre_tokenize_str(c)[0][0])}
        self.fits: dict[int, bool] = {}
        self.units = Memory(self._unit, REMEMBERED)
        self.pieces = Memory(self._piece, REMEMBERED)

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(path)
        return _COUNTERS[path]

    def _encoded(self, name: str) -> list[int]:
        return [t.id for t in self.merge(name)]

    def _unit(self, unit: str) -> array:
        """Counts after each code point of one unit, whose bytes are the characters of ``unit``."""
        size = len(unit)
        last, counts, fits, names = [-1] * (size + 1), [0] * (size + 1), self.fits, self.names
        for end, (token, width) in self.tokens.iter(unit):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - width
            if begin:
                before = last[begin]
                pair = before << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > FITS:
                        fits.clear()
                    fit = fits[pair] = self._encoded(names[before] + names[token]) == [before, token]
                if not fit:
                    continue
            last[end], counts[end] = token, counts[begin] + 1
        inner = self.inner
        if inner.isdisjoint(unit):
            return array("i", counts[1:])
        return array("i", [c for c, x in zip(counts[1:], unit[1:] + "!") if x not in inner])

    def _piece(self, piece: str) -> bytes | np.ndarray:
        """Differences of the counts; 16-bit numbers as bytes, or an array for a long piece."""
        if known := LATIN.fullmatch(piece):
            word, marks = known.groups()
            out = self.units[word.encode().decode("latin-1").translate(self.written)]
            if marks:
                out = out + array("i", [out[-1] + c for c in self.units[marks]])
        else:
            out = self._split(piece)
        if len(piece) > SHORT:
            return np.diff(out, prepend=0)
        return array("h", map(sub, out, chain((0,), out))).tobytes()

    def _split(self, piece: str) -> list[int]:
        """Counts after each code point of a piece of several units."""
        out: list[int] = []
        total = 0
        for unit, (begin, end) in self.split(piece):
            text, counts = piece[begin:end], self.units[unit]
            if text in CONTRACTIONS:
                out += [total + 1, total + 2, total + counts[2]]
            elif begin == len(out) and text[0] in SPACES and text[-1] in SPACES:  # at a prefix's end, all of it is one unit
                while end < len(piece) and piece[end] in SPACES:
                    end += 1
                (run, _), = self.split(piece[begin:end])
                out += [total + c for c in self.units[run]]
            else:
                out += [total + c for c in counts[len(out) - begin:]]
            total += counts[-1]
        return out

    def _plain(self, text: str) -> np.ndarray:
        """Differences of a text in which no added token counts as one."""
        parts = [self.pieces[p] for p in cut_pieces(text)] if text else []
        if all(type(p) is bytes for p in parts):
            return np.frombuffer(b"".join(parts), np.int16)
        return np.concatenate([np.frombuffer(p, np.int16) if type(p) is bytes else p for p in parts])

    def steps(self, text: str) -> np.ndarray:
        """Differences of the counts from each code point to the next. Up to its last character the string
        of an added token is text like any other; with it, it is a token and a new text begins."""
        if self.added is None or not (found := list(self.added.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            part = self._plain(text[at:m.end() - 1]).astype(np.int64)
            before = int(part[:m.start() - at].sum())
            out += [part, [before + 1 - int(part.sum())]]
            at = m.end()
        return np.concatenate(out + [self._plain(text[at:])])


def packed(steps: np.ndarray) -> bytes:
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    width = 1 if -128 <= low and high < 128 else 2 if -32768 <= low and high < 32768 else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked(prefixes: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    steps = np.frombuffer(prefixes, f"<i{prefixes[0]}", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_counts(docs: DataFrame, vocabulary: str, keep_text: bool = False) -> DataFrame:
    """Per document its id, bytes, code points, tokens and the stored counts of all prefixes;
    ``keep_text`` adds the text."""
    def run(batches):
        counter = PrefixCounter.of(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            steps = [counter.steps(t) for t in texts]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                       pa.array([len(s) for s in steps], pa.int64()),
                       pa.array([int(s.sum()) for s in steps], pa.int64()),
                       pa.array([packed(s) for s in steps], pa.binary())]
            names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefixes"]
            if keep_text:
                columns, names = columns + [batch.column(1)], names + ["text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(picked, run, SCHEMA + (", text string" if keep_text else ""), BATCH)


def _answered(counted: DataFrame, answer, names: tuple[str, ...]) -> DataFrame:
    """All columns of ``counted`` and the numbers that ``answer(counts)`` gives, in place of columns
    of those names."""
    kept = [c for c in counted.columns if c not in names]
    place = kept.index("prefixes")

    def run(batches):
        for batch in batches:
            found = [answer(unpacked(p)) for p in batch.column(place).to_pylist()]
            extra = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=kept + list(names))

    picked = counted.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(picked.schema.fields + [StructField(name, LongType()) for name in names])
    return map_batches(picked, run, schema, BATCH)


def tokens_before(counted: DataFrame, chars: int) -> DataFrame:
    """``tokens_before``: the tokens of the first ``chars`` code points (of all, in a shorter text)."""
    return _answered(counted, lambda c: (int(c[max(0, min(chars, len(c) - 1))]),), ("tokens_before",))


def longest_within(counted: DataFrame, budget: int) -> DataFrame:
    """``kept_chars``, ``kept_tokens``: the longest prefix of at most ``budget`` tokens. As a
    longer prefix can have fewer tokens, this is the last such place and not the first crossing."""
    def answer(counts):
        place = int(np.flatnonzero(counts <= max(budget, 0))[-1])
        return place, int(counts[place])

    return _answered(counted, answer, ("kept_chars", "kept_tokens"))


def truncated(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens, kept_tokens): texts cut to the longest prefix within the budget."""
    found = longest_within(prefix_counts(docs, vocabulary, keep_text=True), budget)
    return found.select("doc_id", F.expr("substring(text, 1, cast(kept_chars AS int))").alias("text"),
                        "n_tokens", "kept_tokens")
