"""License scan: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard
parser for the expressions that follow a tag."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagledger.llm.shared import TEXTS, map_batches

# The phrases of the contract with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Labels of our own, and how far each binds those who reuse the text (0 free, 1 not at all allowed).
NOTICES = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit", "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd", "creative commons": "creative-commons",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "spdx license identifier": "spdx",
}
BINDING = {
    "public-domain": 0.0, "cc0": 0.0, "mit": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.2, "creative-commons": 0.3,
    "spdx": 0.0, "mpl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "cc-by-nc": 0.8, "agpl": 0.8, "cc-by-nd": 0.8,
    "reserved": 1.0,
}
UNKNOWN = 0.6
#: What a WITH exception leaves of a licence's binding.
EXCEPTION = 0.75
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"[A-Za-z0-9.+:-]+|[()]")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: ASCII letters in lower case and digits stay, other ASCII parts words, the rest stays.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    phrases: dict[str, list] = {}
    for base, table in ((True, BASE), (False, NOTICES)):
        for phrase, label in table.items():
            phrases.setdefault(phrase, []).append((label, len(phrase.split()), base))
    machine = ahocorasick.Automaton()
    for phrase, labels in phrases.items():
        machine.add_word(f" {phrase} ", labels)
    machine.make_automaton()
    return machine


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, None if it isn't one. Operators in either case."""
    out, stack, operand = [], [], False
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                return None
            stack.pop()
        else:
            if operand:
                break  # prose goes on after the expression
            out.append(low)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def _binding(name: str) -> float:
    family = re.split(r"[-+]?\d", name)[0].strip("-+.")
    return BINDING.get(name, BINDING.get(family, UNKNOWN))


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """(binding, names): OR leaves the choice, AND binds by both, WITH eases its licence."""
    stack: list[float] = []
    names = set()
    for k, token in enumerate(rpn):
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if token == "or" else max(a, b) if token == "and" else a * EXCEPTION)
        else:
            stack.append(_binding(token))
            if k + 1 >= len(rpn) or rpn[k + 1] != "with":
                names.add(token)
    return stack[-1], names


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, score, tagged = [], set(), set(), 0.0, False
    seen, upto = 0, 0
    for end, found in automaton().iter(line):
        seen, upto = seen + line.count(" ", upto, end), end  # blanks before the end, so words
        for label, size, is_base in found:
            if is_base:
                starts.append(seen - size)
                base.add(label)
            labels.add(label)
            score = max(score, BINDING[label])
            tagged |= label == "spdx"
    if tagged:
        for match in TAG.finditer(text):
            rpn = postfix(match[1])
            if rpn:
                bound, names = evaluate(rpn)
                score = max(score, bound)
                labels |= names
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of documents; labels are empty strings and the word places null where nothing is found."""
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA, TEXTS)
