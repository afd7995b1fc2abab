"""The encoder of the token files against the tokenizers library on whole texts."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from tagledger.llm import queries, tokens

ATOMS = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "\0", "a", "The", "'s", "'S", "'re", "'",
         "é", "ß", "ǅ", "ɏ", "ɐ", "×", "÷", "ª", "²", "½", "٣", "7", "42", "_", "--", "€", "“", "<|endoftext|>", "<|endoftext",
         "漢字", "Ж", "ั", "́", "😀", " word", " the", ".", ",\n", "﻿", "x\n ", "​", "İ"]


def ids(model, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    return [ids for _, portion in tokens._portions(texts) for ids in encoder.encode(portion)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("portion, remembered", [(50, 5), (1 << 20, 200_000)])
def test_awkward_texts_have_the_ids_of_the_library(monkeypatch, kind, portion, remembered):
    monkeypatch.setattr(tokens, "PORTION", portion)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    rng, encoder = random.Random(portion), tokens.Encoder(queries.vocabulary())
    texts = ["", " ", *("".join(rng.choices(ATOMS, k=rng.choice((1, 3, 8, 40)))) for _ in range(3000))]
    assert encoded(encoder, pa.array(texts, kind).slice(1)) == ids(encoder.model, texts[1:])
    assert encoder.encode(pa.array([], kind)) == []


def test_a_unit_is_merged_once_for_a_portion(monkeypatch):
    encoder, merged = tokens.Encoder(queries.vocabulary()), []
    merge = encoder._merge
    monkeypatch.setattr(encoder, "_merge", lambda units: merged.append(sorted(units)) or merge(units))
    texts = ["x kolibri, zebrafink", "y zebrafink kolibri", "z kolibri."] * 50
    assert encoded(encoder, pa.array(texts)) == ids(encoder.model, texts)
    assert merged == [[" kolibri", " zebrafink", ",", "."]]


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_splits_go_through_whole(tmp_path, change):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        kind = json.load(f)
    kind["pre_tokenizer"] |= change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(kind), encoding="utf-8")
    encoder = tokens.Encoder(str(path))
    texts = ["The word of the day", "one two", ""]
    assert encoded(encoder, pa.array(texts)) == ids(encoder.model, texts)
