"""Long and odd inputs: time that grows with their length alone, and ids equal to the library's."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfront.llm import bpe, html_extract, html_pages, pii, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def data(path):
    with open(path, "rb") as raw:
        return raw.read()


@pytest.mark.parametrize("page", ["<b>x" * 100_000, "<i><div>" + "<b>x</i>" * 100_000, "<ul><li><b>x" * 30_000, "<p><b>x" * 30_000, "<div>" * 100_000 + "x"])
def test_nested_elements(page):
    began = time.monotonic()
    html_extract.parse(page)
    assert time.monotonic() - began < 15


@pytest.mark.parametrize("text", ["http://a/" * 100_000, "a@b.c@" * 100_000, "token=x" * 50_000, "+1 2" * 100_000, "1.2.3." * 100_000, "4111 1111 " * 50_000, "IBAN " * 50_000, "12 Main Street " * 20_000])
def test_anchors_without_end(text):
    began = time.monotonic()
    pii.find_spans(text)
    assert time.monotonic() - began < 15


def test_words_of_a_megabyte():
    coder = bpe.coder(data(WORD))
    rng = random.Random(3)
    for word in ("a" * 1_000_000, "".join(rng.choices("abcdefghijklmnop", k=300_000))):
        began = time.monotonic()
        assert coder.encode([word])[0]
        assert time.monotonic() - began < 30


def strange(rng):
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCXYZ", "0123456789", " \t\n\r\x0b\x0c", "'\".,;:!?-_#$%&|<>", "äöüßéñçøåÆ", "中文字漢日本語", "ибвгде", "́​‍﻿\xa0 ", "🙂👍🏽🇩🇪", "\x1c\x1d\x85"]
    return "".join(c for _ in range(rng.randint(0, 12)) for c in rng.choices(rng.choice(kinds), k=rng.randint(1, 12)))


def test_ids_of_strange_texts_equal_the_library():
    rng = random.Random(17)
    texts = [strange(rng) for _ in range(6000)] + ["".join(rng.choices("etaoin", k=n)) for n in range(40, 200)]
    for path, encode in ((WORD, bpe.coder(data(WORD)).encode), (BYTE, token_files.byte_level(data(BYTE)).encode)):
        library = Tokenizer.from_file(path)
        library.no_padding(), library.no_truncation()
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pages_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    page = html_pages.labelled_pages(1, 5)[0]
    long = "<html><body><article><h1>A title</h1>" + "<p>" + "Some words of a sentence that goes on, and on. " * 20_000 + "</p></article></body></html>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, "u", long, None, None), (3, None, "<p>a <math><mi>x</mi></math> b</p>", "y", 2)]
    found = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 4 and found[0].asDict().keys() >= {"page_id", "url", "text", "n_chars"}
    texts = {r["page_id"]: r for r in found}
    assert texts[2]["n_chars"] > 900_000 and len({r["text"] for r in found if r["page_id"] == 1}) == 1
    assert html_extract.parse("<p>a <math><mi>x</mi></math> b​ c</p>").blocks[0][1] == "a x b​ c"
