"""Words of the byte-level vocabulary by their parts: as the library's, without its whole encoder."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from wayfront.llm import token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = " \n\t\r\x0b\x1c\x1f\x85\xa0 　abcXYZéßñ²½ªʼǅɏɐ中0129٣'sdmtlrv.,!?-_$€#ﬁ😀İı"


def test_texts_of_all_kinds_of_characters():
    own, library = token_files.ByteLevel(open(BYTE, "rb").read()), Tokenizer.from_file(BYTE)
    draw = random.Random(5)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 24))) for _ in range(5000)]
    texts += [t[:5] + "<|endoftext|>" + t[5:] for t in texts[:100]]
    ids = [token_files.np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts) == ids


def test_plain_words_ask_the_model_alone():
    own = token_files.ByteLevel(open(BYTE, "rb").read())
    asked = []
    whole = own.whole
    own.whole = lambda text: asked.append(text) or whole(text)
    own.encode(["one " + " ".join(f"word{i}, größe{i} plain" for i in range(50))])
    assert sum(map(len, asked)) == 3  # the first word: what comes after a space is merged by the model


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 64)
    own = token_files.ByteLevel(open(BYTE, "rb").read())
    for turn in range(3):
        for i in range(300):
            own.encode([f"a w{'xyz'[turn]}{i} b{i}"])
            assert len(own.inner) <= 64 and len(own.inner.old) <= 64
