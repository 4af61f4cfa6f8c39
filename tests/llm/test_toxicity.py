"""What the toxicity network scores and is trained on."""

from __future__ import annotations

import random

import numpy as np

from wayfront.llm import toxicity


def test_half_a_window_of_words_lies_in_one_window():
    first, lengths, _ = toxicity.windows(np.array([0, 500]))
    for at in range(500 - 24):
        assert ((first <= at) & (at + 25 <= first + lengths)).any(), at


def test_long_documents_are_trained_on(spark, monkeypatch):
    """All toxic documents are longer than the bound."""
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 60)
    rng = random.Random(3)
    plain = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "quam", "nunc"]
    rows = [(i, " ".join("grumble" if i % 3 == 0 and rng.random() < 0.1 else rng.choice(plain) for _ in range(120 if i % 3 == 0 else 40)), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([found[i] == t for i, _, t in rows]) > 0.95
