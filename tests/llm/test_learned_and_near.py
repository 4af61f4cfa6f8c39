"""Toxicity, pages, near duplicates, passages and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from wayfront.llm import html_extract, html_pages, minhash, passages, toxicity
from wayfront.llm.common import read_table


def test_network_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.start(np.random.default_rng(0)).items()}
    x = toxicity.read(["some words in a text " * 12, "another one, short"])
    first, lengths, _ = toxicity.windows(x.docs)
    weights = np.arange(1, len(first) + 1).astype(float)

    def loss():
        return (toxicity.forward(p, toxicity.embed(p, x), first, lengths)[0] * weights).sum()

    rows = toxicity.embed(p, x)
    _, memory = toxicity.forward(p, rows, first, lengths, True)
    grads, _ = toxicity.backward(p, rows, memory, weights)
    for k, g in grads.items():
        at = (0,) * p[k].ndim
        kept, step = p[k][at], 1e-3
        p[k][at] = kept + step
        above = loss()
        p[k][at] = kept - step
        below = loss()
        p[k][at] = kept
        assert abs((above - below) / (2 * step) - np.asarray(g)[at]) < 1e-4, k


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        first, lengths, owner = toxicity.windows(np.array([0, n]))
        covered = {i for f, k in zip(first, lengths) for i in range(f, f + k)}
        assert covered == set(range(n)) and len(first) >= 1 and (owner == 0).all()


def test_toxicity_learns_and_holds_out(spark, odd, empty):
    rng = random.Random(4)
    plain = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "quam", "nunc"]
    rows = []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 160))]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "grumbl" + rng.choice(["e", "ing", "ers", "y"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([found[i]["predicted"] == t for i, _, t in held]) > 0.95
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_tree_marginals_equal_enumeration():
    rng = random.Random(0)
    parents = [-1, 0, 0, 1, 1, 2]
    node, pair = [rng.uniform(-1, 1) for _ in parents], [rng.uniform(-1, 1) for _ in range(4)]
    total, main = 0.0, [0.0] * len(parents)
    for bits in range(1 << len(parents)):
        y = [bits >> i & 1 for i in range(len(parents))]
        w = np.exp(sum(n * v for n, v in zip(node, y)) + sum(pair[2 * y[p] + y[i]] for i, p in enumerate(parents) if p >= 0))
        total += w
        for i, v in enumerate(y):
            main[i] += w * v
    prob, _ = html_extract.marginals(parents, node, pair)
    assert np.allclose(prob, [m / total for m in main])


def test_pages(spark):
    weights, pair = html_extract.loaded(html_extract.model())
    wrong = seen = 0
    for page in html_pages.labelled_pages(80, 11):
        tree = html_extract.parse(page)
        truth = html_extract.labels(tree)
        prob, _ = html_extract.marginals(tree.parents, [sum(weights[k] for k in f) for f in html_extract.active(tree)], pair)
        wrong += sum((prob[b] > 0.5) != bool(truth[b]) for b, _ in tree.blocks)
        seen += len(tree.blocks)
    assert wrong / seen < 0.06
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First   text\nhere, long enough to be read as a paragraph.<br><p>Second &lt;one&gt; of them, also with some more words.</article><footer>&copy; x</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<![x <!-- <p"), (None, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in html_extract.extract(rows).collect()}
    assert found[1]["text"] == "A & B\n\nFirst text here, long enough to be read as a paragraph.\n\nSecond <one> of them, also with some more words."
    assert found[2]["text"] == "" and found[2]["n_chars"] == 0 and len(found) == 5


def sets(text, size):
    w = text.encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, per_cent):
    s = [sets(t or "", size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= per_cent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows, base = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        text = [rng.choice(base) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 25)):
            own = text[:]
            for _ in range(rng.randint(0, max(1, len(own) // 14))):
                own[rng.randrange(len(own))] = rng.choice(base)
            rows.append((len(rows) * 7 + 3, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, "w1"), (5003, "W1"), (5004, " ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size, 80).collect()}
    assert found == brute_components(sorted(rows), size, 80)


def test_near_duplicate_rows(odd, empty):
    assert minhash.near_duplicates(odd, 2, 80).count() == odd.count()
    assert minhash.near_duplicates(empty, 2, 80).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i}" for i in range(4000)) + " " + "y" * 5000 + " end of it"
    whole = minhash.shingle_sets([text], 2)[0]
    monkeypatch.setattr(minhash, "LONGEST", 1500)
    assert (minhash.shingle_sets([text[: text.index("y" * 5000)]], 2)[0] == minhash.shingle_sets([text[: text.index("y" * 5000)]], 2)[0]).all()
    parts = minhash.shingle_sets([text], 2)[0]
    assert len(parts) == len(whole) and len(np.intersect1d(parts, whole)) >= len(whole) - 2


def test_compact_windows_equal_enumeration():
    rng = np.random.default_rng(2)
    for n, width in ((1, 1), (30, 4), (90, 20), (50, 50), (10, 11)):
        v = rng.integers(0, 2**63, n).astype(np.uint64)
        c, left, right = passages.compact_windows(v, width)
        rank = [(int(x) >> 32, i) for i, x in enumerate(v)]
        expected = []
        for i in range(n):
            a = b = i
            while a > 0 and rank[a - 1] > rank[i]:
                a -= 1
            while b < n - 1 and rank[b + 1] > rank[i]:
                b += 1
            if b - a + 1 >= width:
                expected.append((i, a, b))
        assert list(zip(c.tolist(), left.tolist(), right.tolist())) == expected


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(9)
    text = lambda n: [f"t{rng.randrange(100_000)}" for _ in range(n)]
    shared, near = text(60), text(120)
    changed = near[:]
    changed[70] = "other"
    rows = [(i, " ".join(text(80) + shared + text(30))) for i in range(30)]
    rows += [(100, " ".join(text(20) + near + text(5))), (101, " ".join(text(40) + changed)), (200, " ".join(text(300))), (201, " ".join(shared[:40] + text(60)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {*range(30), 100, 101}
    assert all(r["start_word"] <= 80 and r["end_word"] >= 140 for r in found if r["doc_id"] < 30)
    row = next(r for r in found if r["doc_id"] == 101)
    assert row["class_doc_id"] == 100 and row["start_word"] <= 40 and row["end_word"] == 160 and row["similarity"] >= 0.8
    assert passages.repeated_passages(empty).count() == 0
    assert passages.repeated_passages(odd).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one = corpus_pipeline.distinct(spark, docs, sf_dir)
    assert {r["doc_id"] for r in one.collect()} == set(brute_components(sorted(rows), 5, 80).values())
    private = corpus_pipeline.private(spark, docs, sf_dir)
    mix = corpus_pipeline.mix(spark, docs, sf_dir)
    assert one.columns == private.columns == mix.columns == docs.columns
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == ["doc_id", "n_tokens", "ids"] and final.where("n_tokens > 0").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
