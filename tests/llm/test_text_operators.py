"""Personal data, BPE, token files, media, quality and mixing on small data."""

from __future__ import annotations

import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfront.llm.common import WORD_PATTERN
from wayfront.llm import bpe, media, mixing, pii, quality, rans, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "1", "@", ".", "+", "-", " ", "(", ")", "255", "é", "1.2.3.4", "x@y.zz", "+1 (555) 123-4567", "4111111111111111", "\n"]), max_size=24).map("".join))
def test_pii_base_equals_patterns(text):
    assert [s for s in pii.find_spans(text) if s[1] < 4] == base_spans(text)


def test_pii_adds_and_redacts():
    text = "IBAN GB82 WEST 1234 5698 7654 32, password=25a0bc4376e17c8019 at 12 Baker Street, see https://a.b/c."
    kinds = [pii.KINDS[k] for _, k, _ in pii.find_spans(text)]
    assert kinds == ["iban", "secret", "address", "url"]
    assert pii.redacted(text) == "IBAN [IBAN], password=[SECRET] at [ADDRESS], see [URL]."


def test_pii_rows(odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and pii.find(empty).count() == 0
    row = next(r for r in rows if r["doc_id"] == 8)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert next(r for r in rows if r["doc_id"] == 1)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.where("text is null").count() == 1


HARD = ["", "  ", "Hello WORLD it's I'LL 123 4½ ΣΑΣ İst a\x1cb c\x85d <|endoftext|>x<|startoftext|> <|END|>", "日本語 🎉 ñ'S 's ’s", "á ́b ﬁ Å K", "x" * 3000, "  lead  and trail ", "a \n b\n\n c\t"]


def test_word_bpe_equals_library(spark):
    own, library = bpe.coder(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    for text, data in zip(HARD, own.encode(HARD), strict=True):
        ids = np.frombuffer(data, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert own.encode_words(words) == [own.encode_word(w) for w in words]


def test_bpe_rows(odd, empty):
    found = bpe.digests(odd, WORD)
    assert found.count() == odd.count() and found.where("doc_id = 1").first()["n_tokens"] == 0
    assert bpe.digests(empty, WORD).count() == 0
    back = bpe.decode(bpe.encode(odd, WORD), WORD).where("doc_id = 4").first()
    assert back["text"] == "one</w>"


def test_byte_level_equals_library():
    own, library = token_files.byte_level(open(BYTE, "rb").read()), Tokenizer.from_file(BYTE)
    for text, data in zip(HARD, own.encode(HARD), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 32_768, 70_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.full(n, 7), rng.integers(0, 50_257, n), np.minimum(rng.geometric(0.01, n), 60_000), np.full(n, 2**32 - 1)):
        data = rans.encode(ids.astype("<u4"))
        assert (rans.decode(data) == ids).all()
        if n > 65_536:
            assert (rans.decode(data, 1, 2) == ids[32_768:65_536]).all()


def test_rans_notices_damage():
    data = bytearray(rans.encode(np.arange(5000, dtype="<u4") % 300))
    data[-40] ^= 255
    with pytest.raises(rans.Corrupt):
        rans.decode(bytes(data))


def test_token_files(spark, odd, empty, tmp_path):
    rows = token_files.round_trip(odd, BYTE, 2, str(tmp_path / "files")).orderBy("start").collect()
    library = Tokenizer.from_file(BYTE)
    texts = sorted(((r["doc_id"] or -1, r["text"] or "") for r in odd.collect()))
    start = 0
    for (doc, text), row in zip(texts, rows, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (row["doc_id"] or -1, row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(empty, BYTE, 2).count() == 0


def test_gear_cuts_equal_the_rolling_hash():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 90_000).astype(np.uint8).tobytes()
    gear, h, places = [int(g) for g in media.gear()], 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) % 2**64
        if h & int(media.MASK) == 0:
            places.append(i + 1)
    out, at = [], 0
    for p in [*places, len(data)]:
        while p - at > media.MOST:
            at += media.MOST
            out.append(at)
        if p - at >= media.LEAST or (p == len(data) and p > at):
            out.append(p)
            at = p
    assert media.cuts(data) == out


def test_media(spark, odd, empty, tmp_path):
    rng = random.Random(1)
    base = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(12_000))
    more = spark.createDataFrame([(20, base), (21, base[:60_000] * 2), (22, "zz" + base[:50_000]), (23, base)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    path = str(tmp_path / "store")
    rows = media.round_trip(docs, path).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        full = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        if r["doc_id"] not in (6,):
            assert by_id[r["doc_id"]]["payload_sha256"] == hashlib.sha256(full).hexdigest()
            assert by_id[r["doc_id"]]["tail_crc32"] == zlib.crc32(full[-16:])
            raw = io.BytesIO()
            with wave.open(raw, "wb") as out:
                out.setnchannels(1), out.setsampwidth(1), out.setframerate(media.RATE), out.writeframes(full)
            assert by_id[r["doc_id"]]["media_bytes"] == len(raw.getvalue())
            assert by_id[r["doc_id"]]["media_sha256"] == hashlib.sha256(raw.getvalue()).hexdigest()
            mean = sum(full) / len(full)
            crossings = sum((a >= mean) != (b >= mean) for a, b in zip(full, full[1:])) if len(full) < 2000 else None
            found = dict(x.split("=") for x in by_id[r["doc_id"]]["feature"].split(";"))
            assert int(found["sum"]) == sum(full) and int(found["square"]) == sum(b * b for b in full) and int(found["peak"]) == max(full)
            assert crossings is None or int(found["crossings"]) == crossings
            assert list(map(int, found["steps"].split(","))) == [sum(b // 16 == k for b in full) for k in range(16)]
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in media.texts(spark, path).collect())
    assert texts == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert media.round_trip(empty).count() == 0


def test_quality_rows(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] for r in rows if r["n_words"] < 50)
    assert quality.judge(empty, labels).count() == 0
    assert quality.count("a b c a b c x")[4] == 6 and quality.count("a a a a")[4] == 4


def test_quality_cutoffs_are_certified(spark):
    assert abs(quality.binomial_tail(2, 10, 0.5) - 56 / 1024) < 1e-12
    text = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"w{i}###" for i in range(60))
    docs = spark.createDataFrame([(i, bad if i % 10 == 0 else text, "en") for i in range(4000)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 <> 0 as int) as quality")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(4000) if i % 10}
    few = labels.where("doc_id < 200")
    assert quality.judge(docs, few).where("kept").count() == 4000


def test_mixing_targets(spark, odd, empty):
    rows = mixing.taken(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.taken(empty).count() == 0
    docs = spark.createDataFrame([(i, " ".join(["w"] * (50 + i % 97)), ["b", "a", None, "c"][i % 4]) for i in range(2000)], "doc_id long, text string, source string")
    found = mixing.taken(docs).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r["target"] - 1) < 0.02 for r in found)
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()))
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_multinomial_draws(spark):
    """Counts of shards add up to quotas, ranges of indices follow each other, and counts vary like multinomial ones."""
    quota = [50_000, 20_000, 5, 0]
    sources = spark.createDataFrame([(f"={i}", i, q, max(1, q)) for i, q in enumerate(quota)], "skey string, rank long, quota long, blocks long")
    rows = mixing.draws(sources, sum(quota)).collect()
    shards = 1 << (-(-sum(quota) // mixing.SHARD_SLOTS) - 1).bit_length()
    assert {r["shard"] for r in rows} == set(range(shards))
    for i, q in enumerate(quota):
        own = sorted((r["first"], r["count"]) for r in rows if r["rank"] == i)
        assert sum(n for _, n in own) == q and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        counts = np.zeros(shards)
        np.add.at(counts, [r["shard"] for r in rows if r["rank"] == i], [r["count"] for r in rows if r["rank"] == i])
        if q > 1000:
            chi = ((counts - q / shards) ** 2).sum() / (q / shards)
            assert abs(chi - (shards - 1)) < 4 * (2 * (shards - 1)) ** 0.5


def test_draws_in_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SLOTS", 1 << 13)
    quota = [30_000, 9_000, 7]
    sources = spark.createDataFrame([(f"={i}", i, q, max(1, q)) for i, q in enumerate(quota)], "skey string, rank long, quota long, blocks long")
    rows = mixing.draws(sources, sum(quota)).collect()
    for i, q in enumerate(quota):
        own = sorted((r["first"], r["count"]) for r in rows if r["rank"] == i)
        assert sum(n for _, n in own) == q and own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert len({(r["rank"], r["shard"]) for r in rows}) == len(rows) and max(r["shard"] for r in rows) < 5 * 32


def test_mix_keeps_slices_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    rows = [(i, f" \tstart{i}\n\n" + "  ".join(f"w{i}_{k}\n" for k in range(20 + i * 13 % 400)) + "\u00a0x \n", "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixed(docs).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r["text"] in texts[r["doc_id"]] for r in mix)
    assert sum(len(r["text"].split(" ")) >= 1 for r in mix) == len(mix)
    words = sum(len(re.findall(WORD_PATTERN, r["text"])) for r in mix)
    assert words == mixing.taken(docs).agg({"taken": "sum"}).first()[0]
    # a text's distinct pieces, in their order, are the text
    for i, text in texts.items():
        pieces = sorted({(text.index(r["text"]), r["text"]) for r in mix if r["doc_id"] == i})
        assert all(a + len(t) <= b for (a, t), (b, _) in zip(pieces, pieces[1:]))
    counts = mixing.shard_counts(docs)
    assert counts.agg({"slots": "sum"}).first()[0] == mixing.plan(docs).sources.agg({"quota": "sum"}).first()[0]
    assert counts.select("shard").distinct().count() > 1


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 100, 1023):
        got = spark.range(n).selectExpr(mixing.permuted("id", "77L", f"{n}L") + " as p").collect()
        assert sorted(r["p"] for r in got) == list(range(n))
