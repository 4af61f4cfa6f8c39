"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs
before digits, URL schemes and the cues of identifiers.  At each anchor a local
parser expands to the boundaries of the value and validates it.

Kinds, in the order that breaks ties of start: email, ip, card, phone (the base),
then url, iban, secret, address.  Spans are in code points, end exclusive.

Defined results: null text counts as empty; an empty text has no spans; spans of
different kinds may overlap, spans of one kind never do; repeated rows give a row
each; other columns of the input are ignored by ``find`` and kept by ``redact``.
Texts of any length are searched whole, in time linear in their length.  An address
needs its house number within ``STREET_REACH`` characters before the street's kind.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches

KINDS = ("email", "ip", "card", "phone", "url", "iban", "secret", "address")
BASE = KINDS[:4]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_.~-]{8,})")
CLOUD_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
STREET = re.compile(r"([0-9]{1,6}[A-Za-z]?(?: [A-Z][A-Za-z.'-]*){1,4})$")

SCHEMES = ("http://", "https://", "ftp://")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive")
#: Characters to the left of a street's name in which its house number is looked for.
STREET_REACH = 90


@functools.lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("phone", 2))
    for s in SCHEMES:
        found.add_word(s, ("url", len(s)))
    for cue in ("IBAN", "Iban", "iban"):
        found.add_word(cue, ("iban", len(cue)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    found.add_word("AKIA", ("cloud", 4))
    for cue in STREET_CUES:
        found.add_word(cue, ("address", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Expand an at-sign to both sides, not beyond ``least``."""
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (m := DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def ips_in(text: str, start: int) -> Iterator[tuple[int, int, bool]]:
    """Groups of four numbers in a run of dotted numbers, with their verdicts; the last item ends the run."""
    m = DOTTED.match(text, start)
    ends, parts = [start - 1], m.group().split(".")
    for p in parts:
        ends.append(ends[-1] + 1 + len(p))
    for k in range(0, len(parts) - 3, 4):
        good = all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts[k : k + 4])
        yield ends[k] + 1, ends[k + 4], good
    yield m.end(), m.end(), False


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's number, end), in order."""
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone", "url", "iban", "secret", "address"), 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= done[kind]:
            spans.append((start, KINDS.index(kind), end))
            done[kind] = end

    for last, (cue, size) in anchors().iter(text):
        start = last + 1 - size
        if cue == "digit":
            if start >= done["ip"]:
                for s, e, good in ips_in(text, start):
                    if good:
                        spans.append((s, 1, e))
                    done["ip"] = e
            if start >= done["card"]:
                m = DIGITS.match(text, start)
                done["card"] = m.end() if m else start + 1
                if m and 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
                    spans.append((start, 2, m.end()))
        elif cue == "email":
            if start >= done["email"] and (found := email_at(text, start, done["email"])):
                add("email", *found)
        elif cue == "phone":
            if start >= done["phone"] and (m := PHONE.match(text, start)):
                done["phone"] = m.end()
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    spans.append((start, 3, m.end()))
        elif cue == "url":
            if start >= done["url"] and (m := URL.match(text, last + 1)):
                add("url", start, last + 1 + len(m.group().rstrip(".,;:!?)")))
        elif cue == "iban":
            if (m := IBAN.match(text, last + 1)) and iban_valid(m.group(1)):
                add("iban", m.start(1), m.end(1))
        elif cue == "secret":
            if m := SECRET.match(text, last + 1):
                add("secret", m.start(1), m.end(1))
        elif cue == "cloud":
            if m := CLOUD_KEY.match(text, last + 1):
                add("secret", start, m.end())
        else:
            left = max(done["address"], start - STREET_REACH)
            if not text[last + 1 : last + 2].isalnum() and (m := STREET.search(text[left:start])):
                add("address", left + m.start(1), last + 1)
    spans.sort()
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS[4:])])
FOUND_DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:])


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts by kind, the digest of the base spans, and all spans."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans = [], []
        for text in batch["text"].to_pylist():
            found = find_spans(text or "")
            for n, k in enumerate(KINDS):
                counts[k].append(sum(x[1] == n for x in found))
            spans.append(joined(found))
            digests.append(hashlib.sha256(joined([x for x in found if x[1] < len(BASE)]).encode()).hexdigest())
        columns = [batch["doc_id"].cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS[4:])]
        return pa.record_batch(columns, FOUND)

    return docs.select("doc_id", "text").mapInArrow(by_batch(FOUND, work), FOUND_DDL)


def redacted(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` (if there) counted again; null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redacted(t))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
