"""Operator 9 against plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plaintide.llm import personal_data
from plaintide.llm.queries import QUERIES

from .conftest import TABLES, hard_rows

# The base patterns as their contract states them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["1", "23", "456", "4111111111111111", "4111 1111 1111 1111", " ", "-", ".", "+1", "(", ")", "a", "b@c.d", "@", "x.y", "_", "é",
         "\U0001F600", "1.2.3.4", "255.255.255.256", "\n", "abc@d-e.com", "+44 20 7946 0958", "%", "0", "00"]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base(text):
    out = []
    for o, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), o, m.end()))
    return sorted(out)


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(1500)] + ["1" * 9000, "1 " * 5000, "a@b" + ".c" * 5000, "+1" + "2" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    for r in personal_data.candidates(df, keep=("doc_id", "text")).collect():
        assert [(c.s, c.o, c.e) for c in r.candidates if c.o < len(PLAIN)] == base(r.text), r.text[:200]


def plain_redact(text, spans):
    names = [k.upper() for k in personal_data.KINDS]
    out, at = [], 0
    for c in spans:
        if c.s >= at:
            out += [text[at:c.s], f"[{names[c.o]}]"]
            at = c.e
        else:
            at = max(at, c.e)
    return "".join([*out, text[at:]])


def test_many_spans_in_one_text(spark):
    """More spans than are folded at a time, texts of many parts: places, overlaps and redaction as in plain Python."""
    rng = random.Random(6)
    texts = ["".join(rng.choices([*PARTS, "4111111111111111 ", "x@y.org ", "10.1.2.3,", "212-555-0175 ", "123-45-6789,", "é\U0001F600 "], k=4000)) for _ in range(6)]
    texts += ["a@b.com " * 3000, "1," * 9000, "+1 212 555 0175;" * 2000, ("4111111111111111,9998887776665554,") * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    found = personal_data.candidates(df, keep=("doc_id", "text"))
    for r in found.select("*", personal_data.redact(F.col("text"), F.col("candidates")).alias("t")).collect():
        spans = [(c.s, c.o, c.e) for c in r.candidates]
        own = [x for x in spans if x[1] < len(PLAIN)]
        assert own == base(r.text) and spans == sorted(spans)
        ends = sorted(own)
        for s, o, e in spans:
            if o >= len(PLAIN):
                assert not any(b[0] < e and s < b[2] for b in ends)
        assert r.t == plain_redact(r.text, r.candidates)


@pytest.mark.parametrize("part", ["1,", "\t", "a", "a@b.com ", "10.0.0.1,", "+1 212 555 0175;", "4111111111111111,", "1 ", "+", "212-555-0175 "])
def test_a_megabyte_of_one_thing(spark, part):
    text = part * ((1 << 20) // len(part))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    begin = time.perf_counter()
    found = personal_data.candidates(df, keep=("doc_id", "text"))
    row = found.select("doc_id", F.size("candidates").alias("n"), F.length(personal_data.redact(F.col("text"), F.col("candidates"))).alias("l")).first()
    assert time.perf_counter() - begin < 60
    assert row.n == (len(text) // len(part) if part[:2] in ("a@", "10", "+1", "41", "21") else 0) and row.l > 0


def test_query(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = list(PLAIN)
    for r in QUERIES["op9_personal_data"](spark, TABLES).collect():
        want = base(texts[r.doc_id])
        line = ",".join(f"{names[o]}:{s}:{e}" for s, o, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(o == k for _, o, _ in want) for k in range(4)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(i, f'mail a{i}@b.com, token = "{key}" and call +1 (017) 555-7713 from 10.0.0.{i}') for i in range(30)]
    number = next(str(n) for n in range(9998887776665550, 9998887776665560) if not luhn(str(n)))
    rows += [(100 + i, f"version {number} of plain words {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = personal_data.candidates(df, keep=("doc_id", "text"))
    model = personal_data.fit(found)
    spans = personal_data.kept_spans(model)
    got = {r.doc_id: r for r in found.select("doc_id", personal_data.listed(spans).alias("l"), personal_data.redact(F.col("text"), spans).alias("t")).collect()}
    assert got[7].t == 'mail [EMAIL], token = "[SECRET]" and call [PHONE] from [IP]'
    assert got[103].l == "" and got[103].t == rows[33][1]
    # Votes for raise a span's score, votes against lower it.
    assert all(w > -0.2 for w in model.labelers[:4]) and all(0.5 < a <= 1 and 0.5 < b <= 1 for a, b in model.reliability)


def test_hard_rows(hard, nothing):
    assert personal_data.personal_data(hard).count() == len(hard_rows())
    assert personal_data.personal_data(nothing).collect() == []
    overlapping = [(0, 1, 5), (3, 0, 9), (12, 2, 14)]
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(o).alias("o"), F.lit(e).alias("e")) for s, o, e in overlapping])
    assert hard.select(personal_data.redact(F.lit("0123456789abcdef"), spans).alias("t")).first().t == "[IP]9ab[CARD]ef"
