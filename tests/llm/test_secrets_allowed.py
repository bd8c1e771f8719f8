from __future__ import annotations

import random
import string
import time


import pytest

from orbitree.llm.secrets import KINDS, entropy_spans, find_secrets, scan


@pytest.mark.parametrize("ruler", ["_", "-", "=", "_-", "a-"])
def test_rulers_end_at_once(ruler):
    for n in (18, 2000):
        start = time.perf_counter()
        scan("Total" + ruler * n + "12345")
        scan("Total12" + ruler * n + ".")
        assert time.perf_counter() - start < 0.5


def test_letter_only_keys_are_found():
    draw = random.Random(3)
    for letters, least in ((string.ascii_letters, 0.97), (string.ascii_letters + "-_=/+", 0.85), (string.ascii_lowercase, 0.85)):
        keys = ["k" + "".join(draw.choice(letters) for _ in range(39)) for _ in range(300)]
        assert sum(bool(entropy_spans(k)) for k in keys) >= least * len(keys)


def test_words_are_no_secrets():
    for text in ("internationalization_of_words", "some-long-path/of/words", "getCurrentUserAccountBalanceFromDatabase", "Rechtsschutzversicherungsgesellschaft", "MAXIMUM_NUMBER_OF_CONNECTIONS", "Signature________________2024", "incomprehensibilities-and-counterrevolutionaries"):
        assert entropy_spans(text) == [], text


def test_long_runs_neither_crash_nor_hang(spark):
    draw = random.Random(3)
    hashes = " ".join("".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(15_000))
    texts = ["0x" + "0" * 40, "QUJD" + "A" * 45 + "zZ9/", "a" + "-" * 5000 + "12345", "Total" + "_" * 400 + "12345", "x" * 1_000_000, hashes, hashes.upper() + "G"]
    began = time.time()
    spans = [scan(t) for t in texts]
    assert time.time() - began < 60
    assert [k for _, k, _ in spans[0]] == [2] and spans[4] == [] and len([1 for _, k, _ in spans[5] if k == 2]) == 15_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert find_secrets(docs).count() == len(texts)
    assert find_secrets(docs.limit(0)).count() == 0


def test_a_span_beside_a_base_span_stays(spark):
    key = "Zk3vQ9xLw7Rt2Yb8Nc5Md1Pf6Gh4Js0"
    text = f"password=abcdefghijkl {key} secret:{key} {key}"
    kinds = [KINDS[k] for _, k, _ in scan(text)]
    assert kinds == ["assign", "entropy", "assign", "entropy"]
