"""Randomness battery: encoded text is no secret, random bytes in the same encodings are."""

import base64
import json
import random
import string

import pytest
from pyspark.sql import functions as F

from panelflow.llm import secret_scan

SENTENCES = ["the tests were run again on the second machine", "https://example.org/path/to/page?user=12&lang=en", json.dumps({"alg": "HS256", "typ": "JWT", "id": 1234}), "Grüße aus München, schöne Straße", "Καλημέρα σε όλους τους φίλους", "line one\nline two\tand a tab"]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _found(spark, tokens):
    """By place, whether a token is reported, in a corpus with as much written text beside it."""
    texts = [f"see {t} here" for t in tokens] + ["joined_words_in_a_long_identifier_name"] * len(tokens)
    rows = secret_scan.find_secrets(_docs(spark, texts)).select("doc_id", (F.size("_random") > 0).alias("r")).collect()
    return [r.r for r in sorted(rows)[: len(tokens)]]


def _written(seed, n):
    r = random.Random(seed)
    for i in range(n):
        words = r.choice(SENTENCES).split(" ")
        r.shuffle(words)
        yield " ".join(words).encode()


@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode])
def test_encoded_text_is_not_random(spark, encode):
    tokens = [encode(b).decode() for b in _written(1, 60)]
    assert sum(_found(spark, tokens)) == 0


def test_random_bytes_in_base64_are_found(spark):
    r = random.Random(2)
    tokens = [base64.b64encode(r.randbytes(n)).decode() for n in (30, 33, 48, 64) for _ in range(15)]
    assert sum(_found(spark, tokens)) >= 57


def test_signs_of_equality_inside_and_short_rests_do_not_break_decoding(spark):
    tokens = ["a" + "=" * 30 + "b", "A=B=C=D=E=F=G=H=I=J=K=L=M", "q" * 21 + "==", "--__" * 6, "QUJD" * 5 + "Q"]
    assert _found(spark, tokens) == [False] * len(tokens)


def test_power_by_encoding_and_length(spark):
    """Long keys are found in every encoding that has more symbols than hexadecimal."""
    r = random.Random(3)
    alphabets = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    for alphabet in alphabets.values():
        assert sum(_found(spark, ["".join(r.choices(alphabet, k=64)) for _ in range(40)])) >= 38
