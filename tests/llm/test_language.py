"""Language models against a plain dictionary of counts, and languages whose texts pass the sample's bounds."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from panelflow.llm import langid

ALPHABETS = ["αβγδεζηθικλμνξοπρστυ", "абвгдежзиклмнопрстуы", "あいうえおかきくけこさしす", "abcdefghiklmnopqrstu"]


def _texts(seed, alphabet, n, words=25):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(80)]
    return [" ".join(r.choices(vocabulary, k=words)) for _ in range(n)]


def _plain(texts):
    """By context, how often each byte follows it; contexts of up to four bytes, white space before a text."""
    seen = {}
    for t in texts:
        b = b"    " + t.encode().lower()
        for i in range(4, len(b)):
            for order in range(5):
                seen.setdefault(b[i - order : i], Counter())[b[i]] += 1
    return seen


def _plain_bits(seen, text):
    b, bits = b"    " + text.encode().lower(), 0.0
    for i in range(4, len(b)):
        for order in range(4, -1, -1):
            counts = seen.get(b[i - order : i])
            if counts is None:
                continue
            both = sum(counts.values()) + len(counts)
            if counts[b[i]]:
                bits += math.log2(both / counts[b[i]])
                break
            bits += math.log2(both / len(counts))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_dictionary_of_counts():
    by_lang = [_texts(1, ALPHABETS[3], 12), _texts(2, ALPHABETS[3], 9), _texts(3, ALPHABETS[0], 5)]
    langs, keys, counts = [], [], []
    for i, texts in enumerate(by_lang):
        key, n = np.unique(langid.contexts([t.encode() for t in texts])[0], return_counts=True)
        langs.append(np.full(len(key), i)), keys.append(key), counts.append(n)
    model = langid.CodeLengths(np.concatenate(langs), np.concatenate(keys), np.concatenate(counts), 3)
    asked = ["", *(t[0] for t in by_lang), *_texts(4, ALPHABETS[1], 3), "z9 " * 40]
    got = langid._bits([t.encode() for t in asked], model) / langid.SCALE
    for i, texts in enumerate(by_lang):
        seen = _plain(texts)
        for j, t in enumerate(asked):
            assert abs(got[j, i] - _plain_bits(seen, t)) <= 0.005 * (len(t.encode()) + 1)


def test_parts_do_not_change_code_lengths(monkeypatch):
    texts = [t.encode() for t in _texts(1, ALPHABETS[3], 12)]
    key, n = np.unique(langid.contexts(texts)[0], return_counts=True)
    model = langid.CodeLengths(np.zeros(len(key), np.int64), key, n, 1)
    whole = langid._bits([b"", *texts, b"qq"], model)
    monkeypatch.setattr(langid, "CELLS", 7)
    assert (langid._bits([b"", *texts, b"qq"], model) == whole).all()


def test_a_language_of_one_long_text_is_learned_whole(spark, monkeypatch):
    """Its only text passes the bound of bytes, and it is learned all the same; one without a labelled text is never named."""
    monkeypatch.setattr(langid, "MAX_BYTES", 2_000)
    rows = [(t, lang) for lang, a in (("el", ALPHABETS[0]), ("ru", ALPHABETS[1])) for t in _texts(7, a, 30)]
    rows += [(" ".join(_texts(8, ALPHABETS[2], 40)), "ja"), ("", "none"), (None, "none"), (_texts(8, ALPHABETS[2], 41)[-1], None)]
    ids = iter(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(next(ids), t, lang) for t, lang in rows], "doc_id long, text string, lang string")
    got = {r.text: r for r in langid.predict_languages(docs).join(docs, "doc_id").collect()}
    assert all(got[t].lang_pred == lang for t, lang in rows if t and lang)
    assert got[rows[-1][0]].lang_pred == "ja" and got[""].lang_pred == "und"


def test_fifty_languages(spark):
    rows = [(t, f"l{i:02d}") for i in range(50) for t in _texts(i, "abcdefghijklmnopqrstuvwxyz", 12, 40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = langid.predict_languages(docs).where("held_out").collect()
    assert len(got) > 60 and sum(r.lang_pred == rows[r.doc_id][1] for r in got) >= 0.95 * len(got)


def test_rows_without_id_and_repeats(spark):
    docs = spark.createDataFrame([(None, "abc def", "xx"), (7, "abc def", "en"), (7, "abc def", "en"), (8, "Καλημέρα", None)], "doc_id long, text string, lang string")
    got = langid.predict_languages(docs).collect()
    assert sorted((r.doc_id or -1, r.lang_pred) for r in got) == [(-1, "en"), (7, "en"), (7, "en"), (8, "en")]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
