"""Corpus operators on small fixtures, against brute force and round trips; nulls, blanks, repeats and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelflow.llm import embeddings, langid, licenses, minhash, mixing, packing, quality, secret_scan, suffixes, tokens
from panelflow.llm.queries import vocabulary

EXTRA = "doc_id long, text string, lang string, kept boolean, _q string, id string, n long"


def _docs(spark, texts, schema=EXTRA):
    return spark.createDataFrame([(i, t, "en", True, "x", "y", 1) for i, t in enumerate(texts)], schema)


def _prose(seed, n, words=120, longest=200):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(words)]
    return [" ".join(r.choices(vocab, k=r.randint(1, longest))) for _ in range(n)]


def _near(seed=5):
    r, out = random.Random(seed), []
    for t in _prose(seed, 12):
        w = t.split()
        for _ in range(r.randint(1, 6)):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = "zz%d" % r.randint(0, 3)
            out.append(" ".join(v))
    return [None, "", "  \n", "one two", "ONE  two", *out]


def _components(n, links):
    of = list(range(n))
    for a, b in links:
        x, y = of[a], of[b]
        of = [min(x, y) if o in (x, y) else o for o in of]
    return of


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 119, 121, 3000):
        for hi in (1, 2, 300, 50_000, 2**40, 2**63):
            x = rng.integers(0, hi, n, dtype=np.uint64)
            x[n // 2 :] //= 1000
            assert (tokens.unpack(tokens.pack(x), n, int((x >> np.uint64(60) > 0).sum())) == x).all()


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_equal_those_of_whole_texts(name, space):
    r = random.Random(1)
    kinds = [*"abAZ éÉßñ,.'!?#09²\t\n  x×́≠—中 ", "'s", "'ll", " '", "  ", "\n\n", "<|endoftext|>", "<|startoftext|>", "<|"]
    texts = ["".join(r.choices(kinds[: r.choice([8, 14, 20, len(kinds)])], k=r.randint(0, 40))) for _ in range(4000)]
    ids, counts = tokens.Encoder(vocabulary(name), space)([t.encode() for t in texts])
    want = [[*e.ids, 2] for e in tokens.tokenizer(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_token_files_and_packing(spark):
    texts = [None, "", *_prose(2, 40, longest=3000), "dup", "dup"]
    docs = _docs(spark, texts)
    t = tokens.tokenizer(vocabulary("byte_bpe_50k.json"))
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    start = 0
    for r in tokens.token_file_digests(docs, vocabulary("byte_bpe_50k.json"), True).orderBy("doc_id").collect():
        w = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(w), zlib.crc32(w.tobytes()))
        start += len(w)
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).toPandas()
    for r in rows.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024 and rows.length.sum() == sum(map(len, want))


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (9, 6, 3)] == [(0, 0), (1, 0), (1, 6)]
    assert bins.place(8) == (2, 0) and bins.open == 2 and bins.bits == 0b110


def test_near_duplicates_equal_brute_force(spark):
    texts = _near()
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = minhash.near_duplicates(_docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == _components(len(texts), links)
    assert [r.n_shingles for r in got] == [len(s) for s in sets]


def test_links_are_judged_on_words(spark):
    word = "a"
    for _ in range(11):
        word = "".join("ab" if c == "a" else "ba" for c in word)
    other = "".join("a" if c == "b" else "b" for c in word)
    # rows that repeat an id are one document, linked by each of its texts
    rows = [(1, word), (2, other), (3, "a b c"), (3, "a b c d e f"), (4, "A b  c"), (5, "a b c d e f"), (6, None), (None, "a b c")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, True), (2, 1, 2, True), (3, 2, 3, True), (4, 1, 3, False), (5, 2, 3, False), (6, 0, 6, True)]


def test_ranks_drawn_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 4000, 700, 1])
    h = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    whole = minhash.superminhash(h, sizes)
    monkeypatch.setattr(minhash, "PIECE", 333)
    assert (minhash.superminhash(h, sizes) == whole).all()


def test_superminhash_is_a_permutation_of_ranks():
    h = np.arange(1, 4, dtype=np.uint64) * np.uint64(10**15)
    sig = minhash.superminhash(h, np.array([3, 0]))
    assert (sig[1] == 2**64 - 1).all() and (sig[0] != 2**64 - 1).all()
    assert (sig[0] == np.minimum.reduce([minhash.superminhash(h[i : i + 1], np.array([1]))[0] for i in range(3)])).all()


def test_repeats_equal_brute_force(spark, monkeypatch):
    r, texts = random.Random(3), [None, "", "short"]
    passages = _prose(4, 5, longest=160)
    for t in _prose(6, 60):
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            k = r.randrange(len(p))
            t += (p if r.random() < 0.5 else p[:k] + "Z" + p[k + 1 :])[r.randint(0, 60) :]
        texts.append(t if r.random() < 0.9 else "abé" * r.randint(1, 400))
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for most in (suffixes.MOST_CONTEXTS, 1):
        monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
        for row in suffixes.remove_repeats(_docs(spark, texts)).collect():
            b = raw[row.doc_id]
            gone = np.zeros(len(b) + 1, bool)
            for i in range(len(b) - 399):
                if seen[b[i : i + 400]] > 1:
                    gone[i : i + 400] = True
            runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
            assert (bytes(row.kept), row.n_removed, row.n_spans) == (bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]), int(gone.sum()), runs)


def test_a_hot_passage_and_repeated_ids(spark, monkeypatch):
    r = random.Random(8)
    passages = _prose(9, 400, longest=160)
    hot = [p for p in passages if 250 < len(p) < 390][:1] + [p for p in passages if 450 < len(p)][:1]
    assert len(hot) == 2
    texts = [f"{r.choice(passages)[:150]} {hot[i % 2]} {r.choice(passages)[:150]}" for i in range(300)]
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = [sum(any(seen[b[i : i + 400]] > 1 for i in range(max(0, p - 399), min(p, len(b) - 400) + 1)) for p in range(len(b))) for b in raw]
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", 20)
    got = {x.doc_id: x.n_removed for x in suffixes.remove_repeats(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(300)] == want and max(want) > 0
    p, q = passages[0] * 8, passages[1] * 8
    rows = spark.createDataFrame([(1, p[:590]), (1, p[:590]), (1, q[:380]), (2, "x" + q[:380]), (None, p[:590])], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_bytes) for x in suffixes.remove_repeats(rows).collect()) == [(1, 380), (1, 590), (1, 590), (2, 381)]


def test_a_line_that_fills_texts_is_a_row_a_text(spark):
    line, (p, q, *_) = "all of these lines are the same line\n", [x for x in _prose(11, 40, longest=160) if 500 < len(x) < 900]
    texts = [line * 40, line * 25 + p, q + line * 30, "a" * 900, p + q + p, line * 11, line * 3, q[:450], "", None]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = [sum(any(seen[b[i : i + 400]] > 1 for i in range(max(0, p - 399), min(p, len(b) - 400) + 1)) for p in range(len(b))) for b in raw]
    assert {x.doc_id: x.n_removed for x in suffixes.remove_repeats(_docs(spark, texts)).collect()} == dict(enumerate(want))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw)], names=["id", "text"])
    rows = [x for b in suffixes._anchor_rows(iter([batch])) for x in b.to_pylist()]
    assert len(rows) == len({(x["id"], x["c0"], x["c1"]) for x in rows})
    # what one text holds several times needs no other text to be found
    alone = [(x["id"], s["a"], s["b"]) for x in rows if x["times"] > 1 for s in x["inside"]]
    assert all(any(i == 3 and a <= k < b for i, a, b in alone) for k in range(900))
    assert all(x["times"] > 1 or not x["inside"] for x in rows)


def test_quality_counts_and_verdicts(spark):
    clean = _prose(7, 60, words=900)
    texts = [None, "", "a\nb\na", *clean, *("x### y$$$ " * 60 for _ in range(8)), "same words here " * 50]
    rows = quality.score_quality(_docs(spark, texts)).select("doc_id", "_q.*", "base_failed", "kept").orderBy("doc_id").collect()
    assert (rows[2].n_words, rows[2].n_dup_lines, rows[0].n_words) == (3, 1, 0)
    assert (rows[-1].n_repeat_words, rows[-1].kept) == (150, False)
    assert all(r.kept == (r.n_words >= 50) for r in rows[3:63]) and not any(r.kept for r in rows[63:])


def test_a_weak_rule_is_outvoted():
    k = len(quality.RULES)
    vote = lambda *on: tuple(int(j in on) for j in range(k))
    # two pairs of rules that agree; the last rule fires on a fifth of all documents by chance
    table = [(vote(), 7200), (vote(k - 1), 1800), (vote(0, 1), 400), (vote(0, 1, k - 1), 100), (vote(2, 3), 400), (vote(2, 3, k - 1), 100)]
    model = quality.fit(table)

    def bad(votes):
        odds = [s * np.prod([r if v else 1 - r for r, v in zip(rate, votes)]) for s, rate in zip(model["share"], model["rate"])]
        return 1 - odds[0] / sum(odds)

    assert bad(vote(k - 1)) < 0.1 and bad(vote()) < 0.1 and min(bad(vote(0, 1)), bad(vote(2, 3))) > 0.9
    # a rule that fires at times with its partner and at times alone is still believed
    assert bad(vote(0, 1, k - 1)) > 0.9 and model["rate"][0][k - 1] == pytest.approx(0.2, abs=0.03)


def test_no_document_gives_the_priors():
    assert quality.fit([])["share"][0] == pytest.approx(1 - quality.BAD)


def test_verdicts_of_the_posterior_column(spark):
    good, junk = _prose(31, 300, words=900, longest=300), ["x### y$$$ " * 60, "SHOUT!! " * 80]
    texts = [t for t in good if len(t.split()) >= 50] + junk * 12
    # one document in ten has the last rule fire alone: words of great length
    long = [" ".join("w" * 14 + str(i) + "".join(random.Random(i * 100 + j).choices("abcdefgh", k=6)) for j in range(80)) for i in range(15)]
    rows = quality.score_quality(_docs(spark, texts + long)).orderBy("doc_id").collect()
    assert all(r.kept for r in rows[: len(texts) - 24]) and not any(r.kept for r in rows[len(texts) - 24 : len(texts)])
    assert all(r.kept for r in rows[len(texts) :])


def test_secrets(spark):
    rng = random.Random(9)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=64))
    texts = [None, "", 'x\x01é "Password": "abc123" secret=token :abcdef', "AKIA" + "A" * 16 + " AKIA short", "0" * 24 + "g" + "a" * 23, f"key {key} end", "thisisaverylongwordthatpeoplewrite " * 3]
    rows = secret_scan.find_secrets(_docs(spark, texts)).select("doc_id", secret_scan.written(F.col("_base")).alias("b"), secret_scan.written(F.col("_random")).alias("r")).orderBy("doc_id").collect()
    assert [r.b for r in rows] == ["", "", "assign:5:23", "access:0:20", "hex:0:24", "", ""]
    assert [r.r for r in rows] == ["", "", "", "", "", "random:4:68", ""]
    # more matches than one fold takes: places stay right
    many = _docs(spark, ["é token=abcdef1 " * 3000])
    far = secret_scan.find_secrets(many).select(F.size("_base").alias("n"), F.col("_base")[2999]["s"].alias("s")).first()
    assert (far.n, far.s) == (3000, 2999 * 16 + 2)
    masked = secret_scan.redact(_docs(spark, texts)).orderBy("doc_id").collect()
    assert masked[3].text == "[SECRET] AKIA short" and masked[0].text is None and masked[5].text == "key [SECRET] end"


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    x = [*base, *(base[:60] + 0.25 * rng.standard_normal((60, 16))), base[0], base[0]]
    rows = [(i, [float(f) for f in v], "z") for i, v in enumerate(x)]
    rows += [(900, None, "z"), (901, [0.0] * 16, "z"), (902, [1.0, None] + [0.0] * 14, "z"), (903, [float("nan")] * 16, "z"), (904, [], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    of = _components(len(x), [(a, b) for a in range(len(x)) for b in range(a) if near[a, b]])
    assert [got[i].component_id for i in range(len(x))] == of and [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_hot_cells_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 100)
    monkeypatch.setattr(embeddings, "CELL", 64)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 32))
    x = np.concatenate([base, base[0] + 0.1 * rng.standard_normal((350, 32)), base[1:20]])
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    of = _components(len(x), [(a, b) for a in range(len(x)) for b in range(a) if near[a, b]])
    assert [got[i].component_id for i in range(len(x))] == of
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.1]), (2, [-1.0, 0.0]), (1, [-1.0, 0.01]), (5, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(twice).collect())) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (5, 0, 5, True)]


def test_collisions_equal_window_counts():
    p = np.random.default_rng(5).standard_normal((150, 64)).astype(np.float32)
    n = sum((np.abs(p[:, k][:, None] - p[:, k][None, :]) <= 0.6).astype(int) for k in range(64))
    assert all((embeddings.collisions(p, least) == (n >= least)).all() for least in (1, 17, 24, 64))


def test_language(spark):
    en, de = _prose(11, 60), [t.replace("a", "ä").replace("b", "sch") for t in _prose(12, 60)]
    rows = [(i, t, l) for i, (t, l) in enumerate([*((t, "en") for t in en), *((t, "de") for t in de), (None, "en"), ("12 !", "de"), ("abc", None)])]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got[:120]) >= 117
    assert [r.lang_pred for r in got[120:122]] == ["und", "und"] and all(0 <= r.score <= 1 for r in got)


def test_code_lengths_are_a_probability():
    keys, _ = langid.contexts([t.encode() for t in _prose(1, 20)])
    keys, n = np.unique(keys, return_counts=True)
    model = langid.CodeLengths(np.zeros(len(keys), np.int32), keys, n, 1)
    for context in (int(keys[5]) >> 8, int(keys[len(keys) // 2]) >> 8, 0x7A7A7A7A, 0):
        cost = model.costs(context << 8 | np.arange(256, dtype=np.int64))
        assert 0.1 < np.exp2(-cost[:, 0] / langid.SCALE).sum() <= 1.01


def test_languages_of_other_scripts(spark):
    r = random.Random(5)
    alphabets = {"el": "αβγδεζηθικλμνξοπρστυ", "ru": "абвгдежзиклмнопрстуы", "uk": "абвгдежзіклмнопрстує", "ja": "あいうえおかきくけこさしす", "zh": "的一是在不了有和人这中大为"}
    docs = [(" ".join("".join(r.choices(a, k=r.randint(2, 7))) for _ in range(25)), lang) for lang, a in alphabets.items() for _ in range(60)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(docs)]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 60 and sum(x.lang_pred == rows[x.doc_id][2] for x in got) >= 0.97 * len(got)


def test_licenses_equal_brute_force(spark):
    texts = [None, "", *(t for _, t in licenses.TEMPLATES), "prose\nreleased under the mit license!!\nmore", "Licensed under the Apache License, Version 9.9.", "x " * 50]
    want = set()
    for i, t in enumerate(texts):
        for seg in (t or "").split("\n"):
            w = licenses.normalise(seg)
            b = set(licenses.bigrams(w))
            for name, form in licenses.TEMPLATES:
                f = licenses.normalise(form)
                g = set(licenses.bigrams(f))
                if b and 2 * len(b & g) / (len(b) + len(g)) >= 0.8 and [x for x in w if x.isdigit()] == [x for x in f if x.isdigit()]:
                    want.add((i, name))
    assert {(r.doc_id, r.license) for r in licenses.find_licenses(_docs(spark, texts)).collect()} == want


def test_licenses_inside_texts(spark):
    whole = dict(reversed(licenses.WHOLE))
    mit, bsd2, bsd3 = whole["MIT"], whole["BSD-2-Clause"], whole["BSD-3-Clause"]
    broken = lambda t, mark="": "\n".join(mark + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    cases = [
        ("MIT License Copyright (c) 2020 A. Person " + mit, {"MIT"}),
        (broken(whole["GPL-3.0"], "# "), {"GPL-3.0"}),
        (broken(whole["AGPL-3.0"], " * "), {"AGPL-3.0"}),
        (broken(whole["LGPL-2.1"]), {"LGPL-2.1"}),
        ("Our notes are below. Released under the MIT License. Share them freely.", {"MIT"}),
        ('Copyright 2020 A. Person. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', {"Apache-2.0"}),
        ("Copyright 2021\n\n" + bsd2.replace("met: R", "met:\n\n1. R").replace("disclaimer. R", "disclaimer.\n\n2. R"), {"BSD-2-Clause"}),
        (broken(bsd3, "// "), {"BSD-3-Clause"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}),
        ("the licence of the software and the permission to use it are free of charge for any purpose", set()),
    ]
    got = licenses.find_licenses(_docs(spark, [t for t, _ in cases])).toPandas()
    assert [set(got[got.doc_id == i].license) for i in range(len(cases))] == [want for _, want in cases]
    twice = licenses.scan(_docs(spark, ["Released under the MIT License.\nReleased under the MIT License.\nand " + whole["ISC"]])).first()
    assert (twice.n_matches, twice.licenses) == (3, "ISC,MIT")


def test_mixing_meets_targets(spark):
    good, bad = _prose(13, 80), [t + " awful vile" for t in _prose(14, 40)]
    docs = _docs(spark, [*good, *bad, None])
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(80)), *((i, 1, 1) for i in range(80, 120)), (5000, None, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, {"q1t0": 0.9, "q1t1": 0.1}).toPandas()
    mass = {d: sum(r.n_tokens * r.rate * r.p[i] for r in rows.itertuples()) for i, d in enumerate(["q1t0", "q1t1"])}
    assert mass["q1t1"] / mass["q1t0"] == pytest.approx(1 / 9, rel=0.02) and (rows.rate >= 0).all()
    assert (mixing.mix(docs, labels.limit(0)).toPandas().rate == 1).all()
    clash = docs.withColumns({"_mixi": F.lit(1), "_mixn": F.lit(2), "_id": F.lit(3), "copies": F.lit(9)})
    mixed = mixing.apply_mix(clash, labels)
    assert mixed.columns == clash.columns and mixed.select("_mixn", "copies").distinct().collect() == [(2, 9)]


def test_copies_meet_targets_below_half_a_rate(spark):
    import corpus_pipeline

    r = random.Random(21)
    # a third of the documents in each domain, so that the two small targets need rates of 0.2 and 0.05
    kind = [i % 3 for i in range(3000)]
    docs = _docs(spark, [" ".join(r.choices("abcdefgh", k=20)) + (" ", " poor weak thin", " awful vile foul")[k] for k in kind])
    rows = [(i, int(k != 1), int(k == 2)) for i, k in enumerate(kind)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    targets = {"q1t0": 0.8, "q0t0": 0.16, "q1t1": 0.04}
    out = mixing.apply_mix(docs, labels, targets).select("doc_id").toPandas()["doc_id"]
    n = Counter(kind[i] for i in out)
    share = {k: n[k] * (20 if k == 0 else 23) for k in n}
    assert [share.get(k, 0) / sum(share.values()) for k in range(3)] == pytest.approx([0.8, 0.16, 0.04], abs=0.03)
    # rates over 1 repeat documents: whole parts always, the rest by the hash
    got = spark.range(4000).select(mixing.copies(F.col("id"), F.lit(1.25)).alias("n")).groupBy("n").count().collect()
    assert {x["n"] for x in got} == {1, 2} and dict(map(tuple, got))[2] == pytest.approx(1000, abs=120)
    # the stage itself, by its own targets, on the table's labels
    sf = "/root/testdata/sf0.01"
    stage_docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = mixing.mix(stage_docs, known).select("doc_id", "n_tokens", "p")
    written = corpus_pipeline.source_mixing(spark, stage_docs, sf).select("doc_id").join(p, "doc_id")
    domains = sorted({f"q{x.quality}t{x.toxic}" for x in known.where("quality is not null and toxic is not null").select("quality", "toxic").distinct().collect()})
    mass = written.agg(*(F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(len(domains)))).first()
    got = dict(zip(domains, (x / sum(mass) for x in mass)))
    assert all(got[d] == pytest.approx(t, abs=max(0.01, t / 2)) for d, t in mixing.TARGETS.items() if d in got and t > 0.01)


def test_empty_tables(spark):
    docs = _docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    v = vocabulary("byte_bpe_50k.json")
    for found in (tokens.token_file_digests(docs, v, True), minhash.near_duplicates(docs), secret_scan.find_secrets(docs), suffixes.remove_repeats(docs), quality.score_quality(docs), embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")), packing.pack_documents(docs, v), langid.predict_languages(docs), mixing.mix(docs, labels), licenses.scan(docs)):
        assert found.count() == 0
