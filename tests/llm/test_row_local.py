"""Operators that work row by row: tokenizers, URLs, licences, quality, decontamination."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.llm import bpe, decontaminate, licenses, packed_ids, quality, url_filter

BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "  two  spaces\n\n", "é" * 300, "x" * 5000, "ab" * 900 + "!", "ΑΣ ΟΔΟΣ ß İ", "<|endoftext|> B<|startoftext|>", "<|ENDOFTEXT|>", "\x1cA\x85B\xa0C", "1234567 ١٢٣ don't I'LL we've", "日本語テキスト🙂🙂", "e\u0301 \u0301a"]


@pytest.fixture(scope="module")
def encoder():
    with open(BPE, "rb") as f:
        return bpe.encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_bpe_is_the_librarys(encoder, judge, text):
    (got,) = encoder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == judge.encode_ordinary(text)
    assert encoder.decode(got) == text.encode()


def test_one_tree_and_many_trees_agree(encoder, judge):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin shrdluéñ") for _ in range(rng.randrange(2, 30))) for _ in range(400)]
    for w in words:
        raw = w.encode()
        assert encoder.merge(raw) == np.frombuffer(encoder.merge_rows([raw], 64)[0], "<u4").tolist()
    assert encoder.encode(ODD) == [np.array(judge.encode_ordinary(t), "<u4").tobytes() for t in ODD]


def documents(spark, texts, first=0):
    """Documents with an extra column that clashes with names the operators use."""
    return spark.createDataFrame([(first + k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, words string, ids int")


def test_bpe_columns(spark, judge):
    df = documents(spark, [None, *ODD])
    ids = df.select("doc_id", "text", bpe.encode_column(spark, BPE, public_tokenizers.PATTERN).alias("ids"))
    back = ids.select("doc_id", "ids", bpe.decode_column(spark, BPE, public_tokenizers.PATTERN).alias("back"))
    got = {r.doc_id: (bytes(r.ids), bytes(r.back)) for r in back.collect()}
    for k, t in enumerate([None, *ODD]):
        assert got[k] == (np.array(judge.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
    assert df.limit(0).select(bpe.encode_column(spark, BPE, public_tokenizers.PATTERN).alias("x")).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, size=n, dtype=np.uint64).astype("<u4") for n in (0, 1, 70_000, 5, packed_ids.BLOCK)]
    with open(tmp_path / "f", "wb") as out:
        w = packed_ids.PackedWriter(out, bits)
        for k, d in enumerate(docs):
            w.add(None if k == 1 else k, d)
        w.close()
    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_input_file(str(tmp_path / "f")) as f:
        r = packed_ids.PackedReader(f)
        assert (r.bits, r.has.tolist()) == (bits, [1, 0, 1, 1, 1])
        for k, d in enumerate(docs):
            assert (r.document(k) == d).all()
        whole = np.concatenate(docs)
        for a, b in ((0, 1), (65_535, 65_537), (70_000, 70_010), (len(whole) - 1, len(whole))):
            assert (r.read(a, b) == whole[a:b]).all()
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with fs.open_input_file(str(tmp_path / "bad")) as f, pytest.raises(ValueError):
        packed_ids.PackedReader(f)


def test_files_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    texts = [None, *ODD, "Same words, again. And again!", "Same words, again. And again!"]
    df = documents(spark, texts).repartition(5).union(spark.createDataFrame([(None, "no id", "", 0), (3, "again 3", "", 0)], "doc_id long, text string, words string, ids int"))
    got = packed_ids.write_and_read(df, WORDS, 1).collect()
    want, start = [], 0
    for d, t in sorted([*enumerate(texts), (None, "no id"), (3, "again 3")], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert packed_ids.write_and_read(df.limit(0), WORDS, 1).count() == 0


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(r), v, r) for v, r in url_filter.RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    return host, path, None, "block" if any(w in host for w in ("casino", "free-bets", "poker", "xxx", "porn", "malware", "phish", "cheap-pills", "torrent")) or "/phishing/" in path or path.endswith(".exe") else "allow"


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://a.example.com/en", "http://example.com", "http://xexample.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://a.net/fr", "http://x.org/a.net/es/", "http://free-bets.org/", "http://a.org/phishing/x", "http://a.org/x.exe?y", "http://a.org/x.exe/", "http://é.com/ü", "http://com/", "http://" + "a" * 3000 + ".net/es/" + "b" * 3000, "x://y://z.com/q", "://com?/", "http://u\n.com/\nx", "http://casino.com", "http://a.com#/en/"]


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "other") for k, u in enumerate(URLS)] * 2, "page_id long, url string, rule string")
    got = sorted(tuple(r)[:5] for r in url_filter.judge(df).collect())
    want = sorted([(k, *by_hand(u)) for k, u in enumerate(URLS)] * 2)
    assert Counter(got) == Counter(want)
    assert url_filter.judge(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab*?", max_size=6), st.text("ab/*?", max_size=80)), min_size=1, max_size=5), st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab/", max_size=80)), min_size=1, max_size=6))
def test_automaton_is_a_glob(globs, urls):
    import re

    a = url_filter.compile_globs(globs)
    got = a.run([h.encode() + b"\0" + p.encode() for h, p in urls])
    rx = lambda g: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
    assert got.tolist() == [[bool(rx(gh).fullmatch(h) and rx(gp).fullmatch(p)) for gh, gp in globs] for h, p in urls]


LICENCES = [None, "", "...", "Licensed under the Apache License, Version 2.0 (x)", "gnu general\npublic-license; MIT license? cc by", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0", "Released under the MIT License", "permission is granted by apache", "license " * 50, "All rights reserved.", "mit é license", "the apache-license the apache licence"]


def test_licences(spark):
    got = {r.doc_id: r for r in licenses.scan(documents(spark, LICENCES)).collect()}
    for k, t in enumerate(LICENCES):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ") if w]
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r = got[k]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert "apache-2.0" in got[3].labels and "gpl-notice" in got[5].labels and "cc-by-nc" in got[6].labels and got[10].labels == "all-rights-reserved" and got[9].labels == ""
    assert licenses.scan(documents(spark, LICENCES).limit(0)).count() == 0


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "walked", "under", "light", "morning", "quiet", "garden", "seven", "and"]) for _ in range(n)) + "."


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        rows.append((k, prose(rng, 60) if good else " | ".join(prose(rng, 1).upper() + "$$$" for _ in range(40))))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "x" * 200_000), (9002, "x" * 200_000)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    drawn = quality.sample(docs, known)
    assert all(zlib.crc32(str(r.key).encode()) % 5 for r in drawn.collect()) and quality.sample(docs, known, 10).count() == 20
    got = {r.doc_id: r for r in quality.classify(docs, quality.fit(drawn)).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    out = [k for k, _ in rows if got[k].held_out]
    assert out == [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == labels[k][1] for k in out) >= 0.98 * len(out)
    assert got[9000].score == got[9001].score
    assert quality.classify(docs.limit(0), quality.fit(drawn.limit(0))).count() == 0
    assert {r.predicted for r in quality.classify(docs.limit(3), quality.fit(drawn.filter("label = 1"))).collect()} == {1}


def test_calibration_converges_where_full_newton_steps_run_away():
    rng = np.random.default_rng(12)
    for trial in range(40):
        n = 400
        y = (rng.random(n) < rng.uniform(0.1, 0.9)).astype(float)
        d = np.where(y == 1, rng.normal(-0.8, 0.5, n), rng.normal(1.3, 1.0, n))
        r = np.where(y == 1, rng.normal(-1.0, 0.3, n), rng.normal(-2.2, 1.0, n))
        far = rng.random(n) < 0.02  # a few rows far out, some on the wrong side
        d[far], r[far] = rng.uniform(-9, 7, far.sum()), rng.uniform(-4.4, 0.4, far.sum())
        x = np.stack([np.ones(n), d, r, np.minimum(0, r + 1.5) ** 2], axis=1)
        w = quality._logistic(x, y)
        z = x @ w
        p = 1 / (1 + np.exp(-z))
        loss = np.logaddexp(0, z).sum() - y @ z
        assert np.isfinite(w).all() and loss < 0.69 * n, trial
        scale = np.abs(x).max(axis=0)
        assert np.abs((x / scale).T @ (p - y) + 1e-2 * w * scale).max() < 1e-2  # the slope of the penalised loss is nil
        assert (p[y == 1] >= 0.3).mean() > 0.9


ITEMS = ["What is the deepest point of the northern garden pool? It lies near the old iron gate, under three metres of water.", "Seven travellers crossed the frozen plain before dawn. None of them carried a lamp. The youngest led the way home.", "short item"]


def test_leaks(spark):
    rng = random.Random(6)
    filler = prose(rng, 300)
    texts = [None, "", filler, filler + " " + ITEMS[0] + " " + filler, ITEMS[1].upper() + filler, ITEMS[0].split("?")[0] + "? " + filler, "a short item here", (filler + " ") * 30 + ITEMS[1], ITEMS[0] + " " + ITEMS[1], filler + ITEMS[1].replace("lamp", "torch")]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(ITEMS)] + [(7, None), (8, ""), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(documents(spark, texts), bench).collect()}
    assert {(3, 0), (4, 1), (7, 1), (8, 0), (8, 1), (6, 2)} <= got and not {d for d, _ in got} & {0, 1, 2, 5}
    assert decontaminate.contamination(documents(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contamination(documents(spark, texts).limit(0), bench).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(17)
    vocabulary = [f"v{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]

    def some(n):
        return rng.choices(vocabulary, weights, k=n)

    items = [(some(rng.randrange(4, 25)), some(rng.randrange(2, 25))) for _ in range(40)]
    texts = [None, ""]
    for _ in range(160):  # whole items, and such as lose words of either part
        held = some(rng.randrange(0, 200))
        for question, answer in rng.sample(items, rng.randrange(0, 3)):
            lost = rng.choice([0, 0, 0.03, 0.1, 0.3])
            copy = [w if rng.random() >= lost else "gone" for w in question + answer]
            held += copy[: rng.choice([len(copy), len(copy), len(question)])] + some(rng.randrange(0, 120))
        texts.append(" ".join(held))
    bench = spark.createDataFrame([(k, " ".join(q) + "? " + " ".join(a)) for k, (q, a) in enumerate(items)], "item_id long, text string")

    whole = [q + a for q, a in items]
    mean, span = sum(map(len, whole)) / len(whole), max(map(len, whole))
    having = Counter(w for x in whole for w in set(x))
    weight = []
    for x in whole:
        norm = 1.2 * (0.25 + 0.75 * len(x) / mean)
        weight.append({w: math.log(1 + (len(whole) - having[w] + 0.5) / (having[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in Counter(x).items()})

    def share(part, passage):
        n = min(5, len(part))
        cut = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        return len(cut(part) & cut(passage)) / len(cut(part))

    want = {}
    for doc, t in enumerate(texts):
        words = (t or "").split()
        for a in range(0, max(1, len(words) - span), span):
            passage = words[a : a + 2 * span]
            for k, (q, x) in enumerate(items):
                score = sum(v for w, v in weight[k].items() if w in passage) / sum(weight[k].values())
                if score >= 0.6 - 1e-9 and share(q, passage) >= 0.8 and share(x, passage) >= 0.8:
                    want[doc, k] = max(score, want.get((doc, k), 0))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(documents(spark, texts), bench).collect()}
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_wand_finds_what_scoring_everything_finds():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for k in range(150)]
    frequency = Counter(t for _, x in items for t in set(x.split()))
    index = decontaminate.Index(items, frequency, len(items), sum(len(x.split()) for _, x in items) / len(items), 0.35)
    hits = 0
    for _ in range(200):
        source = rng.choice(items)[1].split()
        words = set(rng.sample(source, max(1, len(source) * 2 // 3)) + [rng.choice(vocabulary) for _ in range(30)])
        terms = sorted(index.terms[w] for w in words if w in index.terms)
        brute = {}
        for t in terms:
            for k, w in zip(index.items[t], index.weights[t], strict=True):
                brute[k] = brute.get(k, 0.0) + w
        want = {k for k, s in brute.items() if s >= 0.35}
        assert {k for k, _ in index.search(terms, 0, len(items) - 1)} == want
        assert want <= set(index.possible(np.array(terms)).tolist())
        hits += len(want)
    assert hits > 100


def test_digest_of_ids(spark, judge, tmp_path):
    from driftmark.llm import queries

    spark.createDataFrame([(1, "Hello, world"), (2, None)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, str(tmp_path)).collect()}
    ids = np.array(judge.encode_ordinary("Hello, world"), "<u4").tobytes()
    assert got[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[1].n_tokens == len(ids) // 4
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello, world").hexdigest() and got[2].n_tokens == 0
