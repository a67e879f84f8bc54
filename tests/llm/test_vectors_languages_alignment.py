"""Whitening, language identification and tokenizer alignment against plain computations, with all edge cases of their docstrings."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograph.llm import alignment, language, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# Whitening


def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 6)) * np.array([5, 4, 1, 1, 0.5, 0.1])
    rows = [(i, [float(c) for c in v], f"n{i}") for i, v in enumerate(base)]
    rows += [(0, rows[0][1], "again"), (None, rows[1][1], "no id"), (100, rows[0][1], "copy of another"), (101, None, "null"), (102, [], "empty")]
    rows += [(103, [1.0, None, 2.0, 3.0, 4.0, 5.0], "null entry"), (104, [float("nan")] * 6, "nan"), (105, [float("inf")] * 6, "inf"), (106, [1.0, 2.0], "short"), (107, None, None)]
    return rows


def expected_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    z = (n * x - s) / n @ v / np.sqrt(e)
    return n, ((n * x - s) ** 2).sum(axis=1), z, e / np.trace(c.T @ c / n)


def same_up_to_sign(got, want):
    signs = np.sign((got * want).sum(axis=0))
    return np.allclose(got * signs, want, atol=1e-9)


@pytest.mark.parametrize(("width", "blocks"), [(None, 8), (4, 3), (5, 1)])
def test_whitening_equals_dense_eigenvectors(spark, width, blocks):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, t, 9) for i, v, t in rows], "vec_id long, embedding array<double>, note string, n int").repartition(3)
    out = whitening.whiten(df, k=4, width=width, blocks=blocks)
    assert out.columns == ["vec_id", "note", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [(i, v, t) for i, v, t in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    n, deviation, z, share = expected_whitening([v for _, v, _ in kept], 4)
    got = {}
    for r in out.collect():
        got.setdefault(r["note"], {})[r["component"]] = r
    assert set(got) == {t for _, _, t in kept} and all(sorted(x) == [1, 2, 3, 4] for x in got.values())
    assert all(int(got[t][1]["deviation"]) == d and got[t][1]["n"] == n for (_, _, t), d in zip(kept, deviation))
    assert same_up_to_sign(np.array([[got[t][c]["whitened"] for c in range(1, 5)] for _, _, t in kept]), z)
    one = got[kept[0][2]]
    assert np.allclose([one[c]["explained"] for c in range(1, 5)], share, rtol=1e-9) and one[1]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    kinds = "vec_id long, embedding array<float>, component string"
    assert whitening.whiten(spark.createDataFrame([], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x"), (2, [], "x")], kinds)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 2.0], "x"), (3, [5.0, 2.0], "x")], kinds)).collect()
    assert [r["component"] for r in flat] == [1, 1, 1]  # the second entry never varies
    assert sorted(round(abs(r["whitened"]), 9) for r in flat) == [0.0, round(1.5**0.5, 9), round(1.5**0.5, 9)]


def test_whitening_counts_beyond_a_long():
    x = np.array([[1_000_000, 1_000_064]])
    wide = whitening.deviations(x, 2**50, [2**50 * 1_000_000, 2**50 * 1_000_000], 2_000_000)
    assert wide.tolist() == [[0, 64 * 2**50]]
    with pytest.raises(RuntimeError):
        whitening.PASSES, old = 1, whitening.PASSES
        try:
            whitening.leading(lambda q: np.diag(np.arange(50.0)) @ q, 50, 2, 2, blocks=1)
        finally:
            whitening.PASSES = old


def test_leading_of_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([[5, 5, 5, 4.0001, 4], np.linspace(3.9, 0, 115)])
    a = q * values @ q.T
    e, v, passes, worst = whitening.leading(lambda b: a @ b, 120, 6, 12)
    assert np.allclose(e, values[:6], atol=1e-10) and worst < 1e-10 and passes < 40
    assert np.allclose(a @ v, v * e, atol=1e-10) and np.allclose(v.T @ v, np.eye(6), atol=1e-12)


def test_an_entry_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 2.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(df).collect()


# Languages

PARTS = {"aa": ["ka", "to", "mi", "re", "sun"], "bb": ["ulf", "ergh", "ost", "wik"], "cc": ["ño", "qué", "lla", "dro"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_rows():
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = ["aa", "aa", "bb", "cc"][i % 4]
        rows.append((i, sentence(rng, lang, rng.randrange(3, 40)).upper() if i % 7 == 0 else sentence(rng, lang, rng.randrange(3, 40)), lang))
    rows += [(300, None, "aa"), (301, "", "bb"), (302, " 12 *** ", "cc"), (303, "zzzz xyxy", None), (None, sentence(rng, "bb", 30), "cc"), (304, rows[3][1], "aa"), (304, rows[3][1], "aa"), (305, sentence(rng, "cc", 20_000), None)]
    return rows


def test_languages_of_held_out_rows(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, t, g, 5, "x") for i, t, g in rows], "doc_id long, text string, lang string, score int, other string").repartition(3)
    out = language.identify(df).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "lang", "other", "held_out", "lang_pred", "score", "lead"}
    by = {}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert by.setdefault(r["doc_id"], r) == r  # repeated rows agree
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (300, 301, 302))
    assert by[None]["lang_pred"] == "bb" and by[305]["lang_pred"] == "cc" and by[303]["lang_pred"] == "aa" and by[303]["score"] == 0
    held = [r for r in out if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 60 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_languages_without_anything_to_learn(spark):
    kinds = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], kinds)).count() == 0
    rows = language.identify(spark.createDataFrame([(1, "words here", None), (2, None, "aa")], kinds)).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def plain_grams(text, n):
    kinds = language.word_characters()
    blank = "".join(c if kinds[ord(c)] else " " for c in text.lower()).split()
    padded = [" " * (n - 2) + w + " " * (n - 2) for w in blank]
    return [g for w in padded for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g[1:-1].strip()]


def test_ngrams_are_those_of_the_words():
    texts = ["Ab, cde!", "", "...", "x", "9 ÉTÉ été-x", "áb  \n c"]
    for n in (3, 4, 5):
        key, valid, bounds, letters = language.ngrams(texts, n)
        assert letters.tolist() == [True, False, False, True, True, True]
        for i, t in enumerate(texts):
            own = key[bounds[i] : bounds[i + 1]][valid[bounds[i] : bounds[i + 1]]]
            alone, ok, _, _ = language.ngrams([t], n)
            assert Counter(own.tolist()) == Counter(alone[ok].tolist())
            words = plain_grams(t, n)
            assert len(own) == len(words) and len(set(own.tolist())) == len(set(words))


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text = sentence(random.Random(4), "aa", 3000)
    key, valid, _, _ = language.ngrams([text], 4)
    monkeypatch.setattr(language, "BLOCK", 100)
    parts = [language.ngrams([p], 4) for p in language.blocks(text)]
    assert len(parts) > 50 and Counter(k for p in parts for k in p[0][p[1]].tolist()) == Counter(key[valid].tolist())
    assert [i for lot in language.packed([text, None, "a b"]) for i, _ in lot][-1] == 2


def test_filters_answer_for_more_than_64_languages(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(8)] for i in range(70)}
    rows = [(j * 100 + i, " ".join(rng.choice(w) for _ in range(12)), g) for i, (g, w) in enumerate(own.items()) for j in range(3)]
    f = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.table.shape[1] == 2 and len(f.languages) == 70
    hits, n, _ = f.counts([t for _, t, _ in rows])
    best, share, _ = f.judge(hits, n)
    assert [f.languages[b] for b in best] == [g for _, _, g in rows] and share.min() == 1.0  # no false negatives
    strange, m, _ = f.counts([" ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(4000))])
    assert np.allclose(strange / m, f.false, atol=0.01)  # what a strange text finds is what the correction takes off


# Alignment


def alignment_rows():
    rng = random.Random(8)
    words = "the naïve  café — Überraschung tokenization 12345 don't re-enter 日本語 émoji 😀 x=1;".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, " "), (53, "<|endoftext|> and <s> </s> <unk> <0x41>"), (54, "a▁b"), (55, "\n\n\t  x\r\n"), (56, "aaaa" * 300), (57, "z " * 900), (None, rows[0][1]), (3, rows[3][1]), (58, "\x00 nul")]


def expected_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, p = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE), alignment.pair(A_FILE, B_FILE)
    a.encode_special_tokens = True
    each, counts = [], Counter()
    for i, t in rows:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba, bb = [p.a_bytes[x] for x in ia], [p.b_bytes[x] for x in ib]
        if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            each.append((i, None))
            continue
        ends = [list(np.cumsum([len(x) for x in parts])) for parts in (ba, bb)]
        found, at = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            found.append(tuple([x for x, e in zip(ids, e2) if at < e <= end] for ids, e2 in zip((ia, ib), ends)))
            at = end
        linked = Counter((x, y) for g in found for x in g[0] for y in g[1])
        counts.update(linked.keys())
        each.append((i, (len(ia), len(ib), found, linked)))
    most = {}
    for (x, _), c in counts.items():
        most[x] = max(most.get(x, 0), c)
    out = []
    for i, e in each:
        if e is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, found, linked = e
        sha = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found).encode()).hexdigest()
        out.append((i, na, nb, len(found), sum(linked.values()), sum(n for k, n in linked.items() if counts[k] == most[k[0]]), sum(n * counts[k] for k, n in linked.items()), sha))
    return out


@pytest.mark.parametrize(("piece", "wide", "broadcast"), [(1 << 16, 1 << 14, 2_000_000), (20, 2, -1)])
def test_alignment_equals_plain_groups(spark, monkeypatch, piece, wide, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    rows = alignment_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    p = alignment.pair(A_FILE, B_FILE)
    monkeypatch.setattr(alignment, "PIECE", piece)
    monkeypatch.setattr(alignment, "WIDE", wide)
    want = expected_alignment(rows)
    local = alignment.align([t for _, t in rows], p)  # with the lowered bounds, which Python workers don't see
    assert [(x[0], x[1], x[2], x[3], x[6]) for x in local] == [(w[1], w[2], w[3], w[4], w[7]) for w in want]
    assert all(sum(x[5].tolist()) == x[3] for x in local)
    out = alignment.align_tokenizers(df, A_FILE, B_FILE)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id string, text string"), A_FILE, B_FILE).count() == 0
    ids = alignment.align_tokenizers(spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string"), A_FILE, B_FILE).orderBy(F.desc("doc_id")).collect()
    assert ids[0]["doc_id"] == "a" and ids[0]["n_groups"] == 2 and ids[1]["n_a"] == 0


def test_the_fast_encoder_cuts_like_the_library():
    from tokenizers import Tokenizer

    a, p = Tokenizer.from_file(A_FILE), alignment.pair(A_FILE, B_FILE)
    a.encode_special_tokens = True
    rng = random.Random(3)
    early = [chr(i) for i in range(0x530)]
    texts = ["".join(early)] + ["".join(rng.choice(early + [" "] * 300 + ["'s", "\n"] * 60) for _ in range(200)) for _ in range(60)] + [" " * 3000, "x" * 3000, "\n \t" * 5000, "日本 " * 50]
    assert p.fast is not None and [x.tolist() for x in p.encode(texts)[0]] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
