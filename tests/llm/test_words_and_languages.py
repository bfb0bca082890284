"""Spelling variants, alignment of tokenizers and language profiles against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from edge import CLASHES, LONG, ROWS
from pyspark.sql import functions as F

from ionsift.llm import alignment, language_id, queries, spelling
from ionsift.llm.encoders import default_path


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, every=199, least=6, often=5, ratio=5):
    n = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    form, near = {}, collections.Counter()
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out


def spelled(spark, query_folder):
    return {tuple(r) for r in queries.op11_spelling_variants(spark, query_folder).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variant_rows(seed):
    """Words over three letters, with longer and longer misspellings of each, so that forms lead on to forms."""
    own = random.Random(seed)
    rows = []
    for _ in range(25):
        w = "".join(own.choice("abé") for _ in range(own.randint(5, 8)))
        for v, k in ((w, 160), (w + "ö", 32), (w + "öü", 6), ("ü" + w[1:], 5), (w[:-1], 40), (w.upper(), 1), (w + "öüß", 4)):
            rows += [(len(rows) + j, f"{v}. {v},{v}x {v} 7{v}") for j in range(k // 4)] + [(90_000 + len(rows), f"{v} " * (k % 4))]
    return rows


@pytest.mark.parametrize("words,group", [(50_000, 32_000_000), (7, 400)])
def test_op11_against_plain(spark, tmp_path, monkeypatch, words, group):
    """One shard, and many of few words in many groups, give the same."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", words)
    monkeypatch.setattr(spelling, "groups", lambda sizes, most=group, f=spelling.groups: f(sizes, most))
    rows = variant_rows(3)
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(at)
    want = plain_variants(rows)
    assert len(want) > 60 and sum(f is not None and r != f for _, f, r, *_ in want) > 5
    assert spelled(spark, str(tmp_path)) == want


def test_op11_tables(spark, data, folder):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    few = [tuple(r) for r in docs][:60]
    got = spelling.spelling_variants(spelling.word_counts(spark.createDataFrame(few, "doc_id long, text string"), drop_every=199))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(few)
    assert spelled(spark, folder) == plain_variants([(r[0], r[1]) for r in ROWS])


def test_op11_edges_of_the_automaton():
    """Every word of up to four letters over two, against every other."""
    words = sorted(bytes(w) for k in range(1, 5) for w in itertools.product(b"ab", repeat=k))
    for own in (words, words[::3], words[:1], [b"abab"]):
        trie = spelling.Trie.unpacked(spelling.Trie.of(own, list(range(1, len(own) + 1))).packed())
        for w in [*words, b"ababa", b"c", b"cabab", b"aacab"]:
            assert sorted(trie.near(w)) == [(x, i + 1) for i, x in enumerate(own) if x != w and one_edit(w, x)]


def test_op11_groups_are_bounded():
    sizes = [(i, s) for i, s in enumerate([5, 5, 11, 1, 1, 9, 10])]
    assert spelling.groups(sizes, 10) == [[0, 1], [2], [3, 4], [5], [6]]
    assert spelling.groups([], 10) == []


def test_op11_columns(spark, clashing):
    counts = spelling.word_counts(clashing, least_count=1)
    assert set(counts.columns) == {"word", "n"}
    assert counts.where("word = 'document'").first()["n"] == 1
    assert counts.where("word = 'vital'").count() == 0 and counts.where("word = 'intern'").count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))


def spans(ids, data):
    at, out = 0, []
    for i, x in zip(ids, data, strict=True):
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_pairs(library, text):
    """(ids of both, links, groups) or None; every pair of tokens is looked at within a group."""
    if not text:
        return None
    a, b = library
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    byte = {chr(x if x in shown else next(other)): x for x in range(256)}
    one = a.encode(f" {text}", add_special_tokens=False)
    two = b.encode(text)
    x = spans(one.ids, [bytes(byte[c] for c in t) for t in one.tokens])
    y = spans(two, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two])
    want = f" {text}".encode()
    if b"".join(bytes(byte[c] for c in t) for t in one.tokens) != want or sum(q - p for _, p, q in y) != len(want) or b.decode(two).encode() != want[1:]:
        return None
    ends = sorted({q for *_, q in x} & {q for *_, q in y})
    groups, links, begin = [], [], 0
    for end in ends:
        own, others = ([s for s in side if begin <= s[1] and s[2] <= end] for side in (x, y))
        groups.append(",".join(str(i) for i, *_ in own) + "|" + ",".join(str(i) for i, *_ in others))
        links += [(i, j) for i, p, q in own for j, r, s in others if max(p, r) < min(q, s)]
        begin = end
    return len(x), len(y), links, groups


def plain_alignment(library, rows):
    found = [plain_pairs(library, t) for t in rows]
    n = collections.Counter(p for f in found if f for p in set(f[2]))
    best = collections.defaultdict(int)
    for (i, _), k in n.items():
        best[i] = max(best[i], k)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = f
            out.append((a, b, len(groups), len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [
    " leading", "two  spaces", "a \n b", "x\n\n y\tz ", "<|endoftext|> <s> </s> <unk>", "é 　 ﬁ ️😀 日本語", " ", "\n", "  ", "a b", "İ \x85 x", "don't we'll 12 345,6.7!", "\x1c a\x00 b",
    "a﻿ b", " <0x41> ▁ x▁y", "if (x) {\r\n  y();\r\n}", "\r", "line\nline, line. Line", "a" * 700, "ß½Ⅷ²x", "é ü", "trailing ",
]


@pytest.mark.parametrize("few", [False, True])
def test_op12_against_plain(spark, data, tmp_path, library, monkeypatch, few):
    """Odd texts and whole documents; again with caches, buffers and shards so small that all of them turn over."""
    if few:
        monkeypatch.setattr(alignment, "KEYS", 300)
        monkeypatch.setattr(alignment, "SHARD_KEYS", 50)
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = docs + [(1000 + i, t) for i, t in enumerate(ODD)] + [(r[0], r[1]) for r in ROWS if r[1] != LONG]
    spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_alignment(spark, str(tmp_path)).select("doc_id", *alignment.COMPUTED).collect()
    want = [(d, *x) for (d, _), x in zip(rows, plain_alignment(library, [t for _, t in rows]), strict=True)]
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_op12_turnover(library, monkeypatch):
    """Parts that are dropped and made again."""
    monkeypatch.setattr(alignment, "ENTRIES", 5)
    own = alignment.Pair(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
    assert own.splits and own.across
    for t in ODD * 2:
        whole, parts = own._whole(t), own.of(t)
        assert (whole is None) == (parts is None)
        if whole:
            assert b"".join(p.keys for p in parts) == whole.keys and b";".join(p.groups for p in parts) == whole.groups
    assert len(own.held) <= 5 and len(own.old) <= 5


def test_op12_words_are_encoded_together(monkeypatch):
    """Words that aren't held are one text for both tokenizers, with the results of one by one; few of them, and what isn't a word, are taken alone."""
    own = alignment.Pair(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
    words = [f" {w}" for w in ("alignment", "ñandúes", "Überraschungsei", "a", "хлеб", "ciónquedo", "日本語", "thbletiou", "e\u0301", "ﬁne")]
    assert own._parts([*words, ",", " 12", "end", "\n"]) == [own._part(p) for p in [*words, ",", " 12", "end", "\n"]]
    calls, one = [], own._part
    monkeypatch.setattr(own, "_part", lambda p: calls.append(p) or one(p))
    own.of("".join(f"{w}," for w in ("many", " new", " words", " of", " one", " text")))
    assert {*calls} == {","}
    assert own._parts(words[:2]) == [one(p) for p in words[:2]] and calls[-2:] == words[:2]


def test_op12_other_tokenizers_get_whole_texts(monkeypatch):
    own = alignment.Pair(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
    own.splits = False
    text = "two parts, one  text"
    assert own.of(text) == [own._whole(text)]


def test_op12_pair_counts(spark, library):
    texts = ["the cat", "the cat sat", "the", None, "the cat"]
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = collections.Counter(p for t in texts if (f := plain_pairs(library, t)) for p in set(f[2]))
    assert got == want


def test_op12_damaged_shard(spark, tmp_path):
    """A shard that is cut short, and a key that was never counted."""
    counts = alignment.Counts(f"file://{tmp_path}", [("x", 1, 9, 2)], np.zeros(4, np.int64))
    np.array([1, 9, 5, 6], dtype=np.int64).tofile(f"{tmp_path}/x.bin")
    assert alignment.Lookup(counts).counts(np.array([1, 9])).tolist() == [5, 6]
    with pytest.raises(KeyError):
        alignment.Lookup(counts).counts(np.array([1, 3]))
    np.array([1, 9, 5], dtype=np.int64).tofile(f"{tmp_path}/x.bin")
    with pytest.raises(ValueError):
        alignment.Lookup(counts).counts(np.array([1]))


def kept(df, own):
    assert not set(own) - set(df.columns)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    left = [c for c in CLASHES if c not in own]
    assert df.select(*[f"`{c}`" for c in left]).distinct().collect() == [tuple("x" for _ in left)]


def test_op12_columns(spark, clashing):
    df = alignment.alignment(clashing)
    kept(df, alignment.COMPUTED)
    assert df.count() == len(ROWS)


def letters(dimensions, c):
    bits = np.random.Generator(np.random.Philox(key=[language_id.SEED, ord(c)])).integers(0, 2, dimensions, dtype=np.int8)
    return 2 * bits.astype(float) - 1


def plain_vector(text, dimensions, cache={}):  # noqa: B006
    shown = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    words = shown.split(" ")
    spaced = " " + " ".join(w for w in words if w) + " "
    grams = collections.Counter(spaced[i : i + 3] for i in range(len(spaced) - 2)) if spaced.strip() else {}
    total = np.zeros(dimensions)
    for g, k in grams.items():
        if (g, dimensions) not in cache:
            cache[g, dimensions] = np.roll(letters(dimensions, g[0]), 2) * np.roll(letters(dimensions, g[1]), 1) * letters(dimensions, g[2])
        total += k * cache[g, dimensions]
    return total, np.sqrt(sum(k * k for k in grams.values()))


def plain_languages(rows, dimensions=language_id.DIMENSIONS):
    own = {}
    for d, t, lang in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 5 and lang is not None and t is not None:
            v, size = plain_vector(t, dimensions)
            if size:
                own[lang] = own.get(lang, 0) + v / size
    names = sorted(own)
    if not names:
        return [("und", 0.0) for _ in rows]
    p = np.array([own[k] / np.linalg.norm(own[k]) for k in names])
    if len(names) > 1:
        p = p - p.mean(axis=0)
        p /= np.linalg.norm(p, axis=1, keepdims=True)
    out = []
    for _, t, _ in rows:
        v, size = plain_vector(t, dimensions)
        cosines = p @ v / np.linalg.norm(v) if size else None
        out.append(("und", 0.0) if cosines is None else (names[int(np.argmax(cosines))], min(1.0, max(0.0, float(cosines.max())))))
    return out


def test_op13_against_plain(spark, data, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()]
    rows += [(r[0], r[1], r[2]) for r in ROWS] + [(5000, "Москва и 東京 ΣΑΣ", "xx"), (5001, "12 34 !?", "en"), (5002, "é", None), (5004, "quick", None)]
    spark.createDataFrame([(d, t, k, "a", 1) for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in queries.op13_language_id(spark, str(tmp_path)).collect())
    want = collections.Counter((d, zlib.crc32(str("" if d is None else d).encode()) % 5 == 0, k, round(s, 3)) for (d, *_), (k, s) in zip(rows, plain_languages(rows), strict=True))
    assert got == want
    assert got[5001, zlib.crc32(b"5001") % 5 == 0, "und", 0.0] == 1


def test_op13_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    df = queries.op13_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = df.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right >= 0.97 * n


def test_op13_blocks_and_turnover(spark, data, monkeypatch):
    """Prototypes in blocks, n-grams that are dropped and made again, and sums passed on early give the same."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").limit(80).repartition(2).cache()
    rows = lambda **k: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identified(docs, language_id.fit(docs), **k).select("doc_id", "lang_pred", "score").collect())
    want = rows()
    assert rows(most=1) == want
    monkeypatch.setattr(language_id, "ENTRIES", 300)
    monkeypatch.setattr(language_id, "BLOCK", 2)
    assert rows() == want


def test_op13_edges(spark, clashing, nothing):
    df = language_id.identified(clashing, language_id.fit(clashing))
    kept(df, ["lang_pred", "score"])
    assert df.count() == len(ROWS)
    assert df.where("text is null and (lang_pred <> 'und' or score <> 0)").count() == 0
    untaught = language_id.identified(clashing, language_id.fit(nothing))
    assert {r["lang_pred"] for r in untaught.select("lang_pred").collect()} == {"und"}


def test_op13_large_weights_are_exact():
    own = language_id.Vectors(64)
    codes, counts = language_id.grams("many words of one text and some more of them")
    assert np.array_equal(own.bundle(codes, counts * (1 << 26)), own.bundle(codes, counts) * (1 << 26))
