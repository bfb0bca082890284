"""The ten queries and their operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import zlib

import brute
import pyarrow as pa
import pytest
from edge import CLASHES, ROWS
from pyspark.sql import functions as F

from ionsift.llm import binary_packing, bpe_count, golay_dedup, host_quality, matroska, prefix_shards, queries, source_mix, token_files, toxic_passages, warc
from ionsift.llm.encoders import default_path


def counted(rows):
    return collections.Counter(map(repr, rows))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(default_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).collect() == []


def keeps_columns(df, own, replaced):
    """The clashing input columns that an operator doesn't compute come through as they were."""
    assert not set(own) - set(df.columns)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    left = [c for c in CLASHES if c not in replaced]
    assert df.select(*[f"`{c}`" for c in left]).distinct().collect() == [tuple("x" for _ in left)]


def test_op1(spark, folder, clashing):
    got = queries.op1_host_quality(spark, folder).select("doc_id", *host_quality.RULES).collect()
    assert counted(tuple(r) for r in got) == counted((d, *brute.rules(t)) for d, t, *_ in ROWS)
    df = host_quality.host_quality(clashing)
    keeps_columns(df, [*host_quality.RULES, "kept"], {"n_words", "kept"})
    assert df.count() == len(ROWS)
    assert df.where("kept and base_failed").count() == 0
    assert df.where("source is null and host_rejected").count() == 0


def test_op1_hosts(spark):
    """A host of failures rejects its few good documents; hosts like the others don't."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "bad") for i in range(200)] + [(1000 + i, "short" if i % 20 == 0 else f"{good} {i}", f"h{i % 5}") for i in range(500)]
    df = host_quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["source"] for r in df.where("host_rejected").select("source").distinct().collect()} == {"bad"}
    assert df.where("not kept and not base_failed").count() == 10


def test_op1_no_pushed_down_lambdas(spark, docs):
    plan = host_quality.host_quality(docs).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "lambda" in line for line in plan.split("\n"))


def toxic_table(spark, n=600, noise=0):
    """Every eighth text is toxic; every noise-th clean one holds one of its words."""
    import random

    random.seed(7)
    bad, stems = ["vile", "rotten", "scummy"], ["grulo"]
    words = [f"{a}{b}" for a in ("lo", "ma", "ti", "se", "ra") for b in ("ban", "ter", "lin", "sor", "dek", "fum")]
    rows, labels = [], []
    for i in range(n):
        w = [random.choice(words) + random.choice(["", "a", "o"]) for _ in range(random.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice([*bad, random.choice(stems) + random.choice(words)]))
        elif noise and i % noise == 1:
            w[0] = random.choice(bad)
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op2_accuracy_and_passages(spark):
    docs, labels = toxic_table(spark)
    model = toxic_passages.fit(docs, labels.where(~toxic_passages.held_out(F.col("doc_id"))))
    df = toxic_passages.toxicity(docs, model).join(labels, "doc_id").where(toxic_passages.held_out(F.col("doc_id"))).cache()
    wrong, toxic = df.where("predicted <> toxic").count(), df.where("toxic = 1").count()
    assert toxic > 15 and wrong <= 0.1 * toxic
    hit = df.where("toxic = 1 and size(passages) > 0").select("text", F.col("passages")[0].alias("p")).collect()
    assert len(hit) >= 0.9 * toxic
    assert all(any(b in r["text"][r["p"]["start"] : r["p"]["end"]] for b in ("vile", "rotten", "scummy", "grulo")) for r in hit)


def test_op2_against_brute(spark, tmp_path):
    """The query's scores and evidence, of clean, toxic, empty, repeated and long texts, against a plain version."""
    docs, labels = toxic_table(spark, 240, 7)
    rows = [tuple(r) for r in docs.collect()]
    long = " ".join(t for _, t, *_ in rows)  # all toxic words of the table, far more passages than one text has
    rows += [(9000, long, None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (9003, "vile " * 30, None, None, None), (9004, "rotten vile 12 ÄÖ İx scummy", None, None, None)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_toxic_passages(spark, str(tmp_path)).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(toxic_passages.PARTS)).alias("p")).collect()}
    learnt, held = ([(t, known[d]) for d, t, *_ in rows if d in known and (part[d] == 0) == fits] for fits in (False, True))
    assert {y for _, y in learnt} == {y for _, y in held} == {0, 1}
    for (d, *_), (evidence, score) in zip(rows, brute.toxicity([t for _, t, *_ in rows], learnt, held), strict=True):
        assert got[d]["evidence"] == pytest.approx(evidence, rel=1e-6, abs=1e-9)
        assert got[d]["score"] == pytest.approx(score, rel=1e-4, abs=1e-9)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.7)


def test_op2_all_passages_count():
    """Evidence of a text with hundreds of significant passages and thousands of weak ones."""
    import decimal

    model = toxic_passages.Model(rate=1.0, constant=0.01)
    for n in (1, 13, 40, 400):
        segments = [(i, i + 1, 9.0 + i / 1000) for i in range(n)] + [(i, i + 1, 0.5) for i in range(5000)]
        means = sorted(decimal.Decimal(100.0) * decimal.Decimal(-s).exp() for *_, s in segments)
        want = max(brute.poisson_tail(r, m) for r, m in enumerate(means, 1) if m <= 0.05)
        assert model.evidence(segments, 10_000) == pytest.approx(want)
        assert n == 1 or want > model.evidence(segments[: n - 1], 10_000)


def test_op2_keeps_every_unit(spark):
    """Every token and prefix learnt from has its score in the model."""
    docs, labels = toxic_table(spark, 120)
    model = toxic_passages.fit(docs, labels)
    part = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(toxic_passages.PARTS)) != 0).select("doc_id").collect()}
    learnt = [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").collect() if r["doc_id"] in part]
    score, tokens = brute.toxic_scorer(learnt), sorted({t for text, _ in learnt for t in brute.toxic_tokens(text)} | {"vilex", "grulox", "unheard", "lob"})
    units = {u for t in tokens[:] for u in (t, *(f"{n}:{t[:n]}" for n in (4, 5, 6) if len(t) >= n))}
    assert len(model.units) <= len(units) and len(set(model.units.tolist())) == len(model.units)
    assert [x + toxic_passages.DRIFT for x in model.fresh_scores(tokens)] == pytest.approx([score(t) for t in tokens])


def test_op2_one_hot_id(spark):
    """An id with many rows is learnt from once."""
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(2, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxic_passages.sample(docs, labels, "text", "doc_id", "toxic", 10).count() == 2


def test_op2_edges(spark, folder, clashing, docs):
    rows = queries.op2_toxic_passages(spark, folder).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    one = spark.createDataFrame([(1, 1, 1), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxic_passages.fit(docs, one)
    assert 0 < model.probability(0.0) < 1
    keeps_columns(toxic_passages.toxicity(clashing, model), ["score", "predicted"], {"score", "predicted", "passages"})


def test_op2_segments_against_all_pairs():
    import itertools
    import random

    import numpy as np

    def slow(s):
        """The best segment, then the same on both sides of it."""
        if not len(s):
            return []
        best = max(((sum(s[a:b]), -a, -(b - a)) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[1], -best[1] - best[2]
        return [*slow(s[:a]), (a, b, best[0]), *[(x + b, y + b, z) for x, y, z in slow(s[b:])]]

    random.seed(2)
    for _ in range(300):
        s = [random.choice([-3, -2, -1, 1, 2, 5]) + random.random() * 1e-3 for _ in range(random.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxic_passages.maximal_segments(np.array(s))] == [(a, b) for a, b, _ in slow(s)]


def test_op3(spark, folder, clashing):
    size, total, goal, taken = brute.mix([(d, t, s) for d, t, _, s, _ in ROWS])
    got = queries.op3_source_mix(spark, folder).collect()
    want = [(d, n, total[s], round(goal[s], 6), k) for (d, _, _, s, _), n, k in zip(ROWS, size, taken, strict=True)]
    assert counted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == counted(want)
    assert counted(queries.op3_source_mix(spark, folder).collect()) == counted(got)
    keeps_columns(source_mix.mixed(clashing), ["size", "taken"], {"size", "taken", "target"})


def test_op3_repeats(spark, repeats):
    """Copies of one row, a thousand or three, give their source's words to the last one."""
    got = queries.op3_source_mix(spark, repeats).collect()
    texts = spark.read.parquet(f"{repeats}/documents.parquet").select("doc_id", "text", "source").collect()
    of = {(r["doc_id"], len((r["text"] or "").split())): r["source"] for r in texts}
    taken, goal, each = collections.Counter(), {}, collections.defaultdict(set)
    for r in got:
        s = of[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        goal[s] = r["target"]
        each[r["doc_id"], r["size"]].add(r["taken"])
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == len(texts) and goal.keys() == {"s", "t", None}
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert all(max(k) - min(k) <= 1 for k in each.values())


def test_op3_mixture(spark, docs):
    rows = source_mix.mixture(docs).collect()
    _, _, goal, taken = brute.mix([(d, t, s) for d, t, _, s, _ in ROWS])
    words = collections.Counter()
    for r in rows:
        words[r["source"]] += len(brute.WORD.findall(r["text"]))
    want = collections.Counter()
    for (_, _, _, s, _), k in zip(ROWS, taken, strict=True):
        want[s] += k
    assert words == +want
    texts = {t for _, t, *_ in ROWS if t}
    for r in rows:
        assert r["text"] in texts or any(t.lstrip().startswith(r["text"]) for t in texts)


def test_op3_targets(spark):
    import random

    random.seed(1)
    for _ in range(4):
        sizes = {f"s{i:02d}": random.choice([0, 1, 5, 50, 1000]) for i in range(random.randint(1, 12))} | {None: random.choice([0, 30])}
        df = spark.createDataFrame(list(sizes.items()), "__source string, source_size long")
        got = {r["__source"]: r["target"] for r in source_mix.targets(df).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_op3_many(spark):
    """Bins of three steps against one sort."""
    rows = [(i, " ".join(["w"] * (i % 37 + 1)) + f" {i}", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, _, _, taken = brute.mix(rows)
    got = {r["doc_id"]: r["taken"] for r in source_mix.mixed(df).collect()}
    assert got == {d: k for (d, *_), k in zip(rows, taken, strict=True)}


def test_op4(spark, folder, library, clashing):
    lib = library["byte_bpe_50k.json"]
    rows = queries.op4_binary_packing(spark, folder).collect()
    want = []
    for d, t, *_ in ROWS:
        ids, at = [*lib.encode(t or "", add_special_tokens=False).ids, 1], 0
        for n in binary_packing.binary_lengths(len(ids)):
            want.append((d, at, n, brute.crc(ids[at : at + n]), len(ids)))
            at += n
        assert at == len(ids)
    assert counted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == counted(want)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and {r["offset"] for r in rows} == {0}
    by = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by] == sorted((r["length"] for r in rows), reverse=True)
    full = binary_packing.packed_sequences(clashing)
    assert full.where("octet_length(ids) <> 4 * length").count() == 0


def test_op4_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 4096, 10000):
        parts = binary_packing.binary_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)


def test_op5(spark, folder, clashing, docs):
    prints = [brute.fingerprint(t) for _, t, *_ in ROWS]
    cls = brute.components(prints)
    ids = collections.defaultdict(list)
    for (d, *_), c in zip(ROWS, cls, strict=True):
        ids[c].append(d)
    want = [(d, f"{p:016x}", brute.smallest(ids[c])) for (d, *_), p, c in zip(ROWS, prints, cls, strict=True)]
    assert counted(tuple(r) for r in queries.op5_golay_dedup(spark, folder).select("doc_id", "fingerprint", "component_id").collect()) == counted(want)
    keeps_columns(golay_dedup.near_duplicates(clashing), ["fingerprint", "component_id"], {"fingerprint", "component_id"})
    stay = golay_dedup.one_of_each(docs).collect()
    assert len(stay) == len(set(cls))
    assert sorted(r["doc_id"] for r in stay if r["doc_id"] is not None) == sorted(x for x in (brute.smallest(v) for v in ids.values()) if x is not None)


def test_op5_keys_lose_no_pair():
    import random

    import numpy as np

    random.seed(4)
    for _ in range(400):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), random.choice([0, 1, 2])):
            b ^= 1 << bit
        keys, ends = golay_dedup.candidate_keys(np.array([a, b], dtype=np.uint64).view(np.int64))
        assert set(keys[: ends[1]]) & set(keys[ends[1] :])
        assert ends[1] <= 18


@pytest.mark.parametrize("crowd", [1, 3, 64])
@pytest.mark.parametrize("most", [1, 2])
def test_op5_links_against_all_pairs(spark, monkeypatch, crowd, most):
    """Near and far fingerprints, with crowded keys and without."""
    import random

    random.seed(9)
    monkeypatch.setattr(golay_dedup, "CROWD", crowd)
    base = [random.getrandbits(64) for _ in range(6)]
    prints = {b for b in base} | {0, 2**63, 2**64 - 1}
    for b in base[:3]:
        for _ in range(60):
            x = b
            for bit in random.sample(range(64), random.choice([1, 1, 2, 3, 4])):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "id long, fp long")
    got = {r["fp"]: r["component_id"] for r in golay_dedup.classes(df, most).collect()}
    cls = brute.components(prints, most)
    low = {}
    for i, c in enumerate(cls):
        low.setdefault(c, i)
    assert got == {s: low[c] for s, c in zip(signed, cls, strict=True)}


def test_op6(spark, folder, library, clashing):
    lib = library["byte_bpe_50k.json"]
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in ROWS]
    assert counted(tuple(r) for r in queries.op6_bpe_count(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == counted(want)
    keeps_columns(bpe_count.token_counts(clashing), ["n_tokens", "over_limit"], {"n_tokens", "n_bytes"})


def test_encoders_on_odd_texts(library):
    import random

    import numpy as np

    from ionsift.llm.encoders import Encoder

    random.seed(3)
    alphabet = [*"abcXYZ '.,!?0123\n\t\r", *"éßçñÀ 　\x85\x1c\x1f́ͅ²½Ⅷ中文ΣσςİıДж😀‍  ​_-", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " \n", "don't", "ﬁ", "Å", "foo,", "Bar."]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(8000)]
    count = bpe_count.Counter(default_path("byte_bpe_50k.json"))
    for name, lib in library.items():
        own = Encoder(default_path(name))
        for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.ids(t), "<u4").tolist() == e.ids
            if name.startswith("byte"):
                assert count.count(t) == len(e.ids)


def test_op7(spark, folder, clashing):
    rows = queries.op7_matroska(spark, folder).collect()
    want = []
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert counted((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == counted(want)
    assert all("cues=" in r["feature"] for r in rows)
    keeps_columns(matroska.with_media(clashing), ["media"], {"media", "n_bytes"})


def test_op7_packets(spark, docs):
    media = matroska.with_media(docs)
    p = matroska.packet_table(media.where("doc_id = 5"))
    whole = p.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.countDistinct("cluster").alias("c"), F.collect_set("lacing").alias("l"), F.max("timestamp_ns").alias("t")).first()
    n = len(ROWS[4][1].encode())
    assert whole["s"] == -(-n // 64) * 64 and whole["n"] == -(-n // 1024) and whole["c"] == -(-whole["n"] // 64) and whole["t"] == (whole["n"] - 1) * 128_000_000
    assert "fixed" in whole["l"]


def test_op7_lacing_and_sizes():
    """All lacings, unknown sizes, block groups and bad files."""
    frames = [b"a" * n for n in (700, 3, 255, 0, 510, 42)]
    for kind in ("xiph", "ebml"):
        body = matroska.block(1, 5, frames, kind)
        _, rel, flags, ranges = matroska.frame_ranges(body, 0, len(body))
        assert rel == 5 and [body[a : a + n] for a, n in ranges] == frames
    cluster = matroska._uint(matroska.TIMESTAMP, 9) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, matroska.block(1, 1, [b"xy"], "none")))
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    head = matroska._element(matroska.EBML, matroska._element(matroska.DOC_TYPE, b"matroska"))
    data = head + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + unknown + matroska._element(matroska.CUES, b"")
    media = matroska.parse(data)
    assert [(p.cluster, p.timestamp_ns, p.size, p.keyframe) for p in media.packets] == [(0, 10_000_000, 2, False), (1, 10_000_000, 2, False)]
    for bad in (b"", b"\x1a\x45\xdf\xa3\x8f", b"\0" * 20, data[:-3] + b"\x1c\x53\xbb\x6b\x88"):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def test_op7_malformed_files():
    """Only ValueError, for parts that end early or are missing, and for any cut or changed byte."""
    import random

    m = matroska
    head = m._element(m.EBML, m._element(m.DOC_TYPE, b"matroska"))
    track = m._uint(m.TRACK_NUMBER, 1) + m._uint(m.TRACK_TYPE, 2) + m._element(m.CODEC_ID, b"A_X")
    whole = lambda *parts: head + m._element(m.SEGMENT, b"".join(parts))
    tracks = lambda body: m._element(m.TRACKS, m._element(m.TRACK_ENTRY, body))
    blocks = lambda body: m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 0) + m._element(m.SIMPLE_BLOCK, body))
    assert m.parse(whole(tracks(track), blocks(m.block(1, 0, [b"ab"], "none")))).packets[0].size == 2
    xiph, ebml = (m.block(1, 0, [b"a" * 300, b"b" * 10, b"c"], k) for k in ("xiph", "ebml"))
    for bad in (
        blocks(xiph[:6]), blocks(xiph[:5]), blocks(xiph[:4]), blocks(ebml[:5]), blocks(ebml[:6]), blocks(xiph[:9]), blocks(m.block(1, 0, [b"ab", b"cd"], "fixed")[:-1]), blocks(b"\x81\0"), blocks(b"\xff\0\0\x80abc"), blocks(b""),
        tracks(m._uint(m.TRACK_TYPE, 2) + m._element(m.CODEC_ID, b"A_X")), tracks(m._uint(m.TRACK_NUMBER, 1) + m._element(m.CODEC_ID, b"A_X")), tracks(m._uint(m.TRACK_NUMBER, 1) + m._uint(m.TRACK_TYPE, 2)),
        tracks(track + m._element(m.AUDIO, m._element(m.SAMPLING_FREQUENCY, b"abc"))), tracks(m._element(m.TRACK_NUMBER, b"\1" * 9) + track[3:]), tracks(m._uint(m.TRACK_NUMBER, 1) + m._uint(m.TRACK_TYPE, 2) + m._element(m.CODEC_ID, b"\xff")),
        m._element(m.CUES, m._element(m.CUE_POINT, b"")), m._element(m.CUES, m._element(m.CUE_POINT, m._uint(m.CUE_TIME, 1) + m._element(m.CUE_TRACK_POSITIONS, m._uint(m.CUE_TRACK, 1)))),
        m._element(m.CUES, m._element(m.CUE_POINT, m._uint(m.CUE_TIME, 1) + m._element(m.CUE_TRACK_POSITIONS, m._uint(m.CUE_CLUSTER_POSITION, 1)))),
    ):
        with pytest.raises(ValueError):
            m.parse(whole(bad))
    random.seed(5)
    data = m.mux(bytes(range(256)) * 300)
    for _ in range(400):
        d = bytearray(data[: random.choice([len(data), random.randrange(len(data))])])
        for _ in range(random.randint(1, 4)):
            if d:
                d[random.choice([random.randrange(len(d)), random.randrange(min(len(d), 200))])] = random.randrange(256)
        try:
            m.parse(bytes(d))
        except ValueError:
            pass


def test_op7_many_clusters_of_unknown_size():
    m = matroska
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m._uint(m.TIMESTAMP, 1) + m._element(m.SIMPLE_BLOCK, m.block(1, 0, [b"x"], "none"))
    data = m._element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster * 3000
    assert len(m.parse(data).packets) == 3000


def test_op7_stored_and_read_again(spark, folder, docs, tmp_path):
    """The media column written as a table and parsed from there gives what the query gives."""
    matroska.with_media(docs).write.parquet(f"{tmp_path}/media")
    back = spark.read.parquet(f"{tmp_path}/media")
    got = back.select("doc_id", "n_bytes", matroska.digests(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")
    assert counted(tuple(r) for r in got.collect()) == counted(tuple(r) for r in queries.op7_matroska(spark, folder).collect())
    whole = matroska.packet_table(back).groupBy("doc_id").agg(F.sum("size").alias("s"))
    assert all(r["s"] % 64 == 0 for r in whole.collect())


def test_op7_sizes_round_trip():
    for n in (0, 1, 64, 1023, 1024, 1025, 8192, 65536, 65600, 70000, 200064):
        p = bytes(i % 251 for i in range(n)).ljust(max(64, -(-n // 64) * 64), b"\0")
        data = matroska.mux(p)
        assert matroska.demux(data, matroska.parse(data)) == p


def pages_want():
    first = {}
    for d, t, *_ in ROWS:
        k = t or ""
        first[k] = d if first.get(k) is None else first[k] if d is None else min(d, first[k])
    out = []
    for d, t, *_ in ROWS:
        b, f = (t or "").encode(), first[t or ""]
        revisit = f is not None and f != d and [r[1] or "" for r in ROWS].count(t or "") > 1
        out.append((d, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return out


def test_op8(spark, folder):
    rows = queries.op8_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert counted(tuple(r) for r in rows) == counted(pages_want())


@pytest.mark.parametrize("size", [37, 500, 1 << 20])
def test_op8_ranges(spark, folder, tmp_path, size):
    """Every record once, however the archives are cut, payloads included."""
    at = f"file://{tmp_path}/w"
    files = warc.write(spark.read.parquet(f"{folder}/pages.parquet").repartition(3), at)
    rows = warc.read(files, size).collect()
    assert counted((r["page_id"], r["payload"]) for r in rows if r["record_type"] == "response") == counted((d, t or "") for (d, t, *_), w in zip(ROWS, pages_want(), strict=True) if w[3] == "response")
    assert len(rows) == len(ROWS) == files.agg(F.sum("records")).first()[0]
    assert warc.read(warc.archives(spark, at)).count() == len(ROWS)


def test_op8_damage():
    data = warc.member(warc.record(1, "http://a", b"hello"))
    body = warc.parsed(zlib.decompress(data, 31))
    assert body["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parsed(zlib.decompress(data, 31).replace(b"hello", b"hullo"))


def archive(texts):
    return [warc.member(warc.record(i, f"http://a/{i}", t)) for i, t in enumerate(texts)]


def read_all(data, size):
    """All ranges of an archive in memory."""
    return [r for a in range(0, len(data), size) for r in warc.records(pa.BufferReader(data), a, a + size)]


@pytest.mark.parametrize("size", [50, 300, 1 << 20])
def test_op8_damaged_members(size):
    """A cut member, a flipped byte anywhere, bytes after the last member and a missing piece: an error whatever the ranges, never fewer records."""
    parts = archive([b"alpha " * 40, bytes(range(256)) * 3, b"omega"])
    data = b"".join(parts)
    assert len(read_all(data, size)) == 3
    bad = [data[:-5], data + b"tail", data[: len(parts[0])] + data[len(parts[0]) + 9 :], b"x" + data]
    bad += [data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :] for i in (0, 12, len(parts[0]) // 2, len(parts[0]), len(parts[0]) + 40, len(data) - 30, len(data) - 2)]
    for d in bad:
        with pytest.raises(ValueError):
            read_all(d, size)


def test_op8_round_trip_counts(spark, folder, tmp_path, monkeypatch):
    """An archive that lost records whole is found by the writer's count."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    real = warc.write

    def losing(*args):
        return real(*args).withColumn("records", F.col("records") + 1)

    monkeypatch.setattr(warc, "write", losing)
    with pytest.raises(ValueError, match="written"):
        warc.round_trip(pages, f"file://{tmp_path}/lost")


def test_op8_clashing_columns(spark, clashing, tmp_path):
    """Other columns of pages, of any name, have no part in it."""
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *[F.lit("x").alias(c) for c in (*CLASHES, "sha1", "record_type", "path")])
    rows = warc.round_trip(pages, f"file://{tmp_path}/c", payload=True)
    assert rows.columns == ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    assert counted(tuple(r) for r in rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == counted(pages_want())


def test_op8_is_standard_gzip(spark, folder, tmp_path):
    import glob
    import gzip

    warc.write(spark.read.parquet(f"{folder}/pages.parquet"), f"file://{tmp_path}/g")
    text = b"".join(gzip.open(p).read() for p in glob.glob(f"{tmp_path}/g/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)


def test_op9(spark, folder, clashing):
    rows = queries.op9_prefix_shards(spark, folder).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t, *_ in order]
    total, at, slots, want = sum(sizes), 0, collections.Counter(), []
    for (d, t, *_), n in zip(order, sizes, strict=True):
        s = min(15, (2 * at + n) * 16 // (2 * total))
        want.append((d, n, zlib.crc32((t or "").encode()), "bytes", s, slots[s], None))
        slots[s] += 1
        at += n
    assert counted(tuple(r) for r in rows) == counted(want)
    keeps_columns(prefix_shards.byte_shards(clashing), ["size", "shard", "slot"], {"size", "shard", "slot"})


def test_op9_balance(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    out = prefix_shards.byte_shards(df, shards=7)
    per = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    mean = sum(r["b"] for r in per) / 7
    assert len(per) == 7 and all(abs(r["b"] - mean) <= 91 and r["n"] == r["d"] == r["m"] + 1 for r in per)


def test_op10(spark, folder, library):
    lib = library["word_bpe_49k.json"]
    rows = queries.op10_token_files(spark, folder).collect()
    assert len(rows) == len(ROWS)
    bag = counted((d, brute.crc([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, *_ in ROWS)
    assert counted((r["doc_id"], r["ids_crc32"]) for r in rows) == bag
    at, last = 0, -1
    for r in sorted(rows, key=lambda r: r["start"]):
        key = float("inf") if r["doc_id"] is None else r["doc_id"]
        assert r["start"] == at and key >= last
        at, last = at + r["n_tokens"], key


def test_encoders_cut_no_numerals(library):
    """A part ends where letters end; halves, squares and Roman numerals are numbers, as the libraries' patterns have it."""
    from ionsift.llm.encoders import BYTE_PARTS, WORD_PARTS

    assert BYTE_PARTS.findall("½5 ab² xⅧ9 ¾") == ["½5", " ab", "²", " x", "Ⅷ9", " ¾"]
    assert WORD_PARTS.findall("½5 abc, xⅧ") == ["½5", "abc", ",", "xⅧ"]


def test_op10_width(spark, tmp_path):
    """An id above 65,535 is refused in 16 bits and kept in 32; the width follows the vocabulary; ids of documents are whole numbers."""
    import numpy as np

    for ids, width, fine in (([70000], 2, False), ([65535], 2, True), ([70000], 4, True), ([], 2, True)):
        own = np.array(ids, dtype="<u4").tobytes()
        if fine:
            assert np.frombuffer(token_files.narrowed(own, width), f"<u{width}").tolist() == ids
        else:
            with pytest.raises(ValueError, match="70000"):
                token_files.narrowed(own, width)
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="70000"):
        token_files.write(df, f"file://{tmp_path}/w", end=70000, width=2)
    at = f"file://{tmp_path}/x"
    rows = token_files.read(token_files.write(df, at, end=70000), at).collect()
    assert rows[0]["ids"][-1] == 70000
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.write(df.withColumn("doc_id", F.col("doc_id").cast("string")), f"file://{tmp_path}/y")


def test_op10_odd_ids_and_columns(spark, clashing, tmp_path):
    """The smallest and largest ids, null ids, one id in most rows, and columns of any name."""
    rows = [(-(2**63), "a"), (2**63 - 1, "b"), (None, "c"), (0, "d"), (None, None)] + [(7, f"w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    at = f"file://{tmp_path}/z"
    shards = token_files.write(df, at, shards=8)
    assert shards.agg(F.max("docs")).first()[0] < 250
    got = token_files.read(shards, at).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows if d is not None)) + [None, None]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    files, folder = token_files.token_files(clashing, f"file://{tmp_path}/c")
    assert token_files.read(files, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    assert token_files.read(files, folder).count() == len(ROWS)


def test_op10_ranges():
    """Ranges rise with the ids; an id that is several bounds may go to all of theirs, no id to those at the end."""
    import numpy as np

    r = token_files.Ranges(np.array([5, 7, 7, 7, 9]), 6, 2)
    assert [r.of(i) for i in (4, 5, 6, 7, 8, 9, 10, None)] == [(0, 1), (0, 2), (1, 1), (1, 4), (4, 1), (4, 2), (5, 1), (6, 2)]
    for a, b in ((4, 5), (5, 6), (6, 7), (7, 8), (9, 10)):  # the last range of an id is the first of the next at most
        assert sum(r.of(a)) - 1 <= r.of(b)[0]


def test_op10_one_row_many_times(spark, tmp_path):
    """Rows alike in id and text fill several shards, and all of them come back; so do tables without any id."""
    rows = [(7, "same words here")] * 400 + [(i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name, own in (("a", df), ("n", df.withColumn("doc_id", F.lit(None).cast("long")))):
        at = f"file://{tmp_path}/{name}"
        shards = token_files.write(own, at, shards=10)
        assert shards.agg(F.max("docs")).first()[0] <= 130
        assert token_files.read(shards, at).count() == 500


def test_op10_files_not_local(spark, docs, tmp_path, monkeypatch):
    """Shards read by ranges are those that are mapped."""
    at = f"file://{tmp_path}/r"
    for r in token_files.write(docs, at, shards=2).collect():
        near = token_files.Shard(at, r["name"])
        monkeypatch.setattr(token_files.fs, "LocalFileSystem", type("Other", (), {}))
        far = token_files.Shard(at, r["name"])
        monkeypatch.undo()
        for step in (1, 3, 100):
            for a in range(0, len(near), step):
                b = min(a + step, len(near))
                assert [(i, s, x.tolist()) for i, s, x in near.documents(a, b)] == [(i, s, x.tolist()) for i, s, x in far.documents(a, b)]


def test_op10_files(spark, docs, tmp_path, library):
    at = f"file://{tmp_path}/t"
    shards = token_files.write(docs, at, shards=3)
    for width in (2, 4):
        own = f"{at}{width}"
        rows = token_files.read(token_files.write(docs, own, width=width, shards=3), own).where("doc_id = 6").collect()
        assert rows[0]["ids"] == [*library["word_bpe_49k.json"].encode(ROWS[5][1], add_special_tokens=False).ids, 1]
    name = shards.orderBy("part").first()["name"]
    (tmp_path / "t" / f"{name}.bin").write_bytes(b"")
    with pytest.raises(ValueError):
        token_files.Shard(at, name)
