"""The pipeline, stage by stage, against plain versions of what each keeps."""

import collections
import os

import brute
from edge import CLASHES, ROWS, SCHEMA, table

import corpus_pipeline
from ionsift.llm import binary_packing
from ionsift.llm.encoders import default_path

NAMES = ["quality_rules", "toxicity", "near_duplicates", "mixing", "packing"]


def good(i, n=70):
    return " ".join(f"word{i}x{k}" for k in range(n))


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    rows = [(100 + i, good(i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(200 + i, good(i), "en", "s0", 1) for i in range(5)]  # exact copies
    rows += [(300, "too short", "en", "s1", 1), (301, None, None, None, None)] + [ROWS[8]] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "t")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 0), (101, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    assert kept.columns == docs.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(r for r in rows if not brute.rules(r[1])[-1])
    assert corpus_pipeline.toxicity(spark, kept, folder).count() == kept.count()  # one label of each kind says too little
    once = corpus_pipeline.near_duplicates(spark, kept, folder).cache()
    left = [r for r in kept.collect()]
    cls = brute.components([brute.fingerprint(r["text"]) for r in left])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(min(r["doc_id"] for r, c in zip(left, cls, strict=True) if c == k) for k in set(cls))
    mix = corpus_pipeline.mixing(spark, once, folder).cache()
    assert mix.columns == docs.columns
    _, _, _, taken = brute.mix([(r["doc_id"], r["text"], r["source"]) for r in once.collect()])
    assert sum(len(r["text"].split()) for r in mix.collect()) == sum(taken)
    packed = corpus_pipeline.packing(spark, mix, folder).collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = [n for r in mix.collect() for n in binary_packing.binary_lengths(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1)]
    assert sorted(r["length"] for r in packed) == sorted(want)


def test_toxicity(spark, tmp_path):
    """What the stage keeps against the plain version of the scores."""
    import zlib

    from pyspark.sql import functions as F
    from test_operators import toxic_table

    docs, labels = toxic_table(spark, 240, 7)
    rows = [tuple(r) for r in docs.collect()] + [(9000, None, "fr", None, None), (None, "", None, "x", 0), (9001, "vile rotten scummy " * 3, None, None, None)]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, docs.schema)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).alias("p")).collect()}
    learnt, held = ([(t, known[d]) for d, t, *_ in rows if d in known and (part[d] == 0) == fits] for fits in (False, True))
    want = [r for r, (_, score) in zip(rows, brute.toxicity([r[1] for r in rows], learnt, held), strict=True) if score < 0.7]
    assert len(rows) - 40 < len(want) < len(rows) - 20
    for extra in (False, True):
        own = df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df
        out = corpus_pipeline.toxicity(spark, own, str(tmp_path))
        assert out.columns == own.columns
        assert collections.Counter(tuple(r)[:5] for r in out.collect()) == collections.Counter(want)
        assert not extra or out.select(*[f"`{c}`" for c in CLASHES]).distinct().collect() == [tuple("x" for _ in CLASHES)]


def test_quality_rules_reject_hosts(spark):
    """A host of failures loses its few good documents as well; one table serves sums and rows."""
    rows = [(i, good(i) if i % 20 == 0 else "short", "en", "bad", 1) for i in range(200)] + [(1000 + i, "short" if i % 20 == 0 else good(i), "en", f"h{i % 5}", 1) for i in range(500)]
    out = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(r for r in rows if r[3] != "bad" and r[1] != "short")


def test_near_duplicates_one_exchange(spark, tmp_path):
    """Texts are exchanged once, unless rows repeat in id and text; then one of each stays, by the other columns."""
    rows = [(i, good(i % 50), "en", f"s{i % 3}", i) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/d")
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "__row" in line for line in plan.split("\n")) <= 1
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(50))
    twice = [*rows, *[(i, good(i), "aa", "z", 1) for i in range(20)], *[(7, good(7), "aa", "z", 1)] * 200, (None, good(99), "en", "b", 2), (None, good(99), "en", "a", 2), (None, good(98), None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(twice, SCHEMA).repartition(6), "").collect()
    assert len(out) == 52
    assert {tuple(r) for r in out} == {(i, good(i), "aa", "z", 1) for i in range(20)} | set(rows[20:50]) | {(None, good(99), "en", "a", 2), (None, good(98), None, None, None)}


def test_run_of_whole(spark, tmp_path):
    """run() gives what the plain versions of all stages give one after the other, and leaves one stage's table behind."""
    import glob

    rows = [(100 + i, good(i), "en", f"s{i % 3}", 1) for i in range(40)] + [(200 + i, good(i), "en", "s0", 1) for i in range(5)] + [(300, "too short", "en", "s1", 1), (301, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passing = [r for r in rows if not brute.rules(r[1])[-1]]
    cls = brute.components([brute.fingerprint(r[1]) for r in passing])
    once = [min(r for r, c in zip(passing, cls, strict=True) if c == k) for k in set(cls)]
    size, _, _, taken = brute.mix([(r[0], r[1], r[3]) for r in once])
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = []
    for r, n, k in zip(once, size, taken, strict=True):
        for part in [n] * (k // n) + [k % n] * (k % n > 0):
            ids = [*lib.encode(" ".join(r[1].split(" ")[:part]), add_special_tokens=False).ids, 1]
            want += [(r[0], length, len(ids)) for length in binary_packing.binary_lengths(len(ids))]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    left = lambda: {at for name in (*NAMES, "kept") for at in glob.glob(f"{shared}/ionsift-{name}-*")}
    before = left()
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "doc_tokens").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert [at.split("-")[1] for at in (os.path.basename(x) for x in left() - before)] == ["mixing"]


def test_run(spark, folder, bare):
    assert corpus_pipeline.run(spark, bare).collect() == []
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}


def test_clashing_columns(spark, folder):
    df = table(spark, ROWS, True)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        out.collect()
    mix = corpus_pipeline.mixing(spark, df, folder)
    assert mix.columns == [c for c in df.columns if c not in ("size", "taken", "target")]
    mix.collect()
    pieces = corpus_pipeline.packing(spark, df, folder)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in pieces.collect()} == {r[0] for r in ROWS}
