"""Hand-offs with deadlines as streams, evidence as a table function, and masked retrieval."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ionsift.operators import evidence, generators, retrieval
from ionsift.streaming import handoff

T0 = datetime.datetime(2026, 1, 1, 12)


def events(spark, folder, rows):
    """One file of events, (kind, molecule, ranking, seconds after T0)."""
    spark.createDataFrame([(k, m, r, T0 + datetime.timedelta(seconds=s)) for k, m, r, s in rows], handoff.EVENT).coalesce(1).write.mode("append").json(folder)


def starter(tmp_path, name, patience=60_000):
    out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")

    def start(stream):
        return handoff.answered(stream, patience).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    return start, out


def test_deadlines(spark, tmp_path):
    """Answers in time, too late, never, and for nobody; passes go on until the marker, and no state is left."""
    folder = str(tmp_path / "events")
    start, out = starter(tmp_path, "a")
    events(spark, folder, [("asked", "fast", ["o1"], 0), ("asked", "slow", ["o2", "o3"], 0), ("asked", "never", ["o4"], 10), ("done", "fast", ["r1"], 20)])
    with pytest.raises(TimeoutError):
        handoff.until_complete(spark, folder, start, wait=0, most=1)
    read = lambda: sorted((r["molecule_id"], r["ranking"], r["status"]) for r in spark.read.schema(handoff.ANSWER).json(out).collect())
    assert read() == [("fast", ["r1"], "revised")]
    events(spark, folder, [("asked", "other", ["o5"], 100), ("done", "stray", ["r9"], 100)])  # the clock passes the deadline of the first three
    start(spark.readStream.schema(handoff.EVENT).json(folder)).awaitTermination()
    assert {("slow", ("o2", "o3"), "expired"), ("never", ("o4",), "expired"), ("stray", ("r9",), "unexpected")} <= {(m, tuple(r), s) for m, r, s in read()}
    events(spark, folder, [("done", "slow", ["late"], 105), ("done", "other", ["r5"], 110)])
    handoff.complete(spark, folder)
    assert handoff.until_complete(spark, folder, start, wait=0) == 1
    assert read() == [("fast", ["r1"], "revised"), ("never", ["o4"], "expired"), ("other", ["r5"], "revised"), ("slow", ["late"], "unexpected"), ("slow", ["o2", "o3"], "expired"), ("stray", ["r9"], "unexpected")]
    query = start(spark.readStream.schema(handoff.EVENT).json(folder))
    query.awaitTermination()
    assert len(read()) == 6
    state = spark.read.format("statestore").option("path", str(tmp_path / "a-cp")).option("stateVarName", "under_way").load()
    assert state.count() == 0


@pytest.mark.parametrize("again", ["done", "asked"])
def test_repeated_molecules_fail(spark, tmp_path, again):
    folder = str(tmp_path / "events")
    start, _ = starter(tmp_path, again)
    events(spark, folder, [("asked", "m", ["o"], 0), ("done", "m", ["r"], 1)])
    start(spark.readStream.schema(handoff.EVENT).json(folder)).awaitTermination()
    events(spark, folder, [(again, "m", ["r"], 2)])
    with pytest.raises(StreamingQueryException, match="twice"):
        start(spark.readStream.schema(handoff.EVENT).json(folder)).awaitTermination()


PEAKS = "spectrum int, at int, mz double, intensity double"


def test_evidence_as_a_table_function(spark):
    """The same rows as the joins, over spectra with many peaks and few; by SQL and laterally; what it refuses."""
    import random

    random.seed(4)
    steps = [18.0106, 17.0265, 27.9949, 43.9898, 162.0528, 0.5]
    rows = []
    for s in range(12):
        m, mzs = 60.0, []
        for _ in range(random.randint(0, 25)):
            m += random.choice(steps) + random.choice([0, 0.001, -0.001, 0.004])
            mzs.append(round(m, 4))
        rows += [(s, i, x, random.random()) for i, x in enumerate(sorted(mzs))]
    peaks = spark.createDataFrame(rows, PEAKS)
    modes = [("[M+H]+", "positive", "Orbitrap"), ("[M-H]-", "negative", "qTOF"), ("[M+H]+", "positive", "ion trap"), ("[M+Na]+", "positive", "Orbitrap")]
    spectra = spark.createDataFrame([(s, *modes[s % 4], 400.0 + s) for s in range(12)], "spectrum int, adduct string, ionization_mode string, instrument_type string, precursor_mz double")
    rules = evidence.rule_table(spark)
    rounded = lambda df: sorted((r["spectrum"], r["rule"], r["kind"], round(r["mz"], 6), round(r["error_da"], 8), round(r["strength"], 9), r["from_at"], r["to_at"]) for r in df.collect())
    for kind in ({}, {"absolute": 0.02}):
        want = rounded(evidence.matches(spectra, peaks, rules, **kind))
        assert want and rounded(generators.evidence_matches(spectra, peaks, rules, **kind)) == want
    generators.peaks_with_rules(spectra, peaks, rules).createOrReplaceTempView("peaks_with_rules")
    text = generators.rules_json(rules)
    sql = f"select m.rule, count(*) as n from evidence_matches(table(peaks_with_rules), '{text}', 10.0D, 0.002D) m group by 1"
    want = evidence.matches(spectra, peaks, rules).groupBy("rule").count().collect()
    assert {(r["rule"], r["n"]) for r in spark.sql(sql).collect()} == {(r["rule"], r["count"]) for r in want}
    for bad in (f"evidence_matches(table(select 1 as spectrum), '{text}', 10.0D, 0.002D)", "evidence_matches(table(peaks_with_rules), null, 10.0D, 0.002D)"):
        with pytest.raises(Exception, match="lack|constant"):
            spark.sql(f"select * from {bad}").collect()


def test_masked_scenarios(spark):
    """The own key is missing in one scenario alone, whatever its score; groups without a truth are in neither."""
    library = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("b", "y", 0.7), ("c", "z", 0.1)], "group string, key string, score double")
    truth = spark.createDataFrame([("a", "x"), ("b", "q")], "group string, key string")
    got = sorted((r["case"], r["key"], r["score"]) for r in retrieval.scenarios(library, truth).collect())
    assert got == [("known#a", "x", 0.9), ("known#a", "y", 0.5), ("known#b", "y", 0.7), ("unknown#a", "y", 0.5), ("unknown#b", "y", 0.7)]
    centers = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0)], "group string, center double")
    pool = centers.crossJoin(spark.createDataFrame([("x", 100.0), ("y", 100.001)], "key string, mass double")).select("group", "key", "mass")
    bits = spark.createDataFrame([("x", ["1", "2"]), ("y", ["1", "2", "3"])], "key string, bits array<string>")
    ranks, cases = retrieval.masked_baselines(centers, pool, bits, library, truth)
    order = {}
    for r in ranks.orderBy("rank").collect():
        order.setdefault(r["case"], []).append(r["key"])
    assert order == {"known#a": ["x", "y"], "unknown#a": ["y", "x"], "known#b": ["y", "x"], "unknown#b": ["y", "x"]}
    assert {(r["case"], r["confidence"]) for r in cases.collect()} == {("known#a", 0.9), ("unknown#a", 0.5), ("known#b", 0.7), ("unknown#b", 0.7)}
    assert ranks.where(F.col("scenario") == "known").select("group").distinct().count() == 2
