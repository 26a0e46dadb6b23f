from pyspark.sql import functions as F

from sievewright.operators import outcomes
from sievewright.streaming import arrivals


def test_outcomes(spark):
    schema = "i long, baseline map<string,string>, candidate map<string,string>, baseline_ran boolean, candidate_ran boolean, candidate_succeeded boolean, truncated boolean, fail_to_pass array<string>, pass_to_pass array<string>, expected_label boolean"
    good, bad = {"a": "PASSED", "b": "PASSED"}, {"a": "FAILED", "b": "PASSED"}
    rows = [
        (0, bad, good, True, True, True, False, ["a"], ["b"], True), (1, bad, bad, True, True, False, False, ["a"], ["b"], None), (2, good, good, True, True, True, False, ["a"], ["b"], None),
        (3, bad, {"a": "PASSED"}, True, True, True, False, ["a"], ["b"], None), (4, bad, good, True, True, True, True, ["a"], ["b"], None), (5, bad, good, False, False, True, True, ["a"], ["b"], None),
        (6, bad, bad, True, True, False, False, ["a"], ["b"], True), (7, bad, good, True, True, False, False, ["a"], ["b"], True),
    ]
    got = {r.i: (r.reason, r.resolved, r.label_agrees) for r in outcomes.evaluate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        0: (None, True, True), 1: (None, False, None), 2: ("baseline_not_reproduced", None, None), 3: ("incomplete_tests", None, None), 4: ("truncated", None, None), 5: ("baseline_failed_to_run", None, None),
        6: ("label_disagreement", False, False), 7: ("exit_contradicts_tests", None, None),
    }


def test_failures_of_reporters(spark):
    jest = "  ✕ fixes bug (12ms)\n  ✓ keeps behavior\n\n  ● suite › fixes bug\n\nTests:       1 failed, 1 passed, 2 total"
    ava = "  ✘ [fail]: fixes bug Rejected promise returned by test\n  ✓ keeps behavior\n\n  fixes bug\n\n  1 test failed"
    logs = [
        ("  1) fixes bug\n  ✓ keeps behavior\n  2) keeps behavior:", ["fixes bug", "keeps behavior"]), (jest, ["fixes bug"]), (ava, ["fixes bug"]), ("  ✕ fixes bug (12ms)", []),
        ("  ✕ fixes bug (12ms)\n  ● suite › fixes bug", []), ("  ✕ fixes bug (12ms)\nTests:       1 failed, 1 passed, 2 total", []), ("  ✘ [fail]: fixes bug Rejected promise returned by test", []),
        ("  ✘ [fail]: fixes bug Rejected promise returned by test\n  fixes bug", []), ("  ✘ [fail]: fixes bug Rejected promise returned by test\n  1 test failed", []), ("", []), (None, None),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(logs)], "k int, log string")
    got = {r.k: r.n for r in df.select("k", outcomes.failed_names(F.col("log")).alias("n")).collect()}
    assert got == {k: n for k, (_, n) in enumerate(logs)}


def test_logs_and_lists(spark):
    df = spark.createDataFrame([({"x (3ms)": "passed", "x": "failed", "y": "skipped"}, "  1) z [2 ms]\n  2) x:\nnoise", ["x", "z"], '["p", ""]', "single")], "s map<string,string>, log string, e array<string>, l string, m string")
    n = outcomes.normalized_statuses(F.col("s"))
    r = df.select(n.alias("n"), outcomes.with_recovered(n, F.col("log"), F.col("e")).alias("w"), outcomes.listed(F.col("l")).alias("l"), outcomes.listed(F.col("m")).alias("m"), outcomes.training_text(["m", "l"]).alias("t")).first()
    assert r.n == {"x": "FAILED", "y": "SKIPPED"} and r.w == {"x": "FAILED", "y": "SKIPPED", "z": "FAILED"}
    assert (r.l, r.m) == (["p"], ["single"]) and r.t == '{"l":"[\\"p\\", \\"\\"]","m":"single"}'


def test_arrivals(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-01 00:00:10"), ("a", "2025-01-01 00:00:20"), ("b", "2025-01-01 00:01:10")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), df.schema)
    for name, result in (("first", arrivals.first_arrivals(stream, ["k"], "t", "1 hour")), ("counts", arrivals.windowed_counts(stream, "t", "1 minute", "1 hour", ["k"]))):
        mode = "append" if name == "first" else "complete"
        q = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("first").collect()) == ["a", "b"]
    assert sorted((r.k, r.n_rows) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
