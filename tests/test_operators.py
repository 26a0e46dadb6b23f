import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import contamination, decisions, evidence, normalization, profile, recovery, selection, skew
from sievewright.sources import snapshot

TASK = "row_index long, instance_id string, repository string, base_commit string, license string, language string"
SHA = "a" * 40


def tasks(spark, rows):
    return spark.createDataFrame(rows, TASK)


def decided(spark, rows):
    d = decisions.task_decisions(tasks(spark, rows)).orderBy("row_index").collect()
    return [(r.reason_code, r.cause_code) for r in d]


def test_task_reasons_in_order(spark):
    good = ["i", "Acme/Widget", SHA, "MIT", "ts"]
    rows = [(0, *good), (1, "j", "x", SHA, "MIT", "ts"), (2, "k", "a/b", "12", "MIT", "ts"), (3, "l", "a/b", SHA, None, None), (4, "m", "a/b", SHA, "GPL-3.0", "ts"), (5, None, "a/b", SHA, "MIT", "ts"), (6, "n", "a/b", SHA, "MIT", " "), (7, "o", None, SHA, "MIT", "ts")]
    got = [g[0] for g in decided(spark, rows)]
    assert got == [None, "invalid_repository", "invalid_base_commit", "license_unknown", "license_reject", "missing_instance_id", "missing_language", "missing_repository"]


def test_task_conflicts(spark):
    a, b, bad = ("a/b", SHA, "MIT", "ts"), ("a/c", SHA, "MIT", "ts"), ("a/b", SHA, None, "ts")
    conflict, duplicate = "conflicting_task_provenance", "duplicate_task_provenance"
    assert decided(spark, [(0, "i", *a), (1, "i", *a)]) == [(None, None), (duplicate, None)]
    assert decided(spark, [(0, "i", *a), (1, "i", *a), (2, "i", *b)]) == [(conflict, None), (conflict, duplicate), (conflict, None)]
    assert decided(spark, [(0, "i", *a), (1, "i", *b), (2, "i", *a)]) == [(conflict, None)] * 3
    assert decided(spark, [(0, "i", *bad), (1, "i", *a)]) == [(conflict, "license_unknown"), (conflict, None)]
    assert decided(spark, [(0, "i", *bad), (1, "i", *bad)]) == [("license_unknown", None)] * 2


def test_rollouts(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "o long, k string, raw string, ok boolean, why string")
        return [(r.decision, r.reason_code, r.cause_code) for r in decisions.rollout_decisions(df, "k", "raw", "ok", "why", "o").orderBy("o").collect()]

    assert run([(0, "k", "r", True, None), (1, "k", "r", True, None), (2, "l", "s", True, None)]) == [("admit", None, None), ("reject", "duplicate_trace_row", None), ("admit", None, None)]
    assert run([(0, "k", "r", True, None), (1, "k", "r", False, "w")]) == [("reject", "conflicting_rollout_identity", None), ("reject", "conflicting_rollout_identity", "w")]
    assert run([(0, "k", "r", False, "w"), (1, None, "s", True, None)]) == [("reject", "w", None), ("reject", "missing_rollout_key", None)]


def test_normalize_fills_and_refuses(spark):
    t = spark.createDataFrame([("i", "github.com/a/b", SHA, "MIT", "TypeScript")], "instance_id string, repository string, base_commit string, license string, language string")
    columns = "row_index long, instance_id string, repository string, base_commit string, license string, language string, resolved int, patch string"
    rows = [(0, "i", None, None, None, None, 1, "+a"), (1, "i", "a/x", None, None, None, 1, ""), (2, "q", None, None, None, None, 0, ""), (3, "q", None, None, None, None, -1, ""), (4, "i", "A/B", SHA.upper(), "mit license", "ts", 0, "-x"), (5, "i", None, None, None, None, 2, "")]
    got = normalization.normalize(spark.createDataFrame(rows, columns), t).orderBy("row_index").collect()
    assert [r.reason_code for r in got] == [None, "repository_mismatch", "missing_task", "unknown_resolution", None, "invalid_resolution"]
    assert (got[0].repository, got[0].language, got[0].added_lines, got[0].resolved) == ("github.com/a/b", "TypeScript", 1, True)


def test_cohort(spark):
    a = spark.createDataFrame([("1", "v")], "id string, rev string")
    b = spark.createDataFrame([("1", "w"), ("2", "w")], "id string, rev string")
    whole, repeated = normalization.cohort({"x": a, "y": b}, "id")
    assert whole.count() == 3 and [r.id for r in repeated.collect()] == ["1"]
    assert [r.field for r in normalization.incompatible({"x": a, "y": b}, ["rev"]).collect()] == ["rev"]
    with pytest.raises(ValueError):
        normalization.cohort({"x": a}, "id")


def test_profile_small(spark):
    df = spark.createDataFrame([("one", "a/b", "MIT"), ("one", "A/B", "GPL-3.0"), ("three", None, None)], "id string, repo string, license string")
    r = profile.audit(df, "id", "repo", "license").first()
    assert (r.n_rows, r.n_repositories, r.n_duplicate_ids, r.n_allow, r.n_reject, r.n_unknown) == (3, 1, 1, 1, 1, 1)
    e = profile.audit(df.limit(0), "id", "repo", "license").first()
    assert (e.n_rows, e.n_repositories, e.n_duplicate_ids) == (0, 0, 0)
    d = profile.distribution(spark.createDataFrame([(k, v) for k, v in enumerate([0, 1, 2])], "i long, v long"), F.col("i"), F.col("v")).first()
    assert (d.n, d.minimum, d.p50, d.p95, d.maximum, d.approximate) == (3, 0, 1, 2, 2, False)
    assert profile.distribution(spark.createDataFrame([], "i long, v long"), F.col("i"), F.col("v")).first().n == 0


def test_observed_fields(spark):
    df = spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":"x","c":[1],"d":{"e":1.5},"f":true,"g":1.5}',), ("[1]",), ("broken",), (None,)], "j string")
    got = {(r.field, r.type): r.n_rows for r in profile.observed_fields(df, "j").collect()}
    assert got == {("a", "integer"): 1, ("a", "string"): 1, ("b", "null"): 1, ("c", "array"): 1, ("d", "object"): 1, ("f", "boolean"): 1, ("g", "number"): 1}


def test_ordered_digest(spark):
    import hashlib

    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "i long, v string")
    assert profile.ordered_digest(df, "i", "v") == hashlib.sha256(b"a\nb\n\n").hexdigest()


def test_components_and_split(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefg"] + [(None,)], "v string")
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "d"), ("f", "f"), (None, "a")], "a string, b string")
    got = {r.vertex: r.root for r in contamination.smallest_in_component(v, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    s = spark.createDataFrame([("one", "r1", "same", ["p"]), ("two", "r2", "same", ["q"]), ("three", "r3", "other", ["bench"]), ("four", "r4", "alone", None)], "sample_id string, repository string, task_text string, patch_texts array<string>")
    b = spark.createDataFrame([("x", "zzz", "bench ")], "benchmark_id string, task_text string, patch_text string")
    got = {r.sample_id: (r.contamination_group, r.split) for r in contamination.split_repositories(s, b, 11, 0.5, near=0.95).collect()}
    assert got["one"] == got["two"] and got["one"][0] == "r1" and got["three"] == ("r3", "excluded") and got["four"][1] in ("train", "evaluation")


def test_whole_evidence_searches_samples_and_benchmark_once(spark, monkeypatch):
    from sievewright.operators import edits
    from sievewright.plans import curation_queries

    searched, find = [], edits.candidates
    monkeypatch.setattr(edits, "candidates", lambda left, right, t, *more: searched.append(right is None) or find(left, right, t, *more))
    names = {r.name for r in curation_queries.whole_decontamination_evidence(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(searched) == [False, True] and {f"near_{n}_{k}" for n in ("candidates", "matches") for k in ("samples", "benchmark")} < names


def test_near_content_normalizes_samples_once_and_keeps_every_value(spark, monkeypatch):
    from sievewright.operators import contamination as c

    text = "the quick brown fox jumps over the lazy dog and runs away from the wolf"
    rows = [("b", "r2", text, [text, text]), ("a", "r1", text + "  ", None), ("c", "r3", text + "s", [None, " "])]
    samples = spark.createDataFrame(rows, "sample_id string, repository string, task_text string, patch_texts array<string>")
    benchmark = spark.createDataFrame([("x", text, None)], "benchmark_id string, task_text string, patch_text string")
    calls, normalize = [], c.normalized_text
    monkeypatch.setattr(c, "normalized_text", lambda x: calls.append(1) or normalize(x))
    near = c.near_content(samples, benchmark, 0.95)
    assert len(calls) == 2  # of the samples and of the benchmark
    names = ["kind", "fingerprint", "sample_id", "repository"]
    assert sorted(near.values.select(names).collect()) == sorted(c.content(samples).select(names).collect()) and near.values.count() == 4
    assert [(r.kind, r.similarity < 1) for r in near.matches["samples"].collect()] == [("task", True)] and near.matches["benchmark"].count() == 1


def test_whole_split_resolves_aliases_and_near_content(spark, tmp_path):
    from difflib import SequenceMatcher
    from itertools import combinations

    from sievewright.plans import catalog, curation_queries

    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"
    bench = "a benchmark task that asks for the parser to be repaired without any change of its tests"
    patch = "diff --git a/x b/x adds one line and takes another one away in the middle of the file"
    rows = [
        ("old", "o/old", "about nothing in particular at all", None), ("new", "O/new", "something of quite another kind here", None), ("near1", "n/one", base, None),
        ("near2", "n/two", base.replace("quick", "quack"), None), ("leak", "l/k", bench + "s", None), ("p1", "p/one", None, [patch]), ("p2", "p/two", None, [patch + "s"]),
    ]
    spark.createDataFrame(rows, "sample_id string, repository string, task_text string, patch_texts array<string>").write.parquet(f"{tmp_path}/samples.parquet")
    spark.createDataFrame([("x", bench, "zzz")], "benchmark_id string, task_text string, patch_text string").write.parquet(f"{tmp_path}/benchmark_entries.parquet")
    spark.createDataFrame([("o/old", "o/new")], "alias string, target string").write.parquet(f"{tmp_path}/repository_aliases.parquet")
    got = {r.sample_id: (r.contamination_group, r.split) for r in catalog.entry(spark, str(tmp_path)).collect()}
    assert len(got) == 7 and got["old"] == got["new"] and got["leak"][1] == "excluded"
    near = {frozenset((a[0], b[0])) for a, b in combinations(rows, 2) for x, y in ((a[2], b[2]), ((a[3] or [None])[0], (b[3] or [None])[0])) if x and y and SequenceMatcher(None, x, y, False).ratio() >= 0.95}
    assert near == {frozenset(("near1", "near2")), frozenset(("p1", "p2"))}
    assert {frozenset((a, b)) for a, b in combinations(got, 2) if got[a] == got[b] and got[a][0] == got[b][0]} == near | {frozenset(("old", "new"))}
    n = {r.name: r.n for r in curation_queries.whole_decontamination_evidence(spark, str(tmp_path)).collect()}
    assert n["near_matches_samples"] == 2 and n["near_matches_benchmark"] == 1 and n["near_candidates_samples"] >= 2 and n["near_candidates_benchmark"] >= 1


ROWS = "partition string, rollout_id string, row_hash string, key string, instance_id string, lang string, resolved int"


def test_recovery(spark):
    langs = ["TypeScript", "JavaScript"]
    labelled = spark.createDataFrame([("l", "1", "a", "k", "i", "ts", 1), ("l", "2", "b", "c", "i", "js", 1), ("l", "3", "c", "c", "i", "js", 0), ("l", "4", "d", "far", "i", "ts", 0), ("l", "4", "e", "far", "i", "ts", 1), ("l", "5", "f", "x", "i", "js", 1), ("l", "6", "g", None, "i", "js", 1)], ROWS)
    targets = spark.createDataFrame([
        ("t", "1", "a", "k", "i", "TypeScript", None), ("t", "1", "a", "k", "i", "ts", None), ("t", "2", "b", "c", "i", "js", -1), ("t", "3", "c", "n", "i", "ts", None), ("t", "4", "d", "n", "i", "ts", -1), ("t", "5", "e", "k", "i", "python", None),
        ("t", "6", "f", "y", "i", "ts", 1), ("t", "7", "g", "x", "i", "ts", None), ("t", "8", "h", "y", "i", "ts", None), ("t", "9", "i", None, "i", "ts", None),
    ], ROWS)
    r = recovery.recover(labelled, targets, langs)
    # x is labelled in JavaScript only, so its TypeScript target is a request; y is known from a target row
    assert {x.rollout_id: (x.outcome, x.label) for x in r.collect()} == {"1": ("candidate", True), "2": ("request", None), "3": ("request", None), "4": ("request", None), "7": ("request", None), "8": ("candidate", True)}
    assert sorted((x.key, x.n_targets, x.first_rollout) for x in recovery.requests(r).collect()) == [("c", 1, "2"), ("n", 2, "3"), ("x", 1, "7")]
    assert [(x.key, x.n_true, x.n_false) for x in recovery.conflicts(labelled, targets, langs).collect()] == [("c", 1, 1)]  # far is no target's
    got = recovery.evidence_of(r.where("outcome = 'candidate'"), recovery.observations(labelled, targets, langs)).collect()
    assert sorted((x.key, x.label, x.rollout_id, x.place) for x in got) == [("k", True, "1", 1), ("y", True, "6", 1)]
    assert recovery.contradictions(targets, langs).count() == 0
    c = recovery.counters(labelled, targets, langs).first()
    assert (c.n_labelled, c.n_targets, c.n_ineligible, c.n_known, c.n_candidates, c.n_candidate_keys, c.n_resolved, c.n_unresolved, c.n_requests, c.n_queued, c.n_conflicts, c.n_repeated, c.n_lost) == (7, 10, 1, 1, 2, 2, 2, 0, 3, 4, 1, 1, 1)
    assert all(x.closes for x in recovery.accounting(labelled.unionByName(targets), langs).collect())
    empty = recovery.counters(labelled.limit(0), targets.limit(0), langs).first()
    assert (empty.n_targets, empty.n_candidates, empty.n_lost) == (0, 0, 0)


def test_selection(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "a", 5), (2, None, 5), (3, None, 1), (4, None, 7)], "o long, k string, v long")
    got = {r.o: r.reason for r in selection.decide(df, [("small", F.col("v") < 3)], ["k"], "o").collect()}
    assert got == {0: None, 1: "duplicate", 2: None, 3: "small", 4: "duplicate"}
    c = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"]), ("d", [])], "i string, f array<string>")
    assert sorted(r.i for r in selection.cover(c, "i", F.col("f"), 4, 4).collect()) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        selection.cover(c, "i", F.col("f"), 1, 2)


def test_reference_findings(spark):
    docs = [{"metadata": {"goldPatch": 1}}, {"ref": {"x": [{"diff": 1}]}}, {"patch": 1, "reference": 2}, {"groundTruth": {"patchText": ""}}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{",), (None,)], "j string")
    assert [r[0] for r in df.select(evidence.reference_findings(F.col("j"))).collect()] == [["$.metadata.goldPatch"], ["$.ref.x[].diff"], [], ["$.groundTruth.patchText"], None, None]
    p = spark.createDataFrame([("a\r\nb c", "a\nb"), ("x", " "), (None, "y")], "t string, p string")
    assert [r[0] for r in p.select(evidence.prompt_contains(F.col("t"), F.col("p"))).collect()] == [True, False, False]


def test_skew(spark):
    df = spark.createDataFrame([("hot", k % 3) for k in range(60)] + [(f"k{k}", k) for k in range(30)] + [(None, 1)] * 10, "k string, v long")
    assert [(r.key_kind, r.key_value, r.n_rows) for r in skew.heavy_keys(df, ["k"], 0.5).collect()] == [("k", "hot", 60)]
    assert skew.heavy_keys(df.limit(0), ["k"], 0.5).count() == 0
    p = {r.k: (r.n_rows, r.n_v) for r in skew.key_profile(df, "k", ["v"], {"top": F.max("v")}).collect()}
    assert p["hot"] == (60, 3) and p["k7"] == (1, 1) and None not in p


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "m": {"p": "x"}}\n\n{"i": 2}\n')
    spark.createDataFrame([(3,)], "i long").toPandas().to_parquet(tmp_path / "b.parquet")
    (tmp_path / "README.md").write_text("no data")
    assert [f.name for f in snapshot.discover(tmp_path)] == ["a.jsonl", "b.parquet"]
    assert sorted(r.i for r in snapshot.scan(spark, tmp_path).collect()) == [1, 2, 3]
    assert {r.path for r in snapshot.identities(spark, tmp_path).collect()} == {"a.jsonl", "b.parquet"}
    files = spark.createDataFrame([("x/a.jsonl",), ("y/b.parquet",)], "path string")
    assert {r.path: r.partition for r in snapshot.partitioned(files, {"p": "x/*", "q": "y/**"}).collect()} == {"x/a.jsonl": "p", "y/b.parquet": "q"}
    for bad in ({"p": "x/*"}, {"p": "x/*", "q": "y/*", "r": "z/*"}, {"p": "**", "q": "y/*"}):
        with pytest.raises(ValueError):
            snapshot.partitioned(files, bad)
    with pytest.raises(ValueError):
        snapshot.discover(tmp_path, ("../x",))
    with pytest.raises(ValueError):
        snapshot.discover(tmp_path / "none")
    (tmp_path / "c.jsonl").write_text("[1]\n")
    with pytest.raises(Exception):
        snapshot.read_jsonl(spark, [str(tmp_path / "c.jsonl")], "i long").collect()
    (tmp_path / "c.jsonl").write_text('{"i": 1, "i": 2}\n')
    with pytest.raises(Exception):
        snapshot.read_jsonl(spark, [str(tmp_path / "c.jsonl")], "i long", strict=True).collect()


def test_publishing(spark, tmp_path):
    a = snapshot.publish_json(tmp_path / "m.json", {"b": 1, "a": [None]})
    assert (tmp_path / "m.json").read_text() == '{"a":[null],"b":1}\n' and snapshot.publish_json(tmp_path / "m.json", {"a": [None], "b": 1}) == a
    with pytest.raises(snapshot.Collision):
        snapshot.publish_json(tmp_path / "m.json", {})
    df = spark.createDataFrame([(1,), (2,)], "i long")
    assert snapshot.publish(df, str(tmp_path / "t"))["rows"] == 2
    again = snapshot.publish(df.orderBy(F.desc("i")), str(tmp_path / "t"))
    assert again["rows"] == 2  # the same rows are fine
    with pytest.raises(snapshot.Collision):
        snapshot.publish(df.limit(1), str(tmp_path / "t"))
    df.write.parquet(str(tmp_path / "lost"))
    with pytest.raises(snapshot.Collision):
        snapshot.publish(df, str(tmp_path / "lost"))
    assert snapshot.materialize(df, ["i"], str(tmp_path / "m"), 1)["status"] == "PASS"
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).select("i", "row_index").collect()] == [(1, 0)]
    assert snapshot.materialize(df.limit(0), ["i"], str(tmp_path / "n"))["status"] == "FAIL"


def test_snapshot_order_and_projection(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.jsonl").write_text("".join(f'{{"i": {k}, "m": {{"p": {{"q": "v{k}"}}, "z": 1.5}}, "n": null}}\n' for k in range(50)))
    (tmp_path / "c.jsonl").write_text('{"i": 50, "late": [1]}\n')
    spark.range(51, 60).select(F.col("id").alias("i")).coalesce(1).toPandas().to_parquet(tmp_path / "d.parquet")
    rows = snapshot.scan(spark, tmp_path)
    got = snapshot.numbered(rows.select("i", "source_file", "file_ordinal", "row_place"), ["file_ordinal", "row_place"]).orderBy("row_index").collect()
    assert [(r.i, r.row_index) for r in got] == [(k, k) for k in range(60)]
    assert [r.source_file for r in got if r.i in (0, 50, 51)] == ["a b/x.jsonl", "c.jsonl", "d.parquet"]
    some = snapshot.scan(spark, tmp_path, ["i", "m.p.q"], ("a b/*",), nested=True).where("i = 3").first()
    assert some.m.p.q == "v3" and set(some.m.asDict()) == {"p"}
    for bad in (["m", "m.p"], ["i", "i"]):
        with pytest.raises(ValueError):
            snapshot.projected(bad)
    files = snapshot.identities(spark, tmp_path)
    whole = snapshot.snapshot_digest(files)
    assert whole == snapshot.snapshot_digest(files.orderBy(F.desc("path"))) and whole["n_bytes"] > 0
    assert snapshot.snapshot_digest(files.limit(0))["n_bytes"] == 0


def test_aliases_of_several_targets(spark):
    from sievewright.operators import aliases

    df = spark.createDataFrame([("A/B", "c/d"), ("https://github.com/a/b", "C/D"), ("c/d", "e/f"), (None, "x/y"), ("q/r", "q/r")], "alias string, target string")
    names = df.select(F.concat(F.lit("github.com/"), "alias").alias("alias"), F.concat(F.lit("github.com/"), "target").alias("target")).where("alias not like '%https%'")
    assert {r.name: r.entity for r in aliases.entities(names, strict=True).collect()} == {"github.com/a/b": "github.com/e/f", "github.com/c/d": "github.com/e/f"}
    several = df.union(spark.createDataFrame([("a/b", "z/z")], df.schema))
    rows = spark.createDataFrame([("a/b",)], "repository string")
    assert aliases.resolve(rows, df).first().repository == "github.com/e/f"
    with pytest.raises(ValueError):
        aliases.resolve(rows, several)
    assert aliases.entities(several.where("alias in ('A/B', 'a/b')")).first().entity == "c/d"  # the smallest


def test_manifest_rules(spark):
    from sievewright.operators import manifests as m

    s = spark.createDataFrame([("a", "r1"), ("b", "R2")], "name string, revision string")
    assert m.registry(s, ["revision"]).count() == 2
    for bad in (s.limit(0), s.union(s), s.union(spark.createDataFrame([("c", " ")], s.schema))):
        with pytest.raises(ValueError):
            m.registry(bad, ["revision"])
    seen = spark.createDataFrame([("a", "r9"), ("b", "r2")], s.schema)
    assert [tuple(r) for r in m.pinned_differences(s, seen, ["revision"]).collect()] == [("a", "revision", "r1", "r9")]
    assert [r.name for r in m.untrusted(s, seen, ["name", "revision"]).collect()] in (["a", "b"], ["b", "a"])
    assert sorted(map(tuple, m.unequal(s, seen.where("name = 'a'"), ["name"], ["revision"]).collect())) == [("a", "revision"), ("b", "revision")]
    parts = {"x": s, "y": s.where("name = 'a'"), "z": s.where("name = 'c'")}
    assert [tuple(r) for r in m.overlapping(parts, "name").collect()] == [("a", "x,y")]
    rows = spark.createDataFrame([("p", 1, "k", 5), ("p", 1, "k", 5), ("p", 2, "l", 6), ("q", 1, "l", 7), ("q", 1, "l", 8)], "p string, r int, key string, more int")
    pick = lambda *x: spark.createDataFrame(list(x), "p string, r int, key string")
    assert sorted((r.r, r.more) for r in m.replayed(pick(("p", 1, "k"), ("p", 2, "l")), rows, ["p", "r"], ["key"]).collect()) == [(1, 5), (2, 6)]
    for bad in (pick(("p", 3, "k")), pick(("q", 1, "l")), pick(("p", 1, "other"))):
        with pytest.raises(ValueError):
            m.replayed(bad, rows, ["p", "r"], ["key"])
    assert m.with_unique(pick(("p", 1, "k")), rows.select("key", F.lit(1).alias("one")), "key").count() == 1
    for bad in (pick(("q", 1, "l")), pick(("z", 1, "none"))):
        with pytest.raises(ValueError):
            m.with_unique(bad, rows.select("key", "more"), "key")
    assert [r.more for r in m.exactly(rows, [F.desc("more")], 2).collect()] == [8, 7]
    with pytest.raises(ValueError):
        m.exactly(rows, [F.col("more")], 9)
    h = m.hashed_split(spark.createDataFrame([("A/B",), ("https://github.com/a/b",), ("c/d",), (None,)], "r string"), 11, 0.5)
    assert h.count() == 2 and m.excluded(h.withColumn("split", F.lit("excluded"))).count() == 2
