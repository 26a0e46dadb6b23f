import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import isolation, profile, selection, traces

PATCH = "diff --git a/src/a.ts b/src/a.ts\n-old\n+new"
ROW = {
    "instance_id": "acme__widget-1", "trajectory": [{"role": "system", "content": "You are a coding agent."}, {"role": "user", "content": "Fix the bug"}, {"role": "assistant", "content": "Looking.", "tool_calls": [{"gold_patch": "x"}]}, {"role": "tool", "content": "1"}],
    "tools": ['{"type":"function","function":{"name":"run"}}'], "model_patch": PATCH, "metadata": {"reference_patch": {"patch": PATCH, "num_modified_files": 1}},
}


def changed(**fields):
    row = copy.deepcopy(ROW)
    row.update(fields)
    return {k: v for k, v in row.items() if v is not ...}


def with_step(role, content):
    return changed(trajectory=[*ROW["trajectory"], {"role": role, "content": content}])


IN_PROMPT, MISPLACED, GOLD, INVALID = isolation.REASONS[2], isolation.REASONS[3], isolation.REASONS[1], isolation.REASONS[0]
CASES = [
    (ROW, []), (with_step("user", f"Use this:\r\n{PATCH}".replace("\n", "\r\n")), [IN_PROMPT]), (with_step("tool", [{"deep": f"late {PATCH}"}]), [IN_PROMPT]), (with_step("future-role", PATCH), [IN_PROMPT]),
    (changed(tools=[{"function": {"description": f"Do not expose: {PATCH}"}}]), [IN_PROMPT]), (with_step("assistant", PATCH), []), (changed(metadata={}), [MISPLACED]), (changed(metadata=...), [MISPLACED]),
    (changed(tools=['{"function":{"parameters":{"properties":{"gold_patch":{"type":"string"}}}}}']), [GOLD]), (changed(reference_patch="hidden"), [MISPLACED]), (changed(metadata={"reference_patch": "not structured"}), [MISPLACED]),
    (changed(extra=[{"x": {"oracleDiff": 1}}]), [MISPLACED]), (changed(tools=["{broken"]), [INVALID]), (changed(tools="no list"), [INVALID]), (changed(trajectory=["no object"]), [INVALID]), (changed(trajectory=...), [INVALID]),
    (changed(trajectory=[{"role": "user", "reference": {"patch": "x"}}], tools=["{broken"]), [GOLD]), (changed(metadata={"reference_patch": {"patch": ""}}), [MISPLACED]),
]


def test_inspection(spark):
    texts = [json.dumps(r) for r, _ in CASES] + [None, "{malformed", "[1]"]
    df = isolation.inspected(spark.createDataFrame(list(enumerate(texts)), "row_index int, row string"), "row")
    got = {r.row_index: (r.inspection.reference_patch, list(r.inspection.reasons)) for r in df.collect()}
    want = [reasons for _, reasons in CASES] + [[INVALID, MISPLACED]] * 3
    assert {k: v[1] for k, v in got.items()} == dict(enumerate(want))
    assert got[0][0] and not got[6][0] and not got[len(CASES)][0]
    rows = df.select("row_index", "inspection", F.lit("s").alias("sample_id"), (F.col("row_index") != 5).alias("agrees"))
    found = isolation.findings(rows, 3, 4, 3, 3)
    assert found.where("reason_code = 'raw_normalized_binding_mismatch'").select("row_index").collect()[0][0] == 5 and found.where("sample_id is null").first().reason_code == isolation.REASONS[5]
    s = isolation.summary(rows, found, len(texts)).first()
    assert (s.n_seen, s.n_findings, s.status) == (len(texts), sum(map(len, want)) + 2, "FAIL")
    empty = rows.limit(0)
    assert isolation.summary(empty, isolation.findings(empty, 0, 0, 0, 0), 0).first().status == "BLOCKED"


def test_canonical_digest(spark):
    value = {"b": [1, 2.5, None, True], "a": "é\n\x1b", "A": {"z": 1, "y": 2}}
    df = spark.createDataFrame([(json.dumps(value, indent=2),), (None,), ("{",)], "j string")
    want = hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [r[0] for r in df.select(isolation.canonical_sha256(F.col("j"))).collect()] == [want, None, None]


def test_claims_take_the_first_row(spark):
    raw = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "row_index int, digest string")
    got = isolation.claimed(raw, spark.createDataFrame([("a", "s1"), ("c", "s2")], "digest string, sample_id string"), "digest", "row_index")
    assert [(r.row_index, r.sample_id) for r in got.collect()] == [(1, "s1")]


def test_aliased_fields_and_patches(spark):
    schema = "row_index long, repo string, repository string, instance_id long, issue_id string, resolved int, model_patch struct<patch:string>, pred_patch string, diff string, metadata struct<model_patch:struct<patch:string>>, trajectory array<struct<role:string>>"
    rows = [(0, " ", "a/b", 0, "x", 1, ("m",), "p", "d", (("n",),), []), (1, None, None, None, " 7 ", 2, None, None, None, (("nn",),), None), (2, "x/y", "z", 5, None, -1, None, None, "ddd", None, [("user",)])]
    df = spark.createDataFrame(rows, schema)
    got = df.select(traces.text_field(df, traces.REPOSITORY).alias("r"), traces.identifier_field(df, traces.ISSUE).alias("i"), traces.model_patch(df).alias("m"), traces.patch_bytes(df).alias("b"), traces.label(df).alias("l"), traces.steps(df).alias("n")).collect()
    assert [(r.r, r.i, tuple(r.m), r.b, tuple(r.l), r.n) for r in got] == [("a/b", "0", ("p", "pred_patch"), 1, (True, True), 0), (None, "7", ("nn", "metadata.model_patch.patch"), 2, (None, False), 0), ("x/y", "5", ("", "absent"), 3, (None, True), 1)]
    odd = spark.createDataFrame([("true", True)], "resolved string, b boolean")
    assert [tuple(x) for x in odd.select(traces.label(odd), traces.label(odd, "b")).first()] == [(None, False), (True, True)]


def test_equal_records_share_an_id(spark):
    schema = "row_index long, repo string, license string, base_commit string, instance_id string, language string, trajectory_id string, resolved boolean, trajectory array<struct<role:string,content:string>>, model_patch string"
    rows = [(k, r, "MIT", " " + "A" * 40 + "\n", "i", "ts", "t", True, [("user", "x")], "+a") for k, r in ((0, "A/B"), (1, "A/B"), (2, "a/c"), (3, "none"))]
    fixed = {"source_dataset": "s", "source_dataset_revision": "0" * 40, "harness": "h", "generating_model": "m", "source_repository_id": "o/d"}
    got = {r.row_index: r for r in traces.normalized(spark.createDataFrame(rows, schema), fixed, ["a:1"]).collect()}
    assert got[0].sample_id == got[1].sample_id != got[2].sample_id and got[3].reason == "invalid_repository" and got[3].sample_id is None
    assert got[0].base_commit == "a" * 40 and got[0].patch_metadata.added_lines == 1 and len(got[0].provenance_lineage) == 5


def test_collisions(spark):
    rows = [(0, None, "r", "s0"), (1, "k1", "r", "s1"), (2, "k2", "r", "s1"), (3, "k3", "r", "s2"), (4, "k3", "r", "s3"), (5, "k4", "r", "s4"), (6, "k4", "q", "s5"), (7, None, "r", None)]
    got = traces.collisions(spark.createDataFrame(rows, "row_index long, rollout_key string, raw_sha256 string, sample_id string")).collect()
    assert sorted(map(tuple, got)) == [("rollout_of_several_samples", "k3"), ("sample_of_several_rollouts", "s1"), ("sample_without_rollout_key", "0")]


def test_audit_of_the_stated_fixture(spark):
    schema = "row_index long, instance_id string, repo string, license string, language string, resolved int, trajectory array<string>, patch string"
    rows = [(0, "one", "Acme/Widget", "MIT", "TypeScript", 1, [], "12345"), (1, "one", "https://github.com/acme/widget.git", "GPL-3.0", "TypeScript", 1, ["a"], "12345678"), (2, "three", "x/y", None, "JavaScript", 0, ["a", "b"], "123456789")]
    got = {(r.field, r.key): r.value for r in profile.report(spark.createDataFrame(rows, schema), 4).collect()}
    want = {
        ("unique_repositories", ""): "2", ("duplicate_instance_id", "one"): "2", ("language", "JavaScript"): "1", ("language", "TypeScript"): "2", ("resolved", "resolved"): "2", ("resolved", "unresolved"): "1",
        ("license", "ALLOW"): "1", ("license", "REJECT"): "1", ("license", "UNKNOWN"): "1", ("rejected_row_count", ""): "2", ("trajectory_length", "count"): "3", ("trajectory_length", "p50"): "1", ("trajectory_length", "p95"): "2",
        ("patch_size", "min"): "5", ("patch_size", "p50"): "8", ("patch_size", "p95"): "9", ("status", ""): "FAIL", ("issue", "row_count_drift"): None, ("schema_field_types", "license:null"): None, ("matches_declared_row_count", ""): "false",
    }
    assert {k: got.get(k, "absent") for k in want} == want and ("schema_field_types", "repo:null") not in got
    empty = {(r.field, r.key): r.value for r in profile.report(spark.createDataFrame([], schema)).collect()}
    assert (empty[("row_count", "")], empty[("status", "")], empty[("patch_size", "p50")]) == ("0", "PASS", None)


def test_pilot_policy(spark):
    schema = "ordinal long, repository string, repository_license string, language string, resolved boolean, n_steps int, patch_bytes int, issue string, rollout string"
    good = ("a/b", "MIT", "TypeScript", True, 2, 5)
    rows = [(0, *good, "i", "r"), (1, "https://github.com/A/B", *good[1:], "i", "r"), (2, "a/b", "mit license", "javascript", True, 2, 5, "i", "s"), (3, "x", *good[1:], "i", "r"), (4, "out/side", *good[1:], "i", "r"), (5, "not/frozen", *good[1:], "i", "r")]
    rows += [(6, "a/b", "GPL-3.0", *good[2:], "i", "r"), (7, "a/b", "MIT", "Python", *good[3:], "i", "r"), (8, *good[:3], False, 2, 5, "i", "r"), (9, *good[:4], 0, 5, "i", "r"), (10, *good[:4], 9, 5, "i", "r"), (11, *good[:4], 2, 99, "i", "r"), (12, *good[:3], None, 2, 5, "i", "r")]
    df = spark.createDataFrame(rows, schema)
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "n string")
    policy = selection.PilotPolicy(most_steps=5, most_patch_bytes=50)
    judged = selection.pilot_reasons(df, policy, names("git@github.com:Out/Side.git"), names("A/B", "out/side"))
    assert {r.ordinal: r.reason for r in judged.collect()} == {0: None, 1: "duplicate", 2: None, 3: "repository", 4: "evaluation_repository", 5: "not_in_frozen_split", 6: "license", 7: "language", 8: "unresolved", 9: "empty_trajectory", 10: "trajectory_length", 11: "patch_size", 12: "unresolved"}
    assert [r.ordinal for r in selection.pilot(df, policy, names("q/q")).collect()] == [0, 5, 4, 2]
    for bad in (selection.PilotPolicy(0), selection.PilotPolicy(languages=()), selection.PilotPolicy(licenses=("GPL-3.0",)), selection.PilotPolicy(most_steps=0)):
        with pytest.raises(ValueError):
            bad.check(spark)


def test_cover_refuses(spark):
    df = spark.createDataFrame([(k, "f") for k in range(3)], "k long, f string")
    assert selection.cover(df, "k", F.array("f"), 2, 3).count() == 2
    for rows, low, high in ((df, 4, 5), (df.limit(0), 1, 2), (df.union(df), 1, 9), (df.select(F.lit(None).cast("long").alias("k"), "f"), 1, 9), (df, 3, 2)):
        with pytest.raises(ValueError):
            selection.cover(rows, "k", F.array("f"), low, high)


def test_private_tasks_and_training_texts(spark):
    from sievewright.operators import outcomes

    schema = "instance_id string, repo string, base_commit string, language string, image_name string, test_patch string, FAIL_TO_PASS array<string>, PASS_TO_PASS string, install_config struct<log_parser:string,test_cmd:array<string>>"
    good = ["i", "A/B", "A" * 40, "ts", "img:1", "p", ["a", " b "], "c", ("js", ["npm test"])]
    bad = [("unsupported_language", 3, "go"), ("missing_log_parser", 8, (" ", ["x"])), ("missing_instance_id", 0, None), ("invalid_repository", 1, "x"), ("invalid_base_commit", 2, "f" * 39), ("invalid_image", 4, "a b"), ("missing_test_patch", 5, ""), ("invalid_fail_to_pass", 6, []), ("invalid_fail_to_pass", 6, [None]), ("invalid_pass_to_pass", 7, " "), ("invalid_test_commands", 8, ("js", [])), ("repeated_names", 6, ["b", " b"]), ("names_in_both_lists", 7, "b")]
    rows = [tuple(good)] + [tuple(v if k == at else g for k, g in enumerate(good)) for _, at, v in bad]
    got = outcomes.private_tasks(spark.createDataFrame(rows, schema)).collect()
    assert [r.reason for r in got] == [None] + [b[0] for b in bad] and got[0].fail_to_pass == ["a", "b"] and "patch" not in got[0].asDict()
    s = "sample_id string, repository string, base_commit string, issue_or_pr_id string, trajectory array<struct<role:string,gold_patch:string>>, generated_patch string"
    plain = "sample_id string, repository string, base_commit string, issue_or_pr_id string, trajectory array<struct<role:string,content:string>>, generated_patch string"
    text = outcomes.training_texts(spark.createDataFrame([("s", "é", "c", "0", [("user", "x/y")], None)], plain)).first().text
    assert text == '{"base_commit":"c","generated_patch":null,"issue_or_pr_id":"0","repository":"é","trajectory":[{"content":"x/y","role":"user"}]}'
    for rows, kind in (([("s", "r", "c", "0", [], None)], plain), ([("s", "r", "c", "0", [("user", "x")], None)], s)):
        with pytest.raises(Exception):
            outcomes.training_texts(spark.createDataFrame(rows, kind)).collect()


def test_evaluation_requests(spark):
    from sievewright.operators import recovery

    schema = "partition string, rollout_id string, row_hash string, key string, instance_id string, lang string, resolved int, patch string"
    row = ("p", "r", "h", "k", "i", "ts", None, "x")
    made = recovery.evaluation_requests(spark.createDataFrame([row, row], schema), ["TypeScript"]).collect()
    assert len(made) == 1 and made[0].lang == "TypeScript" and made[0].patch_sha256 == hashlib.sha256(b"x").hexdigest()
    for at, v in ((6, 1), (5, "go"), (6, 7)):
        with pytest.raises(Exception):
            recovery.evaluation_requests(spark.createDataFrame([tuple(v if k == at else x for k, x in enumerate(row))], schema), ["TypeScript"]).collect()


def test_configuration(spark, tmp_path):
    from sievewright.sources import config, snapshot

    (tmp_path / "a.json").write_text('{"schema_version": "1", "aliases": {"Old/Name": "new/name"}}')
    value, sha, n = config.read_mapping(tmp_path / "a.json")
    assert sha == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest() and n == (tmp_path / "a.json").stat().st_size and value["schema_version"] == "1"
    assert [tuple(r) for r in config.aliases(spark, tmp_path / "a.json").collect()] == [("Old/Name", "new/name")]
    for name, text in (("b.json", '{"a": 1, "a": 2}'), ("c.json", "[1]"), ("d.txt", "{}"), ("e.json", '{"schema_version": "1", "aliases": {"x": 1}}'), ("f.json", '{"aliases": {}}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            config.aliases(spark, tmp_path / name)
    with pytest.raises(ValueError):
        config.read_mapping(tmp_path / "a.json", 5)
    assert [r.name for r in config.records(spark, [{"name": "x"}], "name string, rows long").collect()] == ["x"]
    with pytest.raises(ValueError):
        config.records(spark, [{"other": 1}], "name string")
    (tmp_path / "m1").write_bytes(b"one")
    (tmp_path / "m2").write_bytes(b"two")
    assert snapshot.population_digest({"b": tmp_path / "m1", "a": tmp_path / "m2"}) == hashlib.sha256(b"twoone").hexdigest()
    assert snapshot.artifact_name("x", {"b": 1, "a": 2}) == snapshot.artifact_name("x", {"a": 2, "b": 1}) != snapshot.artifact_name("x", {"a": 2, "b": 2})
