"""SQL with the results of the trace queries."""

from __future__ import annotations

from .curation_sql import _SPLIT, _TASKS, canonical, diff, disposition, language, spdx, strip

_RAW = f"""
raw as (select row_index, row_index as k, instance_id, repository as repo, license, language, base_commit, 'r' || (row_index // 2) as trajectory_id,
        case row_index % 7 when 0 then -1 when 1 then null when 2 then 0 when 3 then 0 else 1 end as resolved,
        case row_index % 4 when 3 then null else patch end as own, problem_statement, patch, test_patch,
        case when row_index % 4 = 3 or patch is null then 'absent' when row_index % 4 = 0 then 'model_patch' when row_index % 4 = 1 then 'pred_patch' else 'metadata.model_patch.patch' end as source_field,
        row_index % 23 = 0 as stepless from tasks),
p as (select *, {strip("replace(replace(patch, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} as wanted,
        replace(replace(coalesce(problem_statement, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as prompt, replace(replace(coalesce(test_patch, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as tool from raw),
reason as (select row_index, 'gold_field_in_recorded_model_context' as reason_code from p where k % 11 = 0
        union all select row_index, 'invalid_recorded_model_context' from p where k % 11 <> 0 and k % 19 = 0
        union all select row_index, 'unsupported_reference_patch_location' from p where coalesce(patch, '') = '' or k % 17 = 0
        union all select row_index, 'reference_patch_in_initial_prompt' from p where coalesce(wanted, '') <> '' and k % 17 <> 0 and not stepless
                and (k % 13 = 0 or contains(prompt, wanted) or contains(tool, wanted)))"""

_REASON = f"""case when nullif({strip('license')}, '') is null then 'missing_license' when {disposition('license')} <> 'ALLOW' then 'license_gate' when nullif({strip('repo')}, '') is null then 'missing_repository'
        when {canonical('repo')} is null then 'invalid_repository' when not coalesce(regexp_full_match({strip('base_commit')}, '[0-9a-fA-F]{{40}}'), false) then 'invalid_base_commit'
        when nullif({strip('instance_id')}, '') is null then 'missing_issue' when nullif({strip('language')}, '') is null then 'missing_language' when resolved is null or resolved = -1 then 'unknown_resolution' else 'accepted' end"""

_LABELS = """
one as (select distinct on (sample_id) sample_id, source_dataset, resolved, patch_texts from samples where sample_id is not null),
l as (select coalesce(source_dataset, 'none') as "partition", sample_id as rollout_id, sha256(patch) as row_hash, sha256(regexp_replace(lower(patch), '[^a-z0-9]+', '', 'g')) as key,
        regexp_extract(patch, '^diff --git a/(\\S+) ', 1) as instance_id, resolved from (select source_dataset, sample_id, resolved, unnest(patch_texts) as patch from one) where trim(patch, ' ') <> ''),
e as (select *, regexp_extract(instance_id, '\\.([a-z]+)$', 1) as ending from l),
c as (select * exclude (ending), case when ending in ('ts', 'tsx') then 'TypeScript' when ending in ('js', 'jsx', 'mjs') then 'JavaScript' else ending end as lang,
        "partition" in ('task-forge-v2', 'swe-traces-open') as is_labelled from e),
row_ as (select *, case when lang not in ('TypeScript', 'JavaScript') then 'ineligible' when resolved in (0, 1) then 'known' else 'target' end as row_class from c),
obs as (select distinct "partition", rollout_id, row_hash, key, lang, resolved = 1 as label from row_ where row_class = 'known'),
k as (select key, count(*) as n_labels, count(*) filter (where label) as n_true, case when min(label) = max(label) then min(label) end as label from obs group by key),
target as (select distinct "partition", rollout_id, row_hash, key, instance_id, lang from row_ where row_class = 'target' and not is_labelled),
joined as (select t.*, case when exists (from obs where obs.key = t.key and obs.lang = t.lang) then k.label end as label, coalesce(n_labels, 0) as n_labels from target t left join k using (key)),
recovered as (select *, case when label is null then 'request' else 'candidate' end as outcome from joined)"""

_PILOT = f"""
t as (select row_index, repository, {canonical('repository')} as c, {spdx('license')} as s, {language('language')} as lang, row_index % 7 >= 4 as ok, row_index % 23 = 0 as stepless,
        case row_index % 4 when 3 then 0 else coalesce(strlen(patch), 0) end as n, instance_id, 'r' || (row_index // 2) as rollout from tasks),
place as (select repository, ('0x' || substr(sha256('11:' || repository), 1, 16))::ubigint::double / 18446744073709551615 as u from (select distinct repository from tasks where repository is not null)),
held as (select distinct {canonical('repository')} as c from place where u < 0.2), frozen as (select distinct {canonical('repository')} as c from place where u >= 0.3),
j as (select *, case when c is null then 'repository' when c in (select c from held where c is not null) then 'evaluation_repository' when c not in (select c from frozen where c is not null) then 'not_in_frozen_split' when s is null then 'license'
        when not coalesce(lang in ('TypeScript', 'JavaScript'), false) then 'language' when not ok then 'unresolved' when stepless then 'empty_trajectory' when n > 1600 then 'patch_size' end as reason from t),
f as (select min(row_index) as first from j where reason is null group by c, instance_id, rollout),
d as (select * exclude (reason), case when reason is null and row_index not in (select first from f) then 'duplicate' else reason end as reason from j)"""

_KINDS = {"instance_id": "string", "repo": "string", "license": "string", "language": "string", "base_commit": "string", "trajectory_id": "string", "resolved": "integer", "model_patch": "string", "pred_patch": "string", "metadata": "object", "trajectory": "array", "tools": "array"}


def _audit() -> str:
    size = "case row_index % 4 when 0 then strlen(patch) when 1 then strlen(patch) when 2 then strlen(patch) end"
    facts = [
        "select 'row_count', '', count(*)::varchar from a", "select 'declared_row_count', '', '4000'", "select 'matches_declared_row_count', '', (count(*) = 4000)::varchar from a",
        "select 'rejected_row_count', '', (count(*) filter (where d <> 'ALLOW'))::varchar from a", "select 'rejected_rows_truncated', '', (count(*) filter (where d <> 'ALLOW') > 100)::varchar from a",
        "select 'language', lang, count(*)::varchar from a group by 2", "select 'resolved', label, count(*)::varchar from a group by 2", "select 'license', d, count(*)::varchar from a group by 2",
        "select 'unique_repositories', '', count(distinct repo)::varchar from a", "select 'duplicate_instance_id_count', '', count(*)::varchar from dup", "select 'duplicate_instance_ids_truncated', '', (count(*) > 100)::varchar from dup",
        "select * from (select 'duplicate_instance_id', i, n::varchar from dup order by i limit 100)",
    ]
    for name, column in (("trajectory_length", "steps"), ("patch_size", "size")):
        sample = f"(select {column} as v from a where {column} is not null order by sha256(row_index || ':' || {column}) limit 100000)"
        facts += [
            f"select '{name}', 'count', count({column})::varchar from a", f"select '{name}', 'min', min({column})::varchar from a", f"select '{name}', 'max', max({column})::varchar from a",
            f"select '{name}', 'p50', quantile_disc(v, 0.5)::varchar from {sample}", f"select '{name}', 'p95', quantile_disc(v, 0.95)::varchar from {sample}",
        ]
    facts.append("select 'percentiles_approximate', '', (count(steps) > 100000 or count(size) > 100000)::varchar from a")
    missing = {"model_patch": "not (row_index % 4 = 0 and patch is not null)", "pred_patch": "not (row_index % 4 = 1 and patch is not null)", "resolved": "row_index % 7 = 1", "repo": "repository is null"}
    for c, kind in _KINDS.items():
        gone = missing.get(c, "false" if c in ("metadata", "trajectory", "tools", "trajectory_id") else f"{c} is null")
        facts += [f"select 'schema_field_types', '{c}:{kind}', null where exists (from tasks where not ({gone}))", f"select 'schema_field_types', '{c}:null', null where exists (from tasks where {gone})"]
    facts += ["select 'issue', 'row_count_drift', null from (select count(*) as n from a) where n <> 4000", "select 'issue', 'no_repository_identity', null from (select count(*) as n, count(repo) as r from a) where n > 0 and r = 0"]
    facts.append("select 'status', '', case when count(*) <> 4000 or (count(*) > 0 and count(repo) = 0) then 'FAIL' else 'PASS' end from a")
    return f"""with a as (select row_index, coalesce(instance_id, row_index::varchar) as i, coalesce({canonical("nullif(repository, '')")}, lower(trim(nullif(repository, '')))) as repo, coalesce(nullif(language, ''), 'UNKNOWN') as lang,
        case row_index % 7 when 0 then 'unknown' when 1 then 'unknown' when 2 then 'unresolved' when 3 then 'unresolved' else 'resolved' end as label, {disposition('license')} as d,
        case when row_index % 23 = 0 then 0 else 4 end as steps, {size} as size from tasks), dup as (select i, count(*) as n from a group by i having count(*) > 1),
        fact(field, "key", "value") as ({' union all '.join(facts)}) select * from fact"""


_ALIASES = r"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"
for _pattern, _to in ((r"^[a-z][a-z0-9+.\-]*://", ""), (r"^[^/@]*@", ""), (r"^([^/:]+):[0-9]+(/|$)", r"\1\2"), (r"^([^/:]+):", r"\1/")):
    _ALIASES = f"regexp_replace({_ALIASES}, '{_pattern}', '{_to}')"
_ALIASES = rf"nullif(regexp_replace(regexp_replace(regexp_replace({_ALIASES}, '^[/\s]+|[/\s]+$', '', 'g'), '\.git$', ''), '^[/\s]+|[/\s]+$', '', 'g'), '')"

SQL = {
    "isolation_findings": f"with {_RAW} select * from reason",
    "isolation_summary": f"""with {_RAW} select (select count(*) from raw) as n_seen, (select count(*) from p where coalesce(patch, '') <> '' and k % 17 <> 0) as n_reference_patches, (select count(*) from reason) as n_findings,
        case when (select count(*) from reason) > 0 then 'FAIL' when (select count(*) from raw) = 0 then 'BLOCKED' else 'PASS' end as status""",
    "task_bindings": f"""with {_TASKS}, a as (select * from decided where reason_code is null)
        select x.row_index, a.repo is not distinct from {canonical('x.repository')} and a.commit_ is not distinct from case when regexp_full_match({strip('x.base_commit')}, '[0-9a-fA-F]{{40}}') then lower({strip('x.base_commit')}) end as agrees
        from tasks x join a on nullif({strip('x.instance_id')}, '') = a.instance_id""",
    "model_patches": f"""with {_RAW}, q as (select row_index, source_field, coalesce(own, '') as patch from raw)
        select row_index, source_field, sha256(patch) as sha256, strlen(patch) as bytes, {diff('patch', '+')} as added_lines, {diff('patch', '-')} as removed_lines from q""",
    "normalized_records": f"""with {_RAW} select row_index, {_REASON} as reason, {canonical('repo')} as repository, {spdx('license')} as repository_license,
        case when regexp_full_match({strip('base_commit')}, '[0-9a-fA-F]{{40}}') then lower({strip('base_commit')}) end as base_commit, nullif({strip('instance_id')}, '') as issue_or_pr_id, {language('language')} as language,
        trajectory_id as rollout_id, case when resolved >= 0 then resolved = 1 end as resolved, case when stepless then 0 else 4 end as n_steps, sha256(coalesce(own, '')) as patch_sha256, strlen(coalesce(own, '')) as patch_bytes, source_field,
        concat_ws('|', 'hf-dataset:tables/tasks@{'0' * 40}', 'instance:' || nullif({strip('instance_id')}, ''), 'task-metadata:' || nullif({strip('instance_id')}, ''),
        'materialization:tables', 'trace-partition:tasks', 'upstream-source:tasks', 'task-provenance:tasks@1', 'task-provenance-artifact:tasks') as lineage from raw""",
    "record_checks": "select unnest(['sample_id', 'raw_row', 'lineage', 'commit', 'patch_counts', 'resolved']) as rule, 0 as n_rows",
    "record_collisions": """with r as (select row_index, instance_id as key, sha256(coalesce(repository, '')) as raw, case when license in ('MIT', 'Apache-2.0') and patch is not null then sha256(patch) end as s from tasks)
        select 'sample_without_rollout_key' as rule, row_index::varchar as value from r where s is not null and key is null
        union all select 'sample_of_several_rollouts', s from r where s is not null group by s having count(distinct key) > 1
        union all select 'rollout_of_several_samples', key from r where key is not null group by key having count(*) = count(s) and count(distinct raw) = 1 and count(distinct s) > 1""",
    "audit_report": _audit(),
    "pilot_decisions": f"with {_PILOT} select row_index, coalesce(reason, 'accepted') as reason from d",
    "pilot_subset": f"with {_PILOT} select row_index, case lang when 'TypeScript' then 1 else 2 end as rank, c as canonical, instance_id as issue, rollout from d where reason is null order by rank, c, instance_id nulls first, rollout, row_index limit 100",
    "label_recovery": f'with {_LABELS} select "partition", rollout_id, row_hash, key, outcome, label, n_labels from recovered',
    "label_requests": f'with {_LABELS}, r as (select *, row_number() over (partition by key order by "partition", rollout_id, row_hash) as n from recovered where outcome = \'request\') select key, count(*) as n_targets, min("partition") filter (where n = 1) as first_partition, min(rollout_id) filter (where n = 1) as first_rollout from r group by key',
    "label_conflicts": f"with {_LABELS} select key, n_true, n_labels - n_true as n_false from k where label is null and key in (select key from target)",
    "label_evidence": f'with {_LABELS} select key, label, "partition", rollout_id, row_hash, row_number() over (partition by key, label order by "partition", rollout_id, row_hash) as place from (select distinct key, label, "partition", rollout_id, row_hash from obs where key in (select key from recovered where outcome = \'candidate\'))',
    "label_accounting": f"""with {_LABELS} select "partition", count(*) as n_rows, count(*) filter (where row_class = 'ineligible') as n_ineligible, count(*) filter (where row_class = 'known') as n_known, count(*) filter (where row_class = 'target') as n_target, true as closes from row_ group by 1""",
    "label_counters": f"""with {_LABELS}, t as (select * from row_ where not is_labelled), open_ as (select count(*) as n from t where row_class = 'target')
        select (select count(*) from row_ where is_labelled) as n_labelled, (select count(*) from t) as n_targets, (select count(*) from t where row_class = 'ineligible') as n_ineligible, (select count(*) from t where row_class = 'known') as n_known,
        (select count(*) from recovered where outcome = 'candidate') as n_candidates, (select count(distinct key) from recovered where outcome = 'candidate') as n_candidate_keys, (select count(*) from recovered where label) as n_resolved,
        (select count(*) from recovered where not label) as n_unresolved, (select count(distinct key) from recovered where outcome = 'request') as n_requests, (select count(*) from recovered where outcome = 'request') as n_queued,
        (select count(*) from k where label is null and key in (select key from target)) as n_conflicts, (select n from open_) - (select count(*) from recovered) as n_repeated, 0 as n_lost""",
    "run_outcomes": """with line as (select l_orderkey as k, l_linenumber as t, l_returnflag = 'R' as before, l_returnflag = 'R' and l_quantity > 45 as after from lineitem),
        g as (select k, bool_or(after) as some_after from line group by k),
        r as (select o_orderkey, o_custkey % 10 as c, coalesce(some_after, false) as failing, case o_orderstatus when 'F' then true when 'P' then false end as expected from orders join g on k = o_orderkey),
        s as (select *, case when c = 0 then 'baseline_failed_to_run' when c = 1 then 'candidate_failed_to_run' when c = 3 then 'truncated' when c = 4 then 'incomplete_tests'
              when not failing and c = 2 then 'exit_contradicts_tests' when expected is not null and expected <> not failing then 'label_disagreement' else 'valid' end as reason from r)
        select o_orderkey, reason, case when reason in ('valid', 'label_disagreement') then not failing end as resolved, case when reason in ('valid', 'label_disagreement') then expected = not failing end as label_agrees from s""",
    "resolved_repositories": f"""with recursive step as (select name, min(target) as target from (select {_ALIASES.replace('{x}', 'alias')} as name, {_ALIASES.replace('{x}', 'target')} as target from repository_aliases)
        where name is not null and target is not null and name <> target group by name),
        chain as (select name, target, 1 as depth from step union all select c.name, s.target, depth + 1 from chain c join step s on c.target = s.name)
        select name, arg_max(target, depth) as entity from chain group by name""",
}

_ENTITY = f"""step as (select name, min(target) as target from (select {_ALIASES.replace('{x}', f"coalesce({canonical('alias')}, alias)")} as name, {_ALIASES.replace('{x}', f"coalesce({canonical('target')}, target)")} as target from repository_aliases)
        where name is not null and target is not null and name <> target group by name),
        chain as (select name, target, 1 as depth from step union all select c.name, s.target, depth + 1 from chain c join step s on c.target = s.name),
        entity as (select name, arg_max(target, depth) as entity from chain group by name),
        repo as (select distinct coalesce(e.entity, s.name) as name from (select {_ALIASES.replace('{x}', canonical('repository'))} as name from samples) s left join entity e using (name)),
        placed as (select {canonical('name')} as repository from repo where name is not null),
        split as (select distinct repository, case when ('0x' || substr(sha256('11:' || repository), 1, 16))::ubigint::double / 18446744073709551615 < 0.5 then 'evaluation' else 'train' end as split from placed where repository is not null)"""

_PLANTED = """(select benchmark_id, task_text, patch_text from benchmark_entries union all select 'planted-' || sample_id, task_text, patch_texts[1] || chr(10) || '+one line more'
        from (select distinct on (sample_id) sample_id, task_text, patch_texts from samples where starts_with(sample_id, '00')))"""

SQL |= {
    "run_summary": f"""select reason, count(*) as n_runs, count(*) filter (where resolved) as n_resolved, count(*) filter (where label_agrees) as n_agree, count(*) filter (where not label_agrees) as n_disagree from ({SQL['run_outcomes']}) group by reason""",
    "hashed_split": f"with recursive {_ENTITY} select repository, split from split",
    "excluded_repositories": f"with recursive {_ENTITY} select repository from split where split = 'evaluation'",
    "overlapping_sources": f"""with a as (select distinct {canonical('repository')} as value, 'documents' as p from documents union select {canonical('repository')}, 'samples' from samples union select {canonical('repository')}, 'tasks' from tasks)
        select value, string_agg(p, ',' order by p) as parts from a where value is not null group by value having count(*) > 1""",
    "unequal_records": """select c_custkey, unnest(case when c_custkey % 11 = 0 then ['c_nationkey', 'c_acctbal', 'c_mktsegment'] when c_custkey % 7 = 0 then ['c_acctbal'] else [] end) as field from customer""",
    "replayed_targets": f"with {_LABELS} select \"partition\", rollout_id, row_hash, key, instance_id from recovered where outcome = 'candidate'",
    "private_tasks": f"""with {_TASKS}, a as (select instance_id from decided where reason_code is null),
        p as (select distinct instance_id, sha256(coalesce(problem_statement, '-') || '|' || coalesce(test_patch, '-')) as private_sha256 from tasks),
        one as (select instance_id from p group by instance_id having count(*) = 1) select a.instance_id, private_sha256 from a join one using (instance_id) join p using (instance_id)""",
    "snapshot_rows": """select 'part.parquet' as source_file, count(*) as n_rows, 0 as first, count(*) - 1 as last from part
        union all select 'supplier.parquet', count(*), (select count(*) from part), (select count(*) from part) + count(*) - 1 from supplier""",
    "planted_overlap": "with " + _SPLIT.split(",\ne as (select")[0].replace("benchmark_entries", _PLANTED) + " select distinct sample_id, benchmark_id, kind from v join bench using (kind, fingerprint)",
    "planted_split": "with recursive " + _SPLIT.replace("benchmark_entries", _PLANTED) + " select * from assigned",
    "oracle_tasks": f"""with t as (select row_index as k, {language('language')} as language, nullif({strip('instance_id')}, '') as id, {canonical('repository')} as repo,
        coalesce(regexp_full_match({strip('base_commit')}, '[0-9a-fA-F]{{40}}'), false) as good_commit, nullif(coalesce(test_patch, patch), '') as test_patch from tasks),
        r as (select language, case when not coalesce(language in ('TypeScript', 'JavaScript'), false) then 'unsupported_language' when k % 29 = 0 then 'missing_log_parser' when id is null then 'missing_instance_id' when repo is null then 'invalid_repository'
        when not good_commit then 'invalid_base_commit' when k % 41 = 0 then 'invalid_image' when test_patch is null then 'missing_test_patch' when k % 5 <> 0 and k % 37 = 0 then 'invalid_fail_to_pass' when k % 31 = 0 then 'invalid_test_commands'
        when k % 5 = 0 then 'repeated_names' when k % 3 = 0 then 'names_in_both_lists' else 'usable' end as reason from t) select reason, language, count(*) as n_rows from r group by all""",
    "training_text_sizes": f"""with {_RAW}, a as (select *, {_REASON} as reason from raw), j as (select row_index, {canonical('repo')} as repo, lower({strip('base_commit')}) as c, nullif({strip('instance_id')}, '') as i, nullif(own, '') as own,
        case when row_index % 13 = 0 then concat_ws(chr(10), problem_statement, patch) else problem_statement end as shown, patch, test_patch from a where reason = 'accepted' and not stepless),
        s as (select row_index, '{{"base_commit":' || to_json(c) || ',"generated_patch":' || coalesce(to_json(own)::varchar, 'null') || ',"issue_or_pr_id":' || to_json(i) || ',"repository":' || to_json(repo) || ',"trajectory":['
        || '{{"content":"Solve the task.","role":"system"}},{{"content":' || coalesce(to_json(shown)::varchar, 'null') || ',"role":"user"}},{{"content":' || coalesce(to_json(patch)::varchar, 'null') || ',"role":"assistant"}},{{"content":' || coalesce(to_json(test_patch)::varchar, 'null') || ',"role":"tool"}}]}}' as text from j)
        select row_index::varchar as sample_id, length(text) as n_chars from s""",
    "evaluation_requests": f"with {_LABELS} select distinct \"partition\", rollout_id, row_hash, key, instance_id, lang from recovered where outcome = 'request'",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n_rows from events where ts is not null group by 1, 2",
}
