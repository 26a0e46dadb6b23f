"""SQL with the results of the curation queries."""

from __future__ import annotations

# White space that counts, as the character class of a regular expression.
_W = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LICENSES = "(values ('mit','MIT'),('mit license','MIT'),('apache-2.0','Apache-2.0'),('apache 2.0','Apache-2.0'),('apache license 2.0','Apache-2.0'),('bsd-2-clause','BSD-2-Clause'),('bsd 2-clause','BSD-2-Clause'),('bsd-3-clause','BSD-3-Clause'),('bsd 3-clause','BSD-3-Clause')) as allowed(spelling, spdx)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def spdx(x: str) -> str:
    return f"(select spdx from {_LICENSES} where spelling = lower({strip(x)}))"


def disposition(x: str) -> str:
    return f"case when {spdx(x)} is not null then 'ALLOW' when contains(lower({x}), 'gpl') then 'REJECT' else 'UNKNOWN' end"


def language(x: str) -> str:
    low = f"lower(nullif({strip(x)}, ''))"
    return f"case {low} when 'js' then 'JavaScript' when 'javascript' then 'JavaScript' when 'ts' then 'TypeScript' when 'typescript' then 'TypeScript' else {low} end"


def normalized(x: str) -> str:
    return strip(f"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x{{9}}\\x{{b}}-\\x{{d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+(\\n|$)', '\\1', 'g')")


def canonical(x: str) -> str:
    """Canonical repository; the alias of each step is a lateral column."""
    s = strip(x)
    scp, url = f"regexp_full_match({s}, 'git@[^:]+:.+')", f"contains({s}, '://')"
    host = f"lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace({s}, '^[^:]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
    path = f"regexp_extract(regexp_replace({s}, '^[^:]*://', ''), '^[^/?#]*([^?#]*)', 1)"
    whole = f"case when {scp} then regexp_replace({s}, '^git@([^:]+):', '\\1/') when {url} then nullif({host}, '') || {path} else {s} end"
    parts = f"list_filter(string_split(lower(regexp_replace({whole}, '\\.git$', '')), '/'), lambda p: p <> '')"
    joined = f"array_to_string({parts}, '/')"
    return f"case when len({parts}) = 2 and not {scp} and not {url} then 'github.com/' || {joined} when len({parts}) >= 3 then {joined} end"


def diff(x: str, sign: str) -> str:
    return f"len(list_filter(string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: starts_with(l, '{sign}') and not starts_with(l, '{sign * 3}')))"


_TASKS = f"""
t as (select row_index, nullif({strip('instance_id')}, '') as id, {canonical('repository')} as repo, nullif({strip('repository')}, '') as some_repo,
        lower({strip('base_commit')}) as commit_, {strip('base_commit')} as base_commit, {spdx('license')} as spdx, {disposition('license')} as d, {language('language')} as lang from tasks),
r as (select *, case when d = 'UNKNOWN' then 'license_unknown' when d = 'REJECT' then 'license_reject' when id is null then 'missing_instance_id'
        when some_repo is null then 'missing_repository' when repo is null then 'invalid_repository'
        when not coalesce(regexp_full_match(base_commit, '[0-9a-fA-F]{{40}}'), false) then 'invalid_base_commit' when lang is null then 'missing_language' end as reason,
        concat_ws('|', repo, commit_, spdx, lang) as payload from t),
g as (select id, count(*) as n, count(*) filter (where reason is null) as n_ok, min(row_index) filter (where reason is null) as first_ok,
        min(row_index) filter (where reason is not null) as first_bad, count(distinct payload) filter (where reason is null) as kinds,
        arg_min(payload, row_index) filter (where reason is null) as first_payload from r where id is not null group by id),
o as (select r.id, min(r.row_index) as first_other from r join g using (id) where reason is null and payload <> first_payload group by r.id),
j as (select r.*, g.* exclude (id), least(case when first_bad is not null and first_ok is not null then greatest(first_bad, first_ok) end, first_other) as shows,
        r.id is not null and n_ok > 0 and (n_ok < n or kinds > 1) as conflict from r left join g using (id) left join o using (id)),
decided as (select row_index, id as instance_id, repo, commit_, spdx, lang,
        case when id is null then reason when conflict then 'conflicting_task_provenance' when reason is not null then reason
             when row_index <> first_ok then 'duplicate_task_provenance' end as reason_code,
        case when conflict and reason is not null then reason
             when conflict and row_index <> first_ok and payload = first_payload and row_index < shows then 'duplicate_task_provenance' end as cause_code from j)"""

_CONTENT = f"""
s as (select sample_id, any_value({canonical('repository')}) as repository, any_value(task_text) as task_text, any_value(patch_texts) as patch_texts
      from samples where sample_id is not null group by sample_id),
raw as (select 'task' as kind, task_text as x, sample_id, repository from s union all select 'patch', unnest(patch_texts), sample_id, repository from s),
v as (select distinct kind, sha256(y) as fingerprint, sample_id, repository from (select *, {normalized('x')} as y from raw where x is not null) where y <> ''),
b as (select 'task' as kind, {normalized('task_text')} as y, benchmark_id from benchmark_entries union all select 'patch', {normalized('patch_text')}, benchmark_id from benchmark_entries),
bench as (select kind, sha256(y) as fingerprint, benchmark_id from b where y <> ''),
grouped as (select kind, fingerprint, count(distinct repository) as n_repositories, count(*) as n_samples, min(repository) as first_repository
      from v where true group by 1, 2 having count(distinct repository) > 1)"""

_SPLIT = _CONTENT + """,
e as (select distinct first_repository as a, v.repository as b from v join grouped using (kind, fingerprint) where v.repository <> first_repository),
both_ as (select a, b from e union select b, a from e),
walk as (select distinct repository as vertex, repository as root from s where repository is not null union select b, root from walk join both_ on a = vertex),
root as (select vertex as repository, min(root) as contamination_group from walk group by vertex),
bad as (select distinct contamination_group from v join bench using (kind, fingerprint) join root using (repository)),
assigned as (select sample_id, repository, contamination_group, case when contamination_group in (select contamination_group from bad) then 'excluded'
      when ('0x' || substr(sha256('11:' || contamination_group), 1, 16))::ubigint::double / 18446744073709551615 < 0.5 then 'evaluation' else 'train' end as split
      from s join root using (repository))"""

_SIZES = "n as (select count(*) as n, min(v) as minimum, max(v) as maximum from w), p as (select quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.95) as p95 from (select v from w order by sha256(i || ':' || v::varchar) limit {cap})) select n, minimum, p50, p95, maximum, n > {cap} as approximate from n, p"


def _pilot(rules: str, select: str) -> str:
    return f"""with t as (select row_index, repository, instance_id, {spdx('license')} as s, {language('language')} as lang, {canonical('repository')} as c, strlen(patch) as n from tasks),
        j as (select *, {rules} as reason from t), f as (select min(row_index) as first from j where reason is null group by repository, instance_id),
        d as (select j.* exclude (reason), case when reason is null and row_index not in (select first from f) then 'duplicate' else reason end as reason from j) {select}"""


SQL = {
    "audit_summary": f"""select count(*) as n_rows, count(*) filter (where d = 'ALLOW') as n_allow, count(*) filter (where d = 'REJECT') as n_reject,
        count(*) filter (where d = 'UNKNOWN') as n_unknown, count(*) filter (where d <> 'ALLOW') as n_rejected, count(distinct r) as n_repositories,
        (select count(*) from (select instance_id from tasks where instance_id is not null group by 1 having count(*) > 1)) as n_duplicate_ids
        from (select {disposition('license')} as d, coalesce({canonical('repository')}, lower(trim(repository))) as r from tasks)""",
    "audit_value_counts": f"""with t as (select coalesce(language, 'UNKNOWN') as l, {disposition('license')} as d, coalesce({spdx('license')}, 'UNKNOWN') as s from tasks)
        select 'language' as kind, l as value, count(*) as n_rows from t group by 2 union all select 'license', d, count(*) from t group by 2 union all select 'spdx', s, count(*) from t group by 2""",
    "duplicate_instances": "select instance_id, count(*) as n_rows from tasks where instance_id is not null group by 1 having count(*) > 1",
    "first_duplicate_instances": "select instance_id, count(*) as n_rows from tasks where instance_id is not null group by 1 having count(*) > 1 order by 1 limit 20",
    "license_rejections": f"""select row_index, instance_id, repository, license as raw_license, {disposition('license')} as disposition,
        case when nullif({strip('license')}, '') is null then 'missing' when contains(lower(license), 'gpl') then 'copyleft' else 'not recognised' end as reason
        from tasks where {disposition('license')} <> 'ALLOW'""",
    "patch_size_distribution": "with w as (select row_index::varchar as i, strlen(patch) as v from tasks where patch is not null), " + _SIZES.format(cap=100000),
    "small_sample_distribution": "with w as (select l_orderkey || '-' || l_linenumber as i, l_partkey as v from lineitem where l_partkey is not null), " + _SIZES.format(cap=1000),
    "observed_fields": """select k as field, case json_type(props, '$."' || k || '"') when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number'
        when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'null' end as type, count(*) as n_rows
        from (select props, unnest(json_keys(props)) as k from events where json_valid(props)) group by 1, 2""",
    "canonical_repositories": f"select distinct repository, {canonical('repository')} as canonical from samples",
    "text_fingerprints": f"select row_index, sha256(x) as fingerprint, length(x)::int as n_chars from (select row_index, {normalized('problem_statement')} as x from tasks where problem_statement is not null)",
    "diff_statistics": f"""select row_index, {diff('patch', '+')} as added, {diff('patch', '-')} as removed, strlen(patch) as n_bytes,
        len(list_distinct(regexp_extract_all(patch, '(?m)^diff --git a/(\\S+) b/\\S+', 1))) as n_paths from tasks where patch is not null""",
    "hash_buckets": "select repository, round(('0x' || substr(sha256('11:' || repository), 1, 16))::ubigint::double / 18446744073709551615, 9) as bucket from (select distinct repository from tasks where repository is not null)",
    "task_decisions": f"with {_TASKS} select row_index, instance_id, case when reason_code is null then 'admit' else 'reject' end as decision, reason_code from decided",
    "task_reasons": f"with {_TASKS} select coalesce(reason_code, 'admitted') as reason_code, coalesce(cause_code, 'none') as cause_code, count(*) as n_rows from decided group by 1, 2",
    "rollout_decisions": f"""with r as (select row_index, instance_id as k, sha256(coalesce(problem_statement, '') || '|' || coalesce(patch, '')) as raw, {disposition('license')} = 'ALLOW' as ok from tasks),
        g as (select k, count(*) as n, count(*) filter (where ok) as n_ok, count(distinct raw) as kinds, min(row_index) as first from r where k is not null group by k),
        j as (select *, kinds > 1 or (n_ok > 0 and n_ok < n) as conflict, case when not ok then 'license' end as why from r left join g using (k)),
        c as (select *, case when k is null then coalesce(why, 'missing_rollout_key') when conflict then 'conflicting_rollout_identity' when n_ok = 0 then coalesce(why, 'normalization_error')
              when row_index <> first then 'duplicate_trace_row' end as reason_code from j)
        select row_index, k as rollout, case when reason_code is null then 'admit' else 'reject' end as decision, reason_code, case when k is not null and conflict then why end as cause_code from c""",
    "row_numbers": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_index from orders",
    "claimed_once": "select sha256(text) as h, min(doc_id) as doc_id from documents where text is not null group by 1",
    "normalized_traces": f"""with {_TASKS}, a as (select * from decided where reason_code is null),
        x as (select tasks.row_index, nullif({strip('tasks.instance_id')}, '') as id, {canonical('tasks.repository')} as repo, nullif({strip('tasks.repository')}, '') as raw_repo, lower(tasks.base_commit) as commit_,
              nullif({strip('tasks.base_commit')}, '') as raw_commit, {spdx('tasks.license')} as spdx, nullif({strip('tasks.license')}, '') as raw_license, {language('tasks.language')} as lang,
              (tasks.row_index % 4)::int - 1 as resolved, patch from tasks)
        select x.row_index, case when raw_repo is null then a.repo else x.repo end as repository, case when raw_license is null then a.spdx else x.spdx end as license,
          case when x.lang is null then a.lang else x.lang end as language, {diff('patch', '+')} as added_lines, {diff('patch', '-')} as removed_lines,
          case when x.id is null then 'missing_instance_id' when resolved not in (-1, 0, 1) then 'invalid_resolution' when resolved = -1 then 'unknown_resolution' when a.instance_id is null then 'missing_task'
               when raw_repo is not null and not coalesce(x.repo = a.repo, false) then 'repository_mismatch' when raw_commit is not null and x.commit_ <> a.commit_ then 'base_commit_mismatch'
               when raw_license is not null and not coalesce(x.spdx = a.spdx, false) then 'license_mismatch' when x.lang is not null and x.lang <> a.lang then 'language_mismatch'
               when patch is null then 'missing_patch' else 'accepted' end as reason_code
        from x left join a on x.id = a.instance_id""",
    "exact_groups": f"with {_CONTENT} select * from grouped",
    "exact_benchmark_overlap": f"with {_CONTENT} select distinct sample_id, benchmark_id, kind from v join bench using (kind, fingerprint)",
    "decontaminated_split": f"with recursive {_SPLIT} select * from assigned",
    "decontamination_evidence": f"""with recursive {_SPLIT} select 'exact_groups_' || kind as name, count(*) as n from grouped group by kind
        union all select 'values_' || kind, count(distinct fingerprint) from v group by kind
        union all select 'overlap_samples', count(distinct sample_id) from v join bench using (kind, fingerprint)
        union all select 'samples_' || split, count(*) from assigned group by split union all select 'repositories_' || split, count(distinct repository) from assigned group by split""",
    "pilot_selection": _pilot(
        "case when c is null then 'repository' when s is null then 'license' when not coalesce(lang in ('TypeScript', 'JavaScript'), false) then 'language' when n is null or n = 0 then 'empty_patch' when n > 1600 then 'patch_size' end",
        ", k as (select row_index, case lang when 'TypeScript' then 1 else 2 end as rank, repository, instance_id from d where reason is null) select * from k order by rank, repository, instance_id nulls first, row_index limit 100",
    ),
    "pilot_reasons": _pilot("case when s is null then 'license' when n is null or n = 0 then 'empty_patch' when n > 1600 then 'patch_size' end", "select reason, count(*) as n_rows from d where reason is not null group by reason"),
    "stratified_cover": """with f as (select min(c_custkey) as k from customer group by c_nationkey union select min(c_custkey) from customer group by c_mktsegment),
        rest as (select c_custkey as k from customer where c_custkey not in (select k from f) order by 1 limit greatest(0, 40 - (select count(*) from f)))
        select c_custkey, c_nationkey, c_mktsegment from customer where c_custkey in (select k from f union all select k from rest)""",
    "language_counts": f"select {language('language')} as language, count(*) as n_rows from tasks group by 1",
    "split_overlap": f"""with a as (select lower(trim(split)) as split, {canonical('repository')} as repository from split_assignments)
        select repository from a where split = 'train' and repository is not null intersect select repository from a where split <> 'train'""",
    "unassigned_samples": "select distinct sample_id from samples where sample_id not in (select sample_id from split_assignments where sample_id is not null)",
    "accounting_violations": """select 'price' as rule, count(*) filter (where not coalesce(o_totalprice > 1000, false)) as n_rows from orders
        union all select 'status', count(*) filter (where not coalesce(o_orderstatus in ('F', 'O'), false)) from orders
        union all select 'date', count(*) filter (where not coalesce(o_orderdate >= timestamp '1992-06-01', false)) from orders""",
    "snapshot_differences": """select s_suppkey, case when s_suppkey % 3 = 0 then 'left_only' else 'changed' end as side from supplier where s_suppkey % 3 = 0 or s_suppkey % 5 = 0""",
}
