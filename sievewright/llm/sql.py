"""SQL with the results of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations


def _key(x: str) -> str:
    """Canonical form of a repository name."""
    y = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    for pattern, to in ((r"^[a-z][a-z0-9+.\-]*://", ""), (r"^[^/@]*@", ""), (r"^([^/:]+):[0-9]+(/|$)", r"\1\2"), (r"^([^/:]+):", r"\1/")):
        y = f"regexp_replace({y}, '{pattern}', '{to}')"
    y = f"regexp_replace({y}, '^[/\\s]+|[/\\s]+$', '', 'g')"
    return f"nullif(regexp_replace(regexp_replace({y}, '\\.git$', ''), '^[/\\s]+|[/\\s]+$', '', 'g'), '')"


_ENTITIES = f"""
step as (select name, min(target) as target from (select {_key('alias')} as name, {_key('target')} as target from repository_aliases)
        where name is not null and target is not null and name <> target group by name),
chain as (select name, target, 1 as depth from step union all select c.name, s.target, depth + 1 from chain c join step s on c.target = s.name),
known as (select name, arg_max(target, depth) as entity from chain group by name),
record as (select sample_id, coalesce(k.entity, r.name) as entity, r.name from
        (select sample_id, {_key('min(repository)')} as name from samples where sample_id is not null group by sample_id) r left join known k on k.name = r.name)"""

_PAIRS = """
txt as (select distinct 'task' as kind, sample_id, task_text as x from samples where task_text is not null
        union select 'patch', sample_id, x from (select sample_id, unnest(patch_texts) as x from samples) where x is not null),
numbered as (select row_number() over () as t, * from txt),
word as (select t, kind, sample_id, w, count(*) as n from (select t, kind, sample_id, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) as w from numbered) group by all),
len as (select t, sum(n) as m from word group by t),
common as (select a.t as s, b.t as t, any_value(a.kind) as kind, any_value(a.sample_id) as x, any_value(b.sample_id) as y, sum(least(a.n, b.n)) as c
        from word a join word b on a.w = b.w and a.kind = b.kind and a.sample_id < b.sample_id group by 1, 2),
pair as (select distinct kind, x as sample_id_a, y as sample_id_b from common join len p on p.t = s join len q on q.t = common.t where 2 * c >= 0.8 * (p.m + q.m) - 1e-9)"""

_SPLITS = """
assigned as (select sample_id, min(case when s in ('val', 'dev') then 'validation' else s end) as split from
        (select sample_id, lower(trim(split)) as s from split_assignments where sample_id is not null) where s in ('train', 'validation', 'test', 'val', 'dev') group by sample_id)"""

_CANON = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_COPIES = f"""
one as (select sample_id, any_value(task_text) as task_text, any_value(patch_texts) as patch_texts from samples where sample_id is not null group by sample_id),
canon as (select sample_id, {_CANON.format('task_text')} as task,
        list_sort(list_filter(list_transform(patch_texts, lambda p: {_CANON.format("coalesce(p, '')")}), lambda p: p <> '')) as patches from one),
part as (select sample_id, task || chr(10) || array_to_string(patches, chr(10)) as k from canon where task <> '' and len(patches) > 0),
grp as (select k, min(sample_id) as first_id, count(*) as n_copies from part group by k)"""

SQL = {
    "p1_found": f"with {_PAIRS} select * from pair",
    "p1_groups": """with recursive txt as (select distinct 'task' as kind, sample_id, task_text as x from samples where task_text is not null and sample_id is not null
        union select 'patch', sample_id, x from (select sample_id, unnest(patch_texts) as x from samples where sample_id is not null) where x is not null),
        worded as (select kind, sample_id, array_to_string(list_sort(regexp_extract_all(lower(x), '[a-z0-9]+')), ' ') as b from txt),
        bag as (select kind, b, row_number() over () as t from (select distinct kind, b from worded where b <> '')),
        member as (select distinct kind, sample_id, t from worded join bag using (kind, b)),
        word as (select t, kind, w, count(*) as n from (select t, kind, unnest(string_split(b, ' ')) as w from bag) group by all), len as (select t, sum(n) as m from word group by t),
        common as (select a.t as s, b.t as t, sum(least(a.n, b.n)) as c from word a join word b on a.w = b.w and a.kind = b.kind and a.t < b.t group by 1, 2),
        link as (select s, common.t as t from common join len p on p.t = s join len q on q.t = common.t where 2 * c >= 0.8 * (p.m + q.m) - 1e-9),
        both_ as (select s as a, t as b from link union all select t, s from link),
        walk as (select t as v, t as root from bag union select b, root from walk join both_ on a = v),
        rooted as (select v as t, min(root) as root from walk group by v),
        named as (select kind, root, min(sample_id) as group_id from member join rooted using (t) group by 1, 2),
        n as (select a as t, count(*) as links from both_ group by a)
        select kind, sample_id, group_id, max(coalesce(links, 0)) as links from member join rooted using (t) join named using (kind, root) left join n using (t) group by 1, 2, 3""",
    "p2_found": f"""with recursive {_ENTITIES},
        rec as (select sample_id, coalesce(entity, 'record:' || sample_id) as e from record),
        hit as (select regexp_replace(lower(trim(left_sample_id)), '^sha256:\\s*', '') as l, regexp_replace(lower(trim(right_sample_id)), '^sha256:\\s*', '') as r from sample_matches where matched),
        edge as (select distinct a.e as a, b.e as b from hit join rec a on a.sample_id = l join rec b on b.sample_id = r where a.e <> b.e),
        both_ as (select a, b from edge union select b, a from edge),
        walk as (select distinct e as v, e as root from rec union select b, root from walk join both_ on a = v),
        grp as (select v, min(root) as group_id from walk group by v)
        select sample_id, group_id from rec join grp on v = e""",
    "p4_found": f"with {_COPIES} select first_id, sample_id as copy_id from part join grp using (k) where sample_id <> first_id",
    "p4_copies": f"with {_COPIES} select first_id, n_copies from grp",
    "p5_found": f"with {_PAIRS}, {_SPLITS} select kind, sample_id_a, sample_id_b from pair join assigned a on a.sample_id = sample_id_a join assigned b on b.sample_id = sample_id_b where (a.split = 'train') <> (b.split = 'train')",
    "p5_report": f"""with {_PAIRS}, {_SPLITS},
        x as (select kind, case when b.split = 'train' then sample_id_a else sample_id_b end as sample_id, case when b.split = 'train' then a.split else b.split end as split
              from pair join assigned a on a.sample_id = sample_id_a join assigned b on b.sample_id = sample_id_b where (a.split = 'train') <> (b.split = 'train'))
        select split, source_dataset, kind, count(*) as pairs, count(distinct sample_id) as records from x join (select sample_id, min(source_dataset) as source_dataset from samples group by 1) using (sample_id) group by 1, 2, 3""",
    "p6_found": f"with recursive {_ENTITIES} select sample_id, entity from record where name <> entity",
    "p6_checks": "select unnest(['record_twice', 'record_without_split', 'entity_in_two_splits', 'split_off_target']) as rule, 0 as broken",
    "p7_found": f"""with {_SPLITS},
        held as (select sample_id from assigned where split <> 'train'),
        item as (select benchmark_id as item_id, unnest([task_text, patch_text]) as x from benchmark_entries
                 union all select sample_id, task_text from samples where sample_id in (select sample_id from held)
                 union all select sample_id, unnest(patch_texts) from samples where sample_id in (select sample_id from held)),
        iw as (select item_id, regexp_extract_all(lower(x), '[a-z0-9]+') as w from item where x is not null),
        dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
        ig as (select distinct item_id, array_to_string(w[k : k + 19], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 18)) as k from iw)),
        dg as (select distinct doc_id, array_to_string(w[k : k + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as k from dw))
        select distinct doc_id, item_id from dg join ig using (g)""",
}
