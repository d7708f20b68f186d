"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_HEADER = "regexp_extract(lower(header), '(?:^|[^a-z0-9]){0}[^a-z0-9]*([a-z0-9]+)', 1)"
_DEREP = f"select derep_id id, concat_ws('|', {', '.join(_HEADER.format(n) for n in ('sq', 'size', 'sample', 'chunk'))}, regexp_replace(upper(uniques), '[^A-Z]', '', 'g')) c from derep where header is not null and uniques is not null"
_CLUSTERING = "select clustering_id id, concat_ws('|', lower(coalesce(sample, '')), coalesce(cast(cluster_no as varchar), ''), regexp_replace(upper(sequence), '[^A-Z]', '', 'g')) c from clustering where sequence is not null"
_GROUPS = f"with r as (select 'derep' src, * from ({_DEREP}) union all select 'clustering', * from ({_CLUSTERING})), g as (select src, id, min(id) over (partition by src, c) first_id, count(*) over (partition by src, c) n from r)"

_TERMS = """with s as (select sequence, sample, max(coalesce(abundance, 0)) a from makesequencetable where sequence is not null and sample is not null group by sequence, sample),
n as (select count(distinct sample) n from s),
t as (select sequence, cast(sum(a) as bigint) total, count(*) n_records from s group by sequence),
m as (select t.*, case when n_records > 0.5 * n.n then 'common' when n_records <= 1 and total <= 2 then 'rare' end mark from t, n)"""

_SPANS = """with b as (select clustering_id, regexp_replace(upper(sequence), '[^A-Z]', '', 'g') s from clustering where sequence is not null),
u as (select s, row_number() over (order by s) rec from (select distinct s from b)),
w as (select rec, p, substr(s, p, 50) x from (select rec, s, unnest(range(1, length(s) - 48)) p from u where length(s) >= 50)),
k as (select x from w group by x having min(rec) <> max(rec)),
h as (select rec, p, case when p - lag(p) over (partition by rec order by p) <= 50 then 0 else 1 end fresh from w join k using (x)),
g as (select rec, p, sum(fresh) over (partition by rec order by p) i from h),
z as (select rec, min(p) span_from, max(p) + 49 span_to from g group by rec, i)
select b.clustering_id, cast(span_from as int) span_from, cast(span_to as int) span_to from z join u using (rec) join b using (s)"""


#: Words of eight bases, alike pairs of different texts, and the rows connected through them.
_ALIKE = """with recursive b as (select clustering_id id, abundance, regexp_replace(upper(sequence), '[^A-Z]', '', 'g') s from clustering where sequence is not null),
u as (select s, min(id) rec from b where length(s) >= 8 group by s), w as (select distinct rec, substr(s, p, 8) x from (select rec, s, unnest(range(1, length(s) - 6)) p from u)), z as (select rec, count(*) n from w group by rec),
o as (select a.rec i, c.rec j, count(*) n from w a join w c on a.x = c.x and a.rec < c.rec group by 1, 2),
l as (select i, j from o join z p on p.rec = i join z q on q.rec = j where o.n >= 0.6 * (p.n + q.n - o.n)), e as (select i, j from l union select j, i from l),
r(i, j) as (select i, i from e union select r.i, e.j from r join e on e.i = r.j), g as (select i rec, min(j) root from r group by i),
m as (select b.id, b.abundance, root group_id from b join u using (s) join g using (rec))"""

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_RUNS = f"""with d as (select doc_id, {_WORDS} w from documents where text is not null), t as (select item_id, {_WORDS} w from eval_items where text is not null),
ti as (select item_id, array_to_string(list_slice(w, p, p + 12), ' ') x from (select item_id, w, unnest(range(1, len(w) - 11)) p from t where len(w) >= 13)),
di as (select doc_id, array_to_string(list_slice(w, p, p + 12), ' ') x from (select doc_id, w, unnest(range(1, len(w) - 11)) p from d where len(w) >= 13))
select distinct doc_id, item_id from di join ti using (x)"""

#: Shared letters and the longest level of the doubling from 50 on at which a row has a window that a row of different text has too.
_LEVELS = """with recursive b as (select clustering_id, regexp_replace(upper(sequence), '[^A-Z]', '', 'g') s from clustering where sequence is not null),
u as (select s, row_number() over (order by s) rec from (select distinct s from b)), v as (select unnest([50, 100, 200, 400]) n),
w as (select rec, n, p, substr(s, p, n) x from (select rec, s, n, unnest(range(1, length(s) - n + 2)) p from u, v where length(s) >= n)),
k as (select n, x from w group by n, x having min(rec) <> max(rec)), h as (select rec, n, p from w join k using (n, x)), y as (select rec, max(n) longest from h group by rec),
c as (select rec, count(distinct q) shared from (select rec, unnest(range(p, p + 50)) q from h where n = 50) group by rec)
select b.clustering_id, length(s) n_letters, coalesce(shared, 0) n_shared, coalesce(longest, 0) longest_level from b join u using (s) left join y using (rec) left join c using (rec)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_GROUPS} select src, first_id, id copy_id from g where id <> first_id",
        "p1_records": f"{_GROUPS} select src, first_id, n n_copies from g where id = first_id",
        "p3_found": "select uniques from derep where uniques is not null group by uniques having count(*) >= 0.002 * (select count(*) from derep)",
        "p4_found": f"{_TERMS} select sequence, mark from m where mark is not null",
        "p4_terms": f"""{_TERMS},
r as (select sequence, run, count(distinct sample) n, min(nsamples) lo, max(nsamples) hi from makesequencetable where sequence is not null and sample is not null group by sequence, run),
y as (select sequence, bool_and(lo = n and hi = n) nsamples_right from r group by sequence)
select m.sequence, total, n_records, mark, nsamples_right from m join y using (sequence)""",
        "p2_found": f"{_ALIKE} select group_id, id clustering_id from m where id <> group_id",
        "p2_groups": f"{_ALIKE} select group_id, count(*) n_members, cast(coalesce(sum(abundance), 0) as bigint) abundance from m group by 1",
        "p3_top": "with c as (select uniques, count(*) n_rows from derep where uniques is not null group by 1) select uniques, n_rows from c where n_rows >= (select min(n_rows) from (select n_rows from c order by n_rows desc limit 25))",
        "p6_found": _SPANS,
        "p6_levels": _LEVELS,
        "p8_balance": "select 'documents' what, count(*) n from documents where doc_id is not null union all select unnest(['cut in vain', 'pieces apart', 'overfull', 'overlapping']), 0",
        "p9_found": _RUNS,
        "p10_lost": "select doc_id from documents where contains(text, chr(65533))",
    }
