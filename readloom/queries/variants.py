"""Queries on variants: merging, chimeras, error rates, denoising and taxonomy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom import errors as E
from readloom.cluster import write_table
from readloom.functions import seq as S
from readloom.functions.text import bases
from readloom.kernels.poisson import tail
from readloom.operators import chimera, derep, packed, pairs, primers, qc
from readloom.operators import taxonomy as T
from readloom.queries.reads import OTHER, PAIRS, TABLE, R, reads, seq_table
from readloom.queries.alignment_sql import INDELS, MATCHES, MISMATCHES, alignments, covered, covered_one_off
from readloom.queries.reads import pairs as mates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return note


# --- pairs


#: Mates filtered each by itself, so that some are lost; and clusters of each side by a rule that SQL can state: sequences of a sample with the same first 30 letters go to the most abundant of them, those found once with no other to none.
_MATES = f"""{PAIRS}, fw as (select sample, read_idx, f seq from p where f is not null and not regexp_matches(f, 'N')), rv as (select sample, read_idx, r seq from p where r is not null and not regexp_matches(r, 'N') and list_sum(list_transform(rq, lambda x: pow(10.0, -x / 10.0))) <= 2.0),
fu as (select sample, seq, count(*) n, 'f' side from fw group by 1, 2), ru as (select sample, seq, count(*) n, 'r' side from rv group by 1, 2), uu as (select * from fu union all select * from ru),
un as (select *, substr(seq, 1, 30) w, first_value(seq) over k center, first_value(n) over k n0, sum(n) over (partition by side, sample, substr(seq, 1, 30)) total from uu window k as (partition by side, sample, substr(seq, 1, 30) order by n desc, seq)),
mp as (select side, sample, seq, case when total > 1 then w end cluster, center, n0 from un),
ct as (select fw.sample, f.cluster forward, r.cluster reverse, count(*) abundance from fw join rv using (sample, read_idx) join mp f on f.side = 'f' and f.sample = fw.sample and f.seq = fw.seq join mp r on r.side = 'r' and r.sample = rv.sample and r.seq = rv.seq group by 1, 2, 3)"""


def _sides(spark, d) -> list[DataFrame]:
    """Reads, clusters and map of both sides."""
    out = []
    p = mates(spark, d)
    w = Window.partitionBy("sample", "cluster")
    for side, keep in (("f", F.lit(True)), ("r", S.expected_errors(F.col("rq")) <= 2.0)):
        reads = p.where(F.col(side).isNotNull() & ~F.col(side).contains("N") & keep).select("sample", "read_idx", F.col(side).alias("seq"))
        u = reads.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("n")).withColumn("cluster", F.substring("seq", 1, 30))
        u = u.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "seq")), "total": F.sum("n").over(w)}).where("total > 1")
        clusters = u.where("rank = 1").select("sample", "cluster", F.col("seq").alias("sequence"), F.col("n").alias("n0"), F.col("total").alias("abundance"))
        out += [reads, clusters, u.select("sample", "seq", "cluster")]
    return out


@query("pair_clusters", f"with {_MATES} select * from ct")
def _pair_clusters(spark, d):
    fwd, _, fwd_map, rev, _, rev_map = _sides(spark, d)
    return pairs.cluster_pairs(fwd, fwd_map, rev, rev_map)


_PAIRED = f"""{_MATES}, ce as (select distinct side, sample, cluster, center, n0 from mp where cluster is not null),
cp as (select ct.*, f.center f, reverse(translate(r.center, 'ACGT', 'TGCA')) rc, r.center r, case when r.n0 > f.n0 then 2 else 1 end prefer from ct join ce f on f.side = 'f' and f.sample = ct.sample and f.cluster = forward join ce r on r.side = 'r' and r.sample = ct.sample and r.cluster = reverse),
pq as (select distinct f a, rc b from cp)"""
_CONSENSUS = f"""array_to_string(list_transform(range(length(al0) - length(ltrim(al0, '-')) + 1, length(rtrim(al1, '-')) + 1), lambda i: case when al0[i] = '-' then al1[i] when al1[i] = '-' or prefer = 1 then al0[i] else al1[i] end), '')"""


@query("pair_merge", f"with recursive {_PAIRED}, {alignments('pq', 1, -8, -8)}, ev as (select *, {MATCHES} nmatch, {MISMATCHES} nmismatch, {INDELS} nindel from al), mg as (select *, nmatch >= 12 and nmismatch + nindel <= 1 accept from cp join ev on f = a and rc = b) select sample, case when accept then {_CONSENSUS} else '' end sequence, abundance, forward, reverse, nmatch, nmismatch, nindel, prefer, accept from mg")
def _pair_merge(spark, d):
    return pairs.merge_denoised(*_sides(spark, d), max_mismatch=1, trim_overhang=True, return_rejects=True)


@query("pair_merge_strict", f"with recursive {_PAIRED}, {alignments('pq', 1, -64, -64)}, ev as (select *, {MATCHES} nmatch, {MISMATCHES} nmismatch, {INDELS} nindel from al) select sample, array_to_string(list_transform(range(1, length(al0) + 1), lambda i: case when al0[i] = '-' then al1[i] else al0[i] end), '') sequence, cast(sum(abundance) as bigint) abundance from cp join ev on f = a and rc = b where nmatch >= 12 and nmismatch + nindel = 0 group by 1, 2")
def _pair_merge_strict(spark, d):
    """Without a difference; several pairs of clusters may make one sequence."""
    return pairs.merge_denoised(*_sides(spark, d)).groupBy("sample", "sequence").agg(F.sum("abundance").alias("abundance"))


@query("pair_concatenate", f"with {_PAIRED} select cp.sample, concat(cp.f, 'NNNNNNNNNN', rc) sequence, abundance, f.n0 f_n0, r.n0 r_n0 from cp join ce f on f.side = 'f' and f.sample = cp.sample and f.cluster = forward join ce r on r.side = 'r' and r.sample = cp.sample and r.cluster = reverse")
def _pair_concatenate(spark, d):
    out = pairs.merge_denoised(*_sides(spark, d), just_concatenate=True, propagate=["n0", "absent"])
    return out.select("sample", "sequence", "abundance", F.col("F_n0").alias("f_n0"), F.col("R_n0").alias("r_n0"))


def _merge_input(spark, d):
    return mates(spark, d).select("sample", "f", "r", F.lit(1).alias("n0_f"), F.lit(1).alias("n0_r"))


@query("pair_merge_gapless", f"with recursive {PAIRS}, c as (select sample, f, reverse(translate(r, 'ACGTN', 'TGCAN')) rc, count(*) abundance from p where f is not null group by 1, 2, 3), pq as (select distinct f a, rc b from c), {alignments('pq', 1, -64, -64)}, ev as (select *, {MATCHES} nmatch, {MISMATCHES} nmismatch, {INDELS} nindel from al) select sample, concat(f, substr(rc, nmatch + 1)) sequence, cast(sum(abundance) as bigint) abundance, nmatch, nmismatch, nindel from c join ev on f = a and rc = b group by all")
def _pair_merge_gapless(spark, d):
    """Mates of one read, whose overlap agrees."""
    m = pairs.merge_pairs(_merge_input(spark, d), return_rejects=True)
    return m.groupBy("sample", "sequence", "nmatch", "nmismatch", "nindel").agg(F.sum("abundance").alias("abundance"))


def _seqs(spark, d) -> DataFrame:
    return reads(spark, d).where("seq is not null").select("seq").distinct()


def _against(b: str) -> str:
    return f"sq as (select distinct seq a, '{b}' b from reads where seq is not null)"


@query("nw_align", f"with recursive {_against(OTHER[4:92])}, {alignments('sq', band=16)} select a seq, al0, al1 from al")
def _nw(spark, d):
    al = pairs.nw_align(F.col("seq"), F.substring(F.lit(OTHER), 5, 88), band=16)
    return _seqs(spark, d).select("seq", al.alias("a")).select("seq", "a.al0", "a.al1")


@query("nw_counts", f"with recursive {_against(OTHER)}, {alignments('sq', band=16)} select a seq, {MATCHES} nmatch, {MISMATCHES} nmismatch, {INDELS} nindel from al")
def _nwc(spark, d):
    return _seqs(spark, d).select("seq", pairs.pair_counts(F.col("seq"), F.lit(OTHER), band=16).alias("c")).select("seq", F.col("c.match").alias("nmatch"), F.col("c.mismatch").alias("nmismatch"), F.col("c.indel").alias("nindel"))


@query("nw_hamming", f"with recursive {_against(OTHER)}, {alignments('sq', band=16)} select a seq, {MISMATCHES} + {INDELS} ham from al")
def _nwh(spark, d):
    return _seqs(spark, d).select("seq", pairs.nw_hamming(F.col("seq"), F.lit(OTHER), band=16).alias("ham"))


@query("nw_homopolymer", f"with recursive {_against(OTHER)}, {alignments('sq', homo=-1, band=16)} select a seq, al0, al1 from al")
def _nwhomo(spark, d):
    al = pairs.nw_align(F.col("seq"), F.lit(OTHER), homo_gap=-1, band=16)
    return _seqs(spark, d).select("seq", al.alias("a")).select("seq", "a.al0", "a.al1")


@query("nw_extract", f"with recursive {_against(OTHER[10:80])}, sw as (select b a, a b from sq), {alignments('sw')} select b seq, replace(substr(al1, length(al0) - length(ltrim(al0, '-')) + 1, length(trim(al0, '-'))), '-', '') part from al")
def _nwextract(spark, d):
    return _seqs(spark, d).select("seq", pairs.extract_aligned(F.lit(OTHER[10:80]), F.col("seq")).alias("part"))


#: A primer, and what each of its letters stands for.
PRIMER = "TCTACGCCGGTGCAAYCA"
_SETS = "[" + ", ".join(f"'{primers.IUPAC[c]}'" for c in PRIMER) + "]"
_TRIM = f"""with {R}, s as (select read_idx, sample, seq, reverse(translate(seq, 'ACGTN', 'TGCAN')) rc from r where seq is not null),
pl as (select *, {{0}} pf, {{1}} pr from s)
select read_idx, sample, case when pf is not null then substr(seq, cast(pf + {len(PRIMER)} as int)) else substr(rc, cast(pr + {len(PRIMER)} as int)) end seq from pl where coalesce(pf, pr) + {len(PRIMER)} < length(seq)"""
_PLACE = f"list_min(list_filter(range(1, length({{0}}) - {len(PRIMER) - 2}), lambda p: len(list_filter(range(1, {len(PRIMER) + 1}), lambda i: not contains({_SETS}[i], {{0}}[p + i - 1]))) <= 2))"


@query("primer_trim", _TRIM.format(_PLACE.format("seq"), _PLACE.format("rc")))
def _primer(spark, d):
    out = primers.remove_primers(reads(spark, d), PRIMER, max_mismatch=2)
    return out.select("read_idx", "sample", "seq")


@query("primer_indels")
def _primer_indels(spark, d):
    out = primers.remove_primers(reads(spark, d), PRIMER, max_mismatch=2, allow_indels=True)
    return out.select("read_idx", "sample", "seq")


# --- chimeras

_PARENTS = f"{TABLE}, pp as (select a.sample, a.seq child, b.seq parent from t a join t b on a.sample = b.sample where b.abundance > 1.5 * a.abundance and b.abundance >= 2 and a.seq <> b.seq)"
_COVER = f"""{_PARENTS}, dp as (select distinct child, parent from pp),
cv as (select child, parent, coalesce(nullif(list_position(list_transform(range(1, 97), lambda i: substr(child, cast(i as int), 1) <> substr(parent, cast(i as int), 1)), true), 0) - 1, 96) l,
coalesce(nullif(list_position(list_transform(range(1, 97), lambda i: substr(child, cast(97 - i as int), 1) <> substr(parent, cast(97 - i as int), 1)), true), 0) - 1, 96) r from dp),
fl as (select sample, child seq, count(*) n_parents, max(case when l + r < 96 then l else 0 end) l, max(case when l + r < 96 then r else 0 end) r from pp join cv using (child, parent) group by 1, 2)"""


@query("chimera_parents", f"with {_PARENTS} select sample, child seq, count(*) n_parents from pp group by 1, 2")
def _parents(spark, d):
    """How many sequences of its sample each one is held against."""
    return chimera.parent_counts(seq_table(spark, d), 1.5, 2, inclusive=True)


@query("chimera_gapless", f"with {_COVER} select sample, seq, n_parents, cast(l as int) l, cast(r as int) r, l + r >= 96 chimeric from fl")
def _gapless(spark, d):
    t = seq_table(spark, d)
    return chimera.chimera_evidence(t, t.where("abundance >= 2"), 1.5, gapless=True)


_VOTES = f"""{_PARENTS}, dp as (select distinct child a, parent b from pp), {alignments('dp', band=16)},
cv as (select a child, b parent, {covered('al0', 'al1', 16)} l, {covered('reverse(al0)', 'reverse(al1)', 15)} r from al),
fl as (select sample, child seq, max(case when l + r < length(child) then l else 0 end) + max(case when l + r < length(child) then r else 0 end) >= length(child) hit from pp join cv using (child, parent) group by 1, 2, length(child)),
vt as (select seq, count(*) filter (where coalesce(hit, false)) n_flagged, count(*) n_samples from t left join fl using (sample, seq) group by 1),
vo as (select *, n_flagged >= n_samples or n_flagged > 0 and n_flagged >= (n_samples - 1) * 0.9 chimeric from vt)"""


@query("chimera_vote", f"with recursive {_VOTES} select seq, n_flagged, n_samples, chimeric from vo")
def _vote(spark, d):
    return chimera.chimera_votes(seq_table(spark, d))


@query("chimera_remove", f"with recursive {_VOTES} select sample, seq, cast(abundance as bigint) abundance from t where seq not in (select seq from vo where chimeric)")
def _remove(spark, d):
    return chimera.remove_chimeras(seq_table(spark, d))


_FEW = f"""{TABLE}, pp as (select a.sample, a.seq child, b.seq parent from t a join t b on a.sample = b.sample where b.abundance > 2 * a.abundance and b.abundance > 8 and a.seq <> b.seq), dp as (select distinct child a, parent b from pp), {alignments('dp', band=16)},
cv as (select a child, b parent, {covered('al0', 'al1', 16)} l, {covered('reverse(al0)', 'reverse(al1)', 15)} r from al),
fl as (select sample, child seq, count(*) >= 2 and max(case when l + r < length(child) then l else 0 end) + max(case when l + r < length(child) then r else 0 end) >= length(child) hit from pp join cv using (child, parent) group by 1, 2, length(child))"""


@query("chimera_per_sample", f"with recursive {_FEW} select t.sample, t.seq, cast(t.abundance as bigint) abundance from t left join fl using (sample, seq) where not coalesce(hit, false)")
def _per_sample(spark, d):
    return chimera.remove_chimeras(seq_table(spark, d), "per-sample")


_ONE_OFF = f"""{TABLE}, o as (select seq, sum(abundance) n from t group by 1), pp as (select a.seq a, b.seq b from o a join o b on b.n > 2 * a.n and b.n > 8 and a.seq <> b.seq), {alignments('pp', band=16)},
cv as (select a, b, {covered('al0', 'al1', 16)} l, {covered('reverse(al0)', 'reverse(al1)', 15)} r, {covered_one_off('al0', 'al1', 16)} lo, {covered_one_off('reverse(al0)', 'reverse(al1)', 15)} ro, {MISMATCHES} + {INDELS} >= 4 far from al),
us as (select *, l + r < length(a) u, l + r < length(a) and far f from cv),
fl as (select a seq, count(*) n, max(case when u then l else 0 end) l, max(case when u then r else 0 end) r, max(case when f then l else 0 end) fl, max(case when f then r else 0 end) fr, max(case when f then lo else 0 end) lo, max(case when f then ro else 0 end) ro from us group by 1)"""


@query("chimera_denovo_one_off", f"with recursive {_ONE_OFF} select o.seq, coalesce(fl.n >= 2 and (l + r >= length(o.seq) or fl + ro >= length(o.seq) or lo + fr >= length(o.seq)), false) chimeric from o left join fl using (seq)".replace("fl + ro", "fl.fl + ro"))
def _denovo(spark, d):
    pooled = seq_table(spark, d).groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    return chimera.chimeras_denovo(pooled, allow_one_off=True)


_NEAR = """nr as (select x.seq a, y.seq b from s x join s y on x.seq <> y.seq and contains(y.seq, x.seq) where length(x.seq) >= 20
union select a, b from (select seq a, n, left(seq, n) h from s, lateral (select unnest(range(20, length(seq))) n)) join (select seq b, n, right(seq, n) h from s, lateral (select unnest(range(20, length(seq))) n)) using (n, h) where a <> b),
md as (select distinct case when (-x.total, x.seq) < (-y.total, y.seq) then b else a end a, case when (-x.total, x.seq) < (-y.total, y.seq) then a else b end b from nr join s x on x.seq = a join s y on y.seq = b)"""


@query("shift_denovo", f"""with recursive {TABLE}, s as (select seq, sum(abundance) total from t group by 1), {_NEAR}, mo as (select a, b from md join s x on x.seq = a join s y on y.seq = b where y.total > x.total), {alignments('mo')},
hit as (select distinct a from al where {MATCHES} >= 20 and {MISMATCHES} + {INDELS} = 0 and {MATCHES} < length(a) and {MATCHES} < length(b))
select seq, seq in (select a from hit) shifted from s""")  # fmt: skip
def _shift(spark, d):
    pooled = seq_table(spark, d).groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    return chimera.shifted(pooled)


@query("collapse_no_mismatch", f"""with recursive {TABLE}, u as (select sample, seq, sum(abundance) abundance from (select * from t union all select sample, substr(seq, 1, 80), abundance from t) group by 1, 2), s as (select seq, sum(abundance) total from u group by 1), {_NEAR}, {alignments('md')},
rk as (select seq, row_number() over (order by total desc, seq) k from s), ln as (select c.k, list(p.k) parents from al join rk c on c.seq = a join rk p on p.seq = b where {MISMATCHES} + {INDELS} = 0 group by 1),
al_k as (select rk.k, coalesce(parents, []) parents from rk left join ln using (k)),
gr(k, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all select gr.k + 1, case when list_has_any(parents, kept) then kept else list_append(kept, gr.k + 1) end from gr join al_k on al_k.k = gr.k + 1),
fin as (select kept from gr order by k desc limit 1), go as (select k, coalesce(list_min(list_intersect(parents, kept)), k) into_k from al_k, fin)
select sample, x.seq, cast(sum(abundance) as bigint) abundance from u join rk on rk.seq = u.seq join go using (k) join rk x on x.k = into_k group by 1, 2""")  # fmt: skip
def _collapse(spark, d):
    """A table that also has every sequence cut to its first 80 letters."""
    t = seq_table(spark, d)
    return chimera.collapse_no_mismatch(derep.merge_tables([t, t.withColumn("seq", F.substring("seq", 1, 80))], repeats="sum"))


# --- error rates

_TRANS = f"""{R}, tr as (select instr('ACGT', substr('{OTHER}', cast(pos as int), 1)) - 1 nti, instr('ACGT', substr(seq, cast(pos as int), 1)) - 1 ntj, q, count(*) n from (select seq, unnest(qual) q, generate_subscripts(qual, 1) pos from r where qual is not null)
where substr(seq, cast(pos as int), 1) <> 'N' group by 1, 2, 3)"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return derep.gapless_transitions(reads(spark, d), OTHER)


@query("trans_counts_gapless", f"with {_TRANS} select cast(nti as int) nti, cast(ntj as int) ntj, cast(q as int) q, n from tr")
def _trans(spark, d):
    return transitions(spark, d)


@query("trans_accumulate", f"with {_TRANS} select cast(nti as int) nti, cast(ntj as int) ntj, cast(q as int) q, cast(sum(n) as bigint) n from (select * from tr union all select * from tr where q < 30) group by 1, 2, 3")
def _accumulate(spark, d):
    t = transitions(spark, d)
    return E.accumulate([t, t.where("q < 30")])


def _long(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A matrix of rates, whose size is fixed, as rows."""
    return spark.createDataFrame([(i // 4, i % 4, q, round(float(m[i, q]), 9)) for i in range(16) for q in range(m.shape[1])], "nti int, ntj int, q int, rate double")


_GRID = "g as (select cast(i // 4 as int) nti, cast(i % 4 as int) ntj, cast(q as int) q from unnest(range(0, 16)) a(i), unnest(range(0, 41)) b(q))"


@query("err_noqual", f"with {_TRANS}, {_GRID}, s as (select nti, ntj, sum(n) n from tr group by 1, 2), k as (select g.nti, g.ntj, g.q, coalesce(s.n, 0) + 1 n from g left join s on g.nti = s.nti and g.ntj = s.ntj) select nti, ntj, q, round(n / sum(n) over (partition by nti, q), 9) rate from k")
def _noqual(spark, d):
    return _long(spark, E.flat_errors(E.to_matrix(transitions(spark, d))))


@query(
    "err_binned",
    f"""with {_TRANS}, {_GRID}, b as (select unnest([2, 12, 23, 37]) q), tot as (select nti, q, sum(n) t from tr group by 1, 2),
e as (select i.nti, j.ntj, b.q, coalesce(tr.n, 0) / tot.t r from b, (select unnest([0, 1, 2, 3]) nti) i, (select unnest([0, 1, 2, 3]) ntj) j join tot on tot.nti = i.nti and tot.q = b.q left join tr on tr.nti = i.nti and tr.ntj = j.ntj and tr.q = b.q where i.nti <> j.ntj),
lo as (select g.*, max(e.q) q0 from g join e on e.nti = g.nti and e.ntj = g.ntj and e.q <= greatest(g.q, 2) where g.nti <> g.ntj group by all), hi as (select g.*, min(e.q) q1 from g join e on e.nti = g.nti and e.ntj = g.ntj and e.q >= least(g.q, 37) where g.nti <> g.ntj group by all),
v as (select lo.nti, lo.ntj, lo.q, greatest(1e-7, least(0.25, a.r + case when q1 = q0 then 0 else (c.r - a.r) * (lo.q - q0) / (q1 - q0) end)) r from lo join hi using (nti, ntj, q) join e a on a.nti = lo.nti and a.ntj = lo.ntj and a.q = q0 join e c on c.nti = lo.nti and c.ntj = lo.ntj and c.q = q1)
select nti, ntj, q, round(r, 9) rate from v union all select nti, nti, q, round(1 - sum(r), 9) from v group by nti, q""",
)
def _binned(spark, d):
    return _long(spark, E.binned_errors([2, 12, 23, 37])(E.to_matrix(transitions(spark, d))))


@query("err_inflate", f"with {_GRID}, e as (select *, case when nti = ntj then 1 - pow(10.0, -q / 10.0) else pow(10.0, -q / 10.0) / 3 end e from g) select nti, ntj, q, round(case when nti = ntj then e else 3 * e / (1 + 2 * e) end, 9) rate from e")
def _inflate(spark, d):
    return _long(spark, E.inflate(E.nominal_errors(40), 3))


@query("err_loess")
def _loess(spark, d):
    return _long(spark, E.loess_errors(E.to_matrix(transitions(spark, d))))


@query("error_plot_data", f"with {_TRANS} select cast(nti as int) nti, cast(ntj as int) ntj, cast(q as int) q, n, cast(sum(n) over (partition by nti, q) as bigint) total, round(n / sum(n) over (partition by nti, q), 9) rate, round(case when nti = ntj then 1 - pow(10.0, -q / 10.0) else pow(10.0, -q / 10.0) / 3 end, 9) nominal from tr")
def _plot(spark, d):
    return E.observed_rates(transitions(spark, d)).withColumns({"rate": F.round("rate", 9), "nominal": F.round("nominal", 9)})


@query("lambda_gapless", f"with {R} select read_idx, round(list_sum(list_transform(range(1, 97), lambda i: case when substr(seq, cast(i as int), 1) in (substr('{OTHER}', cast(i as int), 1), 'N') then ln(1 - pow(10.0, -qual[i] / 10.0)) else ln(pow(10.0, -qual[i] / 10.0) / 3) end)), 4) log_rate from r where qual is not null")
def _lambda(spark, d):
    return reads(spark, d).where("qual is not null").select("read_idx", F.round(derep.gapless_log_rate(F.col("seq"), F.col("qual"), OTHER), 4).alias("log_rate"))


@query("poisson_pvalue", f"with {TABLE}, u as (select sample, seq, abundance k, sum(abundance) over (partition by sample) * 0.002 m from t) select sample, seq, round(greatest(0, 1 - list_sum(list_transform(range(0, k), lambda i: exp(-m + i * ln(m) - lgamma(i + 1))))), 6) p from u")
def _poisson(spark, d):
    @F.pandas_udf("double")
    def p(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(tail(k.to_numpy(), m.to_numpy()))

    t = seq_table(spark, d).withColumn("m", F.sum("abundance").over(Window.partitionBy("sample")) * 0.002)
    return t.select("sample", "seq", F.round(p(F.col("abundance"), F.col("m")), 6).alias("p"))


# --- denoising


def uniques(spark: SparkSession, d: str) -> DataFrame:
    kept = qc.filter_reads(reads(spark, d), qc.Filter(trunc_q=None, max_ee=4.0))
    return derep.quality_arrays(kept)


@query("denoise")
def _denoise(spark, d):
    from readloom.operators.denoise import denoise

    return denoise(uniques(spark, d), E.nominal_errors(40), E.binned_errors([2, 12, 23, 37])).clusters


@query("denoise_pooled")
def _denoise_pooled(spark, d):
    from readloom.operators.denoise import denoise

    return denoise(uniques(spark, d), E.nominal_errors(40), E.binned_errors([2, 12, 23, 37]), pool=True).denoised


@query("denoise_pseudo")
def _denoise_pseudo(spark, d):
    from readloom.operators.denoise import denoise

    return denoise(uniques(spark, d), E.nominal_errors(40), E.binned_errors([2, 12, 23, 37]), pool="pseudo").denoised


@query("learn_errors")
def _learn(spark, d):
    from readloom.operators.denoise import learn_errors

    return _long(spark, learn_errors(reads(spark, d), uniques(spark, d), 100_000_000, E.binned_errors([2, 12, 23, 37])).err_out)


# --- taxonomy

_RANKS = ", ".join(f"coalesce(nullif(trim(string_split(h, ';')[{i}]), null), '{T.UNSPECIFIED}') r{i}" for i in range(1, 7))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """References with their values as a clean header."""
    t = spark.read.parquet(f"{d}/reffasta.parquet")
    items = packed.split_packed(t, "ref_id", "id").groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    items = items.withColumn("x", F.filter("x", lambda v: ~v["item"].rlike(r"^RF[0-9]+\.[0-9]+\z") & (v["item"] != "NA")))
    return t.where("sequence is not null").join(items, "ref_id").select("ref_id", F.concat(F.array_join(F.transform("x", lambda v: v["item"]), ";"), F.lit(";")).alias("header"), F.upper("sequence").alias("seq"))


@query("tax_rank_pad", f"with k as (select ref_id, regexp_replace(id, ';\\s*$', '') h from reffasta where id is not null) select ref_id, {_RANKS} from k")
def _pad(spark, d):
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("id is not null")
    return t.select("ref_id", T.lineage(F.col("id"), 6).alias("l")).select("ref_id", *[F.col("l")[i].alias(f"r{i + 1}") for i in range(6)])


@query("tax_kmer_train", "with w as (select distinct ref_id, id grp, substr(upper(sequence), cast(i as int), 8) word from reffasta, unnest(range(1, length(sequence) - 6)) t(i) where sequence is not null and id is not null and length(sequence) >= 20) select grp, word, count(*) n from w where regexp_matches(word, '^[ACGT]{8}$') group by 1, 2")
def _train(spark, d):
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("id is not null").select(F.col("id").alias("grp"), F.upper("sequence").alias("seq"))
    return T.training_words(t, group="grp")


@query("tax_species_exact", "with q as (select distinct substr(upper(sequence), 11, 60) seq from reffasta where length(sequence) >= 70), s as (select * from q where regexp_matches(seq, '^[ACGT]*$')) select s.seq, r.ref_id from s join reffasta r on contains(upper(r.sequence), s.seq)")
def _exact(spark, d):
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("sequence is not null").select("ref_id", F.lit("").alias("genus"), F.lit("").alias("species"), F.upper("sequence").alias("seq"))
    return T.species_hits(t.where(F.length("seq") >= 70).select(F.substring("seq", 11, 60).alias("seq")), t).select("seq", "ref_id")


@query("tax_greengenes", """with k as (select ref_id, list_transform(string_split_regex(id, ';\\s*'), lambda x: regexp_replace(x, '^[a-z]__', '')) p from reffasta where id is not null and sequence is not null),
c as (select ref_id, list_transform(range(1, 7), lambda i: coalesce(p[i], '')) p from k), n as (select ref_id, list_slice(p, 1, coalesce(nullif(list_position(p, ''), 0) - 1, 6)) p from c)
select ref_id, concat(array_to_string(p, ';'), ';') header from n where len(p) > 0""")  # fmt: skip
def _greengenes(spark, d):
    """Headers of all references, taken as taxa with prefixes."""
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("id is not null and sequence is not null")
    refs = t.select(F.col("ref_id").cast("string").alias("header"), F.upper("sequence").alias("seq"))
    out = T.greengenes_taxonomy(refs.withColumn("seq", F.concat_ws("|", "header", "seq")), t.select(F.col("ref_id").cast("string").alias("id"), F.col("id").alias("taxon")))
    return out.select(F.split("seq", r"\|")[0].cast("long").alias("ref_id"), "header")


@query("tax_match_genera", "with k as (select ref_id, trim(string_split(id, ';')[6]) tax, trim(string_split(id, ';')[7]) sp, trim(regexp_extract(string_split(id, ';')[6], '^[^/_ ]*')) bin from reffasta where id is not null) select ref_id, coalesce(tax <> '' and bin <> '' and (tax = bin or starts_with(tax, concat(bin, ' ')) or starts_with(tax, concat(bin, '_')) or starts_with(tax, concat(bin, '/')) or ends_with(tax, concat('/', bin))), false) hit from k")
def _match_genera(spark, d):
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("id is not null")
    tax = F.trim(F.try_element_at(F.split("id", ";"), F.lit(6)))
    return t.select("ref_id", S.genus_matches(tax, F.trim(F.regexp_extract(F.try_element_at(F.split("id", ";"), F.lit(6)), "^[^/_ ]*", 0))).alias("hit"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """All sequences of denoised clusters and of the merged tables: none of them is a reference."""
    c, t = (spark.read.parquet(f"{d}/{name}.parquet").select(bases(F.col("sequence")).alias("seq")) for name in ("clustering", "makesequencetable"))
    return c.unionByName(t).where("seq is not null").distinct()


@query("tax_classify")
def _classify(spark, d):
    return T.classify(variants(spark, d), refs(spark, d))


@query("tax_bootstrap")
def _bootstrap(spark, d):
    out = T.classify(variants(spark, d), refs(spark, d), min_boot=0, try_rc=True)
    return out.groupBy("Phylum").agg(F.count(F.lit(1)).alias("n"), F.avg("boot_Genus").alias("mean_boot_genus"))


@query("tax_heldout")
def _heldout(spark, d):
    """Each half of the references classified by the other half: of the sequences whose genus the other half has, how many got one and how many the right one."""
    r = refs(spark, d).withColumns({"half": F.pmod(F.xxhash64("ref_id"), F.lit(2)), "genus": T.lineage(F.col("header"), 6)[5]})
    r = write_table(r.where(F.col("genus") != T.UNSPECIFIED), "halves")
    out = None
    for half in (0, 1):
        test, train = r.where(F.col("half") == half), r.where(F.col("half") != half)
        truth = test.join(train.select("genus").distinct(), "genus", "left_semi").select("seq", "genus").distinct()
        part = T.check_genus(T.classify(truth.select("seq"), train, min_boot=80), truth).select(F.lit(half).alias("half"), "n", "n_assigned", "n_right")
        out = part if out is None else out.unionByName(part)
    return out


@query("tax_add_species", """with k as (select ref_id, trim(string_split(id, ';')[6]) g, trim(string_split(id, ';')[7]) s, upper(sequence) seq from reffasta where id is not null and sequence is not null), r as (select * from k where g <> '' and s <> ''),
h as (select q.seq, list_sort(list_distinct(list(r.g))) gs, list_sort(list_distinct(list(r.s))) ss from (select distinct seq from r where regexp_matches(seq, '^[ACGT]*$') and length(seq) >= 16) q join r on contains(r.seq, q.seq) group by 1)
select seq, case when len(gs) = 1 then gs[1] end genus, case when len(gs) = 1 and len(ss) = 1 then ss[1] end species from h""")  # fmt: skip
def _add_species(spark, d):
    t = spark.read.parquet(f"{d}/reffasta.parquet").where("id is not null and sequence is not null")
    part = lambda i: F.trim(F.try_element_at(F.split("id", ";"), F.lit(i)))
    r = t.select("ref_id", part(6).alias("genus"), part(7).alias("species"), F.upper("sequence").alias("seq")).where("genus <> '' and species <> ''")
    q = r.where(S.is_acgt(F.col("seq")) & (F.length("seq") >= 16))
    s = T.assign_species(q, r)
    taxa = s.select("seq", "Genus")
    return T.add_species(taxa, s).select("seq", F.col("Genus").alias("genus"), F.col("Species").alias("species"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
