"""Global alignment in SQL, as an independent check of the alignment kernel: a recursion over anti-diagonals whose state is replaced at each step."""

from __future__ import annotations


def _in_run(s: str, i: str) -> str:
    """Does letter i of s lie in a run of three equal letters or more?"""
    same = lambda p, q: f"{s}[{i}] = {s}[{i} + {p}] and {s}[{i}] = {s}[{i} + {q}]"
    return f"(({i} > 2 and {same(-1, -2)}) or ({i} > 1 and {i} < length({s}) and {same(-1, 1)}) or ({i} + 1 < length({s}) and {same(1, 2)}))"


def alignments(pairs: str, match: int = 5, mismatch: int = -4, gap: int = -8, homo: int | None = None, band: int = -1) -> str:
    """CTEs that make al(a, b, al0, al1) of a table of different pairs (a, b). To be put after ``with recursive``.

    A cell is four times its score plus 2 for a step up, 1 for one left and 0 along the diagonal, so the greatest number is the
    best score and, of equal ones, the step that is preferred.
    """
    far, wide = -4_000_000, 1_000_000 if band < 0 else band
    up = lead = str(4 * gap)
    if homo is not None:
        up, lead = (f"case when {_in_run(s, i)} then {4 * homo} else {4 * gap} end" for s, i in (("a", "r"), ("b", "(d - r)")))
    score = lambda x: f"coalesce({x} - ({x} & 3), {far})"
    return f"""nw(a, b, d, n, m, dn, up, lo1, e1, lo2, e2, s1, s2, t1, t2) using key (a, b) as (
select a, b, 0, length(a), length(b), {wide} + greatest(length(a) - length(b), 0), {wide} + greatest(length(b) - length(a), 0), cast(0 as bigint), [cast(0 as bigint)], cast(0 as bigint), cast([] as bigint[]), [''], cast([] as varchar[]), [''], cast([] as varchar[]) from {pairs}
union all
select a, b, d, n, m, dn, up, lo, e, lo1, e1,
list_transform(e, lambda v, i: case v & 3 when 2 then concat(s1[lo + i - 1 - lo1], a[lo + i - 1]) when 1 then concat(s1[lo + i - lo1], '-') else concat(s2[lo + i - 1 - lo2], a[lo + i - 1]) end), s1,
list_transform(e, lambda v, i: case v & 3 when 2 then concat(t1[lo + i - 1 - lo1], '-') when 1 then concat(t1[lo + i - lo1], b[d - lo - i + 1]) else concat(t2[lo + i - 1 - lo2], b[d - lo - i + 1]) end), t1
from (select *, list_transform(range(lo, hi + 1), lambda r: case when r = 0 then 1 when r = d then 2 else greatest(
{score('e1[r - lo1]')} + case when d - r = m then 0 else {up} end + 2, {score('e1[r - lo1 + 1]')} + case when r = n then 0 else {lead} end + 1, {score('e2[r - lo2]')} + case when a[r] = b[d - r] then {4 * match} else {4 * mismatch} end) end) e
from (select * replace (d + 1 as d), greatest(0, d + 1 - m, (d + 2 - up) // 2) lo, least(n, d + 1, (d + 1 + dn) // 2) hi from nw where d < n + m))),
al as (select a, b, s1[1] al0, t1[1] al1 from nw where d = n + m)"""


_LEAD = "(length({0}) - length(ltrim({0}, '-')))"
_FROM = f"(greatest({_LEAD.format('al0')}, {_LEAD.format('al1')}) + 1)"
_TO = f"(length(al0) - greatest({_LEAD.format('reverse(al0)')}, {_LEAD.format('reverse(al1)')}))"
_COUNT = "cast(len(list_filter(range(" + _FROM + ", " + _TO + " + 1), lambda i: {0})) as int)"
#: Of al: columns between the gaps at the ends in which letters agree, differ, or stand against a gap.
MATCHES, MISMATCHES, INDELS = (_COUNT.format(c) for c in ("al0[i] = al1[i] and al0[i] <> '-'", "al0[i] <> al1[i] and al0[i] <> '-' and al1[i] <> '-'", "al0[i] = '-' or al1[i] = '-'"))


def covered(x: str, y: str, most: int) -> str:
    """How much of query x its parent y covers from the left, both with gaps: at most ``most`` letters before the parent begins, then equal columns to the first difference."""
    skip = _LEAD.format(x)
    credit = f"least({_LEAD.format(f'substr({y}, {skip} + 1)')}, greatest({most} - {skip}, 0))"
    return f"({credit} + coalesce(list_position(list_transform(range({skip} + {credit} + 1, length({x}) + 1), lambda i: {x}[i] <> {y}[i]), true) - 1, length({x}) - {skip} - {credit}))"


def covered_one_off(x: str, y: str, most: int) -> str:
    """The same with one difference stepped over, whose column counts where the query has a letter in the next one."""
    skip = _LEAD.format(x)
    at = f"({skip} + {covered(x, y, most)} + 1)"
    rest = f"coalesce(list_position(list_transform(range({at} + 1, length({x}) + 1), lambda i: {x}[i] <> {y}[i]), true) - 1, length({x}) - {at})"
    return f"({covered(x, y, most)} + case when {at} < length({x}) then case when {x}[{at} + 1] <> '-' then 1 else 0 end + {rest} else 0 end)"
