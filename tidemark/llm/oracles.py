"""DuckDB SQL of the queries that SQL can express, straight from their definitions."""

from . import chat_format, url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{separators}'), lambda x: x != '')"


_SPACE = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UP}', '{_LOW}')"


OP3 = f"""
with recursive w as (select row_number() over () as r, doc_id, {_words(_lowered("text"), _SPACE)} as ws from documents),
g as (select distinct r, array_to_string(ws[i:i + 4], ' ') as s from (select r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select r, count(*) as n from g group by 1),
o as (select a.r as a, b.r as b, count(*) as o from g a join g b on a.s = b.s and a.r < b.r group by 1, 2),
l as (select a, b from o join n x on x.r = a join n y on y.r = b where 100 * o >= 75 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
t(r, q) as (select r, r from w union select t.r, e.b from t join e on e.a = t.q),
c as (select t.r, min(w.doc_id) as m from t join w on w.r = t.q group by 1),
k as (select a as r, count(*) as n_links from e group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.m as component_id, coalesce(k.n_links, 0) as n_links
from w left join n using (r) left join c using (r) left join k using (r)
"""

OP5 = f"""
with w as (select row_number() over () as r, doc_id, {_words("text", _SPACE)} as ws from documents),
k as (select r, i, array_to_string(ws[i:i + 34], ' ') as s from (select r, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
d as (select s from k group by 1 having count(*) > 1),
p as (select distinct r, unnest(range(i, i + 35)) as p from k where s in (select s from d)),
a as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
h as (select a.r, string_agg(word, ' ' order by a.p) filter (p.p is null) as kept, count(p.p) as gone from a left join p on p.r = a.r and p.p = a.p group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join h using (r)
"""

OP6 = f"""
with b as (select row_number() over () as q, item_id, {_words(_lowered("text"), _NOT_WORD)} as ws from benchmark),
v as (select q, cast(item_id as varchar) as item, n, array_to_string(ws[i:i + n - 1], ' ') as s from (select q, item_id, ws, least(13, len(ws)) as n, unnest(range(1, greatest(len(ws) - 11, 2))) as i from b where len(ws) > 0)),
w as (select row_number() over () as r, doc_id, {_words(_lowered("text"), _NOT_WORD)} as ws from documents),
z as (select distinct n from v),
k as (select r, n, i, array_to_string(ws[i:i + n - 1], ' ') as s from (select r, n, ws, unnest(range(1, len(ws) - n + 2)) as i from w cross join z where len(ws) >= n)),
m as (select k.r, k.i, k.n, v.item from k join v on v.s = k.s and v.n = k.n),
h as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from m) group by 1),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m where item is not null) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from w left join h using (r) left join t using (r)
"""


def _chat() -> str:
    t = chat_format.Template()
    twice = lambda x: f"replace({x}, '{t.escape}', '{t.escape * 2}')"
    grown = lambda x: f"length({twice(x)}) + " + " + ".join(f"(length({twice(x)}) - length(replace({twice(x)}, '{c}', ''))) // {len(c)}" for c in t.control)
    marks = len(t.open) + len(t.between) + len(t.close)
    walk = " or ".join(f"(coalesce(before, '') = '{s}' and role in ({', '.join(repr(x) for x in to)}))" for s, to in t.moves.items())
    return f"""
with c as (select conv_id, turn, role, text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
y as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before, lead(role) over (partition by conv_id order by turn, role, text) as after from x),
z as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said, coalesce(string_agg(text, '' order by turn, role, text) filter (role in ('assistant')), '') as learned,
cast(sum({marks} + {grown("role")} + {grown("text")}) as bigint) as formatted_chars, bool_and({walk}) and bool_or(after is null and role in ('assistant')) as valid from y group by 1)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars, valid from z
"""


def _shrunk(name: str, groups: str, parent: str, key: str) -> str:
    """CTEs: groups (with n, bad) joined with parent (m) on key, and their posterior means m and sizes."""
    p = "pm * (1 - pm)"
    return f"""
{name}_g as (select g.*, p.m as pm from ({groups}) g join {parent} p on g.{key} = p.{key}),
{name}_s as (select case when sum(n * (bad / n - pm) * (bad / n - pm)) - sum({p}) > 0 then least({url_filter.STRONGEST}, greatest({url_filter.WEAKEST}, (sum(n * {p}) / sum(n)) / ((sum(n * (bad / n - pm) * (bad / n - pm)) - sum({p})) / sum(n)) - 1)) else {url_filter.STRONGEST} end as s from {name}_g),
{name} as (select g.* exclude (pm), (bad + coalesce(s, {url_filter.STRONGEST}) * pm) / (n + coalesce(s, {url_filter.STRONGEST})) as m, n + coalesce(s, {url_filter.STRONGEST}) as size from {name}_g g cross join {name}_s)"""


def _urls(rules: list[tuple[str, str, str]]) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    second = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)
    last = lambda n: f"case when len(a) > {n} then array_to_string(a[len(a) - ({n}) + 1:], '.') else host end"
    best = "".join(f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{i}'" for i, (_, h, p) in enumerate(ordered))
    rule = "case" + "".join(f" when k = '{i}' then '{h}{p}'" for i, (_, h, p) in enumerate(ordered)) + " end"
    verdict = "case" + "".join(f" when k = '{i}' then '{v}'" for i, (v, _, _) in enumerate(ordered)) + " end"
    return f"""
with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}') as host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages),
v as (select *, string_split(host, '.') as a from u),
y as (select *, case when len(a) > 1 and length(a[-1]) = 2 and a[-2] in ({second}) then 2 else 1 end as c from v),
x as (select page_id, url, host, path, {last("c + 1")} as domain, {last("c")} as suffix, case{best} end as k from y),
lb as (select doc_id, max(case when quality = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad from labels where quality is not null group by 1),
oc as (select x.host, x.domain, x.suffix, lb.bad from x join lb on lb.doc_id = try_cast(regexp_extract(x.path, '^/[a-z]+/([0-9]{{1,18}})(?:/|\\.html)?$', 1) as bigint)),
h as (select host, domain, suffix, cast(count(*) as double) as n, cast(sum(bad) as double) as bad from oc group by 1, 2, 3),
top as (select 1 as one, (coalesce(sum(bad), 0.0) + 1) / (coalesce(sum(n), 0.0) + 2) as m from h),{_shrunk("sfx", "select suffix, 1 as one, sum(n) as n, sum(bad) as bad from h group by 1", "top", "one")},{_shrunk("dom", "select domain, suffix, sum(n) as n, sum(bad) as bad from h group by 1, 2", "sfx", "suffix")},{_shrunk("hst", "select host, domain, n, bad from h", "dom", "domain")},
j as (select x.page_id, x.host, x.path, coalesce(hst.m, dom.m, sfx.m, 0.5) as m, coalesce(hst.size, dom.size, sfx.size, 2.0) as size, x.k
from x left join hst on hst.host = x.host left join dom on dom.domain = x.domain left join sfx on sfx.suffix = x.suffix),
w as (select *, sqrt(m * (1 - m) / (size + 1)) as sd from (select distinct m, size from j where m > {url_filter.LIMIT} and m < 1)),
e as (select *, greatest(0.0, m - {url_filter.SPAN} * sd) as low, least(1.0, m + {url_filter.SPAN} * sd) as high from w),
q as (select m, size, low + (high - low) * (k + 0.5) / {url_filter.STEPS} as v from e cross join range({url_filter.STEPS}) r(k)),
d as (select m, size, v, exp((m * size - 1) * ln(v / m) + ((1 - m) * size - 1) * ln((1 - v) / (1 - m))) as f from q),
sure as (select m, size, coalesce(sum(f) filter (v > {url_filter.LIMIT}), 0) >= {url_filter.SURE} * sum(f) as sure from d group by 1, 2)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when coalesce(sure, j.m >= 1) then 'block' else 'allow' end) as verdict from j left join sure on sure.m = j.m and sure.size = j.size
"""


def oracle_sql(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op3_jaccard": OP3, "op5_substring_dedup": OP5, "op6_decontaminate": OP6, "op8_chat": _chat(), "op10_url_filter": _urls(rules)}
