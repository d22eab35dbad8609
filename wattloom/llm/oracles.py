"""SQL for DuckDB that gives the rows of those operators that SQL can express, on its own terms: word lists and plain pairs."""

from __future__ import annotations

from collections.abc import Sequence

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan() -> str:
    """Base places from lists of words. Labels and scores for the names and notices that the given tables hold, told word by word; the
    operator's other licenses are tested one by one in tests/llm."""
    return rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
word as (select r, unnest(ws) as w0, unnest(range(len(ws))) as i from w),
near as (select r, i, w0, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2, lead(w0, 3) over o as w3, lead(w0, 4) over o as w4,
         lag(w0, 1) over o as p1, lag(w0, 2) over o as p2 from word window o as (partition by r order by i)),
b as (select r, i, 'gpl' as label from near where w0 = 'gnu' and w1 = 'general' and w2 = 'public' and w3 = 'license'
      union all select r, i, 'apache' from near where w0 = 'apache' and w1 = 'license'
      union all select r, i, 'cc-by' from near where w0 = 'cc' and w1 = 'by'
      union all select r, i, 'mit' from near where w0 = 'mit' and w1 = 'license'),
base as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as base_labels from b group by r),
seen as (select *, coalesce(p1 in ('under', 'by') or (p1 = 'the' and p2 in ('under', 'by')), false) as granted,
         coalesce(regexp_full_match(case when w0 = 'gnu' then w4 when w0 = 'cc' then w3 else w2 end, 'version|v?[0-9]+'), false) as numbered from near),
d as (select r, 'gpl' as label, case when granted then 0.95 when numbered then 0.85 else 0.6 end as score from seen where w0 = 'gnu' and w1 = 'general' and w2 = 'public' and w3 = 'license'
      union all select r, 'apache', case when granted then 0.95 when numbered then 0.85 else 0.6 end from seen where w0 = 'apache' and w1 = 'license'
      union all select r, 'mit', case when granted then 0.95 else 0.6 end from seen where w0 = 'mit' and w1 = 'license'
      union all select r, 'cc-by-nc', case when granted then 0.95 else 0.85 end from seen where w0 = 'cc' and w1 = 'by' and w2 = 'nc'
      union all select r, 'all-rights-reserved', 0.7 from seen where w0 = 'all' and w1 = 'rights' and w2 = 'reserved'),
kept as (select r, list(distinct label) as labels, max(score) as best from d group by r)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') as labels,
       greatest(coalesce(best, 0.0), case when n_base is null then 0.0 else 0.6 end)::double as score
from w left join base using (r) left join kept using (r)"""


def ngram_jaccard_join(percent: int, size: int) -> str:
    """All pairs of distinct sets that share a shingle, their exact counts, and what links reach."""
    run = " || ' ' || ".join(f"lead(w0, {k}) over o" for k in range(size))
    return rf"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
word as (select r, unnest(ws) as w0, unnest(range(len(ws))) as i from w where len(ws) >= {size}),
long as (select r, list_sort(list(distinct g)) as sh from (select r, {run} as g from word window o as (partition by r order by i)) where g is not null group by r),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < {size} then [array_to_string(ws, ' ')] else sh end as sh from w left join long using (r)),
node as (select min(doc_id) as node, sh, len(sh) as n from s where len(sh) > 0 group by sh),
x as (select node, n, unnest(sh) as g from node),
pair as (select a.node as a, b.node as b, count(*) as same, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.g = b.g and a.node < b.node group by a.node, b.node),
link as (select a, b from pair where 100 * same >= {percent} * (na + nb - same)),
edge as (select a, b from link union all select b, a from link),
reach(node, root) as (select node, node from node union select edge.b, reach.root from reach join edge on reach.node = edge.a),
comp as (select node, min(root) as component_id from reach group by node)
select s.doc_id, len(s.sh)::bigint as n_shingles, coalesce(comp.component_id, s.doc_id)::bigint as component_id
from s left join node on s.sh = node.sh left join comp on comp.node = node.node"""


def secret_scan(rules: Sequence[tuple[str, str, int, int]], base: Sequence[str]) -> str:
    """Each rule (kind, pattern, group, least length) by itself over whole texts; where a match starts is told by the lengths of what lies between matches."""
    quoted = [(kind, pattern.replace("'", "''"), group, least) for kind, pattern, group, least in rules]
    each = " union all ".join(
        f"""select r, {k} as k, '{kind}' as kind, unnest(string_split_regex(t, '{p}')[:-2]) as gap, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', {group})) as g, {least} as least,
 unnest(range(len(regexp_extract_all(t, '{p}')))) as i from d where regexp_matches(t, '{p}')"""
        for k, (kind, p, group, least) in enumerate(quoted)
    )
    told = "kind || ':' || a || ':' || (a + n)"
    listed = ", ".join(f"'{b}'" for b in base)
    counts = ", ".join(f"(count(*) filter (where kind = '{b}'))::bigint as n_{b}" for b in base)
    names = ", ".join(f"coalesce(n_{b}, 0)::bigint as n_{b}" for b in base)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
each as ({each}),
placed as (select r, k, kind, length(m) as n, length(g) as size, least, sum(length(gap) + length(m)) over (partition by r, k order by i) - length(m) as a from each),
kept as (select r, k, kind, a::bigint as a, n from placed where size >= least),
told as (select r, {counts}, string_agg({told}, ',' order by a, k) filter (where kind in ({listed})) as base, string_agg({told}, ',' order by a, k) as spans from kept group by r)
select doc_id, {names}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join told using (r)"""


def filter_audit() -> str:
    """Every order and step counted from the documents themselves."""
    lose = "f[w] and not hit"
    return rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
own as (select d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
f as (select doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as f from own),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as bad from labels where doc_id is not null group by 1),
g as (select part, f, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where bad) as n_bad from f left join l using (doc_id) group by 1, 2),
x(k) as (select unnest(range(1, 6))),
o as (select [a.k, b.k, c.k, d.k, e.k] as ks from x a, x b, x c, x d, x e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select array_to_string(list_transform(ks, lambda k: 'ABCDE'[k]), '') as filter_order, x.k as step, ks[x.k] as w, ks[:x.k - 1] as before from o, x),
e as (select part, filter_order, step, w, f, n, n_good, n_bad, len(list_filter(before, lambda k: f[k])) > 0 as hit from g, s),
r as (select part, filter_order, step::int as step, w, coalesce(sum(n) filter (where not f[w] and not hit), 0)::bigint as kept, coalesce(sum(n) filter (where {lose}), 0)::bigint as removed,
  coalesce(sum(n) filter (where f[w] and hit), 0)::bigint as redundant, coalesce(sum(n) filter (where f[w] and len(list_filter(f, lambda b: b)) = 1), 0)::bigint as unique_fails,
  coalesce(sum(n_good) filter (where {lose}), 0)::bigint as good_lost, coalesce(sum(n_bad) filter (where {lose}), 0)::bigint as toxic_lost from e group by all)
select * exclude (w), (sum(removed) over (partition by part, w))::bigint as shapley from r"""


def prefix_trie() -> str:
    """Prefixes as whole lists of turns, grouped and compared as such; sums over a subtree by joining each node with all prefixes of it."""
    return r"""
with recursive crc_step(i, c, k) as (select range::ubigint, range::ubigint, 0 from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from crc_step where k < 8),
crc_table as (select list(c order by i) as t from crc_step where k = 8),
own as (select conv_id, list((coalesce(role, ''), coalesce(text, '')) order by turn nulls first) as turns from conversations where conv_id is not null group by 1),
h as (select own.*, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint) % 4)::int as h from own, crc_table),
c as (select h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) as turns from h left join own b on b.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from c),
m as (select conv_id, n, depth, turns[:depth] as path from p),
node as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, max(n) as longest,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from m group by path),
x as (select *, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(path[depth][2], '[^\x20\x09-\x0D]+')) end as saved from node),
u as (select unnest(range(depth + 1)) as d, path, saved, longest = depth as leaf, depth from x),
sums as (select path[:d] as path, sum(saved) as saved_tokens, count(*) filter (where leaf) as n_leaves, count(*) filter (where depth = d + 1) as n_children from u group by 1)
select x.conv_id::bigint as conv_id, x.depth::bigint as depth, a.conv_id::bigint as parent_conv_id, x.n_convs::bigint as n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, x.ends_sha256 from x join sums on sums.path = x.path left join x a on x.depth > 0 and a.path = x.path[:x.depth - 1]"""
