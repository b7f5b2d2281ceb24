"""SQL that gives the rows of those queries that SQL can express whole: repeated bytes, formatted chats, near-duplicate groups, clusters, dominance counts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Bytes are pairs of hexadecimal digits; a window is 400 of them.
SUFFIX_DEDUP = """with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, i, md5(substr(h, 2 * i + 1, 400)) k from (select r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) i from d)),
s as (select r, i, lag(i) over (partition by r order by i) p from w where k in (select k from w group by k having count(*) > 1)),
g as (select r, i, sum(case when p is null or i > p + 200 then 1 else 0 end) over (partition by r order by i) g from s),
spans as (select r, min(i) a, max(i) + 200 b from g group by r, g),
kept as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) from_ from spans),
parts as (select r, max(b) last, sum(b - a) removed, count(*) n, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) kept from kept join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(case when n is null then h else kept || substr(h, 2 * last + 1) end)) kept_sha256 from d left join parts using (r)"""

_OWN = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"length(regexp_replace({0}, '[\\#<:]', '\\\0', 'g'))"
CHAT_FORMAT = rf"""with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -7, 0, 'user', {_OWN} union all select -7, 1, 'assistant', {_OWN})
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) loss_sha256, sum(15 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::bigint formatted_chars from c group by conv_id"""

MINHASH = f"""with recursive d as (select doc_id, {_WORDS} ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end ss from d),
k as (select ss, len(ss) n, min(doc_id) rep from (select doc_id, list_sort(ss) ss from s) where len(ss) > 0 group by ss),
e as (select rep, n, unnest(ss) x from k),
l as (select a.rep a, b.rep b from e a join e b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2 having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
u as (select a, b from l union all select b, a from l),
r(node, seen) as (select rep, rep from k union select r.node, u.b from r join u on r.seen = u.a),
c as (select node, min(seen) component from r group by node)
select doc_id, len(s.ss)::bigint n_shingles, coalesce(component, doc_id) component_id, doc_id = coalesce(component, doc_id) kept from s left join k on list_sort(s.ss) = k.ss left join c on node = rep"""

#: CRC-32 by a table of 256 entries that the query makes; cells on a dense grid of slots and levels.
DOMINANCE = """with t as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))),
s as (select sale_id, floor(epoch(sold_at) / 86400)::bigint slot, floor(floor(100 * total + 0.5) / 1000)::bigint level,
1 + xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 3 w from sales, t),
c as (select slot, level, count(*) n, sum(w) w from s where slot is not null and level is not null group by 1, 2),
g as (select a.slot, b.level, coalesce(n, 0) n, coalesce(w, 0) w from (select distinct slot from c) a cross join (select distinct level from c) b left join c on c.slot = a.slot and c.level = b.level),
e as (select slot, level, sum(n) over p n, sum(w) over p w from g window p as (partition by level order by slot rows between unbounded preceding and 1 preceding)),
v as (select slot, level, sum(n) over p n, sum(w) over p w from e window p as (partition by slot order by level desc rows between unbounded preceding and 1 preceding))
select sale_id, s.slot, s.level, case when v.slot is not null then coalesce(n, 0)::bigint end n_sales, case when v.slot is not null then coalesce(v.w, 0)::bigint end n_rows from s left join v on s.slot = v.slot and s.level = v.level"""


def _clusters(k: int, rounds: int, dims: int) -> str:
    """Rounds of Lloyd as so many common table expressions; components are long, distances exact."""
    near = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    parts = [
        f"e as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: isfinite(x))) = {dims})",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 c, v from e order by sha256('2:' || vec_id) limit {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, any_value(e.vec_id) vec_id, any_value(e.v) v, arg_min(c.c, ({near}, c.c)) c, min({near}) d from e cross join c{i} c group by r)")
        if i < rounds:
            means = f"select c, list(m order by j) v from (select c, j, floor(sum(v[j])::double / count(*))::bigint m from a{i} cross join (select unnest(range(1, {dims + 1})) j) group by c, j) group by c"
            parts.append(f"c{i + 1} as materialized (select c.c, coalesce(m.v, c.v) v from c{i} c left join ({means}) m using (c))")
    return f"with {', '.join(parts)} select vec_id, c::int cluster, d distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(c{rounds}.v, ',')) centroid_sha256 from a{rounds} join c{rounds} using (c)"


CLUSTERS = _clusters(40, 5, 64)

#: The contract's base columns of two operators whose own results have no SQL.
BASE_QUALITY = r"""with d as (select row_number() over () r, doc_id, text t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
w as (select r, i, array_to_string(ws[i:i + 7], ' ') k from (select r, ws, unnest(range(1, greatest(len(ws) - 6, 1))) i from d)),
c as (select distinct r, unnest(range(i, i + 8)) p from (select r, i, count(*) over (partition by r, k) n from w) where n > 1),
n as (select r, count(*) n from c group by 1),
l as (select r, string_split(t, chr(10)) ls from d where t is not null), u as (select r, unnest(ls) x from l), e as (select r, sum(n - 1) n from (select r, x, count(*) n from u where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1, 2) group by 1)
select doc_id, len(ws) n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(e.n, 0)::bigint n_dup_lines, coalesce(n.n, 0)::bigint n_repeat_words, len(ws) < 20 or 100 * coalesce(n.n, 0) > 30 * len(ws) base_failed from d left join n using (r) left join e using (r)"""

_ANY = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
BASE_SECRETS = rf"""with d as (select doc_id, coalesce(text, '') t from documents)
select doc_id, len(list_filter(regexp_extract_all(t, '{_ANY}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) n_assign,
len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) n_hex from d"""
