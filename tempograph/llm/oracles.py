"""DuckDB SQL for those of the corpus queries that SQL can express."""

from __future__ import annotations

from tempograph.llm.secrets import ALLOWED, CLASSES, KINDS, WINDOW

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NEAR_DUP = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
  e as (select doc_id, len(s) as n, unnest(s) as x from s),
  p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
  l as (select a, b from p where 100 * c >= 85 * (na + nb - c)), both_ways as (select a, b from l union all select b, a from l),
  r as (select doc_id, doc_id as root from documents union select k.b, r.root from r join both_ways k on k.a = r.doc_id where r.root < k.b)
  select s.doc_id, cast(len(s) as bigint) as n_shingles, m.root as component_id, s.doc_id = m.root as kept from s join (select doc_id, min(root) as root from r group by 1) m on s.doc_id = m.doc_id"""

LINE_DEDUP = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), l as (select doc_id, unnest(l) as line, unnest(range(len(l))) as pos from d),
  k as (select *, translate(trim(line, {_BLANKS}), {_LOWER}) as key from l), o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
  m as (select k.*, o.key is not null and o.owner <> doc_id as gone from k left join o on k.key = o.key)
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATTERNS = {
    "assign": _text(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": _text("AKIA[A-Z0-9]+"),
    "hex": _text("[0-9a-f]+"),
    "entropy": _text("[A-Za-z0-9+/_=-]+"),
}
_KEEP = {
    "assign": f"length(regexp_extract(hit, {_PATTERNS['assign']}, 1)) >= 6",
    "access": "length(hit) >= 20",
    "hex": "length(hit) >= 24",
    "entropy": "length(hit) >= 20 and regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]')",
}


def _spans(kind: str) -> str:
    """Matches of a kind with their places, from the lengths of matches and of the gaps between them."""
    p = _PATTERNS[kind]
    return f"""(select doc_id, {KINDS.index(kind)} as rank, hit, cast(sum(length(gap)) over w + sum(length(hit)) over w - length(hit) as bigint) as a, cast(sum(length(gap)) over w + sum(length(hit)) over w as bigint) as z
    from (select doc_id, unnest(string_split_regex(text, {p})[:-2]) as gap, unnest(regexp_extract_all(text, {p})) as hit, unnest(range(len(regexp_extract_all(text, {p})))) as i from d) window w as (partition by doc_id order by i rows unbounded preceding))"""


_WINDOWS = f"list_transform(range(1, length(hit) - {WINDOW - 2}), lambda i: substr(hit, cast(i as bigint), {WINDOW}))"
_ENTROPY = f"list_max(list_transform({_WINDOWS}, lambda v: -list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (({WINDOW} - length(replace(v, c, ''))) / {WINDOW}.0) * log2(({WINDOW} - length(replace(v, c, ''))) / {WINDOW}.0)))))"
_BITS = "case " + " ".join(f"when regexp_matches(hit, {_text(p)}) then {bits}" for p, bits in CLASSES) + " end"
_ALLOWED = " or ".join(f"regexp_matches(hit, {_text(p)})" for p in ALLOWED)

SECRETS = f"""with d as (select doc_id, coalesce(text, '') as text from documents),
  base as ({" union all ".join(f"select doc_id, rank, a, z from {_spans(k)} where {_KEEP[k]}" for k in KINDS[:3])}),
  more as (select doc_id, rank, hit, a, z from {_spans("entropy")} where {_KEEP["entropy"]}),
  fresh as (select m.* from more m where not exists (select 1 from base b where b.doc_id = m.doc_id and b.a <= m.a and b.z >= m.z)),
  added as (select doc_id, rank, a, z from fresh where not ({_ALLOWED}) and round({_ENTROPY}, 9) >= {_BITS}),
  every as (select *, {list(KINDS)}[rank + 1] || ':' || a || ':' || z as t from (select * from base union all select * from added))
  select d.doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
    sha256(coalesce(string_agg(t, ',' order by a, rank) filter (where rank < 3), '')) as base_sha256, coalesce(string_agg(t, ',' order by a, rank), '') as spans
  from d left join every e on d.doc_id = e.doc_id group by d.doc_id"""

_RUN = "'[a-z]+'"
URL_FILTER = f"""with recursive t as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
  h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from t),
  rules(verdict, rule) as (values ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
  fits as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc, rule desc) as k from h join rules r
    on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, position('/' in rule)))),
  p as (select h.*, rule, verdict as ruling from h left join (select * from fits where k = 1) f on h.page_id = f.page_id),
  e as (select page_id, host, ruling, unnest(list_concat(regexp_extract_all(host, {_RUN}), regexp_extract_all(translate(path, {_LOWER}), {_RUN}))) as run from p),
  counted as (select run, count(distinct host) as n from e group by run),
  words as (select run as piece, n from counted where n > 1 and length(run) <= 24),
  model as (select coalesce(sum(n), 0) + 1 as total, coalesce(max(length(piece)), 1) as most from words),
  ends as (select run, unnest(range(1, length(run) + 1)) as j from counted),
  spots as (select run, j, unnest(range(0, j)) as i from ends),
  tried as (select s.run, s.j, s.i, case when w.n is null then ln(total) + 3.0 + 2.5 * (s.j - s.i) else ln(total) - ln(w.n) end as price
    from spots s cross join model left join words w on w.piece = substr(s.run, s.i + 1, s.j - s.i) where s.i = 0 or s.j - s.i <= most),
  steps as (select run, j, list(struct_pack(i := i, price := price) order by i) as ways from tried group by run, j),
  best as (select run, 0 as j, [cast(0 as double)] as costs, [cast(0 as bigint)] as back from counted
    union all select run, j, list_append(costs, least_way.cost), list_append(back, least_way.i) from (
      select b.run, s.j, b.costs, b.back, list_sort(list_transform(s.ways, lambda w: struct_pack(cost := b.costs[w.i + 1] + w.price, i := w.i)))[1] as least_way from best b join steps s on s.run = b.run and s.j = b.j + 1)),
  cut as (select run, cast(length(run) as bigint) as j, back from best where j = length(run)
    union all select run, back[j + 1], back from cut where j > 0),
  pieces as (select run, substr(run, back[j + 1] + 1, j - back[j + 1]) as word from cut where j > 0),
  sums as (select word, count(*) filter (where ruling = 'block') as b, count(*) filter (where ruling = 'allow') as a from e join pieces using (run) where ruling is not null group by word),
  classes as (select count(*) filter (where ruling = 'block') as nb, count(*) filter (where ruling = 'allow') as na from p),
  sizes as (select sum(b) + count(*) as tb, sum(a) + count(*) as ta from sums),
  odds as (select word, ln((b + 1) / tb) - ln((a + 1) / ta) as x from sums cross join sizes cross join classes where nb > 0 and na > 0),
  scores as (select page_id, sum(coalesce(x, 0)) as s from e join pieces using (run) left join odds using (word) group by page_id)
  select p.page_id, host, path, rule, coalesce(ruling, case when s is not null and nb > 0 and na > 0 and ln(nb / na) + s > 0 then 'block' else 'allow' end) as verdict
  from p left join scores on p.page_id = scores.page_id cross join classes"""

# crc32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast({0} as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, cast(x as bigint)) else xor(a >> 1, case when a % 2 = 1 then 3988292384 else 0 end) end), 4294967295)"""
_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE = f"""with recursive d as (select doc_id, lang, n_chars, n_chars + case when {_CRC.format("doc_id")} % 7 = 0 then 1 else 0 end as claimed, source, text from documents),
  l as (select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf("claimed")} as claim from d),
  p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
  t as (select lang, 0 as level, pos, n, leaf as h from p
    union all select lang, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lang, level, pos // 2),
  sub as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from t where n = 1),
  u as (select 0 as level, pos, n, h from sub union all select level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from u where n > 1 group by level, pos // 2),
  height as (select lang, max(level) as levels from t group by lang),
  every as (select lang, level, pos, n, h from t where n > 1
    union all select s.lang, g.levels + u.level, u.pos, u.n, u.h from u cross join sub s join height g on g.lang is not distinct from s.lang where u.n > 1),
  f as (select doc_id, p.lang, leaf, 0 as level, p.pos, claim as h, '' as proof, g.levels, sub.pos as spot from p join height g on g.lang is not distinct from p.lang join sub on sub.lang is not distinct from p.lang
    union all select doc_id, f.lang, leaf, f.level + 1, here // 2, sha256(case when e.h is null then f.h when e.pos > here then f.h || e.h else e.h || f.h end), proof || coalesce(e.h, ''), levels, spot
      from (select *, case when level = levels then spot else pos end as here from f) f
      join (select distinct lang, level from every) v on v.lang is not distinct from f.lang and v.level = f.level
      left join every e on e.lang is not distinct from f.lang and e.level = f.level and e.pos = xor(here, 1)),
  last as (select *, row_number() over (partition by lang, doc_id, leaf order by level desc) as k from f)
  select doc_id, leaf, sub.h as subroot, r.h as root, sha256(proof) as proof_sha256, f.h as folded_root, f.h = r.h as verified
  from last f join sub on sub.lang is not distinct from f.lang cross join (select h from u where n = 1) r where k = 1"""

PREFIX_TRIE = rf"""with recursive o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from conversations where conv_id is not null),
  c as (select distinct conv_id, {_CRC.format("conv_id")} % 4 as h from o),
  r as (select c.conv_id, o.pos, role, text from c join o on o.conv_id = c.conv_id where o.pos >= h union all select c.conv_id, o.pos, role, text from c join o on o.conv_id = c.conv_id - c.conv_id % 20 where o.pos < h),
  n as (select *, row_number() over (partition by conv_id order by pos) as depth from r),
  w as (select conv_id, 0 as depth, sha256('') as path, cast(null as varchar) as up, cast(0 as bigint) as words from c
    union all select n.conv_id, n.depth, sha256(w.path || sha256(role) || sha256(text)), w.path, len(regexp_extract_all(text, '[^ 	-]+')) from w join n on n.conv_id = w.conv_id and n.depth = w.depth + 1),
  node as (select depth, path, any_value(up) as up, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs from w group by depth, path),
  kid as (select depth - 1 as depth, up as path, count(*) as n_children from node where depth > 0 group by depth, up),
  own as (select node.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved from node left join kid on kid.depth = node.depth and kid.path = node.path),
  above as (select depth as d, path as p, depth, path, up from own union all select d, p, o.depth, o.path, o.up from above a join own o on o.depth = a.depth - 1 and o.path = a.up),
  sums as (select a.depth, a.path, count(*) filter (where o.n_children = 0) as n_leaves, sum(o.saved) as saved_tokens from above a join own o on o.depth = a.d and o.path = a.p group by a.depth, a.path),
  size as (select conv_id, max(depth) as depth from w group by conv_id),
  ends as (select w.depth, w.path, string_agg(cast(w.conv_id as varchar), ',' order by w.conv_id) as ids from w join size s on s.conv_id = w.conv_id and s.depth = w.depth group by w.depth, w.path)
  select o.conv_id, cast(o.depth as bigint) as depth, b.conv_id as parent_conv_id, o.n_convs, cast(o.n_children as bigint) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
  from own o join sums s on s.depth = o.depth and s.path = o.path left join own b on b.depth = o.depth - 1 and b.path = o.up left join ends e on e.depth = o.depth and e.path = o.path"""

ORACLES = {"op6_url_filter": URL_FILTER, "op2_near_dup": NEAR_DUP, "op7_line_dedup": LINE_DEDUP, "op8_secrets": SECRETS, "op11_merkle": MERKLE, "op12_prefix_trie": PREFIX_TRIE}
