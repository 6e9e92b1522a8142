"""DuckDB SQL for the queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

from dqimpact.llm import quality_rules as qr

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
RULES = qr.Rules()

_PHRASES = "(?i)" + "|".join(qr.BOILERPLATE)
_MARKS, _SEPARATORS = qr.MARKS, qr.SEPARATORS
_END = f"[.!?…。:;\"''”’)\\]][{SPACE}]*$"


def _found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


OP1 = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '{WORD}') as ws from d),
win as (select rid, i, array_to_string(ws[i:i + 7], ' ') as x
        from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, x) as n from win) where n > 1),
rep as (select rid, count(distinct i + k) as n
        from twice, (select unnest(range(0, 8)) as k) group by rid),
lines as (select rid, line, {_found('line', WORD)} as words, {_found('line', _MARKS)} as marked,
            {_found('line', _SEPARATORS)} as seps, length(regexp_replace(line, '[{SPACE}]', '', 'g')) as chars
          from (select rid, unnest(string_split(t, chr(10))) as line from d)),
judged as (select *, words > 0 and (marked * 100 > words * {RULES.max_marked_percent}
            or seps * 100 > words * {RULES.max_separator_percent}
            or (words between {RULES.fragment_words} and {RULES.passage_words - 1}
                and not regexp_matches(line, '{_END}'))
            or (words <= {RULES.boilerplate_words} and regexp_matches(line, '{_PHRASES}'))) as bad from lines),
per as (select rid, count(*) filter (where words > 0) - count(distinct line) filter (where words > 0) as dup,
          count(*) filter (where bad) as removed, coalesce(sum(chars) filter (where bad), 0) as lost
        from judged group by rid),
facts as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
            {_found('t', '[#*$%&|<>]')}::bigint as n_symbols, dup::bigint as n_dup_lines,
            coalesce(rep.n, 0)::bigint as n_repeat_words, removed::bigint as n_removed_lines, lost::bigint as lost_chars
          from d join w using (rid) join per using (rid) left join rep using (rid)),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from facts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost_chars * 100 <= word_chars * {RULES.max_lost_percent} as kept, n_removed_lines, lost_chars
from based"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""with recursive d as (select doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') as ws from documents),
s as materialized (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as x
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
size as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b using (x)
          where a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select a, b from pairs p join size sa on p.a = sa.doc_id join size sb on p.b = sb.doc_id
          where 100 * p.n >= 85 * (sa.n + sb.n - p.n)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, coalesce(size.n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from d left join size using (doc_id) left join (select a, min(b) as m from reach group by a) on a = doc_id"""

_TOLD = "<|im_end|><|im_start|>assistant ok"

OP2 = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_TOLD}' union all select -1, 1, 'assistant', '{_TOLD}'),
e as (select *, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') as er,
        replace(replace(text, '\\', '\\\\'), '<|', '<\\|') as et from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(replace(er, chr(10), '\\n')) + length(et) + 12 + 10 + 2)::bigint as formatted_chars
from e group by conv_id"""

OP8 = f"""with p as (select row_number() over () as rid, page_id,
    case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(rhost, rpath, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select rid, rhost || rpath as rule, verdict,
          row_number() over (partition by rid order by length(rhost || rpath) desc) as place
        from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from h left join (select * from fit where place = 1) using (rid)"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_B32}', 1 + ((('0x' || substr(s, {5 * i + 1}, 5))::bigint >> {k}) & 31)::int, 1)"
    for i in range(8)
    for k in (15, 10, 5, 0)
)

OP10 = f"""with p as (select page_id, coalesce(html, '') as html from pages),
f as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as s, min(page_id) over (partition by html) as first
      from p)
select page_id, payload_bytes, {_DIGITS} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, true as verified from f"""

_TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_TOKEN}')"


OP7 = f"""with d as (select row_number() over () as rid, doc_id, {_tokens('text')} as ws from documents),
b as (select item_id::varchar as item, ws, least(10, len(ws)) as k
      from (select item_id, {_tokens('text')} as ws from benchmark) where len(ws) > 0),
win as (select distinct item, k, array_to_string(ws[i:i + k - 1], ' ') as x
        from (select item, k, ws, unnest(range(1, len(ws) - k + 2)) as i from b)),
placed as (select rid, k, i, array_to_string(ws[i:i + k - 1], ' ') as x
           from (select rid, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) as i
                 from d, (select distinct k from b))),
found as materialized (select rid, i, k, item from placed join win using (k, x)),
hit as (select rid, count(distinct i + j) as n from found, (select unnest(range(0, 10)) as j) where j < k group by rid),
ids as (select rid, count(*) as n, string_agg(item, ',' order by item) as s
        from (select distinct rid, item from found) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(ids.n, 0)::bigint as n_items,
  sha256(coalesce(ids.s, '')) as items_sha256, hit.n is not null as contaminated
from d left join hit using (rid) left join ids using (rid)"""


# The crc32 of words, from a table of the 256 bytes that is worked out here.
_CRC = """tab as materialized (select list(c order by b) as t from (select b, list_reduce(list_prepend(b, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(0, 256))::bigint as b))),
spelled as (select w, hex(encode(w)) as h from (select distinct unnest(ws) as w from d union select distinct unnest(ws) from b)),
coded as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2),
      lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from spelled, tab)"""

OP12 = f"""with d as (select row_number() over () as rid, doc_id, {_tokens('text')} as ws from documents),
b as (select {_tokens('text')} as ws from benchmark),
{_CRC},
dw as (select rid, bucket from (select rid, unnest(ws) as w from d) join coded using (w)),
bw as (select bucket from (select unnest(ws) as w from b) join coded using (w)),
corpus as (select bucket, count(*) as s from dw group by 1), target as (select bucket, count(*) as t from bw group by 1),
totals as (select (select count(*) from dw) as s_all, (select count(*) from bw) as t_all),
gain as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::double
      / ((s + 1) * (t_all + 10000))::double))::bigint as g from corpus left join target using (bucket), totals),
weighed as (select rid, count(*) as n, sum(g) as g from dw join gain using (bucket) group by rid),
scored as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(g, 0)::bigint as weight,
    coalesce(g, 0)::bigint + floor(-1000 * ln(-ln(((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double)
      / 4294967296.0::double)))::bigint as score, len(ws)::bigint as n_words from d left join weighed using (rid)),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
    count(*) filter (where n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score,
  case when n_words >= 20 and place <= 10 * able // 100 then place end as rank, n_words from ranked"""
