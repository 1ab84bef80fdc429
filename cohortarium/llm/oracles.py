"""SQL (DuckDB) for the results of training-data queries that SQL can express at a bearable cost."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Turn numbers are below 256 in the tables this runs on, so no conversation spans two blocks.
OP1 = r"""
with recursive rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns as (
  select *, row_number() over w as i, sum(tokens) over (w rows unbounded preceding) as upto
  from (select *, cast(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 3 as bigint) as tokens,
    cast(14 + len(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + len(regexp_replace(text, '([\\#<])', '\\\1', 'g')) as bigint) as chars from rows) x
  window w as (partition by conv_id order by turn, role, text, tokens)
), system as (
  select conv_id, arg_min(i, i) as i, arg_min(tokens, i) as tokens, arg_min(chars, i) as chars from turns where role = 'system' group by conv_id
), room as (
  select t.conv_id, max(t.i) as n, 2048 - 512 - coalesce(any_value(s.tokens), 0) as room from turns t left join system s on s.conv_id = t.conv_id group by t.conv_id
), walk as (
  select conv_id, cast(1 as bigint) as i, cast(1 as bigint) as first, cast(0 as hugeint) as base from room
  union all
  select w.conv_id, w.i + 1, case when t.upto - w.base > r.room then w.i + 1 else w.first end, case when t.upto - w.base > r.room then p.upto else w.base end
  from walk w join room r on r.conv_id = w.conv_id join turns t on t.conv_id = w.conv_id and t.i = w.i + 1 join turns p on p.conv_id = w.conv_id and p.i = w.i
), windows as (
  select conv_id, first, max(i) as last from walk group by conv_id, first
), history as (
  select w.conv_id, w.first, w.last, coalesce(max(k), 0) as h from windows w
  left join (select unnest([1, 2, 3, 4]) as k) ks on k < w.first
    and coalesce((select upto from turns t where t.conv_id = w.conv_id and t.i = w.first - 1), 0) - coalesce((select upto from turns t where t.conv_id = w.conv_id and t.i = w.first - 1 - k), 0) <= 512
  group by all
), shown as (
  select h.conv_id, sum((select sum(chars) from turns t where t.conv_id = h.conv_id and t.i between h.first - h.h and h.last) + case when s.i is not null and s.i not between h.first - h.h and h.last then s.chars else 0 end) as chars
  from history h left join system s on s.conv_id = h.conv_id group by h.conv_id
)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by t.i)) as turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by t.i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(any_value(s.chars) as bigint) as formatted_chars
from turns t join shown s on s.conv_id = t.conv_id group by t.conv_id
"""

OP5 = f"""
with words as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from words)),
earliest as (select g, min(doc_id) as m from windows group by g),
gone as (select distinct doc_id, i + k as i from windows join earliest using (g), range(13) t(k) where m < doc_id),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from words),
kept as (select e.doc_id, count(*) as n_words, count(gone.i) as n_removed, string_agg(word, ' ' order by e.i) filter (gone.i is null) as said from each e left join gone on gone.doc_id = e.doc_id and gone.i = e.i group by e.doc_id)
select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256 from words w left join kept on kept.doc_id = w.doc_id
"""

OP7 = f"""
with recursive words as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
shingles as (select distinct doc_id, g from (select doc_id, case when len(ws) >= 3 then array_to_string(ws[i:i + 2], ' ') else array_to_string(ws, ' ') end as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from words where len(ws) > 0))),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select p.a, p.b from shared p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.n >= 90 * (x.n + y.n - p.n)),
reach as (select doc_id, doc_id as c from words union select l.b, r.c from reach r join links l on l.a = r.doc_id)
select w.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.c) as component_id from words w left join sizes s on s.doc_id = w.doc_id join reach r on r.doc_id = w.doc_id group by w.doc_id
"""

ORACLES = {"op1_chat_formatting": OP1, "op5_substring_dedup": OP5, "op7_ngram_jaccard": OP7}
