"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

# Windows of three non-blank lines (or all of fewer), and one or two lines of more
# than 50 words; of a repeated window all but
# the first occurrence lose their lines.
LINE_DEDUP = """
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from {docs}),
lines as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as l from docs),
full_ as (select doc_id, i, l, len(regexp_extract_all(l, '[^ ]+')) as w, row_number() over (partition by doc_id order by i) as r,
                 count(*) over (partition by doc_id) as n
          from lines where trim(l, ' ') <> ''),
win as (select a.doc_id, a.i as i1, b.i as i2, c.i as i3, a.w as w1, a.w + b.w as w2, a.r, a.n,
               a.l as l1, a.l || chr(10) || b.l as l2,
               a.l || chr(10) || coalesce(b.l, chr(0)) || chr(10) || coalesce(c.l, chr(0)) as w
        from full_ a
        left join full_ b on b.doc_id = a.doc_id and b.r = a.r + 1
        left join full_ c on c.doc_id = a.doc_id and c.r = a.r + 2
       ),
every as (select doc_id, i1, i2, i3, w from win where r <= greatest(n - 2, 1)
          union select doc_id, i1, null, null, l1 || chr(10) || chr(0) || chr(10) || chr(0) from win where w1 > 50
          union select doc_id, i1, i2, null, l2 || chr(10) || chr(0) from win where w1 <= 50 and w2 > 50),
ranked as (select *, row_number() over (partition by w order by doc_id, i1) as k from every),
gone as (select distinct doc_id, unnest([i1, i2, i3]) as i from ranked where k > 1),
kept as (select l.doc_id, string_agg(l.l, chr(10) order by l.i) as text,
                bool_or(trim(l.l, ' ') <> '') as has
         from lines l anti join gone g on g.doc_id = l.doc_id and g.i = l.i
         group by l.doc_id),
cut as (select doc_id, count(*) as n from gone where i is not null group by doc_id)
select d.doc_id, cast(len(d.ls) as bigint) as n_lines, cast(coalesce(c.n, 0) as bigint) as n_removed,
       case when c.n is null then d.text when k.has then k.text else '' end as text
from docs d left join cut c using (doc_id) left join kept k using (doc_id)
"""
SQL["op1_line_dedup"] = LINE_DEDUP.format(docs="documents")

# A document word is hit if it lies in an occurrence of an item's window.
_WORDS = ("list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')")
          + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")
CONTAMINATION = """
with d as (select doc_id, text, """ + _WORDS + """ as ws from {docs}),
b as (select item_id, """ + _WORDS + """ as ws from benchmark),
bw as (select distinct item_id, least(13, len(ws)) as n,
              unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
                                    lambda i: array_to_string(ws[i : i + least(13, len(ws)) - 1], ' '))) as gram
       from b where len(ws) > 0),
sizes as (select distinct n from bw),
dw as (select d.doc_id, s.n, unnest(range(1, len(d.ws) - s.n + 2)) as pos,
              unnest(list_transform(range(1, len(d.ws) - s.n + 2),
                                    lambda i: array_to_string(d.ws[i : i + s.n - 1], ' '))) as gram
       from d, sizes s where len(d.ws) >= s.n),
hit as (select dw.doc_id, dw.pos, dw.n, bw.item_id from dw join bw on bw.n = dw.n and bw.gram = dw.gram),
cover as (select doc_id, count(distinct p) as n_hit
          from (select doc_id, unnest(range(pos, pos + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
        from (select distinct doc_id, cast(item_id as varchar) as i from hit where item_id is not null) group by doc_id)
"""
SQL["op7_winnowing"] = CONTAMINATION.format(docs="documents") + """
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.items, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.ws) as contaminated
from d left join cover c using (doc_id) left join its i using (doc_id)
"""

# Sizes of the marked-up turns: 12 + role + 1 + text + 11 characters each, where
# every backslash and every "<|" adds one. Examples end at the assistant's turns
# and at the last one.
SQL["op10_chat"] = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as r,
             count(*) over (partition by conv_id) as n,
             24 + length(role) + length(text)
             + length(text) - length(replace(text, chr(92), ''))
             + (length(text) - length(replace(text, '<|', ''))) // 2
             + length(role) - length(replace(role, chr(92), ''))
             + (length(role) - length(replace(role, '<|', ''))) // 2
             + 3 * (length(role) - length(replace(role, chr(10), ''))) as c from t),
p as (select *, sum(c) over (partition by conv_id order by r) as upto from s)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by r)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by r) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (role = 'assistant' or r = n) as bigint) as formatted_chars
from p group by conv_id
"""

# CRC-32 by the table of its reflected polynomial; {} is a list of byte values.
_CRC_TABLE = """crc as (select list(v order by i) as t from (
  select i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i)))"""
_CRC = ("xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")

# A prefix is named by the chained digests of its turns; a node's ancestors are
# the prefixes of its smallest member up to its depth.
SQL["op11_prefix_trie"] = "with " + _CRC_TABLE + """,
t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as p
      from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
ids as (select conv_id, conv_id - conv_id % 100 as base,
               """ + _CRC.format("list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))") + """ % 6 as h
        from (select distinct conv_id from t), crc),
size as (select conv_id as base, count(*) as n from t group by 1),
built as (select i.conv_id, t.p, t.role, t.text from ids i join t on t.conv_id = i.base and t.p <= i.h
          union all
          select i.conv_id, t.p - i.h + least(i.h, coalesce(s.n, 0)), t.role, t.text
          from ids i join t on t.conv_id = i.conv_id and t.p > i.h left join size s on s.base = i.base),
pre as (select conv_id, p as d, length(text) as chars,
               string_agg(sha256(role) || sha256(text), '' order by p) over (partition by conv_id order by p) as name from built
        union all select conv_id, 0, 0, '' from ids),
nodes as (select name, d, count(*) as n, min(conv_id) as m, min(chars) as chars from pre group by name, d),
kids as (select left(name, length(name) - 128) as name, count(*) as k from nodes where d > 0 group by 1),
sub as (select a.name, count(*) filter (k.k is null) as n_leaves, sum((v.n - 1) * v.chars) as saved
        from nodes v join pre a on a.conv_id = v.m and a.d <= v.d left join kids k on k.name = v.name group by a.name),
ends as (select name, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
         from (select conv_id, arg_max(name, d) as name from pre group by conv_id) group by name)
select v.m as conv_id, cast(v.d as bigint) as depth, up.m as parent_conv_id, cast(v.n as bigint) as n_convs,
       cast(coalesce(k.k, 0) as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves,
       cast(s.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes v join sub s using (name) left join kids k using (name) left join ends e using (name)
left join nodes up on v.d > 0 and up.name = left(v.name, length(v.name) - 128)
"""

# Letters beyond ASCII are U+00C0 to U+00FF: two bytes, the first of them 195.
_UTF8 = ("flatten(list_transform(string_split({}, ''), lambda x: case when ord(x) < 128 then [cast(ord(x) as bigint)] "
         "else [cast(195 as bigint), cast(ord(x) - 64 as bigint)] end))")

# Near words share what is left when one letter goes: both without the letter at
# the same place, or one without a letter and the other whole.
SQL["op12_spelling"] = "with recursive " + _CRC_TABLE + """,
docs as (select coalesce(cast(doc_id as varchar), '') as id, """ + _LOWER.format("coalesce(text, '')") + """ as text from documents),
runs as (select id, unnest(regexp_extract_all(text, '[a-z\u00C0-\u00FF]+')) as run from docs),
counted as (select id, run, count(*) as k from runs group by id, run),
hashed as (select run, k, """ + _CRC.format(_UTF8.format("id || ':' || run")) + """ as h from counted, crc),
words as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed),
voc as (select word, cast(sum(k) as bigint) as n from words where length(word) >= 5 group by word having sum(k) >= 3),
cut as (select word, i, left(word, i - 1) || substr(word, i + 1) as rest
        from (select word, unnest(range(1, length(word) + 1)) as i from voc)),
near as (select a.word, b.word as near from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
         union select word, rest from cut where rest in (select word from voc)
         union select rest, word from cut where rest in (select word from voc)),
best as (select near.word, count(*) as n_near, arg_min(near, (-v.n, near)) as near, max(v.n) as near_n
         from near join voc v on v.word = near.near group by near.word),
forms as (select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 2 * v.n then b.near end as form,
                 case when b.near_n >= 2 * v.n then b.near_n end as form_n
          from voc v left join best b using (word)),
chain as (select word, word as at, form as next from forms
          union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next)
select f.word, f.form, c.at as root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from forms f join chain c on c.word = f.word and c.next is null
"""

# Every pair of documents that shares a shingle, compared on full sets; components
# by what can be reached over links.
SQL["op9_minhash"] = """
with recursive docs as (
  select doc_id, list_filter(string_split_regex(""" + _LOWER.format("coalesce(text, '')") + """, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws
  from documents),
grams as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end) as gram
  from docs),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k
           from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
links as (select u, v from shared join sizes a on a.doc_id = u join sizes b on b.doc_id = v
          where 100 * k >= 80 * (a.n + b.n - k)),
both_ways as (select u, v from links union all select v, u from links),
reach as (select doc_id as u, doc_id as v from docs
          union select r.u, b.v from reach r join both_ways b on b.u = r.v)
select doc_id, coalesce(n, 0) as n_shingles, c.m as component_id, doc_id = c.m as kept
from docs left join sizes using (doc_id) join (select u as doc_id, min(v) as m from reach group by u) c using (doc_id)
"""
