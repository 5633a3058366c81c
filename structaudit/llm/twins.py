"""SQL twins of the queries on texts and conversations."""

from structaudit.llm import pii, shard

#: Damage, faults, and a parse by states of the role grammar: every row takes an edit, insertions follow it, the cheapest stay.
REPAIR_SQL = r"""
with recursive
crc_steps as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) r(i)),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as name from conversations),
marked as (
  select given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: unicode(ch)::bigint)),
                                  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from given, crc_steps),
harmed as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from marked, unnest(case when kind = 3 then [1, 2] else [1] end) u(copy) where kind <> 0),
listed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, left(role, 1) as ini,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare from harmed),
judged as (
  select *, case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd' when right(bare, 1) in ('.', '!', '?') then '-' else 't' end as fault,
         lag(ini) over (partition by conv_id order by pos) || ini as step from listed),
shifts(s, sym, z) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(s, z, k) as (values (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
edits(e, s, sym, z, price) as (
  select 'D', s, null, s, 3 from range(4) r(s) union all select 'K', s, sym, z, 0 from shifts union all select 'R', s, sym, z, 2 from shifts where sym <> 's'),
convs as (select conv_id, max(pos) as last from listed group by conv_id),
parse(conv_id, pos, s, best) as (
  select conv_id, 0::bigint, z, {'cost': 2 * k, 'audit': repeat('I', k)} from convs, added where added.s = 0
  union all
  select p.conv_id, p.pos + 1, a.z, min({'cost': p.best.cost + e.price + case when j.fault = 't' and e.e <> 'D' then 1 else 0 end + 2 * a.k, 'audit': p.best.audit || e.e || repeat('I', a.k)})
  from parse p join judged j on j.conv_id is not distinct from p.conv_id and j.pos = p.pos + 1
       join edits e on e.s = p.s and (e.e = 'D' or j.fault not in ('b', 'd')) and (e.e <> 'K' or e.sym = j.ini)
       join added a on a.s = e.z
  group by p.conv_id, p.pos, a.z),
won as (
  select p.conv_id, min(p.best) as best from parse p join convs c on c.conv_id is not distinct from p.conv_id and p.pos = c.last where p.s in (0, 3) group by p.conv_id),
letters as (
  select w.conv_id, i, substr(w.best.audit, i, 1) as e, length(replace(left(w.best.audit, i), 'I', '')) as pos,
         length(replace(left(w.best.audit, i), 'D', '')) as place from won w, unnest(range(1, length(w.best.audit) + 1)) u(i)),
shown as (
  select l.*, j.role, j.text, max(case when l.e = 'K' and l.place = 1 and j.ini = 's' then 1 else 0 end) over (partition by l.conv_id) as opened
  from letters l left join judged j on j.conv_id is not distinct from l.conv_id and j.pos = l.pos and l.e <> 'I' where l.e <> 'D'),
said as (
  select conv_id, string_agg(case when e = 'K' then role when (place - opened) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i) as words from shown group by conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
         count(*) filter (fault = 't') as truncated, count(*) filter (step not in ('su', 'ua', 'au')) as illegal from judged group by conv_id)
select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, coalesce(w.best.cost, 0)::bigint as cost, coalesce(w.best.audit, '') as audit, sha256(coalesce(s.words, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id
     left join won w on w.conv_id is not distinct from o.conv_id left join said s on s.conv_id is not distinct from o.conv_id"""

#: Near words by what is left when one letter is taken away: from both at the same place, or from the longer word.
SPELLING_SQL = r"""
with recursive
crc_steps as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) r(i)),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from documents, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) u(run) group by all),
named as (select run, n, concat(doc_id::varchar, ':', run) as name from runs where length(run) >= 6),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(list_transform(string_split(name, ''), lambda ch: unicode(ch)::bigint), lambda p: case when p < 128 then [p] else [192 + (p >> 6), 128 + (p & 63)] end))),
                                 lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) as h from named, crc_steps),
words as (
  select word, sum(n)::bigint as n
  from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
holes as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) u(i)),
pairs as (
  select a.word, b.word as near, b.n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select h.word, w.word, w.n from holes h join words w on h.rest = w.word
  union
  select w.word, h.word, h.n from holes h join words w on h.rest = w.word),
best as (select word, count(*) as n_near, max(n) as near_n, arg_min(near, (-n, near)) as near from pairs group by word),
found as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 5 * w.n then b.near end as form, case when b.near_n >= 5 * w.n then b.near_n end as form_n
  from words w left join best b using (word)),
ways(word, place) as (select word, word from found union all select ways.word, f.form from ways join found f on f.word = ways.place where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, w.place as root
from found f join ways w using (word) join found e on e.word = w.place where e.form is null"""

CRC_STEPS = "select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) r(i)"

#: The network round by round: a number goes on after six rounds as long as it lies outside.
SHARD_SQL = rf"""
with recursive
crc_steps as ({CRC_STEPS}),
given as (select doc_id, coalesce(text, '') as text from documents),
hashed as (
  select doc_id, (octet_length(encode(text)) + 16)::bigint as size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32 from given, crc_steps),
numbered as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_number from hashed),
sizes as (select n, a, (n + a - 1) // a as b from (select count(*) as n, floor(sqrt(greatest(count(*) - 1, 0)))::bigint + 1 as a from given)),
keys as (select {shard.round_keys(shard.SEED)} as keys),
net(row_number, i, l, r) as (
  select row_number, 0, row_number // b, row_number % b from numbered, sizes
  union all
  select row_number, i + 1, case when i % 2 = 0 then (l + ((r % {shard.P1} + keys[i % 6 + 1]) % {shard.P1} * {shard.M1} % {shard.P1} + 1) * {shard.M2} % {shard.P2}) % a else l end,
         case when i % 2 = 1 then (r + ((l % {shard.P1} + keys[i % 6 + 1]) % {shard.P1} * {shard.M1} % {shard.P1} + 1) * {shard.M2} % {shard.P2}) % b else r end
  from net, sizes, keys where i = 0 or i % 6 > 0 or l * b + r >= n),
placed as (select row_number, l * b + r as place from net, sizes where i > 0 and i % 6 = 0 and l * b + r < n)
select doc_id, size, text_crc32, 'rows' as law, (place % 40)::int as shard, (place // 40)::bigint as slot, null::int as grown_shard, row_number
from numbered join placed using (row_number)"""

#: Where a pattern of the operator looks around, the runs it must not begin or end in are fenced by two private characters first.
_FENCED = r"regexp_replace(text, '([{0}]+)', chr(57344) || '\1' || chr(57345), 'g')"
_LETTERS, _DASHED = _FENCED.format("A-Za-z0-9"), _FENCED.format("0-9A-Za-z-")
_PROPOSED = {
    "email": ("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("text", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
           "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as bigint), 0) > 255)) = 0"),
    "card": ("text", r"[0-9](?:[\x20-]?[0-9])+",
             "list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then substr(digits, -i, 1)::int"
             " when substr(digits, -i, 1)::int > 4 then substr(digits, -i, 1)::int * 2 - 9 else substr(digits, -i, 1)::int * 2 end)) % 10 = 0"),
    "phone": ("text", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 10 and 15"),
    "iban": (_LETTERS, r"\x{E000}[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}\x{E001}|\x{E001}(?:\x20\x{E000}[A-Z0-9]{4}\x{E001}){2,7}(?:\x20\x{E000}[A-Z0-9]{1,3}\x{E001})?)",
             "length(replace(hit, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(substr(replace(hit, ' ', ''), 5)"
             " || left(replace(hit, ' ', ''), 4), ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end)),"
             " lambda r, v: case when v >= 10 then (r * 100 + v) % 97 else (r * 10 + v) % 97 end) = 1"),
    "national": (_DASHED, r"\x{E000}[0-9]{3}-[0-9]{2}-[0-9]{4}\x{E001}", "true"),
}


def _proposals(rank: int, kind: pii.Kind) -> str:
    text, pattern, valid = _PROPOSED[kind.name]
    among = "length(digits) between 14 and 19" if kind.name == "card" else "true"
    return rf"""
  select * from (
    select rid, {rank} as rank, '{kind.name}' as kind, start, start + length(hit) as stop, {kind.score} as worth, '(?:^|[^a-z])(?:{kind.near})' as near,
           '(?:^|[^a-z])(?:{kind.against})' as against, {str(kind.base).lower()} as base, {valid} as valid,
           substr(text, greatest(start - {pii.CONTEXT}, coalesce(lag(start + length(hit)) over w, 0)) + 1,
                  start - greatest(start - {pii.CONTEXT}, coalesce(lag(start + length(hit)) over w, 0))) as before,
           substr(text, start + length(hit) + 1, least({pii.CONTEXT}, coalesce(lead(start) over w, length(text)) - start - length(hit))) as after
    from (select *, regexp_replace(hit, '[^0-9]', '', 'g') as digits from (
      select rid, text, i, hit, (sum(length(piece) + length(hit)) over (partition by rid order by i) - length(hit))::bigint as start from (
        select rid, text, i, regexp_replace(hits[i], '[\x{{E000}}\x{{E001}}]', '', 'g') as hit, regexp_replace(pieces[i], '[\x{{E000}}\x{{E001}}]', '', 'g') as piece
        from (select rid, text, regexp_extract_all({text}, '{pattern}') as hits, string_split_regex({text}, '{pattern}') as pieces from given), unnest(range(1, len(hits) + 1)) u(i))))
    where {among} window w as (partition by rid order by start)) where valid"""


PII_SQL = f"""
with given as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
proposed as ({" union all ".join(_proposals(i, k) for i, k in enumerate(pii.KINDS))}),
scored as (
  select *, least(100, worth + case when regexp_matches(lower(before || ' ' || after), near) then 20 else 0 end
                  - case when regexp_matches(lower(before || ' ' || after), against) then 30 else 0 end) as score from proposed),
kept as (select *, concat(kind, ':', start::bigint, ':', stop::bigint) as shown from scored where base or score >= {pii.KEEP}),
told as (
  select rid, {", ".join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in pii.KINDS)}, max(score)::int as top_score,
         string_agg(shown, ',' order by start, rank, stop) filter (base) as base, string_agg(shown, ',' order by start, rank, stop) as spans from kept group by rid)
select doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in pii.KINDS[:4])}, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, top_score, {", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in pii.KINDS[4:])}
from given left join told using (rid)"""
