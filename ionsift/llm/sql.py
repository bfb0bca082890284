"""SQL that gives the rows of those queries that SQL can express, for an engine with list functions and lambdas.

The other queries rest on tokenizers, XXH64, a fitted model or a file format;
the tests hold them against brute-force versions and exact round trips.
"""

from __future__ import annotations

from .host_quality import SYMBOLS
from .source_mix import MOST, SHARE, WEIGHTS

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ODD = "0123456789#*$%&|<>{}[]_=+~^\\"

OP1 = f"""
with d as (select doc_id, source, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '{WORD}') as w from d),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from (select r, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from w)),
c as (select r, i, count(*) over (partition by r, gram) as n from g),
p as (select r, count(distinct i + k) as n_repeat_words from c, (values (0), (1), (2)) o(k) where n > 1 group by r),
l as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from d) where length(translate(line, {SPACES}, '')) > 0 group by r),
b as (select doc_id, source, len(w) as n_words, length(translate(t, {SPACES}, '')) as word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join p using (r) left join l using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
h as (select source, count(*) as n, count(*) filter (where base_failed) as k from f where source is not null group by 1),
s as (select count(*) as h, sum(n) as n, sum(k) as k, sum(n * n * 1.0) as nn, sum(k * 1.0 * k / n) as kk, sum(k) / sum(n) as m from h),
v as (select n, m, n - nn / n - (h - 1) as room, kk - k * m - (h - 1) * m * (1 - m) as spread from s),
q as (select m, case when room > 0 and spread > 0 then least(1e6, greatest(1.0, m * (1 - m) / (spread / room) - 1)) else 1e6 end as strength from v),
e as (select source, h.n as n, (k + m * strength) / (h.n + strength) as rate, strength from h, q),
x as (select source, round(rate, 6) as host_rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) >= 0.5 as host_rejected from e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, coalesce(host_rejected, false) as host_rejected,
  not base_failed and not coalesce(host_rejected, false) as kept from f left join x using (source)
"""

_WEIGHTS = "[" + ", ".join(f"{w}.0" for w in WEIGHTS) + "]"
OP3 = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
k as (select doc_id, source, len(regexp_extract_all(t, '{WORD}')) as size,
  -ln((cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(t)), 1, 13) as bigint) + 0.5) / 4503599627370496.0)
  / (0.5 + 0.5 * (1 - (length(t) - length(translate(t, '{ODD}', ''))) / greatest(length(t), 1))) as ky from d),
s as (select source, sum(size) as source_size from k group by 1),
w as (select *, ({_WEIGHTS})[(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as w, {MOST}.0 * source_size as lim from s),
o as (select *, row_number() over (order by lim / w, source nulls last) as n, sum(source_size) over () * {SHARE} as budget, sum(w) over () as all_w from w),
l as (select *, (budget - coalesce(sum(lim) over (order by n rows between unbounded preceding and 1 preceding), 0)) as lft,
  (all_w - coalesce(sum(w) over (order by n rows between unbounded preceding and 1 preceding), 0)) as opn from o),
v as (select *, first_value(case when not lim < lft * w / opn then lft / opn end ignore nulls) over (order by n rows between unbounded preceding and unbounded following) as level from l),
t as (select source, source_size, cast(least(lim, coalesce(level, 'inf'::double) * w) as double) as target from v),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
q as (select k.doc_id, k.size, p.*, cast(floor(target) as bigint) - epochs * source_size as budget, sum(k.size) over (partition by k.source, k.ky) as tied, count(*) over (partition by k.source, k.ky) as ties, row_number() over (partition by k.source, k.ky) as place,
  sum(k.size) over (partition by k.source order by k.ky range between unbounded preceding and current row) as upto from k join p on k.source is not distinct from p.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(epochs * size + case when upto <= budget then size when upto - tied < budget then (budget - (upto - tied)) // ties + (place <= (budget - (upto - tied)) % ties)::int else 0 end as bigint) as taken from q
"""

OP8 = """
with p as (select page_id, coalesce(html, '') as h, count(*) over (partition by coalesce(html, '')) as n, min(page_id) over (partition by coalesce(html, '')) as f from pages),
r as (select *, n > 1 and f is not null and f is distinct from page_id as again, sha1(h) as x from p),
b as (select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(x, i * 5 + 1, 5) as bigint)) as v from r)
select page_id, strlen(h) as payload_bytes,
  array_to_string(list_transform(v, lambda c: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(c >> 15) % 32 + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(c >> 10) % 32 + 1]
  || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(c >> 5) % 32 + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[c % 32 + 1]), '') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then f end as refers_to from b
"""

OP9 = """
with recursive bits(i, k, c) as (select i, 0, i from range(256) g(i) union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
d as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + 1 as size from documents),
h as (select doc_id, size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: cast('0x' || b as bigint)) as bytes from d),
c as (select doc_id, size, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b: xor(c >> 8, tab[xor(c % 256, b) + 1])), 4294967295) as text_crc32 from h, tab),
s as (select *, sum(size) over (order by doc_id nulls last, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as total from c),
p as (select *, cast(least(15, (2 * upto - size) * 16 // (2 * total)) as int) as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id nulls last, text_crc32, size) - 1 as slot, cast(null as int) as grown_shard from p
"""

ORACLE_SQL = {"op1_host_quality": OP1, "op3_source_mix": OP3, "op8_warc": OP8, "op9_prefix_shards": OP9}
