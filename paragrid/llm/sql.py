"""DuckDB SQL for the queries that SQL can express."""

from paragrid.llm.common import LOWER, UPPER
from paragrid.llm.url_filter import SECOND_LEVEL, SUFFIXES


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

URL_FILTER_SQL = rf"""
with p as (
  select page_id, {_LOWER.format("coalesce(regexp_extract(url, '^[^:]*(?::[^/][^:]*|:/[^/][^:]*)*?://([^/?#]*)', 1), '')")} as host,
         coalesce(regexp_extract(url, '^[^:]*(?::[^/][^:]*|:/[^/][^:]*)*?://[^/?#]*([^?#]*)', 1), '') as path,
         try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint) as key
  from pages),
l as (select doc_id as key, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels group by 1),
j as (select p.host, l.bad from p left join l using (key)),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad, regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '') as name, string_split(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '.') as parts from j group by host),
h1 as (select host, n, bad, case when regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') then name when len(parts) > 2 and ((length(parts[-1]) = 2 and parts[-2] in {_listed(SECOND_LEVEL)}) or array_to_string(parts[-2:], '.') in {_listed(SUFFIXES)})
              then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain, case when regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') then name else regexp_replace(domain, '^[^.]*\.', '') end as suffix from h0),
d0 as (select suffix, domain, sum(n) as n, sum(bad) as bad from h1 group by all),
s0 as (select suffix, sum(n) as n, sum(bad) as bad from d0 group by all),
s1 as (select *, (select (count(case when n > 0 then 1 end) * coalesce(sum(bad) / sum(n), 0.0) + 0.5) / (count(case when n > 0 then 1 end) + 1) from s0) as mean, (select count(case when n > 0 then 1 end) + 1.0 from s0) as most from s0),
sk as (select coalesce(greatest(1.0, least(1000.0, sum(n * mean * (1 - mean)) / greatest(sum(case when n > 0 then pow(bad - n * mean, 2) / n else 0 end) - sum(case when n > 0 then mean * (1 - mean) else 0 end), 1e-6 * sum(n)) - 1)), 1.0) as k from s1),
s2 as (select suffix, (bad + least(k, most) * mean) / (n + least(k, most)) as rate, n + least(k, most) as total from s1, sk),
d1 as (select d0.*, s2.rate as mean, s2.total as most from d0 join s2 using (suffix)),
dk as (select coalesce(greatest(1.0, least(1000.0, sum(n * mean * (1 - mean)) / greatest(sum(case when n > 0 then pow(bad - n * mean, 2) / n else 0 end) - sum(case when n > 0 then mean * (1 - mean) else 0 end), 1e-6 * sum(n)) - 1)), 1.0) as k from d1),
d2 as (select domain, (bad + least(k, most) * mean) / (n + least(k, most)) as rate, n + least(k, most) as total from d1, dk),
g1 as (select h1.*, d2.rate as mean, d2.total as most from h1 join d2 using (domain)),
gk as (select coalesce(greatest(1.0, least(1000.0, sum(n * mean * (1 - mean)) / greatest(sum(case when n > 0 then pow(bad - n * mean, 2) / n else 0 end) - sum(case when n > 0 then mean * (1 - mean) else 0 end), 1e-6 * sum(n)) - 1)), 1.0) as k from g1),
g2 as (select host, n + least(k, most) as total, (bad + least(k, most) * mean) / (n + least(k, most)) as rate from g1, gk),
g3 as (select host, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) as low from g2),
f as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from p)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when low > 0.5 then 'block' else 'allow' end as verdict
from f left join g3 using (host)
"""

LINE_DEDUP_SQL = rf"""
with l as (select doc_id, rn, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i
           from (select doc_id, coalesce(text, '') as t, row_number() over () as rn from documents)),
k as (select *, {_LOWER.format(f"trim(line, {_SPACE})")} as key from l),
c as (select key from k where key <> '' group by key having count(distinct rn) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from k left join c using (key) group by rn
"""

HOST_QUALITY_SQL = r"""
with t as (select doc_id, source, coalesce(text, '') as text, row_number() over () as rn from documents),
w as (select rn, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
u as (select rn, unnest(words) as word, generate_subscripts(words, 1) as i from w),
v as (select rn, i, case when lead(word, 4) over o is not null then concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) end as win
      from u window o as (partition by rn order by i)),
r as (select rn, i, case when win is not null and count(*) over (partition by rn, win) > 1 then 1 else 0 end as rep from v),
x as (select rn, max(rep) over (partition by rn order by i rows between 4 preceding and current row) as cov from r),
y as (select rn, sum(cov)::bigint as n_repeat_words from x group by rn),
s as (select rn, unnest(string_split(text, chr(10))) as line from t),
d as (select rn, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from s where regexp_matches(line, '[^\x20\x09-\x0D]') group by rn),
m as (select w.rn, doc_id, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines
      from w left join y using (rn) left join d using (rn)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
f as (select *, base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as failed from b),
h as (select source, count(*) as n, sum(failed::int) as bad from f group by source),
g as (select sum(bad) / sum(n) as mean, count(*) as groups, sum(n) as total, sum(bad * bad / n) as square from h),
k as (select mean, greatest(1.0, least(1000.0, mean * (1 - mean) / greatest((square - total * mean * mean - groups * mean * (1 - mean)) / total, 1e-6) - 1)) as k from g),
p as (select source, n + k as total, (bad + k * mean) / (n + k) as rate from h, k),
z as (select source, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 as rejected from p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from f join z on f.source is not distinct from z.source
"""

HARD_NEGATIVES_SQL = r"""
with e as (
  select row_number() over () as u, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
c as (select u, id, unnest(v) as x, generate_subscripts(v, 1) as i from e),
s as (select a.u as a, b.u as b, cast(sum(a.x * b.x) as bigint) as score from c a join c b using (i) where a.id % 50 = 0 group by all),
m as (select s.a, s.b, s.score, ea.id as anchor_id, eb.id, ea.label = eb.label as same from s join e ea on ea.u = s.a join e eb on eb.u = s.b),
p as (select *, row_number() over (partition by a order by score desc, id, b) as r from m where same and a <> b qualify r <= 5),
n as (select p.anchor_id, p.id as positive_id, m.id as negative_id, p.score as positive_score, m.score as negative_score,
             row_number() over (partition by p.a, p.b order by m.score desc, m.id, m.b) as rank
      from p join m on m.a = p.a and not m.same and 100 * m.score between 50 * p.score and 95 * p.score qualify rank <= 3)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH_SQL = rf"""
with d as (select row_number() over () as rn, doc_id, {_TERMS} as words from documents),
n as (select rn, doc_id, len(words) as n from d where len(words) > 0),
t as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from n),
m as (select rn, doc_id, 100 - 25 + (25 * n * n_docs) // n_terms as m from n, t),
p as (select rn, term, count(*) as tf from (select rn, unnest(words) as term from d) group by all),
f as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, t group by term, n_docs),
i as (select q, item_id, unnest(words) as term from (select row_number() over () as q, item_id, {_TERMS} as words from benchmark)),
s as (select q, any_value(item_id) as item_id, rn, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from i join f using (term) join p using (term) join m using (rn) group by q, rn having score > 0)
select item_id, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as int) as rank, doc_id, score from s
qualify rank <= 20
"""
