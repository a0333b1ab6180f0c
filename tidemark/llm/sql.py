"""SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from tidemark.functions.identity import PLACEHOLDERS

_HELD = ", ".join(f"'{p.replace(' ', '')}'" for p in PLACEHOLDERS)

LISTINGS = rf"""with recursive
 ids as (select posting_no, lower(regexp_replace(x, '[\s\p{{Z}}]+', '', 'g')) as key from (select posting_no, unnest(list_concat([job_id], coalesce(aliases, []))) as x from postings)),
 bare as (select posting_no, regexp_replace(regexp_replace(url, '[\s\p{{Z}}]+', '', 'g'), '(?i)^(?:[a-z][a-z0-9+.-]*:)?//', '') as b from postings where url is not null),
 parts as (select posting_no, b, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?#]*)', 1)), '^[^@]*@|:\d*$|\.$', '', 'g'), '^(?:(?:www\d?|m|mobile)\.)+', '') as host,
  regexp_replace(regexp_replace(regexp_extract(b, '^[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') as path, regexp_extract(b, '^[^?#]*\?([^#]*)', 1) as q from bare),
 ruled as (select p.*, listing_key as rule from parts p left join platforms f on lower(f.host) = p.host),
 pieces as (select posting_no, host, case when rule is null or rule = 'whole path' then case when regexp_matches(path, '\d{{4}}') then path end when rule = 'number ending the path' then regexp_extract(path, '(\d+)$', 1)
  else regexp_extract('&' || q, '(?i)[&;]' || regexp_extract(rule, '^parameter (\S+)$', 1) || '=([^&;]*)', 1) end as piece from ruled),
 keys as (select posting_no, key from ids where key is not null and key not in ({_HELD}) union select posting_no, 'url|' || host || '|' || piece from pieces where host <> '' and piece <> ''),
 stars as (select distinct posting_no as a, min(posting_no) over (partition by key) as b from keys),
 edges as (select a, b from stars where a <> b union select b, a from stars where a <> b),
 reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
 roots as (select a, least(a, min(b)) as root from reach group by a)
 select root as accepted_no, a as posting_no from roots where root <> a"""

REPOSTS = r"""with d as (select posting_no, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, company, description)), '[\p{L}\p{Nd}]+')) as ws from postings
  where description is not null and len(regexp_extract_all(lower(description), '[\p{L}\p{Nd}]+')) >= 40),
 w as (select posting_no, len(ws) as n, unnest(ws) as word from d),
 c as (select x.posting_no as a, y.posting_no as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as shared from w x join w y on x.word = y.word and x.posting_no < y.posting_no group by all)
 select a as posting_no_a, b as posting_no_b from c where shared >= 0.7 * (na + nb - shared) - 1e-9"""

_GROUPED = LISTINGS.rsplit("\n", 1)[0]

SURVIVORS = rf"""{_GROUPED},
 members as (select a as posting_no, root as g from roots union select root, root from roots),
 rows as (select m.g, p.*, case description_status when 'full' then 4 when 'snippet' then 3 when 'fetch_failed' then 2 when 'missing' then 1 else 0 end as st, length(coalesce(description, '')) as sz,
  regexp_matches(coalesce(posted_at, ''), '\d') and not regexp_matches(posted_at, '^0000|\+ days ago') as dated, coalesce(t.trust_rank, (select trust_rank from date_sources where date_source = 'unknown')) as tr
  from members m join postings p using (posting_no) left join date_sources t on t.date_source = coalesce(p.date_source, 'unknown')),
 d as (select g, arg_max(posting_no, (st, sz, last_seen_at, posting_no)) as no, arg_max(sz, (st, sz, last_seen_at, posting_no)) as sz from rows group by g),
 t as (select g, arg_max(posting_no, (-tr, last_seen_at, posting_no)) as no from rows where dated group by g)
 select g as accepted_no, 'description' as field, no::varchar as surviving from d where sz > 0 union all select g, 'posted_at', no::varchar from t union all
 select distinct g, 'alias', key from members join ids using (posting_no) where key is not null and key not in ({_HELD}) union all
 select distinct g, 'source_url', u from (select g, unnest(source_urls) as u from rows) where u is not null"""

SQL = {"p2_found": LISTINGS, "p3_found": REPOSTS, "p5_found": SURVIVORS}
