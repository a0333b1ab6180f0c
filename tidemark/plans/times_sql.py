"""SQL of p1_found: another reading of the same rules, with the other engine's calendar and zones.

A value is cut into its date and the rest; the rest is a clock with a zone or nothing. Words and
offsets are stated here again, so that a mistake in the operator's cascade shows as a difference.
"""

from __future__ import annotations

_FIELDS = ("date_posted", "posted_at", "expires_at", "first_seen_at")
# Beginnings of month words by language; the whole word is checked below.
_MONTH = """case when regexp_matches(m, '^(jan(uary?|v(ier)?)?|jänner|ene(ro)?)$') then 1 when regexp_matches(m, '^(feb(ruary?|rero)?|févr(ier)?)$') then 2 when regexp_matches(m, '^(mar(ch|zo|s)?|märz?|mrz)$') then 3
 when regexp_matches(m, '^(apr(il)?|abr(il)?|avr(il)?)$') then 4 when regexp_matches(m, '^(mayo?|mai)$') then 5 when regexp_matches(m, '^(jun(e|io?)?|juin)$') then 6 when regexp_matches(m, '^(jul(y|io?)?|juil(let)?)$') then 7
 when regexp_matches(m, '^(aug(ust)?|ago(sto)?|août)$') then 8 when regexp_matches(m, '^(sep(t|tember|tiembre|tembre)?|set(iembre)?)$') then 9 when regexp_matches(m, '^(oct(ober|ubre|obre)?|okt(ober)?)$') then 10
 when regexp_matches(m, '^nov(ember|iembre|embre)?$') then 11 when regexp_matches(m, '^(dec(ember)?|dez(ember)?|dic(iembre)?|déc(embre)?)$') then 12 end"""
_WEEKDAY = (
    "(?:(?:mon|tues?|wednes|thu(?:rs?)?|fri|satur|sun)(?:day)?|wed|sat|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonnabend|sonntag|mo|di|mi|do|fr|sa|so|lunes|lun|martes|miércoles|mié|jueves|jue|viernes|vie|"
    "sábado|sáb|domingo|dom|lundi|mardi|mercredi|mer|jeudi|jeu|vendredi|ven|samedi|sam|dimanche|dim)[.]?,? "
)
# Minutes east of UTC that an abbreviation means, in Australia and elsewhere.
_MINUTES = """case when starts_with(zone, 'Australia/') and z in ('EST', 'AEST') then 600 when starts_with(zone, 'Australia/') and z in ('EDT', 'AEDT') then 660 when starts_with(zone, 'Australia/') and z = 'CST' then 570 when starts_with(zone, 'Australia/') and z = 'CDT' then 630
 when zone = 'Europe/Dublin' and z = 'IST' then 60 when zone = 'Asia/Jerusalem' and z = 'IST' then 120 when zone = 'Asia/Dhaka' and z = 'BST' then 360 when zone = 'Asia/Manila' and z = 'PST' then 480 when zone = 'Asia/Shanghai' and z = 'CST' then 480
 when z in ('UTC', 'GMT', 'Z', 'UT', 'WET') then 0 when z in ('WEST', 'BST', 'CET', 'MEZ') then 60 when z in ('CEST', 'MESZ', 'EET') then 120 when z = 'EEST' then 180 when z = 'PKT' then 300 when z = 'IST' then 330 when z = 'AEST' then 600 when z = 'AEDT' then 660
 when z = 'ACST' then 570 when z = 'ACDT' then 630 when z = 'AWST' then 480 when z = 'EST' then -300 when z = 'EDT' then -240 when z = 'CST' then -360 when z = 'CDT' then -300 when z = 'MST' then -420 when z = 'MDT' then -360 when z = 'PST' then -480 when z = 'PDT' then -420 end"""
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?: ?([AaPp])[.]?[Mm][.]?)?(?: Uhr)?"
_ZONE = r"(?: ?(Z|[+-][0-9]{2}(?::?[0-9]{2})?|(?:UTC|GMT)[+-][0-9]{1,2}(?::?[0-9]{2})?|[A-Z]{1,5}|[A-Z][A-Za-z_]+/[A-Za-z_/]+)(?:\[[^\]]+\])?)?"
_NAMES = "['shape', 'a', 'm', 'c', 'rest']"

FOUND = rf"""with long as (select posting_no, captured_at, local_zone as zone, date_order as ord, u.field as field, trim(regexp_replace(u.value, '[\s\x{{00A0}}]+', ' ', 'g')) as v
  from postings p left join platforms l on lower(trim(p.platform)) = lower(trim(l.platform)), lateral (select unnest([{', '.join(f"{{'field': '{f}', 'value': {f}}}" for f in _FIELDS)}]) as u)
  where u.value is not null and not regexp_matches(u.value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$')),
 bare as (select *, regexp_replace(v, '(?i)^{_WEEKDAY}', '') as d from long),
 cut as (select *, case when regexp_matches(v, '^[0-9]{{4}}[-/.][0-9]') then 'ymd' when regexp_matches(v, '^(19|20)[0-9]{{6}}(T?[0-9]{{4}}([0-9]{{2}})?.{{0,60}})?$') then 'compact'
   when regexp_matches(d, '^[0-9]{{1,2}}(?:[.]|st|nd|rd|th)?[ -](?:de )?[^\s0-9.,-]{{3,10}}[.]?,?[ -](?:de )?[0-9]{{4}}') then 'dmy name' when regexp_matches(d, '^[^\s0-9.,-]{{3,10}}[.]? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}') then 'mdy name'
   when regexp_matches(v, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]') then 'numbers' end as shape from bare),
 parts as (select *, case shape when 'ymd' then regexp_extract(v, '^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})(.*)$', ['a', 'b', 'c', 'rest'])
   when 'compact' then regexp_extract(v, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(.*)$', ['a', 'b', 'c', 'rest'])
   when 'dmy name' then regexp_extract(d, '^([0-9]{{1,2}})(?:[.]|st|nd|rd|th)?[ -](?:de )?([^\s0-9.,-]{{3,10}})[.]?,?[ -](?:de )?([0-9]{{4}})(.*)$', ['a', 'b', 'c', 'rest'])
   when 'mdy name' then regexp_extract(d, '^([^\s0-9.,-]{{3,10}})[.]? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})(.*)$', ['a', 'b', 'c', 'rest'])
   when 'numbers' then regexp_extract(v, '^([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-]([0-9]{{4}}|[0-9]{{2}})(.*)$', ['a', 'b', 'c', 'rest']) end as x from cut where shape is not null),
 clocked as (select *, lower(case shape when 'dmy name' then x.b when 'mdy name' then x.a else '' end) as m, case when shape = 'numbers' and ord = 'ymd' and length(x.c) = 4 then 'dmy' else ord end as rule,
   case when shape = 'compact' and x.rest <> '' then regexp_replace(x.rest, '^T?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?', '\1:\2:\3')
    else regexp_replace(x.rest, case when shape = 'ymd' then '^[T ]' when shape = 'dmy name' then '^,? (at |um |a las )?' when shape = 'mdy name' then '^,? (at )?' else '^,? ' end, '') end as time from parts),
 timed as (select *, x.rest = '' as bare_date, regexp_extract(case when shape = 'compact' then regexp_replace(time, '^([0-9]+:[0-9]+):(?:$|([^0-9]))', '\1\2') else time end, '^{_CLOCK}{_ZONE}$', ['h', 'mi', 's', 'f', 'ap', 'z']) as t,
   regexp_matches(case when shape = 'compact' then regexp_replace(time, '^([0-9]+:[0-9]+):(?:$|([^0-9]))', '\1\2') else time end, '^{_CLOCK}{_ZONE}$') as clock from clocked),
 dated as (select *, coalesce(t.z, '') as z, case when shape in ('ymd', 'compact') or rule = 'ymd' and shape = 'numbers' then x.a else x.c end as y,
   case when shape in ('ymd', 'compact') then try_cast(x.b as integer) when m <> '' then {_MONTH} when rule in ('dmy', 'ymd') then try_cast(x.b as integer) when rule = 'mdy' then try_cast(x.a as integer) end as mo,
   try_cast(case when shape in ('ymd', 'compact') then x.c when shape = 'dmy name' then x.a when shape = 'mdy name' then x.b when rule = 'ymd' then x.c when rule = 'mdy' then x.b when rule = 'dmy' then x.a end as integer) as day from timed where bare_date or clock),
 walls as (select *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', case when try_cast(y as integer) < 70 then try_cast(y as integer) + 2000 when try_cast(y as integer) < 100 then try_cast(y as integer) + 1900 else try_cast(y as integer) end, mo, day,
    case when bare_date then 0 when t.ap = '' then try_cast(t.h as integer) when try_cast(t.h as integer) between 1 and 12 then try_cast(t.h as integer) % 12 + case when lower(t.ap) = 'p' then 12 else 0 end end,
    case when bare_date then 0 else try_cast(t.mi as integer) end, case when bare_date or t.s = '' then 0 else try_cast(t.s as integer) end) as timestamp) as wall,
   case when bare_date or t.f = '' then 0 else try_cast(rpad(left(t.f, 6), 6, '0') as bigint) end as us, case when bare_date or z = '' then zone when contains(z, '/') then z end as region, replace(regexp_replace(z, '^(UTC|GMT)([+-])', '\2'), ':', '') as off from dated),
 local as (select *, timezone(region, wall) as late from walls),
 instants as (select posting_no, field, case when region is not null then epoch_us(case when timezone(region, late - interval 1 hour) = wall then late - interval 1 hour else late end)
   when regexp_matches(off, '^[+-]') then epoch_us(wall) - (case when left(off, 1) = '-' then -60000000 else 60000000 end) * (case when length(off) <= 3 then try_cast(substr(off, 2) as bigint) * 60 else (try_cast(substr(off, 2) as bigint) // 100) * 60 + try_cast(substr(off, 2) as bigint) % 100 end)
   else epoch_us(wall) - ({_MINUTES})::bigint * 60000000 end + us as utc_us from local),
 counted as (select posting_no, field, try_cast(v as bigint) * case length(v) when 10 then 1000000 when 13 then 1000 else 1 end as utc_us from long where regexp_matches(v, '^([0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}})$')
  union all select posting_no, field, round(try_cast(v as decimal(28, 9)) * 1000000)::bigint from long where regexp_matches(v, '^[0-9]{{10}}[.][0-9]{{1,6}}$')
  union all select posting_no, field, try_cast(left(v, 17) as decimal(18, 6))::decimal(28, 6) * 1000000 from long where regexp_matches(v, '^[0-9]{{10}}[.][0-9]{{7,9}}$')
  union all select posting_no, field, epoch_us(captured_at) - coalesce(try_cast(a.n as bigint), 1) * case left(a.u, 1) when 'h' then 3600000000 when 'd' then 86400000000 when 'w' then 604800000000 else 60000000 end
   from (select *, regexp_extract(lower(v), '^(?:posted |about )?([0-9]{{1,5}}|an?|one) ?(h|hrs?|hours?|d|days?|w|wks?|weeks?|m|mins?|minutes?) ago$', ['n', 'u']) as a from long) where a.u <> '')
 select posting_no, field, utc_us::bigint as utc_us from instants where utc_us is not null union all select posting_no, field, utc_us::bigint from counted where utc_us is not null"""
