"""The reference-equivalent operators as queries over the whole domain tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import adapters, extract, markup, text
from tidemark.operators import identity, metrics, ranking, reconcile, rules, state
from tidemark.plans import pipeline, settings
from tidemark.storage import register, shared_dir, table
from tidemark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The fixed clock of all queries.
NOW = "2026-08-01 00:00:00"
_SPACE = r"[\s\p{Z}]"


def _now():
    return F.lit(NOW).cast("timestamp")


def query(name: str, *tables: str, sql: str | None = None):
    """Register a query over whole tables."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            SQL[name] = sql
        return build

    return register


def _us(column):
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def _clean(column: str) -> str:
    """SQL of text.clean_text."""
    bare = f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"(case when {column} is null or lower({bare}) in ('nan','nat','none','<na>','null') then '' else {bare} end)"


def _norm(column: str) -> str:
    """SQL of text.normalized."""
    return f"trim(regexp_replace(strip_accents(lower({_clean(column)})), '{_SPACE}+', ' ', 'g'))"


# --- scalar normalisers ---------------------------------------------------------------------------


@query(
    "q_clean_tokens", "postings",
    sql=f"""select posting_no, {_clean('posted_at')} as posted_at, case when isfinite(try_cast({_clean('posted_at')} as double)) then try_cast({_clean('posted_at')} as double) end as number,
    case when lower({_clean('salary_text')}) in ('true','1','yes') then true when lower({_clean('salary_text')}) in ('false','0','no') then false end as flag from postings""",
)
def clean_tokens(p):
    return p.select("posting_no", text.clean_text(F.col("posted_at")).alias("posted_at"), text.optional_number(F.col("posted_at")).alias("number"), text.optional_bool(F.col("salary_text")).alias("flag"))


@query("q_normalize_text", "postings", sql=f"select posting_no, {_norm('title')} as title, {_norm('location')} as location from postings")
def normalize_text(p):
    return p.select("posting_no", text.normalized(F.col("title")).alias("title"), text.normalized(F.col("location")).alias("location"))


_URL_SQL = f"""with t as (select posting_no, {_clean('url')} as u from postings),
 s as (select posting_no, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(u, '^[^:]+://([^/?#]*)', 1) as auth,
  regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) as q from t),
 h as (select *, lower(regexp_extract(auth, '^([^:@]+)(?::\\d*)?$', 1)) as host, regexp_extract(auth, ':(\\d+)$', 1) as port from s),
 k as (select *, list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(string_split(x, '=')[1]), 'utm_') and lower(string_split(x, '=')[1]) not in ('trk','trackingid','refid')) as kept from h)
 select posting_no, case when scheme in ('http','https') and host <> '' and not regexp_matches(u, '{_SPACE}') then
  'https://' || host || case when port in ('','80','443') then '' else ':' || port end || case when path = '' then '/' else path end ||
  case when len(kept) = 0 then '' else '?' || array_to_string(list_sort(list_transform(kept, lambda x: case when contains(x, '=') then x else x || '=' end)), '&') end end as url from k"""


@query("q_canonical_url", "postings", sql=_URL_SQL)
def canonical_urls(p):
    return p.select("posting_no", text.canonical_url(F.col("url")).alias("url"))


@query(
    "q_host_allowed", "postings",
    sql="""with h as (select posting_no, url, coalesce(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@|:\\d*$', '', 'g')), '') as host from postings)
    select posting_no, host, url is not null and regexp_matches(url, '(?i)^https?://') and (host in ('jobmoor.example','talentbay.example') or ends_with(host, '.jobmoor.example') or ends_with(host, '.talentbay.example')) as allowed from h""",
)
def hosts(p):
    return p.select("posting_no", F.coalesce(text.url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(text.host_allowed(F.col("url"), ["jobmoor.example", "talentbay.example"]), F.lit(False)).alias("allowed"))


@query(
    "q_stable_ids", "postings",
    sql=f"""select posting_no, regexp_replace(lower(coalesce(platform,'')), '[^a-z0-9]', '', 'g') || ':' || left(sha256(case when coalesce(source_id,'') <> '' then source_id else coalesce(url,'') end), 24) as stable_id,
    left(sha256(lower(coalesce(platform,'')) || '_' || lower(coalesce(title,'')) || '_' || lower(coalesce(company,'')) || '_' || regexp_replace(coalesce(url,''), '^{_SPACE}+|{_SPACE}+$', '', 'g')), 16) as legacy_id,
    search_track || ':' || left(sha256(coalesce(query_id,'')), 20) as query_key, coalesce(regexp_full_match(source_id, '[0-9]{{1,22}}'), false) as numeric_id from postings""",
)
def ids(p):
    c = F.col
    return p.select(
        "posting_no", text.stable_id(c("platform"), c("source_id"), c("url")).alias("stable_id"), text.legacy_id(c("title"), c("company"), c("url"), c("platform")).alias("legacy_id"),
        text.query_key(c("search_track"), c("query_id")).alias("query_key"), text.snowflake(c("source_id")).alias("numeric_id"),
    )


@query(
    "q_work_mode", "postings",
    sql=f"""with n as (select posting_no, is_remote, {_norm("coalesce(title,'') || ' ' || coalesce(location,'')")} as heading, {_norm('description')} as body from postings)
    select posting_no, case when regexp_matches(heading || ' ' || body, '{text.NOT_REMOTE}') then 'on_site' when regexp_matches(heading || ' ' || body, '\\bhybrid\\b') then 'hybrid' when is_remote = false then 'on_site'
    when is_remote or regexp_matches(heading, '\\bremote\\b') or regexp_matches(body, '{text.REMOTE_ROLE}') then 'remote' when regexp_matches(heading || ' ' || body, '{text.ON_SITE}') then 'on_site' else 'unknown' end as mode from n""",
)
def work_modes(p):
    blank = F.lit("")
    heading = text.normalized(F.concat_ws(" ", F.coalesce("title", blank), F.coalesce("location", blank)))
    staged = p.select("posting_no", "is_remote", heading.alias("heading"), text.normalized(F.col("description")).alias("body"))
    return staged.select("posting_no", text.work_mode(F.col("heading"), F.col("body"), F.col("is_remote")).alias("mode"))


@query(
    "q_sanitize", "postings",
    sql=r"""select posting_no, regexp_replace(regexp_replace(recruiter_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '(https?://[^\s?#]+)[?#]\S*', '\1', 'g') as contact,
    regexp_replace(regexp_replace(url, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '(https?://[^\s?#]+)[?#]\S*', '\1', 'g') as url from postings""",
)
def sanitized(p):
    return p.select("posting_no", text.sanitize(F.col("recruiter_email")).alias("contact"), text.sanitize(F.col("url")).alias("url"))


@query(
    "q_presentation", "postings",
    sql=rf"""select posting_no, left(replace(regexp_replace({_clean('title')}, '([\\`*_{{}}\[\]()#+.!|>~-])', '\\\1', 'g'), '@', '@' || chr(8203)), 80) as title,
    left(replace(regexp_replace({_clean('company')}, '([\\`*_{{}}\[\]()#+.!|>~-])', '\\\1', 'g'), '@', '@' || chr(8203)), 40) as company from postings""",
)
def cards(p):
    return p.select("posting_no", text.display(F.col("title"), 80).alias("title"), text.display(F.col("company"), 40).alias("company"))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


@query(
    "q_iso_gate", "postings",
    sql=f"""with t as (select posting_no, {_clean('posted_at')} as v from postings) select posting_no, case when regexp_matches(v, '{_ISO}') then
    epoch_us(try_cast(replace(v, 'T', ' ') || case when length(v) = 10 then ' 00:00:00+00' when regexp_matches(v, '(Z|[+-]\\d{{2}}:\\d{{2}})$') and length(v) > 10 then '' else '+00' end as timestamptz)) end as utc_us from t""",
)
def iso_gate(p):
    return p.select("posting_no", _us(text.iso_instant(F.col("posted_at"))).alias("utc_us"))


#: Example dictionary: term to aliases.
TERMS = {"sql": ["sql", "sql queries"], "go": ["golang", "go"], "react": ["react(?:\\.js)?"], "ci": ["continuous integration", "ci/cd"], "triage": ["triage calls"], "espresso": ["espresso"]}


@query(
    "q_term_tags", "postings",
    sql="select posting_no, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(description), '(^|[^a-z0-9])(?:{'|'.join(a)})([^a-z0-9]|$)') then '{n}' end" for n, a in sorted(TERMS.items())) + "], lambda x: x is not null), ',') as terms from postings where description is not null",
)
def term_tags(p):
    return p.where("description is not null").select("posting_no", F.array_join(text.terms_in(F.lower("description"), TERMS), ",").alias("terms"))


@query("q_html_text", "postings")
def html_texts(p):
    """Text of every description with its blocks as lines."""
    return p.select("posting_no", markup.block_text(F.col("description")).alias("text"), markup.flat_text(F.col("description")).alias("line"))


@query("q_jsonld", "postings", sql="select posting_no, title, company from postings where title is not null and company is not null")
def jsonld(p):
    """Title and company back out of pages that carry them as JSON-LD."""
    body = F.to_json(F.struct(F.array(F.struct(F.lit("JobPosting").alias("@type"), F.col("title"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"))).alias("@graph")))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.replace(body, F.lit("</"), F.lit("<\\/")), F.lit("</script><p>x</p></html>"))
    pages = p.where("title is not null and company is not null").select("posting_no", F.explode(markup.jsonld(page)).alias("o"))
    posting = pages.where(F.get_json_object("o", "$['@type']") == "JobPosting")
    return posting.select("posting_no", F.get_json_object("o", "$.title").alias("title"), F.get_json_object("o", "$.hiringOrganization.name").alias("company"))


_BOTH_TEXTS = "(select posting_no, 'description' as field, description as t from postings union all select posting_no, 'source_description', source_description from postings)"


def _durations_sql(cues: extract.Cues) -> str:
    """Durations by unnested clauses and their pieces."""
    pattern = extract.DURATION
    low = "replace(replace(lower(t), '–', '-'), '—', '-')"
    for i, word in enumerate(extract.NUMBER_WORDS):
        low = f"regexp_replace({low}, '\\b{word}\\b', '{i}', 'g')"
    around = "(l || ' ' || r)"
    tests = [f"regexp_matches({around}, '{cues.asks}')", f"not regexp_matches(r, '^\\s+(?:{cues.follows})')"]
    if cues.precedes:
        tests.append(f"not (regexp_matches(l, '(?:{cues.precedes}).{{0,30}}$') and not regexp_matches(r, '^\\s+(?:{cues.unless})'))")
    months = f"case when starts_with(regexp_extract(hit, '{pattern}', 3), 'month') then 1.0::double else 12.0::double end"
    return f"""with c as (select posting_no, field, unnest(string_split_regex(regexp_replace({low}, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '[\\n;,]')) as clause from {_BOTH_TEXTS}),
    e as (select posting_no, field, {_norm('clause')} as evidence from c where regexp_matches(clause, '{pattern}')),
    g as (select posting_no, field, evidence, regexp_extract_all(evidence, '{pattern}') as hits, string_split_regex(evidence, '{pattern}') as gaps from e),
    h as (select posting_no, field, evidence, unnest(hits) as hit, right(unnest(gaps[1:len(gaps)-1]), {cues.before}) as l, left(unnest(gaps[2:]), {cues.after}) as r from g)
    select posting_no, field, try_cast(regexp_extract(hit, '{pattern}', 1) as double) * ({months}) as minimum_months, try_cast(regexp_extract(hit, '{pattern}', 2) as double) * ({months}) as maximum_months,
     regexp_matches({around}, '{cues.wishes}') as preferred, evidence from h where {' and '.join(tests)}"""


def _durations(p: DataFrame, cues: extract.Cues) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("description", "source_description")])
    texts = p.select("posting_no", F.explode(fields).alias("t")).select("posting_no", "t.field", F.col("t.text").alias("text"))
    return extract.durations(texts, "text", cues).drop("text")


@query("q_duration_requirements", "postings", sql=_durations_sql(settings.EXPERIENCE))
def duration_requirements(p):
    """Experience that the texts ask for."""
    return _durations(p, settings.EXPERIENCE)


@query("q_contract_terms", "postings", sql=_durations_sql(settings.TERMS_OF_CONTRACT))
def contract_terms(p):
    """Lengths of contracts and other durations that the texts state."""
    return _durations(p, settings.TERMS_OF_CONTRACT)


def _sections_sql(title: str, eligible: str, footer: str) -> str:
    """Sections by numbered lines and a running count of headings."""
    return f"""with l as (select posting_no, generate_subscripts(ls, 1) - 1 as i, unnest(ls) as line from (select posting_no, string_split_regex(description, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]') as ls from postings where {eligible})),
    t as (select posting_no, i, line, {title} as title from l), k as (select posting_no, min(i) as first, max(i) as last from t where title is not null group by posting_no
      having count(*) >= 2 and count(distinct {_norm('title')}) = count(*)),
    f as (select k.posting_no, first, coalesce(min(i) filter (i > last and {footer}), max(i) + 1) as foot from k join t using (posting_no) group by k.posting_no, first),
    s as (select t.*, foot, i < first or i >= foot as common, count(title) over (partition by posting_no order by i) as n from t join f using (posting_no)),
    shared as (select posting_no, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (common), ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') as text from s group by posting_no),
    own as (select posting_no, n, max(title) as title, regexp_replace(string_agg(line, chr(10) order by i), '^{_SPACE}+|{_SPACE}+$', '', 'g') as text from s where not common group by posting_no, n)
    select posting_no, (n - 1)::integer as n, own.title, case when shared.text = '' then own.text when own.text = '' then shared.text else shared.text || chr(10) || own.text end as text from own join shared using (posting_no)
    union all select posting_no, 0, title, description from postings where posting_no not in (select posting_no from k)"""


_BARE = "trim(regexp_replace(line, '^\\s*(?:[-*•]\\s+|\\d+[.)]\\s+)', ''))"
_ROLE_TITLE = f"""(select case when length(x) between 3 and 120 then x end from (select regexp_replace(case when regexp_matches(b, '(?i)^(?:role|position|job title)\\s*:\\s*.') then regexp_extract(b, '(?i)^[^:]*:\\s*(.+)$', 1)
  when regexp_matches(b, '{settings._ROLE}') and not regexp_matches(b, '{settings._DEMAND}') and len(string_split_regex(b, '\\s+')) <= 10 then b end, '^[*: ]+|[*: ]+$', '', 'g') as x from (select {_BARE} as b)))"""
_PART_TITLE = f"nullif(lower(regexp_extract(line, '(?i)^\\W*({'|'.join(settings.PARTS)})\\s*:', 1)), '')"


def _split(p: DataFrame, description, heading, footer=None) -> DataFrame:
    """Sections of ``description``; a post that isn't split is its only section."""
    split = extract.sections(p.select("posting_no", "title", "description", description.alias("__text")), "__text", heading, footer)
    whole = F.array(F.struct("title", F.col("description").alias("text")))
    rows = split.select("posting_no", F.posexplode(F.coalesce("sections", whole)).alias("n", "s"))
    return rows.select("posting_no", "n", "s.title", "s.text")


@query("q_split_roles", "postings", sql=_sections_sql(_ROLE_TITLE, "kind = 'lead' and description_status = 'full'", f"regexp_matches(line, '{settings._FOR_ALL}')"))
def split_roles(p):
    """Sections of leads that offer several roles; every other posting is its only section."""
    several = F.coalesce((F.col("kind") == "lead") & (F.col("description_status") == "full"), F.lit(False))
    return _split(p, F.when(several, F.col("description")), settings.role_heading, settings.for_all)


@query("q_sections", "postings", sql=_sections_sql(_PART_TITLE, "description is not null", "false"))
def parts(p):
    """Descriptions split at the labels that open a part; every other posting is its only section."""
    return _split(p, F.col("description"), settings.part_heading)


# --- rule engine, ranking, counts -----------------------------------------------------------------


def rule_set() -> tuple[list[rules.Rule], list[rules.Score]]:
    """An example rule set."""
    status, active = F.col("description_status"), F.col("active_status")
    c = F.col
    checks = [
        rules.Rule("listing_closed", rules.REJECT, active == "closed"),
        rules.Rule("no_title", rules.REJECT, F.coalesce(F.trim("title"), F.lit("")) == ""),
        rules.Rule("stale", rules.REJECT, c("last_seen_at") < _now() - F.expr("interval 120 days")),
        rules.Rule("description_incomplete", rules.REVIEW, ~status.eqNullSafe(F.lit("full"))),
        rules.Rule("listing_unverified", rules.REVIEW, active.isin("blocked", "unverified")),
        rules.Rule("conflicting_locations", rules.REVIEW, F.array_contains("evidence_warnings", "conflicting_locations")),
        rules.Rule("remote", rules.NOTE, c("work_mode") == "remote"),
        rules.Rule("pay_unknown", rules.GAP, c("salary_min").isNull() | F.isnan("salary_min")),
    ]
    points = [
        rules.Score(F.lit(40), status == "full"), rules.Score(F.lit(25), c("work_mode").isin("remote", "hybrid")),
        rules.Score(rules.share_score(F.least(F.size(F.coalesce("aliases", F.array())), F.lit(3)), F.lit(3), 20), F.lit(True)), rules.Score(F.lit(15), c("is_priority_location")),
    ]
    return checks, points


def decided(p: DataFrame) -> DataFrame:
    """The example rule set over the postings."""
    return rules.decide(p, *rule_set())


_DECIDE = """select posting_no, active_status, job_id, search_track, last_seen_at, work_mode,
 case when coalesce(active_status = 'closed', false) or coalesce(trim(title), '') = '' or coalesce(epoch_us(last_seen_at) < epoch_us(timestamp '2026-08-01') - 120*86400*1000000::bigint, false) then 'rejected'
  when coalesce(description_status, '') <> 'full' or coalesce(active_status in ('blocked','unverified'), false) or coalesce(list_contains(evidence_warnings, 'conflicting_locations'), false) then 'review' else 'qualified' end as tier,
 cast((case when description_status = 'full' then 40 else 0 end) + (case when work_mode in ('remote','hybrid') then 25 else 0 end) + round_even(least(coalesce(len(aliases), 0), 3) * 20.0 / 3, 0) + (case when is_priority_location then 15 else 0 end) as integer) as score,
 list_filter([case when active_status = 'closed' then 'listing_closed' end, case when coalesce(trim(title), '') = '' then 'no_title' end,
  case when epoch_us(last_seen_at) < epoch_us(timestamp '2026-08-01') - 120*86400*1000000::bigint then 'stale' end, case when work_mode = 'remote' then 'remote' end], lambda x: x is not null) as reasons,
 list_filter([case when coalesce(description_status, '') <> 'full' then 'description_incomplete' end, case when active_status in ('blocked','unverified') then 'listing_unverified' end,
  case when list_contains(evidence_warnings, 'conflicting_locations') then 'conflicting_locations' end, case when salary_min is null or isnan(salary_min) then 'pay_unknown' end], lambda x: x is not null) as gaps from postings"""


@query("q_decide_tiers", "postings", sql=f"select posting_no, tier, score, array_to_string(reasons, ',') as reasons, array_to_string(gaps, ',') as gaps from ({_DECIDE})")
def decide_tiers(p):
    return decided(p).select("posting_no", "tier", "score", F.array_join("reasons", ",").alias("reasons"), F.array_join("gaps", ",").alias("gaps"))


_RANK = "case tier when 'qualified' then 2 when 'review' then 1 else 0 end"


@query("q_rank_topk", "postings", sql=f"select posting_no, tier, score from ({_DECIDE}) order by {_RANK} desc, score desc, last_seen_at desc, posting_no limit 100")
def rank_topk(p):
    order = [rules.tier_rank(F.col("tier")).desc(), F.col("score").desc(), F.col("last_seen_at").desc()]
    return ranking.ranked(decided(p), order, "posting_no", 100).select("posting_no", "tier", "score")


@query(
    "q_verification_sample", "postings",
    sql=f"select posting_no, tier, score from ({_DECIDE}) where {_RANK} = (select max({_RANK}) from ({_DECIDE})) order by score desc, posting_no limit 3",
)
def verification_sample(p):
    d = decided(p).select("posting_no", "score", "tier", rules.tier_rank(F.col("tier")).alias("rank"))
    return ranking.ranked(d.where(F.col("rank") == d.agg(F.max("rank")).scalar()), [F.col("score").desc()], "posting_no", 3).select("posting_no", "tier", "score")


@query("q_reason_histogram", "postings", sql=f"select code, count(*) as n from (select unnest(list_concat(reasons, gaps)) as code from ({_DECIDE})) group by code")
def reason_histogram(p):
    return metrics.code_histogram(decided(p), "reasons", "gaps")


@query(
    "q_run_counts", "postings",
    sql=f"""select count(*) as rows_in, count(distinct lower(replace(job_id, ' ', ''))) as ids, count(*) filter (tier = 'qualified') as qualified, count(*) filter (tier = 'review') as review,
    count(*) filter (tier = 'rejected') as rejected, sum(score)::bigint as points from ({_DECIDE})""",
)
def run_counts(p):
    tier = F.col("tier")
    return decided(p).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_distinct(F.lower(F.replace("job_id", F.lit(" "), F.lit("")))).alias("ids"), F.count_if(tier == "qualified").alias("qualified"),
        F.count_if(tier == "review").alias("review"), F.count_if(tier == "rejected").alias("rejected"), F.sum("score").alias("points"),
    )


@query(
    "q_eval_confusion", "postings", "feedback_labels",
    sql=f"""with d as (select job_id, max({_RANK}) as r from ({_DECIDE}) group by job_id) select label as expected, case r when 2 then 'qualified' when 1 then 'review' else 'rejected' end as actual, count(*) as n
    from feedback_labels join d using (job_id) group by all""",
)
def eval_confusion(p, labels):
    return metrics.confusion(_labelled(p, labels), F.col("label"), F.col("actual"))


def _labelled(p, labels):
    best = decided(p).groupBy("job_id").agg(F.max(rules.tier_rank(F.col("tier"))).alias("r"))
    return labels.join(best, "job_id").withColumn("actual", F.when(F.col("r") == 2, "qualified").when(F.col("r") == 1, "review").otherwise("rejected"))


@query(
    "q_eval_metrics", "postings", "feedback_labels",
    sql=f"""with d as (select job_id, max({_RANK}) as r from ({_DECIDE}) group by job_id), e as (select case label when 'relevant' then 'qualified' when 'not_relevant' then 'rejected' else 'review' end as x,
    case r when 2 then 'qualified' when 1 then 'review' else 'rejected' end as y from feedback_labels join d using (job_id))
    select count(*) as cases, round(count(*) filter (x = y) / nullif(count(*), 0), 4) as agreement, round(count(*) filter (x = 'qualified' and y = 'qualified') / nullif(count(*) filter (y = 'qualified'), 0), 4) as precision,
    round(count(*) filter (x = 'qualified' and y = 'qualified') / nullif(count(*) filter (x = 'qualified'), 0), 4) as recall from e""",
)
def eval_metrics(p, labels):
    expected = F.when(F.col("label") == "relevant", "qualified").when(F.col("label") == "not_relevant", "rejected").otherwise("review")
    return metrics.agreement(_labelled(p, labels), expected, F.col("actual"), "qualified")


# --- run metrics ----------------------------------------------------------------------------------

_OUT = "(select distinct * from query_outcomes)"


@query(
    "q_query_yield", "query_outcomes", "postings",
    sql=f"""with o as (select query_id, count(*) as requests, sum(raw)::bigint as raw, round(sum(duration_seconds), 3) as seconds from {_OUT} group by query_id), j as (select query_id, count(distinct job_id) as jobs from postings group by query_id)
    select query_id, requests, raw, seconds, coalesce(jobs, 0) as jobs, round(coalesce(jobs, 0) / requests, 4) as per_request, round(case when seconds > 0 then coalesce(jobs, 0) * 60 / seconds end, 4) as per_minute from o left join j using (query_id)""",
)
def query_yield(o, p):
    return metrics.query_yield(o.distinct(), p.select("query_id", "job_id"))


_GOOD = "status in ('success','valid_empty')"


@query(
    "q_source_coverage", "query_outcomes",
    sql=f"""select site, phase, count(*) as attempts, count(*) filter ({_GOOD}) as good, count(*) filter (status = 'partial') as partial, count(*) filter (status not in ('success','valid_empty','partial','skipped')) as failed,
    sum(converted)::bigint as converted, count(distinct query_id) as queries from {_OUT} group by site, phase""",
)
def source_coverage(o):
    return metrics.coverage(o.distinct(), ["site", "phase"])


_STATUS = f"""select {{key}}, case when count(*) filter (status <> 'skipped') = 0 and count(*) filter (status = 'skipped') > 0 then 'skipped' when count(*) filter (status <> 'skipped') = 0 then 'unverified'
 when count(*) filter ({_GOOD}) = count(*) filter (status <> 'skipped') and sum(converted) filter ({_GOOD}) > 0 then 'success' when count(*) filter ({_GOOD}) = count(*) filter (status <> 'skipped') then 'valid_empty'
 when count(*) filter ({_GOOD}) > 0 or sum(converted) filter (status <> 'skipped') > 0 then 'partial' else 'failed' end as source_status from {_OUT} group by {{key}}"""


@query("q_source_status", "query_outcomes", sql=_STATUS.replace("{key}", "query_id"))
def source_status(o):
    return metrics.source_status(o.distinct(), "query_id")


@query(
    "q_health", "query_outcomes",
    sql=f"select run_id, case when bool_or(source_status in ('failed','partial')) then 'degraded' when bool_or(source_status in ('success','valid_empty')) then 'healthy' else 'idle' end as health from ({_STATUS.replace('{key}', 'run_id, site')}) group by run_id",
)
def health(o):
    parts = metrics.source_status(o.distinct().withColumn("k", F.struct("run_id", "site")), "k")
    return metrics.health(parts.select("k.run_id", "source_status"), "run_id")


@query("q_problem_summary", "query_outcomes", sql=f"select site, status, coalesce(lower(trim(reason)), '') as reason, count(*) as n from {_OUT} where not {_GOOD} group by all")
def problem_summary(o):
    return metrics.problems(o.distinct())


# --- identity and joins ---------------------------------------------------------------------------


@query(
    "q_merge_payload", "postings",
    sql="""with p as (select *, lower(regexp_replace(job_id, '\\s', '', 'g')) as k, case description_status when 'full' then 3 when 'snippet' then 2 when 'fetch_failed' then 1 else 0 end as r from postings)
    select k, count(*) as n, min(posting_no) as first_row, md5(coalesce(arg_max(coalesce(description, ''), (r, length(coalesce(description, '')), -posting_no)), '')) as text_md5, arg_min(location, posting_no) filter (coalesce(location, '') <> '') as location,
    arg_min(job_level, posting_no) filter (coalesce(job_level, '') <> '') as job_level, len(list_distinct(flatten(list(coalesce(source_urls, []))))) as urls from p where k is not null group by k""",
)
def merge_payload(p):
    rank = F.when(F.col("description_status") == "full", 3).when(F.col("description_status") == "snippet", 2).when(F.col("description_status") == "fetch_failed", 1).otherwise(0)
    keyed = p.withColumn("k", F.lower(F.regexp_replace("job_id", r"\s", ""))).where("k is not null").withColumn("description", F.coalesce("description", F.lit("")))
    merged = identity.merge_payload(keyed, "k", "posting_no", "description", rank, ["location", "job_level"], ["source_urls"])
    return merged.select("k", "n", "first_row", F.md5(F.coalesce("description", F.lit("")).cast("binary")).alias("text_md5"), "location", "job_level", F.size("source_urls").cast("bigint").alias("urls"))


@query("q_merge_fold", "postings")
def merge_fold(p):
    """Survivor of each posting by the ordered greedy fold on ids and destination URLs."""
    rows = p.select("posting_no", "platform", "source_id", text.canonical_url(F.col("url")).alias("u"), text.canonical_url(F.col("application_url")).alias("a"), F.lower(F.trim("job_id")).alias("j"))
    last = F.lower(F.element_at(F.split(F.regexp_replace("a", "[?].*$", ""), "/"), -1))
    specific = F.when(~last.isin(*text.GENERAL_PAGES), F.concat(F.lit("url:"), F.col("a")))
    keys = F.array_compact(F.concat(F.array("j"), F.sort_array(F.array_distinct(F.array(F.concat(F.lit("url:"), F.col("u")), specific)))))
    return identity.greedy_fold(rows, "posting_no", keys, ("platform", "source_id"))


@query("q_merge_jobs", "postings")
def merge_jobs(p):
    """Postings with one id or destination as one, with all fields that a merge fills."""
    merged = pipeline.merge(pipeline.normalize_postings(p), "posting_no")
    return merged.withColumn("text_md5", F.md5(F.col("description").cast("binary"))).drop("description")


@query("q_run_due", "postings", "seen_identities")
def run_due(p, seen):
    """A whole run over all postings: what would be delivered, best first."""
    done = pipeline.run(p, "posting_no", *rule_set(), [F.col("last_seen_at").desc()], seen, 100, now=_now())
    return done.due.select("turn", "posting_no", "job_id", "tier", "score", "merged")


@query(
    "q_unseen", "postings", "seen_identities",
    sql="""with k as (select posting_no, unnest(list_concat([job_id], coalesce(aliases, []))) as identity from postings), s as (select distinct posting_no from k join seen_identities using (identity)),
    f as (select posting_no, job_id from postings where posting_no not in (select posting_no from s)) select posting_no, job_id from f where posting_no in (select min(posting_no) from f where job_id is not null group by job_id)""",
)
def unseen(p, seen):
    ids_ = F.concat(F.array("job_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    return identity.unseen(p.where("job_id is not null").select("posting_no", "job_id", "aliases"), ids_, "job_id", "posting_no", seen, "identity").select("posting_no", "job_id")


def _latest_deliveries(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.col("attempted_at").desc(), F.col("received_at").desc(), F.col("status"), F.col("message_id").desc_nulls_last(), F.col("attempts"))
    return d.distinct().withColumn("n", F.row_number().over(w)).where("n = 1").select("job_id", "status", F.col("attempts").cast("bigint").alias("attempts"))


_LATEST = """(select job_id, status, attempts::bigint as attempts from (select *, row_number() over (partition by job_id order by attempted_at desc, received_at desc, status, message_id desc nulls last, attempts) as n from (select distinct * from deliveries)) where n = 1)"""


@query(
    "q_upsert_pending", "deliveries", "feedback_labels",
    sql=f"select coalesce(i.job_id, c.job_id) as job_id, case when i.job_id is not null then i.status else c.status end as status, case when i.job_id is not null then i.attempts else c.attempts end as attempts from {_LATEST} c full join (select job_id, label as status, 0::bigint as attempts from feedback_labels) i on c.job_id = i.job_id",
)
def upsert_pending(d, labels):
    incoming = labels.select("job_id", F.col("label").alias("status"), F.lit(0).cast("bigint").alias("attempts"))
    return identity.upsert(_latest_deliveries(d), incoming, "job_id", ["status", "attempts"])


@query(
    "q_refresh_pending", "deliveries", "feedback_labels",
    sql=f"select c.job_id, c.attempts, coalesce(i.label, c.status) as status from {_LATEST} c left join feedback_labels i on c.job_id = i.job_id",
)
def refresh_pending(d, labels):
    return identity.refresh(_latest_deliveries(d), labels.select("job_id", F.col("label").alias("status")), "job_id", ["status"])


@query("q_enqueue_pending", "deliveries", "postings", "seen_identities")
def enqueue_pending(d, p, seen):
    """Unseen postings put into the latest deliveries: an entry under an alias goes on under the posting's id."""
    ids_ = F.concat(F.array("job_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    new = identity.unseen(p.where("job_id is not null").select("posting_no", "job_id", "aliases"), ids_, "job_id", "posting_no", seen, "identity")
    return identity.rekeyed(_latest_deliveries(d), new, "job_id", "aliases", "posting_no", ["posting_no"], {"status": F.lit("pending"), "attempts": F.lit(0).cast("bigint")})


@query("q_refresh_aliases", "deliveries", "postings")
def refresh_aliases(d, p):
    """The latest deliveries with the last posting that found each by id or alias; nothing is inserted."""
    return identity.rekeyed(_latest_deliveries(d), p.select("posting_no", "job_id", "aliases"), "job_id", "aliases", "posting_no", ["posting_no"])


# --- reconciliation -------------------------------------------------------------------------------

_SNAP = {
    "b": "select posting_no as k, active_status as v from postings where posting_no % 7 <> 0",
    "l": "select posting_no as k, case when posting_no % 5 = 0 then 'local' else active_status end as v from postings where posting_no % 7 <> 0 and posting_no % 11 <> 0 or posting_no % 77 = 0",
    "r": "select posting_no as k, case when posting_no % 3 = 0 then 'remote' else active_status end as v from postings where posting_no % 7 <> 0 and posting_no % 13 <> 0 or posting_no % 91 = 0",
}


def _snapshots(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, v = F.col("posting_no").alias("k"), F.col("active_status")
    base = p.where("posting_no % 7 <> 0").select(k, v.alias("v"))
    local = p.where("posting_no % 7 <> 0 and posting_no % 11 <> 0 or posting_no % 77 = 0").select(k, F.when(F.expr("posting_no % 5 = 0"), "local").otherwise(v).alias("v"))
    remote = p.where("posting_no % 7 <> 0 and posting_no % 13 <> 0 or posting_no % 91 = 0").select(k, F.when(F.expr("posting_no % 3 = 0"), "remote").otherwise(v).alias("v"))
    return base, local, remote


@query(
    "q_three_way_merge", "postings",
    sql=f"""with u as (select k, 'b' as s, struct_pack(v := v) as v from ({_SNAP['b']}) union all select k, 'l', struct_pack(v := v) from ({_SNAP['l']}) union all select k, 'r', struct_pack(v := v) from ({_SNAP['r']})),
    m as (select k, any_value(v) filter (s = 'b') as b, any_value(v) filter (s = 'l') as l, any_value(v) filter (s = 'r') as r from u group by k),
    w as (select k, case when l is not distinct from b then r when r is not distinct from b or l is not distinct from r then l when l is null or r is null then null else struct_pack(v := greatest(l.v, r.v)) end as m from m)
    select k, m.v as v from w where m is not null""",
)
def three_way_merge(p):
    return reconcile.three_way(*_snapshots(p), "k", "v", F.greatest)


@query(
    "q_merge_acks", "seen_identities",
    sql="""with b as (select identity, seen_at from seen_identities), l as (select identity, seen_at + case when hash_no % 4 = 0 then 60 else 0 end as seen_at from (select *, length(identity) + ascii(right(identity, 1)) as hash_no from b) where hash_no % 5 <> 0),
    r as (select identity, seen_at + case when hash_no % 3 = 0 then 90 else 0 end as seen_at from (select *, length(identity) + ascii(right(identity, 1)) as hash_no from b) where hash_no % 7 <> 0)
    select identity, case when l.identity is not null and r.identity is not null then greatest(l.seen_at, r.seen_at) else coalesce(l.seen_at, r.seen_at) end as seen_at from b left join l using (identity) left join r using (identity)
    where (l.identity is not null and r.identity is not null) or (coalesce(l.seen_at, r.seen_at) is not null and coalesce(l.seen_at, r.seen_at) is distinct from b.seen_at)""",
)
def merge_acks(seen):
    n = F.length("identity") + F.ascii(F.right("identity", F.lit(1)))
    b = seen.withColumn("h", n)
    local = b.where("h % 5 <> 0").select("identity", (F.col("seen_at") + F.when(F.col("h") % 4 == 0, 60).otherwise(0)).alias("seen_at"))
    remote = b.where("h % 7 <> 0").select("identity", (F.col("seen_at") + F.when(F.col("h") % 3 == 0, 90).otherwise(0)).alias("seen_at"))
    return reconcile.merge_acks(seen, local, remote, "identity", "seen_at")


@query(
    "q_merge_newest", "deliveries",
    sql="""select job_id, status, message_id, epoch_us(latest) as latest_us from (select *, greatest(attempted_at, received_at) as latest, row_number() over (partition by job_id order by greatest(attempted_at, received_at) desc, message_id desc nulls last, status) as n from (select distinct * from deliveries)) where n = 1""",
)
def merge_newest(d):
    best = Window.partitionBy("job_id").orderBy(F.greatest("attempted_at", "received_at").desc(), F.col("message_id").desc_nulls_last(), "status")
    rows = d.distinct().withColumn("n", F.row_number().over(best)).where("n = 1")
    return rows.select("job_id", "status", "message_id", _us(F.greatest("attempted_at", "received_at")).alias("latest_us"))


@query(
    "q_merge_bounded", "postings",
    sql="select company, posting_no from (select company, posting_no, row_number() over (partition by company order by last_seen_at desc, posting_no) as n from postings) where n <= 5",
)
def merge_bounded(p):
    return reconcile.bounded(p.select("company", "posting_no", "last_seen_at"), ["company"], [F.col("last_seen_at").desc(), F.col("posting_no")], 5).select("company", "posting_no")


@query(
    "q_merge_grow_only", "deliveries", "query_outcomes",
    sql="""with u as (select job_id as k, attempted_at as t from deliveries union all select query_id, started_at from query_outcomes), m as (select k, max(t) as t from u group by k)
    select k, epoch_us(t) as t_us from m where epoch_us(t) >= (select max(epoch_us(t)) from m) - 62*86400*1000000::bigint""",
)
def merge_grow_only(d, o):
    ledgers = [d.select(F.col("job_id").alias("k"), F.col("attempted_at").alias("t")), o.select(F.col("query_id").alias("k"), F.col("started_at").alias("t"))]
    return reconcile.grow_only(ledgers, "k", "t", 62).select("k", _us("t").alias("t_us"))


# --- windows, budgets, schedules ------------------------------------------------------------------


@query(
    "q_plan_cross", "query_outcomes",
    sql=f"""with s as (select distinct site from query_outcomes), t as (select distinct search_track from query_outcomes), l as (select site, search_track, max(epoch_us(started_at)) as last_us from {_OUT} where {_GOOD} group by all)
    select s.site, t.search_track, last_us, row_number() over (order by last_us nulls first, s.site, t.search_track) as place from s cross join t left join l on l.site = s.site and l.search_track = t.search_track""",
)
def plan_cross(o):
    """Every site and track, least recently successful first; both lists are configuration-sized."""
    last = o.where(F.col("status").isin(*metrics.GOOD)).groupBy("site", "search_track").agg(F.max(_us("started_at")).alias("last_us"))
    lists = o.agg(F.collect_set("site").alias("s"), F.collect_set("search_track").alias("t"))
    plans = lists.select("t", F.explode("s").alias("site")).select("site", F.explode("t").alias("search_track"))
    return plans.join(last, ["site", "search_track"], "left").withColumn("place", F.row_number().over(Window.orderBy(F.col("last_us").asc_nulls_first(), "site", "search_track")).cast("bigint"))


@query(
    "q_round_robin", "postings",
    sql="""with r as (select search_track, min(posting_no) as f from postings group by search_track), k as (select search_track, row_number() over (order by f) as track_rank from r)
    select posting_no, row_number() over (partition by search_track order by last_seen_at, posting_no) as turn, track_rank from postings join k using (search_track)""",
)
def round_robin(p):
    out = ranking.round_robin(p.where("search_track is not null").select("posting_no", "search_track", "last_seen_at"), "search_track", [F.col("last_seen_at")], "posting_no")
    return out.select("posting_no", F.col("turn").cast("bigint").alias("turn"), F.col("track_rank").cast("bigint").alias("track_rank"))


@query(
    "q_aging_priority", "deliveries",
    sql="select job_id, message_id, epoch_us(attempted_at) as at_us, greatest(0, 40 - cast(trunc((epoch(timestamptz '2026-08-01 00:00:00+00') - floor(epoch(attempted_at))) / 21600) as integer)) as priority from (select distinct * from deliveries)",
)
def aging(d):
    waited = F.unix_timestamp(_now()) - F.unix_timestamp("attempted_at")
    return d.distinct().select("job_id", "message_id", _us("attempted_at").alias("at_us"), ranking.aging_priority(F.lit(40), waited, 6).alias("priority"))


_ORDER = "started_at, received_at, run_id, query_id, status, raw, duration_seconds, phase"


@query(
    "q_breaker_islands", "query_outcomes",
    sql=f"""with o as (select *, row_number() over (partition by site order by {_ORDER}) as n from {_OUT}), i as (select *, sum(case when status in ('failed','parse_failed') then 0 else 1 end) over (partition by site order by n) as island from o)
    select site, n, sum(case when status in ('failed','parse_failed') then 1 else 0 end) over (partition by site, island order by n)::bigint as run from i""",
)
def breaker(o):
    w = Window.partitionBy("site").orderBy(*[c.strip() for c in _ORDER.split(",")])
    numbered = o.distinct().withColumn("n", F.row_number().over(w).cast("bigint"))
    return ranking.failure_runs(numbered, "site", ["n"], F.col("status").isin("failed", "parse_failed")).select("site", "n", "run")


@query(
    "q_budget_cutoff", "query_outcomes",
    sql=f"""with o as (select *, row_number() over (partition by run_id order by {_ORDER}) as n from {_OUT}), s as (select run_id, n, raw, coalesce(sum(raw) over (partition by run_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as spent_before from o)
    select run_id, n, spent_before from s where spent_before < 50""",
)
def budget(o):
    w = Window.partitionBy("run_id").orderBy(*[c.strip() for c in _ORDER.split(",")])
    numbered = o.distinct().withColumn("n", F.row_number().over(w).cast("bigint"))
    return ranking.within_budget(numbered, ["run_id"], [F.col("n")], "raw", 50).select("run_id", "n", "spent_before")


@query(
    "q_rotation", "query_outcomes",
    sql="with s as (select site, row_number() over (order by site) - 1 as place, count(*) over () as size from (select distinct site from query_outcomes)) select site, ((place - 4) % size + size) % size as place from s",
)
def rotation(o):
    sites = o.select("site").distinct()
    every = Window.orderBy("site")  # one row per site: configuration-sized
    placed = sites.select("site", (F.row_number().over(every) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("size"))
    return placed.select("site", ranking.rotated(F.col("place"), F.lit(4), F.col("size")).cast("bigint").alias("place"))


@query(
    "q_digest_batches", "deliveries",
    sql="with d as (select *, row_number() over (partition by status order by attempted_at, job_id, message_id nulls last, received_at, attempts) as n from (select distinct * from deliveries)) select status, cast(floor((n - 1) / 5) as bigint) as batch, count(*) as size, min(job_id) as first_id from d group by all",
)
def digests(d):
    order = [F.col("attempted_at"), F.col("job_id"), F.col("message_id").asc_nulls_last(), F.col("received_at"), F.col("attempts")]
    numbered = ranking.numbered(d.distinct(), "status", order, "place").withColumn("batch", ranking.batches(F.col("place"), 5))
    return numbered.groupBy("status", "batch").agg(F.count(F.lit(1)).alias("size"), F.min("job_id").alias("first_id"))


@query("q_page_novelty", "postings", sql="select posting_no from (select posting_no, batch_no, min(batch_no) over (partition by query_id, job_id) as p from postings) where p = batch_no")
def page_novelty(p):
    return ranking.first_pages(p.select("posting_no", "query_id", "job_id", "batch_no"), ["query_id", "job_id"], "batch_no").select("posting_no")


# --- state gates ----------------------------------------------------------------------------------

_LAST = f"select query_id, max(epoch_us(started_at)) filter ({_GOOD}) as ok_us, max(epoch_us(started_at)) as try_us, sum(converted) filter ({_GOOD})::bigint as yielded from {_OUT} group by query_id"
_NOW_US = "epoch_us(timestamp '2026-08-01')"


def _last(o: DataFrame) -> DataFrame:
    good = F.col("status").isin(*metrics.GOOD)
    return o.distinct().groupBy("query_id").agg(
        F.max(F.when(good, F.col("started_at"))).alias("ok"), F.max("started_at").alias("tried"), F.sum(F.when(good, F.col("converted"))).alias("yielded")
    )


@query(
    "q_due_queries", "query_outcomes",
    sql=f"""select query_id, not coalesce({_NOW_US} - ok_us >= 0 and {_NOW_US} - ok_us < 720*3600*1000000::bigint, false) as due, not coalesce({_NOW_US} - coalesce(try_us, ok_us) >= 0 and {_NOW_US} - coalesce(try_us, ok_us) < 240*3600*1000000::bigint, false) as attempt_due,
    case when coalesce(yielded, 0) = 0 then 48 else 12 end as cadence_hours, cast(least(720, greatest(72, coalesce(trunc(({_NOW_US} - ok_us) / 3600000000.0 + 24), 72))) as integer) as look_back_hours from ({_LAST})""",
)
def due_queries(o):
    return _last(o).select(
        "query_id", state.due(F.col("ok"), _now(), 720 * 3600).alias("due"), state.attempt_due(F.col("tried"), F.col("ok"), _now(), 240 * 3600).alias("attempt_due"),
        state.cadence(12, 48, F.col("yielded")).alias("cadence_hours"), state.look_back(F.col("ok"), _now(), 72).alias("look_back_hours"),
    )


@query("q_watermark_advance", "query_outcomes", sql=f"select run_id, epoch_us(max(started_at)) as last_us from {_OUT} group by run_id having bool_and(coalesce({_GOOD} or status = 'skipped', false))")
def watermark_advance(o):
    return state.advanced(o.distinct(), "run_id", F.col("status").isin(*metrics.GOOD, "skipped"), "started_at").select("run_id", _us("last_success").alias("last_us"))


@query(
    "q_cache_ttl", "postings", "deliveries",
    sql=f"""with c as (select job_id, max(epoch_us(attempted_at)) as at_us from deliveries group by job_id) select posting_no, case when {_NOW_US} - at_us >= 0 and {_NOW_US} - at_us < 30*86400*1000000::bigint then at_us end as cached_us from postings left join c using (job_id)""",
)
def cache_ttl(p, d):
    cache = d.groupBy("job_id").agg(F.max("attempted_at").alias("fetched_at")).withColumn("cached_us", _us("fetched_at"))
    return state.cached(p.select("posting_no", "job_id"), cache, "job_id", _now(), 30 * 86400, ["cached_us"]).select("posting_no", "cached_us")


@query("q_quota_admission", "query_outcomes")
def quota(o):
    """Requests of each site admitted at most 20 in 31 days and 6 hours apart."""
    requests = o.distinct().select("site", "started_at", "run_id", "query_id")
    return state.admitted(requests, "site", "started_at", 20, 31, 6 * 3600)


@query(
    "q_aimd_step", "query_outcomes",
    sql=f"""with a as (select run_id, count(*) as n, count(*) filter ({_GOOD}) as ok, bool_or(coalesce(lower(reason), '') in ('http_429','challenge')) as trouble from {_OUT} group by run_id)
    select run_id, cast(case when trouble then greatest(4, floor(16 / 2)) when n > 0 and ok = n and n >= 16 then 20 else 16 end as integer) as next_limit, cast(case when trouble then least(60.0, 4.0) when n > 0 and ok = n then greatest(2.0, 1.5) else 2.0 end as double) as next_delay from a""",
)
def aimd_step(o):
    trouble = F.bool_or(F.coalesce(F.lower("reason"), F.lit("")).isin("http_429", "challenge"))
    a = o.distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*metrics.GOOD)).alias("ok"), trouble.alias("trouble"))
    limit, delay = state.aimd(F.lit(16), F.lit(2.0), F.col("n"), F.col("ok"), F.col("trouble"), F.lit(1), 4, 24, 2.0, 60.0)
    return a.select("run_id", limit.alias("next_limit"), delay.alias("next_delay"))


@query(
    "q_retry_backoff", "deliveries",
    sql="select job_id, max(attempts)::bigint as attempts, least(86400, 300 * cast(pow(2, least(max(attempts), 8)) as bigint)) as wait_seconds from deliveries where status in ('failed','uncertain') group by job_id",
)
def retry_backoff(d):
    a = d.where(F.col("status").isin("failed", "uncertain")).groupBy("job_id").agg(F.max("attempts").cast("bigint").alias("attempts"))
    return a.select("job_id", "attempts", state.back_off(F.col("attempts")).alias("wait_seconds"))


@query(
    "q_state_validators", "deliveries",
    sql="""select 'known_status' as rule, count(*) filter (not coalesce(status in ('delivered','failed','uncertain','pending','permanent_failure'), false)) as violations from deliveries union all
    select 'attempts', count(*) filter (not coalesce(attempts between 0 and 8, false)) from deliveries union all select 'received_later', count(*) filter (not coalesce(received_at >= attempted_at, false)) from deliveries union all
    select 'has_id', count(*) filter (not coalesce(job_id <> '', false)) from deliveries""",
)
def validators(d):
    return state.violations(d, {
        "known_status": F.col("status").isin("delivered", "failed", "uncertain", "pending", "permanent_failure"), "attempts": F.col("attempts").between(0, 8),
        "received_later": F.col("received_at") >= F.col("attempted_at"), "has_id": F.col("job_id") != "",
    })


# --- set operations -------------------------------------------------------------------------------


@query(
    "q_union_sources", "postings", "deliveries",
    sql="select platform as source, count(*) as n, count(distinct job_id) as ids from (select platform, job_id from postings union all select split_part(job_id, ':', 1), job_id from deliveries) group by platform",
)
def union_sources(p, d):
    both = p.select("platform", "job_id").unionByName(d.select(F.split_part("job_id", F.lit(":"), F.lit(1)).alias("platform"), "job_id"))
    return both.groupBy(F.col("platform").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"))


@query(
    "q_set_ops", "postings", "deliveries", "feedback_labels",
    sql="""select 'both' as part, job_id from (select job_id from deliveries intersect select job_id from feedback_labels) union all select 'labels_only', job_id from (select job_id from feedback_labels except select job_id from deliveries) union all
    select 'never_sent', job_id from (select job_id from postings where job_id is not null except select job_id from deliveries)""",
)
def set_ops(p, d, labels):
    a, b = d.select("job_id"), labels.select("job_id")
    part = lambda name, rows: rows.select(F.lit(name).alias("part"), "job_id")
    return part("both", a.intersect(b)).unionByName(part("labels_only", b.subtract(a))).unionByName(part("never_sent", p.select("job_id").where("job_id is not null").subtract(a)))


# --- sentence, freshness and code predicates ------------------------------------------------------


@query(
    "q_sentence_flags", "postings",
    sql=r"""select posting_no, len(list_filter(string_split_regex(regexp_replace(coalesce(lower(description), ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\n;]'), lambda s: regexp_matches(s, '\b(?:required|minimum|must)\b') and not regexp_matches(s, '\bbonus\b')))::integer as demands from postings""",
)
def sentence_flags(p):
    return p.select("posting_no", rules.any_sentence(F.col("description"), r"\b(?:required|minimum|must)\b", r"\bbonus\b").alias("demands"))


#: Example groups of alternatives.
GROUPS = [["sql", "go"], ["ci"], ["triage", "espresso"]]


@query(
    "q_required_groups", "postings",
    sql="with t as (select posting_no, list_filter([" + ", ".join(f"case when regexp_matches(lower(description), '(^|[^a-z0-9])(?:{'|'.join(a)})([^a-z0-9]|$)') then '{n}' end" for n, a in sorted(TERMS.items())) + "], lambda x: x is not null) as known from postings where description is not null) select posting_no, (" + " + ".join(f"list_has_any(known, {g})::integer" for g in GROUPS) + ") as met from t",
)
def required_groups(p):
    rows = p.where("description is not null").select("posting_no", text.terms_in(F.lower("description"), TERMS).alias("known"))
    groups = F.array(*[F.array(*[F.lit(x) for x in g]) for g in GROUPS])
    return rows.select("posting_no", rules.groups_met(groups, F.col("known")).alias("met"))


@query(
    "q_freshness", "postings",
    sql=f"""select posting_no, case when epoch_us(last_seen_at) < {_NOW_US} - 150*86400*1000000::bigint then 'closed' when captured_at is null then 'unknown' when epoch_us(captured_at) > {_NOW_US} + 86400*1000000::bigint then 'future'
    when epoch_us(captured_at) < {_NOW_US} - 90*86400*1000000::bigint then 'stale' else 'fresh' end as freshness from postings""",
)
def freshness(p):
    return p.select("posting_no", rules.freshness(F.col("captured_at"), F.col("last_seen_at") + F.expr("interval 150 days"), _now(), 90).alias("freshness"))


@query(
    "q_currency_codes", "postings",
    sql=r"with t as (select posting_no, list_distinct(list_transform(regexp_extract_all(salary_text, '\b(USD|EUR|GBP|INR|PKR|AUD|CAD|AED|usd|eur|gbp|inr|pkr|aud|cad|aed)\b', 1), lambda x: upper(x))) as c from postings where salary_text is not null) select posting_no, case when len(c) = 1 then c[1] end as code from t",
)
def currency_codes(p):
    codes = "USD EUR GBP INR PKR AUD CAD AED".split()
    return p.where("salary_text is not null").select("posting_no", rules.single_code(F.col("salary_text"), codes + [c.lower() for c in codes]).alias("code"))


@query(
    "q_first_contact", "postings",
    sql=r"select posting_no, list_filter(regexp_extract_all(description, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), lambda x: not regexp_matches(x, '^jobs@'))[1] as contact from postings where description is not null",
)
def first_contact(p):
    return p.where("description is not null").select("posting_no", rules.first_contact(F.col("description"), "^jobs@").alias("contact"))


# --- more state and health ------------------------------------------------------------------------


@query(
    "q_attempt_machine", "deliveries",
    sql="select job_id, message_id, attempts, case when status = 'delivered' then 'done' when reason = 'http_500' then 'closed' when attempts >= 3 then 'exhausted' else 'pending' end as next from (select distinct * from deliveries)",
)
def attempt_machine(d):
    outcome = F.when(F.col("status") == "delivered", "success").when(F.col("reason") == "http_500", "gone").otherwise("failed")
    return d.distinct().select("job_id", "message_id", "attempts", state.next_status(F.lit("pending"), outcome, F.col("attempts"), 3).alias("next"))


@query(
    "q_queue_build", "deliveries", "postings",
    sql=f"""with q as (select job_id, max(attempts) as attempts, min(epoch_us(attempted_at)) as queued_us from deliveries group by job_id), c as (select job_id, min(posting_no) % 5 as p, bool_or(active_status = 'active') as r from postings where job_id is not null group by job_id),
    h as (select * from q where {_NOW_US} - queued_us < 1440*3600*1000000::bigint), j as (select coalesce(h.job_id, c.job_id) as job_id, coalesce(attempts, 0) as attempts, coalesce(p, 3) as priority, coalesce(queued_us, {_NOW_US}) as queued_us from h full join c on h.job_id = c.job_id where coalesce(r, true))
    select job_id, case when attempts >= 3 then 'exhausted' else 'pending' end as status, priority::bigint as priority from j order by priority, queued_us, job_id limit 500""",
)
def queue_build(d, p):
    queue = d.groupBy("job_id").agg(F.max("attempts").alias("attempts"), F.min("attempted_at").alias("queued_at")).withColumn("priority", F.lit(3).cast("bigint"))
    cards = p.where("job_id is not null").groupBy("job_id").agg((F.min("posting_no") % 5).alias("priority"), F.bool_or(F.col("active_status") == "active").alias("relevant"))
    return state.build_queue(queue, cards, "job_id", _now(), 1440, 3, 500).select("job_id", "status", "priority")


@query(
    "q_assessment", "query_outcomes",
    sql=f"""select run_id, case when not bool_or({_GOOD}) then 'failed' when count(*) filter (status not in ('success','valid_empty','skipped') and phase <> 'detail') > 0 then 'degraded' else 'ok' end as state,
    array_to_string(list_sort(list(distinct site || ':' || status) filter (status not in ('success','valid_empty','skipped') and phase <> 'detail')), ',') as reasons from {_OUT} group by run_id""",
)
def assessment(o):
    a = metrics.assessment(o.distinct(), "run_id", {"phase": ["detail"]})
    return a.select("run_id", "state", F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"))


@query(
    "q_write_back", "postings", "feedback_labels",
    sql="select posting_no, query_id, search_track, coalesce(label, active_status) as active_status from postings left join feedback_labels using (job_id)",
)
def write_back(p, labels):
    rows = p.select("posting_no", "job_id", "query_id", "search_track", "active_status")
    return identity.write_back(rows, labels.select("job_id", F.col("label").alias("active_status")), "job_id", ["active_status"]).drop("job_id")


@query(
    "q_merge_delivery", "deliveries", "seen_identities",
    sql=f"""with p as (select * from {_LATEST} where status <> 'delivered'), acked as (select identity from seen_identities where seen_at > 1768000000) select job_id, status, attempts from p where job_id not in (select identity from acked)""",
)
def merge_delivery(d, seen):
    pending = _latest_deliveries(d).where("status <> 'delivered'")
    acked = seen.where("seen_at > 1768000000").select(F.col("identity").alias("job_id")).distinct()
    return pending.join(acked, "job_id", "left_anti")


# --- records out of what sources return -----------------------------------------------------------

_HOSTS = ["jobmoor.example", "talentbay.example"]
_PROVIDERS = [("moor", ["jobmoor.example", "www.jobmoor.example"], "/([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"), ("bay", ["talentbay.example", "www.talentbay.example"], "/(jobs)/view/(?:[^/]*-)?([0-9]+)")]


@query(
    "q_first_links", "postings",
    sql=_URL_SQL.replace(f"select posting_no, {_clean('url')} as u from postings", f"select posting_no, {_clean('l')} as u, i from (select posting_no, unnest(ls) as l, generate_subscripts(ls, 1) as i from (select posting_no, list_concat([application_url], coalesce(source_urls, []), [url]) as ls from postings))")
    .replace("select posting_no, u, lower", "select posting_no, i, u, lower").replace("select posting_no, case when scheme", "select posting_no, arg_min(url, i) filter (url is not null) as link from (select posting_no, i, case when scheme") + ") group by posting_no",
)
def first_links(p):
    links = F.concat(F.array("application_url"), F.coalesce("source_urls", F.array().cast("array<string>")), F.array("url"))
    return p.select("posting_no", adapters.first_link(links).alias("link"))


@query(
    "q_search_records", "postings",
    sql=f"""select posting_no, case when {_clean('salary_source')} = 'direct_data' then 'disclosed' when {_clean('salary_currency')} <> '' then 'inferred' else 'unknown' end as evidence,
    case when platform in ('Talentbay') and is_remote = false then null else is_remote end as remote, case when {_clean('description')} <> '' then 'full' else 'missing' end as description_status,
    search_track || ':' || left(sha256(coalesce(platform, '') || '|' || coalesce(search_track, '') || '|' || coalesce(query_id, '')), 16) as plan from postings""",
)
def search_records(p):
    c = F.col
    return p.select(
        "posting_no", adapters.salary_evidence(c("salary_source"), c("salary_currency")).alias("evidence"), adapters.reported_remote(c("is_remote").cast("string"), c("platform"), ["talentbay"]).alias("remote"),
        F.when(text.clean_text(c("description")) != "", "full").otherwise("missing").alias("description_status"), adapters.plan_id(c("search_track"), c("platform"), c("search_track"), c("query_id")).alias("plan"),
    )


@query(
    "q_employer_ids", "postings",
    sql=f"""with c as ({_URL_SQL}), x as (select posting_no, url, regexp_extract(url, '^https://([^/?:]*)', 1) as host, regexp_extract(url, '^https://[^/?]*([^?]*)', 1) as path from c)
    select posting_no, case when host in ('jobmoor.example', 'www.jobmoor.example') and regexp_full_match(path, '/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+') then 'moor' when host in ('talentbay.example', 'www.talentbay.example') and regexp_full_match(path, '/jobs/view/(?:[^/]*-)?[0-9]+') then 'bay' end as provider,
    case when host like '%jobmoor.example' and regexp_full_match(path, '/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+') then regexp_extract(path, '([A-Za-z0-9_-]+)$', 1) when host in ('talentbay.example', 'www.talentbay.example') and regexp_full_match(path, '/jobs/view/(?:[^/]*-)?[0-9]+') then regexp_extract(path, '([0-9]+)$', 1) end as id from x""",
)
def employer_ids(p):
    found = p.select("posting_no", adapters.employer_posting(F.col("url"), _PROVIDERS).alias("e"))
    return found.select("posting_no", "e.provider", "e.id")


@query(
    "q_simplified_queries", "postings",
    sql="""select posting_no, concat_ws(' ', 'site:posts', case when contains(lower(title), 'lahore') then 'Lahore' when contains(lower(title), 'remote') then 'Remote' end,
    case when contains(lower(title), 'data') then 'Data' when contains(lower(title), 'nurse') then 'Nurse' else 'software' end, 'hiring') as query from postings where title is not null and not contains(title, 'site:')""",
)
def simplified_queries(p):
    rows = p.where("title is not null and not contains(title, 'site:')")
    return rows.select("posting_no", adapters.simplified(F.col("title"), ["Lahore", "Remote"], ["Data", "Nurse"], "site:posts", "software", "hiring").alias("query"))


@query(
    "q_recent_posts", "postings",
    sql="""select posting_no, coalesce(regexp_matches(url, '(?i)^https?://([^/?#@]*[.])?(jobmoor|talentbay)[.]example(:[0-9]*)?(/jobs/|/viewjob)'), false) as is_post,
    coalesce(floor((epoch_us(timestamp '2026-08-01') - epoch_us(captured_at)) / 86400000000.0) between 0 and 60, false) as recent from postings""",
)
def recent_posts(p):
    return p.select("posting_no", adapters.post_url(F.col("url"), _HOSTS, ["/jobs/", "/viewjob"]).alias("is_post"), adapters.recent(F.col("captured_at"), _now(), 60).alias("recent"))


@query("q_receipts_kept", "deliveries", "seen_identities", sql="select job_id, message_id, attempts from deliveries where job_id in (select identity from seen_identities)")
def receipts_kept(d, seen):
    return identity.retained(d, seen, "job_id", "identity").select("job_id", "message_id", "attempts")


@query(
    "q_cached_details", "postings",
    sql="""with d as (select url, arg_max(description, (length(description), -posting_no)) as description, arg_max(platform, (length(description), -posting_no)) as platform from postings where description_status = 'full' and description is not null and url is not null group by url),
    j as (select p.posting_no, p.title, p.description_status as old, p.description as own, d.description as text, coalesce(coalesce(p.description_status, '') <> 'full' and trim(d.description, ' ') <> '' and (d.platform is null or d.platform is not distinct from p.platform), false) as takes, coalesce(len(p.evidence_warnings), 0) as warned from postings p left join d on p.url = d.url)
    select posting_no, title, case when takes then 'full' else old end as status, md5(case when takes then text else own end) as text_md5, (warned + case when takes then 1 else 0 end)::integer as warnings from j""",
)
def cached_details(p):
    full = p.where("description_status = 'full' and description is not null and url is not null")
    best = F.max_by(F.struct("description", "platform"), F.struct(F.length("description").alias("n"), (-F.col("posting_no")).alias("o"))).alias("b")
    details = full.groupBy("url").agg(best).select("url", "b.description", "b.platform")
    cards = identity.apply_details(p.select("posting_no", "title", "url", "platform", "description", "description_status", "evidence_warnings"), details, "url", "platform")
    warnings = F.size(F.coalesce("evidence_warnings", F.array().cast("array<string>")))
    return cards.select("posting_no", "title", F.col("description_status").alias("status"), F.md5(F.col("description").cast("binary")).alias("text_md5"), warnings.alias("warnings"))


# --- more counts, gates and orders ----------------------------------------------------------------


@query(
    "q_precision_at_10", "postings", "feedback_labels",
    sql=f"""with d as (select job_id, max({_RANK} * 1000 + score) as s, min(posting_no) as o from ({_DECIDE.replace('select posting_no,', 'select posting_no,', 1)}) group by job_id), t as (select label from feedback_labels join d using (job_id) where s >= 1000 order by s desc, o limit 10)
    select count(*) as shown, round(count(*) filter (label = 'relevant') / nullif(count(*), 0), 4) as precision from t""",
)
def precision_at_10(p, labels):
    best = decided(p).groupBy("job_id").agg(F.max(rules.tier_rank(F.col("tier")) * 1000 + F.col("score")).alias("s"), F.min("posting_no").alias("o"))
    shown = labels.join(best, "job_id").where("s >= 1000")
    return metrics.precision_at(shown, [F.col("s").desc(), F.col("o")], 10, F.col("label") == "relevant")


@query("q_score_gate", "postings", sql=f"select posting_no, case when tier <> 'rejected' and score < 40 then 'review' else tier end as tier from ({_DECIDE})")
def score_gate(p):
    low = (F.col("tier") != rules.TIERS[0]) & (F.col("score") < 40)
    return decided(p).select("posting_no", F.when(low, rules.TIERS[1]).otherwise(F.col("tier")).alias("tier"))


@query(
    "q_delivery_counts", "deliveries",
    sql="""with b as (select date_trunc('day', attempted_at) as day, job_id, coalesce(bool_or(status = 'delivered'), false) as done, coalesce(bool_or(status = 'permanent_failure'), false) as lost from deliveries group by all)
    select epoch_us(day) as day_us, count(*) filter (done) as delivered, count(*) filter (not done) as failed, count(*) filter (not done and lost) as permanent from b group by day""",
)
def delivery_counts(d):
    out = metrics.delivery_counts(d.withColumn("day", F.date_trunc("day", "attempted_at")), "day", "job_id")
    return out.select(_us("day").alias("day_us"), "delivered", "failed", "permanent")


@query(
    "q_queue_counts", "deliveries", "postings",
    sql=f"""with b as (select distinct job_id from deliveries where job_id is not null), a as ({SQL['q_queue_build']}) select count(b.job_id) as initial, count(*) filter (b.job_id is null) as enqueued, count(*) filter (a.job_id is null) as removed,
    count(*) filter (a.status = 'pending') as pending, count(*) filter (a.status = 'exhausted') as exhausted from b full join a on a.job_id = b.job_id""",
)
def queue_counts(d, p):
    return metrics.queue_counts(d.where("job_id is not null"), queue_build(d, p), "job_id")


@query(
    "q_backend_order", "query_outcomes",
    sql=f"with h as (select backend, max(epoch_us(started_at)) filter ({_GOOD}) as healthy_us from {_OUT} where backend is not null group by backend) select backend, healthy_us, row_number() over (order by healthy_us desc nulls last, backend) as place from h",
)
def backend_order(o):
    """Backends, the one that worked last first; a configuration-sized list."""
    h = o.where("backend is not null").groupBy("backend").agg(F.max(F.when(F.col("status").isin(*metrics.GOOD), _us("started_at"))).alias("healthy_us"))
    return h.withColumn("place", F.row_number().over(Window.orderBy(F.col("healthy_us").desc_nulls_last(), "backend")).cast("bigint"))


@query(
    "q_admission_now", "query_outcomes",
    sql=f"""with h as (select run_id, max(epoch_us(started_at)) as last, count(*) filter (epoch_us(started_at) > epoch_us(timestamp '2026-06-01') - 31*86400*1000000::bigint and epoch_us(started_at) <= epoch_us(timestamp '2026-06-01')) as recent, min(raw) as remaining from {_OUT} group by run_id)
    select run_id, recent, case when last > epoch_us(timestamp '2026-06-01') then 'clock_ahead' when recent >= 30 then 'rolling_exhausted' when epoch_us(timestamp '2026-06-01') - last < 240*3600*1000000::bigint then 'minimum_interval' when remaining <= 5 then 'credit_reserve' when 1 >= remaining then 'hourly_limit' end as denial from h""",
)
def admission_now(o):
    o = o.distinct()
    account = o.groupBy("run_id").agg(F.min("raw").alias("remaining")).select("run_id", "remaining", F.lit(1).alias("hour_used"), F.col("remaining").alias("hour_limit"))
    return state.admission(o, "run_id", "started_at", F.lit("2026-06-01 00:00:00").cast("timestamp"), 30, 31, 240, account, 5)


# --- streams --------------------------------------------------------------------------------------


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """A stream run over everything there is, its rows written to shared storage and read back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    register(spark, path)
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_query(name: str, source: str, sql: str):
    """Register a query whose input is read as a stream of files."""

    def register(build):
        def start(spark: SparkSession, sf_dir: str) -> DataFrame:
            schema = table(spark, sf_dir, source).schema
            # a pattern, since a plain path must be a folder and the table may be one file
            return build(spark.readStream.schema(schema).parquet(f"{sf_dir}/{source}.parque[t]"))

        QUERIES[name] = start
        SQL[name] = sql
        return build

    return register


@stream_query("q_stream_dedup", "query_outcomes", sql="select run_id, query_id, site, phase from query_outcomes group by all")
def stream_dedup(o):
    keyed = o.withColumn("k", F.xxhash64("run_id", "query_id", "site", "phase"))
    return _drained(streams.deduplicated(keyed, "k", "started_at", "3650 days").select("run_id", "query_id", "site", "phase"), "dedup")


@stream_query(
    "q_stream_windows", "query_outcomes",
    sql="""with w as (select epoch_us(date_trunc('day', started_at)) as start_us, site, count(*) as n from query_outcomes where started_at is not null group by all)
    select start_us, site, n from w where start_us + 86400*1000000::bigint <= (select max(epoch_us(started_at)) from query_outcomes) - 7200*1000000::bigint""",
)
def stream_windows(o):
    """Requests per day and site; a day is given out once the watermark, two hours behind, has passed its end."""
    counts = _drained(streams.windowed_counts(o, "started_at", ["site"], "1 day", "2 hours"), "windows")
    return counts.select(_us("start").alias("start_us"), "site", "n")


@stream_query("q_stream_admission", "query_outcomes", sql="select site, count(*) as n, least(count(*), 3) as admitted from query_outcomes group by site")
def stream_admission(o):
    rows = _drained(streams.rolling_admission(o, "site", "started_at", "run_id", 3, 10**9), "admission")
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if("admitted").alias("admitted"))
