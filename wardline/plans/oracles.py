"""SQL counterparts of the registered queries, for DuckDB over the same tables.

They compute the expected values straight from the tables: no JSON is built or parsed, and
the windows are folded poll by poll over each config's whole history.
"""

from __future__ import annotations

from wardline.operators.normalize import DEFAULT_SOURCE
from wardline.plans.inputs import COUNTRIES, PATHS, RULES


def _case(index: str, values) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {index} {arms} end"


def _type_case(render, default: str) -> str:
    arms = " ".join(f"when '{t}' then {render(*rules)}" for t, rules in RULES.items())
    return f"case event_type {arms} else {default} end"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _padded(tags: list[str], size: int) -> list[str]:
    return tags + [""] * (size - len(tags))


# One row per delivery (arr) and per event (evt).
EVENTS = f"""
base as (
  select event_id, user_id, event_type, value,
    cast(regexp_extract(props, '[0-9]+') as integer) as k,
    cast(epoch_us(ts) // 1000000 as bigint) as epoch
  from events),
arr0 as (
  select base.*, 'cfg-' || (user_id % 2) as config_id, 'req-' || event_id as request_id,
    '198.51.' || (user_id // 256) || '.' || (user_id % 256) as client_ip,
    {_case('event_id % 7', PATHS)} as path,
    {_case('user_id % 6', COUNTRIES)} as country,
    nullif(cast(k as bigint), 0) as bot, nullif(cast(floor(value / 5) as bigint), 0) as risk,
    {_type_case(lambda ids, acts, tags: f"'{acts[0].lower()}'", "'none'")} as action,
    {_type_case(lambda ids, acts, tags: _list(_padded(tags, len(ids))), '[]::varchar[]')} as tags,
    case when event_id % 2 = 0 then 'GET' else 'POST' end as method,
    case when event_id % 2 = 0 then 'pol-1' else 'pol-2' end as policy_id,
    case when event_type = 'error' then '403' else '200' end as status,
    (epoch - 1704067200) // 1800 as poll0
  from base),
arr1 as (
  select arr0.*, poll0 + late as poll_no, late, event_id % 50 = 0 as twice
  from arr0, (values (0), (1)) l(late) where late = 0 or event_id % 50 = 0),
arr as (
  select arr1.*, 1704067200 + 30 * poll_no as poll_epoch,
    config_id || '@' || (1704067200 + 30 * poll_no) as batch_id,
    sha256(request_id || ':' || config_id || ':' || epoch) as id
  from arr1),
evt as (select * from arr where late = case when twice then 1 else 0 end)"""

POLLS = """
polls as (
  select config_id, poll_no, poll_epoch as t, batch_id, count(*) as ec,
    count(*) filter (event_type = 'error') as dc,
    count(*) filter (event_type in ('error', 'purchase', 'signup')) as ac,
    count(*) filter (event_type in ('click', 'signup')) as mc
  from arr group by all),
rated as (
  select *, cast(sum(ec) over h as double)
      / case when t = min(t) over h then 1 else (t - min(t) over h) / 60.0::double end as rate,
    row_number() over (partition by config_id order by t) as rn,
    (t - min(t) over (partition by config_id)) // 300 as tick,
    min(t) over (partition by config_id) as t0
  from polls
  window h as (partition by config_id order by t range between 3599 preceding and current row))"""


def _fold(deny: str, count: str, spike: str) -> str:
    """The accumulate-and-reset fold, one step per poll."""
    return f"""
fold as (
  select config_id, rn, t, tick, t0, batch_id, t as ws, ec, dc, ac, mc, 1 as polls,
    dc >= {deny} * ec as by_deny, ec >= {count} as by_count,
    rate > 0 and cast(ec as double) > rate * {spike} as by_spike
  from rated where rn = 1
  union all
  select config_id, rn, t, tick, t0, batch_id, ws, ec, dc, ac, mc, polls,
    cast(dc as double) / ec >= {deny}, ec >= {count},
    rate > 0 and cast(ec as double) / greatest(1.0::double, (t - ws) / 60.0::double) > rate * {spike}
  from (
    select n.config_id, n.rn, n.t, n.tick, n.t0, n.batch_id, n.rate,
      case when s.fresh then n.t else s.ws end as ws,
      case when s.fresh then 0 else s.ec end + n.ec as ec,
      case when s.fresh then 0 else s.dc end + n.dc as dc,
      case when s.fresh then 0 else s.ac end + n.ac as ac,
      case when s.fresh then 0 else s.mc end + n.mc as mc,
      case when s.fresh then 0 else s.polls end + 1 as polls
    from (
      select f.*, n.rn as next_rn, f.by_deny or f.by_count or f.by_spike or n.tick > f.tick as fresh
      from fold f join rated n on n.config_id = f.config_id and n.rn = f.rn + 1) s
    join rated n on n.config_id = s.config_id and n.rn = s.next_rn)),
ended as (
  select *, lead(tick) over (partition by config_id order by rn) > tick as ticked from fold),
win as (
  select config_id || '#' || ws * 1000 as window_id, config_id, ws, t as we,
    case when by_deny then 'severity_escalation' when by_count then 'event_count'
      when by_spike then 'severity_escalation' else 'time_ceiling' end as reason,
    ec, dc, ac, mc, polls, cast(dc as double) / ec as ratio, by_deny or by_spike as escalated,
    case when by_deny or by_count or by_spike then t else t0 + 300 * (tick + 1) end as closed
  from ended where by_deny or by_count or by_spike or ticked),
member as (
  select w.window_id, f.batch_id from fold f join win w on w.config_id = f.config_id and w.ws = f.ws)"""


WINDOWS = EVENTS + "," + POLLS + "," + _fold("0.3", "30", "3.0")
JOINED = WINDOWS + """,
we as (select m.window_id, e.* from member m join evt e on e.batch_id = m.batch_id)"""

FLAT_WINDOW = """select window_id, config_id, reason as trigger_reason, cast(ec as bigint) as event_count,
  cast(dc as bigint) as deny_count, cast(ac as bigint) as alert_count,
  cast(mc as bigint) as monitor_count, cast(polls as bigint) as polls, ws as window_start_s,
  we as window_end_s, cast(we - ws as bigint) as window_duration_seconds, ratio as deny_ratio,
  escalated as was_escalated, closed as closed_at_s from win"""


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes}\n{body}"


def _win(body: str) -> str:
    return _with(WINDOWS, body, True)


def _we(body: str) -> str:
    return _with(JOINED, body, True)


def _top(value: str, source: str = "we") -> str:
    return _we(f"""
select window_id, value, n, rank from (
  select *, row_number() over (partition by window_id order by n desc, value) as rank from (
    select window_id, {value} as value, count(*) as n from {source}
    where {value} <> '' group by all))
where rank <= 10""")


def _avg(col: str) -> str:
    return f"floor(coalesce(avg({col}), 0) * 100 + 0.5) / 100"


TOPS = """,
cnt as (
  select window_id, kind, value, count(*) as n, count(*) filter (deny) as dn from (
    select window_id, 'ip' as kind, client_ip as value, action = 'deny' as deny from we
    union all select window_id, 'path', path, action = 'deny' from we
    union all select window_id, 'country', country, action = 'deny' from we
    union all select window_id, 'tag', unnest(tags), action = 'deny' from we)
  where value <> '' group by all),
top as (
  select * from (
    select *, row_number() over (partition by window_id, kind order by n desc, value) as rk from cnt)
  where rk <= 10),
busy as (
  select window_id, sum(dn) as dn, sum(dn) filter (drk <= 4) as top_dn from (
    select *, row_number() over (partition by window_id order by dn desc, value) as drk
    from cnt where kind = 'ip' and dn > 0) group by 1),
cls as (
  select w.*, coalesce(top_dn >= 0.5 * dn, false) as coordinated,
    case when ratio > 0.5 and coalesce(top_dn >= 0.5 * dn, false) then 'critical'
      when ratio >= 0.3 then 'high' when ratio >= 0.15 then 'medium'
      when ratio > 0 then 'low' else 'info' end as severity
  from win w left join busy using (window_id)),
agg as (
  select window_id, count(*) as stored, count(distinct nullif(client_ip, '')) as ips,
    """ + _avg("bot") + " as avg_bot, " + _avg("risk") + """ as avg_risk,
    count(*) filter (bot >= 80) as bot80
  from we group by 1),
summ as (
  select c.*, coalesce(stored, 0) as stored, coalesce(ips, 0) as ips, coalesce(avg_bot, 0) as avg_bot,
    coalesce(avg_risk, 0) as avg_risk, coalesce(bot80, 0) as bot80,
    case when escalated then 'sonnet' else 'haiku' end as tier,
    'Window ' || c.window_id || ': busiest [ip::' || coalesce(i1.value, '-') || '], then [ip::'
      || coalesce(i2.value, '-') || ']' as analysis
  from cls c left join agg using (window_id)
  left join top i1 on i1.window_id = c.window_id and i1.kind = 'ip' and i1.rk = 1
  left join top i2 on i2.window_id = c.window_id and i2.kind = 'ip' and i2.rk = 2),
strat as (
  select 's-' || config_id || '-' || hr as id, config_id, created, te, td,
    case when hr % 5 = 0 then 'failed' else 'complete' end as status,
    case when cast(td as double) / te >= 0.2 then 'medium' else 'low' end as severity,
    'Hour of ' || config_id || ' with ' || te || ' events' as analysis
  from (select config_id, closed // 3600 as hr, max(closed) as created,
      cast(sum(ec) as bigint) as te, cast(sum(dc) as bigint) as td from win group by 1, 2))"""


def _sum(body: str, more: str = "") -> str:
    return _with(JOINED + TOPS + more, body, True)


def _trend(name: str, kind: str, n: int) -> str:
    return _sum(f"""
select config_id, {name}, count from (
  select *, row_number() over (partition by config_id order by count desc, {name}) as rk from (
    select config_id, value as {name}, cast(sum(n) as bigint) as count
    from top join win using (window_id) where kind = '{kind}' group by all))
where rk <= {n}""")


NEWEST = "select *, row_number() over (order by closed desc, window_id) as rk from summ"
NEWEST_BY_CONFIG = (
    "select *, row_number() over (partition by config_id order by closed desc, window_id) as rk"
    " from summ"
)

USAGE = """
usage as (
  select o_orderkey as call_seq, cast(o_orderdate as date) as date, o_orderkey % 4 as tr,
    case o_orderkey % 4 when 0 then 'haiku' when 1 then 'sonnet' when 2 then 'opus'
      else 'unknown' end as tier,
    cast(floor(o_totalprice) as bigint) as ti, cast(floor(o_totalprice) as bigint) // 4 as tk
  from orders),
cost as (
  select *, case tier when 'haiku' then ti * 250 + tk * 1250 when 'sonnet' then ti * 3000 + tk * 15000
    when 'opus' then ti * 15000 + tk * 75000 else 0 end as nano from usage),
day as (
  select date, cast(sum(nano) as bigint) as total, count(*) as calls,
    count(*) filter (tier <> 'haiku') as esc,
    """ + ",\n    ".join(
    f"cast(coalesce(sum({col}) filter (tier = '{tier}'), 0) as bigint) as {tier}_{side}_tokens"
    for tier in ("haiku", "sonnet", "opus")
    for side, col in (("input", "ti"), ("output", "tk"))
) + """
  from cost where tier <> 'unknown' group by 1)"""

WINDOW_CALLS = """,
calls as (
  select window_id, closed, closed // 86400 as day,
    cast(case when escalated then ec * 300 * 3000 + ec * 60 * 15000
      else ec * 300 * 250 + ec * 60 * 1250 end as bigint) as nano, escalated
  from win),
spent as (
  select *, cast(sum(nano) over (partition by day order by closed, window_id) as bigint) as upto
  from calls)"""


def _bucket_counts(score: str) -> list[str]:
    """Counts of the five ranges of a score; the outer ones are open."""
    bounds = ["{} < 20", *(f"{{}} >= {b} and {{}} < {b + 20}" for b in (20, 40, 60)), "{} >= 80"]
    return [f"count(*) filter ({b.replace('{}', score)})" for b in bounds]


def _decoded(lists: str) -> str:
    return f"array_to_string({lists}, '|')"


def oracle_sql() -> dict[str, str]:
    ev = lambda body: _with(EVENTS, body)
    polls = lambda body: _with(EVENTS + "," + POLLS, body)
    acts = _type_case(lambda ids, a, tags: "'" + "|".join(a) + "'", "''")
    lower_acts = _type_case(lambda ids, a, tags: "'" + "|".join(x.lower() for x in a) + "'", "''")
    raw_tags = _type_case(lambda ids, a, tags: "'" + "|".join(tags) + "'", "''")
    n_rules = _type_case(lambda ids, a, tags: str(len(ids)), "0")
    rule_rows = " union all ".join(
        f"select '{t}' as event_type, {i} as rule_pos, '{rule}' as rule, '{acts_[i]}' as rule_action,"
        f" '{tags[i] if i < len(tags) else ''}' as rule_tag"
        for t, (ids, acts_, tags) in RULES.items()
        for i, rule in enumerate(ids)
    )
    served = (
        "select id, batch_id, client_ip, path, country as geo_country, action as rule_action_summary,"
        " cast(epoch as double) as event_time_epoch"
    )
    usage = lambda body: _with(USAGE, body)
    day_cols = (
        "haiku_input_tokens, haiku_output_tokens, sonnet_input_tokens, sonnet_output_tokens,"
        " opus_input_tokens, opus_output_tokens"
    )
    sampled = """
flag as (
  select window_id, id, poll_epoch, event_id, action = 'deny' as d, coalesce(risk >= 20, false) as r,
    coalesce(bot >= 20, false) as b, md5(id || ':0') as h, count(*) over (partition by window_id) as total
  from we),
s1 as (select *, d and count(*) filter (d) over w <= 4 as t1 from flag
  window w as (partition by window_id order by poll_epoch, event_id)),
s2 as (select *, not t1 and r and count(*) filter (r and not t1) over w <= 3 as t2 from s1
  window w as (partition by window_id order by poll_epoch, event_id)),
s3 as (select *, not t1 and not t2 and b and count(*) filter (b and not t1 and not t2) over w <= 2 as t3
  from s2 window w as (partition by window_id order by poll_epoch, event_id)),
s4 as (select *, t1 or t2 or t3 as taken, count(*) filter (t1 or t2 or t3) over (partition by window_id) as n
  from s3),
s5 as (select *, case when total <= 12 then 0 when t1 then 1 when t2 then 2 when t3 then 3
    when row_number() over (partition by window_id, taken order by h) <= 12 - n then 4 end as tier
  from s4)"""
    # an empty text is written as nothing and read back as null
    export_cols = """id, client_ip as "clientIP", method,
  case when path = '/console' then '/console,"a b"' || chr(10) || country else nullif(path, '') end as path,
  action as "ruleActionSummary", nullif(country, '') as "geoCountry", bot as "botScore", risk as "userRiskScore",
  strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as "eventTime",
  status as "responseStatus\""""
    merged = ev("""
select id, batch_id, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d') as event_date from evt""")
    retained = ev(
        "select id, cast(epoch as double) as event_time_epoch from evt"
        " where poll_epoch >= 1704067200 + 6 * 3600"
    )
    found = {
        # sources
        "read_raw_ndjson": ev("""
select config_id, poll_epoch, request_id, cast(null as bigint) as total from arr
union all select config_id, poll_epoch, '', count(*) from arr group by 1, 2"""),
        "read_raw_files": ev("""
select config_id, poll_epoch, count(*) + count(*) filter (event_id % 97 = 0) + 1 as lines,
  count(*) filter (event_id % 97 = 0) as malformed, cast(1 as bigint) as metadata, count(*) as events
from arr group by 1, 2"""),
        "line_quality": ev("""
select config_id, poll_epoch, count(*) + count(*) filter (event_id % 97 = 0) + 1 as lines,
  count(*) filter (event_id % 97 = 0) as malformed, cast(1 as bigint) as metadata, count(*) as events
from arr group by 1, 2"""),
        "split_batch_metadata": ev("""
select config_id, poll_epoch, count(*) as total, 'o' || poll_no as "offset"
from arr group by config_id, poll_epoch, poll_no"""),
        "tag_batch": ev("""
select batch_id, config_id, poll_epoch, count(*) as n, poll_epoch as poll_time_s
from arr group by all"""),
        "incremental_slice": ev("""
select config_id, request_id, poll_no from arr, (select max(poll_no) as last_0 from arr
  where config_id = 'cfg-0' and poll_no < 1400)
where (config_id = 'cfg-0' and poll_no > last_0)
  or (config_id = 'cfg-1' and epoch >= 1704067200 + 12 * 3600 - 3 * 3600)"""),
        "ingest_stream": ev("select id, batch_id, client_ip from evt"),
        "ingest_event_table": ev("select id, batch_id, client_ip from evt"),
        "ingest_slice": ev("""
select config_id, batch_id, request_id from arr join (select config_id, max(poll_no) as last from arr
  where poll_no < 1400 group by 1) l using (config_id) where poll_no > last"""),
        "ingest_poll_log": polls("""
select batch_id, ec as event_count, dc as deny_count, ac as alert_count, mc as monitor_count,
  'o' || poll_no as last_offset from polls"""),
        # decode and normalise
        "decode_fields": ev(f"select request_id, batch_id, {raw_tags} as tags, {acts} as actions from arr"),
        "assemble_rules": ev(f"""
select id, batch_id, cast(rule_pos as integer) as rule_pos, rule, '4' as rule_version,
  'Rule ' || rule || ' matched' as rule_message, rule_tag, '' as rule_data, '' as rule_selector,
  rule_action
from arr join ({rule_rows}) r using (event_type)"""),
        "action_summary": ev(
            "select config_id, action as rule_action_summary, count(*) as n from arr group by all"
        ),
        "severity_indicators": ev(f"""
select id, batch_id, event_type = 'error' as has_deny, false as has_tarpit,
  cast({n_rules} as bigint) as rule_count, {lower_acts} as actions from arr"""),
        "map_fields": ev("""
select config_id, policy_id, batch_id, client_ip, request_id, 'HTTP/1.1' as protocol, method,
  'www.example.com' as host, '443' as port, path, '' as query, status as response_status,
  case when event_id % 5000 = 0 then '' else (event_id % 5000)::varchar end as response_bytes,
  country as geo_country, '' as geo_city, '' as user_risk_uuid from arr"""),
        "event_id": ev("select distinct id from arr"),
        "event_time": ev("""
select epoch::varchar as start, cast(epoch as double) as event_time_epoch,
  epoch * 1000 as event_time_ms from arr"""),
        "lenient_ints": ev("""
select config_id, bot as bot_score, risk as user_risk_score, count(*) as n from arr group by all"""),
        "rules_long": ev(f"""
select config_id, rule, rule_tag, rule_action, count(*) as n
from arr left join ({rule_rows}) r using (event_type) group by all"""),
        # upkeep
        "upsert_latest": ev("select id, batch_id, client_ip from evt"),
        "apply_retention": retained,
        "purge_events": retained,
        "poll_state": polls("""
select config_id, t as poll_time_s, batch_id as last_batch_id, ec as events_in_last_batch,
  cast(sum(ec) over (partition by config_id, t // 86400 order by t) as bigint) as total_events_today
from polls"""),
        "poll_health": _win("""
select c.config_id, case when c.config_id = '' then 'unconfigured' when p.t is null then 'idle'
    else 'active' end as status, p.t as last_poll_time_s, p.ec as events_in_last_batch,
  p.today as total_events_today, nano / 1e9::double as today_usd,
  greatest(0, 10000000000 - nano) / 1e9::double as budget_remaining_usd,
  nano >= 10000000000 as budget_cap_reached, n as analysis_count
from (select case when n_nationkey = 24 then '' else 'cfg-' || n_nationkey end as config_id from nation) c
left join (
  select config_id, max(t) as t, max_by(ec, t) as ec, cast(sum(ec) as bigint) as today
  from polls where t <= 1704067200 + 23 * 3600 group by 1) p using (config_id),
(select cast(sum(nano) as bigint) as nano, count(*) as n from calls where day = 1704067200 // 86400)""").replace(
            WINDOWS, WINDOWS + WINDOW_CALLS
        ),
        "config_current": """
select p_brand as "key", max_by(p_size, p_partkey)::varchar as value,
  1704067200 + max(p_partkey) * 60 as updated_at_s from part group by 1""",
        "config_history": """
select p_brand as "key", p_size::varchar as value, p_partkey as change_seq,
  1704067200 + p_partkey * 60 as valid_from_s,
  1704067200 + lead(p_partkey) over (partition by p_brand order by p_partkey) * 60 as valid_to_s
from part""",
        "with_user": """
select p_brand as "key", p_partkey as change_seq, (p_partkey % 1500)::varchar as updated_by_user_id,
  c_name || '@example.com' as updated_by_email, c_name as updated_by_name
from part left join customer on c_custkey = p_partkey % 1500""",
        "upsert_users": """
with lg as (
  select o_orderkey as seq, o_orderdate as login_at, c_name || case o_orderstatus when 'F' then '@example.com'
      else '@partner.example.com' end as email,
    case when o_orderpriority = '5-LOW' then null else c_name || '/' || o_orderstatus end as name
  from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P'),
per as (
  select email, arg_min(coalesce(name, ''), row(login_at, seq)) as first_name,
    arg_max(name, row(login_at, seq)) filter (name is not null) as new_name,
    max(login_at) as last_at, count(*) as n from lg group by 1),
u as (select c_custkey::varchar as id, c_name || '@example.com' as email, c_name as name,
  case when c_nationkey = 0 then 'admin' else 'analyst' end as role from customer)
select coalesce(id, left(sha256(email), 32)) as id, email,
  coalesce(new_name, case when id is not null then u.name else first_name end) as name,
  case when id is not null then 'directory' else 'oidc' end as provider,
  coalesce(role, 'analyst') as role,
  cast(case when id is not null or n > 1 then epoch_us(last_at) // 1000000 end as bigint) as last_login_at_s
from u full join per using (email)""",
        # windows
        "poll_aggregate": polls("""
select config_id, batch_id, t as poll_time_s, ec as event_count, dc as deny_count, ac as alert_count,
  mc as monitor_count from polls"""),
        "baseline_rate": polls("select batch_id, rate as baseline_rate from rated"),
        "analysis_windows": _win(FLAT_WINDOW),
        "trigger_event_count": _win(FLAT_WINDOW + " where reason = 'event_count'"),
        "trigger_severity_escalation": _win(
            FLAT_WINDOW + " where reason = 'severity_escalation' and ratio >= 0.3"
        ),
        "trigger_rate_spike": _with(
            EVENTS + "," + POLLS + "," + _fold("2.0", "1000000000", "1.2"), FLAT_WINDOW, True
        ),
        "trigger_time_ceiling": _win(FLAT_WINDOW + " where reason = 'time_ceiling'"),
        "stream_windows": _win(FLAT_WINDOW),
        "route_tier": _with(
            WINDOWS + WINDOW_CALLS,
            """
select window_id, case when escalated then 'sonnet' else 'haiku' end as tier, closed as closed_at_s
from spent where upto - nano < 1500000000""",
            True,
        ),
        # statistics
        "window_events": _we("select window_id, id, batch_id from we"),
        "top_ips": _top("client_ip"),
        "top_paths": _top("path"),
        "top_countries": _top("country"),
        "top_rule_tags": _top("tag", "(select window_id, unnest(tags) as tag from we)"),
        "unique_ips": _we(
            "select window_id, count(distinct nullif(client_ip, '')) as unique_ips from we group by 1"
        ),
        "unique_ips_sketched": _win(
            "select window_id, count(distinct nullif(client_ip, '')) as unique_ips"
            " from member join arr using (batch_id) group by 1"
        ),
        "avg_scores": _we(
            f"select window_id, {_avg('bot')} as avg_bot_score, {_avg('risk')} as avg_user_risk_score"
            " from we group by 1"
        ),
        "score_distribution": _we("""
select window_id, score, bucket, count(v) filter (v >= lo and v < hi) as n
from (select window_id, 'bot_score' as score, bot as v from we
  union all select window_id, 'user_risk_score', risk from we),
  (values ('0-19', -1000000, 20), ('20-39', 20, 40), ('40-59', 40, 60), ('60-79', 60, 80),
    ('80-100', 80, 1000000)) b(bucket, lo, hi)
group by all"""),
        "priority_sample": _with(
            JOINED + "," + sampled,
            """
select window_id, id, case tier when 0 then 'all' when 1 then 'deny' when 2 then 'risk' when 3 then 'bot'
    else 'fill' end as tier,
  row_number() over (partition by window_id order by tier,
    case when tier = 4 then h else '' end, poll_epoch, event_id) as sample_pos
from s5 where tier is not null""",
            True,
        ),
        "classify_severity": _sum(
            "select window_id, ratio as deny_ratio, coordinated, severity from cls"
        ),
        "window_summary": _sum("""
select s.window_id, config_id, config_id || '@' || ws as batch_id, reason as trigger_reason,
  tier as model_used, severity, cast(ec as bigint) as event_count, stored as stored_events,
  cast(dc as bigint) as deny_count, s.ips as unique_ips, cast(avg_bot as double) as avg_bot_score,
  cast(avg_risk as double) as avg_user_risk_score, i.value as top_ip, i.n as top_ip_count,
  g.value as top_rule_tag, coalesce(p.listed, 0) as paths_listed, bot80 as bot_80_100,
  coalesce(l.ips, '') as top_ips, coalesce(l.paths, '') as top_paths,
  coalesce(l.countries, '') as top_countries, coalesce(l.tags, '') as top_rule_tags,
  coalesce(d.bots, '0|0|0|0|0') as bot_score_distribution,
  coalesce(d.risks, '0|0|0|0|0') as user_risk_score_distribution
from summ s
left join (
  select window_id, string_agg(value || ':' || n, '|' order by rk) filter (kind = 'ip') as ips,
    string_agg(value || ':' || n, '|' order by rk) filter (kind = 'path') as paths,
    string_agg(value || ':' || n, '|' order by rk) filter (kind = 'country') as countries,
    string_agg(value || ':' || n, '|' order by rk) filter (kind = 'tag') as tags
  from top group by 1) l on l.window_id = s.window_id
left join (
  select window_id, concat_ws('|', """ + ", ".join(_bucket_counts("bot")) + """) as bots,
    concat_ws('|', """ + ", ".join(_bucket_counts("risk")) + """) as risks
  from we group by 1) d on d.window_id = s.window_id
left join top i on i.window_id = s.window_id and i.kind = 'ip' and i.rk = 1
left join top g on g.window_id = s.window_id and g.kind = 'tag' and g.rk = 1
left join (select window_id, count(*) as listed from top where kind = 'path' group by 1) p
  on p.window_id = s.window_id"""),
        "batch_request": _with(
            JOINED + TOPS + "," + sampled,
            """
select s.window_id, config_id, tier, least(12, stored) as sampled,
  printf('%.1f%%', floor(ratio * 1000 + 0.5) / 10) as deny_ratio,
  strftime(make_timestamp(ws * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as window_start,
  ips as unique_ips, i.value as top_ip, f.id as first_event, f.rule as first_rule
from summ s
left join top i on i.window_id = s.window_id and i.kind = 'ip' and i.rk = 1
left join (
  select p.window_id, p.id, w.rule from (
    select *, row_number() over (partition by window_id order by tier,
      case when tier = 4 then h else '' end, poll_epoch, event_id) as pos
    from s5 where tier is not null) p
  join (select window_id, id, list_filter(tags, lambda x: x <> '')[1] as rule from we) w
    on w.window_id = p.window_id and w.id = p.id
  where pos = 1) f on f.window_id = s.window_id""",
            True,
        ),
        "parse_response": """
with c as (
  select conv_id || '-' || turn as response_id, conv_id % 3 as kind, role, turn, text,
    role || ' turn [ip::198.51.0.' || conv_id % 256 || ']' as said from conversations)
select response_id, kind <> 2 as is_json, case when kind = 2 then text else said end as analysis,
  case when kind <> 2 and turn % 3 = 0 then 'critical' when kind <> 2 and turn % 3 = 1 then 'high'
    else 'info' end as severity,
  case when kind = 2 then '' else role end as flags, '' as notable_ips,
  case when kind = 2 then 0 else turn end as total_events
from c""",
        # trends
        "latest_windows": _sum(
            f"select window_id, config_id, severity, closed as created_at_s from ({NEWEST_BY_CONFIG})"
            " where rk <= 20"
        ),
        "severity_counts": _sum(
            "select config_id, "
            + ", ".join(
                f"count(*) filter (severity = '{s}') as {s}"
                for s in ("critical", "high", "medium", "low", "info")
            )
            + " from cls group by 1"
        ),
        "deny_ratio_trend": _win("""
select config_id, closed as time_s, ratio as deny_ratio, cast(ec as bigint) as event_count from win"""),
        "persistent_ips": _sum("""
select config_id, ip, batch_count from (
  select *, row_number() over (partition by config_id order by batch_count desc, ip) as rk from (
    select config_id, value as ip, count(*) as batch_count from top join win using (window_id)
    where kind = 'ip' and rk <= 3 group by all having count(*) >= 2))
where rk <= 20"""),
        "rule_tag_trend": _trend("tag", "tag", 15),
        "country_trend": _trend("country", "country", 10),
        "window_table": _sum(f"""
select config_id, rk as batch, closed as time_s, severity, cast(ec as bigint) as event_count,
  cast(dc as bigint) as deny_count, ratio as deny_ratio, ips as unique_ips,
  cast(avg_bot as double) as avg_bot_score, cast(avg_risk as double) as avg_user_risk_score,
  reason as flags from ({NEWEST_BY_CONFIG}) where rk <= 20"""),
        "notable_windows": _sum("""
select s.window_id, severity, closed as time_s, analysis, coalesce(ips, '') as notable_ips,
  coalesce(tags, '') as notable_patterns
from summ s left join (
  select window_id, string_agg(value, '|' order by rk) filter (kind = 'ip' and rk <= 3) as ips,
    string_agg(value, '|' order by rk) filter (kind = 'tag' and rk <= 2) as tags
  from top group by 1) t on t.window_id = s.window_id
where severity in ('critical', 'high')""").replace("analysis, coalesce(ips", "analysis, coalesce(t.ips"),
        "latest_prior": _sum("""
select id, analysis, severity, created as created_at_s from strat where status = 'complete'
order by created desc, id limit 1"""),
        "strategic_request": _sum(
            """
select cast(20 as bigint) as batch_count, 'opus' as tier,
  (select '{' || """
            + " || ',' || ".join(
                f"'\"{s}\":' || count(*) filter (severity = '{s}')"
                for s in ("critical", "high", "medium", "low", "info")
            )
            + """ || '}' from last) as severities,
  (select coalesce('[' || string_agg('{"ip":"' || ip || '","batch_count":' || n || '}', ',' order by n desc, ip)
      || ']', 'none') from (
    select value as ip, count(*) as n from top join last using (window_id)
    where kind = 'ip' and top.rk <= 3 group by 1 having count(*) >= 2 order by n desc, ip limit 20)) as persistent_ips,
  (select coalesce('[' || string_agg('{"country":"' || c || '","count":' || n || '}', ',' order by n desc, c)
      || ']', 'nothing known') from (
    select value as c, cast(sum(n) as bigint) as n from top join last using (window_id)
    where kind = 'country' group by 1 order by n desc, c limit 10)) as countries,
  (select analysis from strat where status = 'complete' order by created desc, id limit 1) as prior_analysis""",
            ",\nlast as (select * from (" + NEWEST + ") where rk <= 20)",
        ),
        "hourly_request": _sum("""
select config_id, hr * 3600 as interval_start_s, count(*) as batch_count, count(*) as listed_count, 'sonnet' as tier,
  max(window_id) filter (rk = 1) as newest_window, max(analysis) filter (rk = 1) as newest_analysis
from (select *, row_number() over (partition by config_id, hr order by closed desc, window_id) as rk
  from (select *, closed // 3600 as hr from summ))
group by config_id, hr"""),
        "complete_windows": _sum("""
select window_id, ec % 4 < 3 as answered,
  case ec % 4 when 0 then 'Window ' || window_id when 1 then '{"analysis":"","severity":""}'
    when 2 then 'Quiet ' || window_id else '' end as analysis,
  case ec % 4 when 0 then 'high' when 3 then severity else 'info' end as severity,
  case when ec % 4 = 0 then reason else '' end as flags,
  case when ec % 4 = 0 then '198.51.0.1' else '' end as notable_ips, 0::bigint as n_patterns,
  tier as model_used, cast(case when ec % 4 < 3 then ec * 300 else 0 end as bigint) as input_tokens,
  cast(case when ec % 4 < 3 then ec * 60 else 0 end as bigint) as output_tokens,
  case when ec % 4 = 3 then 0 when escalated then ec * 300 * 3000 + ec * 60 * 15000
    else ec * 300 * 250 + ec * 60 * 1250 end / 1e9::double as estimated_cost_usd,
  ips as unique_ips from summ"""),
        "strategic_summary": _sum(f"""
select r.*, 'opus' as model,
  cast(1706659200 - 168 * 3600 as bigint) as window_start_s, 1706659200::bigint as window_end_s,
  count(*) as batch_summary_count, string_agg(window_id, '|' order by rk) as batch_summary_ids,
  cast(sum(ec) as bigint) as total_events, cast(sum(dc) as bigint) as total_denies,
  cast(sum(ac) as bigint) as total_alerts
from ({NEWEST}), (values
  ('scheduled-20240131T000000', '{DEFAULT_SOURCE}', null, null, null, null, null, null, null, null,
    null, null::bigint, null::bigint, null::double, 'running', 'scheduled'),
  ('run-1', '{DEFAULT_SOURCE}', 'ann@example.com', '17', '24h', 'calm', 'low', 'f', 'r|s', 'good',
    '[{{"events":3,"name":"c1"}}]', 4000, 500,
    (4000 * 15000 + 500 * 75000) / 1e9::double, 'complete', 'on_demand'),
  ('run-2', '{DEFAULT_SOURCE}', 'debug', null, null, 'Analysis error at [call_model]: timeout', null,
    null, null, null, null, null, null, null, 'failed', 'debug')
) r(id, source, requested_by, requested_by_user_id, time_range_requested, analysis, severity, flags,
  recommendations, policy_effectiveness_notes, campaigns, input_tokens, output_tokens,
  estimated_cost_usd, status, trigger_type)
where rk <= 20 group by all"""),
        "merge_events": merged,
        "compact_events": merged,
        # serving
        "event_by_id": ev(f"{served} from evt where id = (select min(id) from arr)"),
        "query_events": ev(
            f"{served} from evt where country = 'US' and action = 'deny' order by epoch desc, id limit 200"
        ),
        "query_events_in_range": ev(
            f"{served} from evt where path = '/console' and epoch between 1704067200 + 864000"
            " and 1704067200 + 1296000"
        ),
        "query_events_range_after_limit": ev(
            f"select * from ({served} from evt where path = '/find' order by epoch desc, id limit 300)"
            " where event_time_epoch between 1704067200 + 26 * 86400 and 1704067200 + 29 * 86400"
        ),
        "query_events_all": ev(f"{served} from evt where country = 'RU'"),
        "ip_drilldown": ev("""
select epoch as event_time_s, method, path, action as rule_action_summary, country as geo_country,
  bot as bot_score, id from evt where client_ip = '198.51.0.7' order by epoch desc, id limit 50"""),
        "batch_page": ev("""
select t.batch_id, total, id, client_ip
from (select batch_id, count(*) as total from evt where batch_id = 'cfg-0@1704070200' group by 1) t
left join (select batch_id, id, client_ip from evt where batch_id = 'cfg-0@1704070200'
  order by id limit 5 offset 2) p using (batch_id)"""),
        "analysis_stream": _sum(f"""
select window_id as id, 'batch' as type, closed as created_at_s, severity, cast(ec as bigint) as events,
  tier as model, cast(dc as bigint) as deny_count from (
  select *, row_number() over (order by rk) as r from ({NEWEST}) where severity = 'high') where r <= 100
union all
select id, 'strategic', created, severity, te, 'opus', null from (
  select *, row_number() over (order by created desc, id) as rk from strat where status = 'complete')
where rk <= 10"""),
        "analysis_by_id": _sum("""
select 'strategic' as type, id, created as created_at_s, severity, analysis, te as events
from strat where id = 's-cfg-0-473352'"""),
        "volume_series": _sum(f"""
select closed as time_s, window_id, cast(ec as bigint) as event_count, cast(dc as bigint) as deny_count,
  severity from ({NEWEST}) where rk <= 100"""),
        "scaled_series": _sum(f"""
select point, floor((2 + case when n = 1 then 98.0 else (point - 1) / cast(n - 1 as double) * 196.0 end)
    * 10 + 0.5) / 10 as x,
  floor((2 + 36.0 - ec / cast(mx as double) * 36.0::double) * 10 + 0.5) / 10 as event_y,
  floor((2 + 36.0 - dc / cast(mx as double) * 36.0::double) * 10 + 0.5) / 10 as deny_y
from (select ec, dc, row_number() over (order by closed, window_id desc) as point, count(*) over () as n,
    greatest(1, max(ec) over (), max(dc) over ()) as mx from ({NEWEST}) where rk <= 100)"""),
        "score_bands": ev(
            "select "
            + ", ".join(
                f"case when {c} is null then '' when {c} >= 80 then 'critical' when {c} >= 60 then 'high'"
                f" when {c} >= 40 then 'medium' else 'low' end as {name}"
                for c, name in (("bot", "bot_band"), ("risk", "risk_band"))
            )
            + ", count(*) as n from evt group by all"
        ),
        "previews": """
select doc_id, case when length(text) > 500 then left(text, 500) || '...' else text end as preview
from documents""",
        "entity_references": _sum("""
select c.window_id as analysis_id, 'ip' as kind, cast(rk as bigint) as pos, coalesce(value, '-') as ref
from (select window_id, rk from win, (values (1), (2)) r(rk)) c
left join (select window_id, rk, value from top where kind = 'ip') t
  on t.window_id = c.window_id and t.rk = c.rk""").replace("cast(rk as bigint)", "cast(c.rk as bigint)"),
        "referenced_events": ev("""
select a.request_id as analysis_id, a.id as ref, cast(e.epoch as double) as event_time_epoch, e.client_ip,
  e.path, e.action as rule_action_summary from arr a left join evt e on e.id = a.id"""),
        "window_counts": _win("""
select count(*) as count_all, count(*) filter (closed > 1704693600 - 168 * 3600) as count_filtered from win"""),
        "export_ndjson": ev("""
select id, client_ip, tags[2] as second_tag, bot as bot_score, bot is null as null_kept
from evt where action = 'deny'"""),
        "export_csv": ev(f"select {export_cols} from evt"),
        "export_manifest": ev("""
select 'export-' || country as id, 'complete' as status, 'csv' as format, count(*) as actual_rows,
  true as has_data, 1706659200::bigint as created_at_s, 1706659200::bigint as completed_at_s
from evt where country <> '' group by country"""),
        # spend
        "call_cost": usage("select call_seq, tier, nano as cost_nano from cost"),
        "daily_spend": usage(f"""
select strftime(date, '%Y-%m-%d') as date, {day_cols}, total as total_nano, calls as analysis_call_count,
  esc as escalation_count, total / 1e9::double as estimated_total_usd,
  total >= 5000000000 as budget_warning_fired, total >= 10000000000 as budget_cap_reached from day"""),
        "budget_flags": usage("""
select strftime(date, '%Y-%m-%d') as date, min(call_seq) filter (upto >= 5000000000) as warning_call,
  min(call_seq) filter (upto >= 10000000000) as cap_call
from (select *, sum(nano) over (partition by date order by call_seq) as upto from cost
  where tier <> 'unknown') group by 1"""),
        "budget_gate": usage("""
select call_seq, nano as cost_nano, cast(upto - nano as bigint) as spent_before,
  upto - nano < 10000000000 as admitted
from (select *, sum(nano) over (partition by date order by call_seq) as upto from cost)"""),
        "cost_summary": usage("""
select strftime(d, '%Y-%m-%d') as date, coalesce(total, 0) / 1e9::double as estimated_total_usd,
  coalesce(calls, 0) as analysis_call_count, coalesce(esc, 0) as escalation_count,
  coalesce(total, 0) >= 5000000000 as budget_warning_fired,
  coalesce(total, 0) >= 10000000000 as budget_cap_reached,
  greatest(0, 10000000000 - coalesce(total, 0)) / 1e9::double as budget_remaining_usd
from (select unnest(generate_series(min(date), max(date), interval 1 day))::date as d from usage)
left join day on day.date = d"""),
    }
    # the same records from counts per poll, and stored as windows close
    found["window_summary_from_counts"] = found["stored_summaries"] = found["window_summary"]
    found["stored_rule_tag_trend"] = found["rule_tag_trend"]
    return found
