"""Reference SQL for the checks: common table expressions that rebuild the test views independently of the operators."""

from __future__ import annotations

from collections.abc import Sequence

PI = "3.141592653589793"

E = """
e as (
  select event_id, match_id, k, match_id*2 + k%2 as team_id, match_id*2 + 1 - k%2 as opponent_team_id,
    case event_type when 'click' then 'Pressure' when 'view' then 'Pass' when 'error' then 'Duel'
      when 'signup' then 'Carry' else 'Shot' end as type,
    sec, 120 - value%60 as x, k*0.8::double as y, value > 115 as is_goal, (k+1)/120::double as xg,
    event_id%4 = 0 as under_pressure, sec//60 as minute, sec%60 as second, sec//120 as possession
  from (select event_id, user_id as match_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k,
      cast(floor(epoch_us(ts - timestamp '2024-01-01 00:00:00' + timestamp '1970-01-01')/400000000) as int) as sec
    from events) q)"""

N0 = E + """,
n0 as (
  select match_id, event_id, k, team_id, opponent_team_id, sec, minute, second, is_goal, xg, under_pressure,
    case when type = 'Pressure' and k%5 = 4 then 'Block' when type = 'Pass' and k%8 = 7 then 'Ball Receipt*'
      when type = 'Duel' and k%4 = 1 then 'Interception' when type = 'Duel' and k%4 = 2 then 'Clearance'
      when type = 'Duel' and k%4 = 3 then 'Ball Recovery' when type = 'Carry' and k%3 = 1 then 'Dribble' else type end as type,
    case when sec < 3300 then 1 else 2 end as period,
    case when event_id%53 <> 0 then possession end as possession,
    case when k%33 <> 32 then x end as x, case when k%33 <> 32 then y end as y,
    case k%9 when 0 then 'Regular Play' when 1 then 'From Corner' when 2 then 'From Free Kick' when 3 then 'From Throw In'
      when 4 then 'From Goal Kick' when 5 then 'From Counter' when 6 then 'From Keeper' when 7 then 'From Kick Off' end as pattern,
    case when k%50 <> 49 then match_id*100 + k%11 end as player_id,
    case when k%9 <> 8 then match_id*100 + (k+1)%11 end as recipient_id,
    case when k%13 <> 0 then 100.0::double + k%20 end as end_x, case when k%13 <> 0 then k*0.8::double end as end_y,
    case when k%6 = 4 then 'Low Pass' when k%3 = 0 then 'High Pass' when k%3 = 1 then 'Ground Pass' end as height,
    case k%5 when 1 then 'Corner' when 2 then 'Throw-in' end as pass_type,
    case when is_goal then 'Goal' else case k%6 when 0 then 'Saved' when 1 then 'Blocked' when 2 then 'Off T'
      when 3 then 'Post' when 4 then 'Wayward' else 'Saved To Post' end end as shot_outcome,
    case k%4 when 0 then 'Head' when 2 then 'Left Foot' else 'Right Foot' end as body_part,
    case k%20 when 19 then 'Penalty' when 18 then 'Free Kick' else 'Open Play' end as shot_type,
    case k%3 when 0 then 'Won' when 1 then 'Lost In Play' end as duel_outcome
  from e)"""

N = N0 + """,
n as (
  select *, case when type = 'Shot' and k%4 <> 3 then 'e' || max(case when type = 'Pass' then event_id end) over (
      partition by match_id order by sec, event_id rows between unbounded preceding and current row) end as key_pass_id,
    case when k%10 = 0 then true else false end as cross_flag, k%12 = 5 as through_flag, k%14 = 2 as cut_flag,
    k%16 = 9 as switch_flag,
    case when k%14 = 2 then 'Cutback' when k%12 = 5 then 'Through Ball' when k%16 = 9 then 'Switch' when k%10 = 0 then 'Cross'
      when height = 'High Pass' then 'High Pass' when height in ('Ground Pass', 'Low Pass') then 'Ground Pass'
      when pass_type is not null then pass_type else 'Other Pass' end as style
  from n0)"""


def distance(x: str, y: str) -> str:
    return f"sqrt(pow(120-({x}), 2) + pow(40-({y}), 2))"


def angle(x: str, y: str) -> str:
    m1, m2 = f"sqrt(pow(120-({x}),2)+pow(36.8-({y}),2))", f"sqrt(pow(120-({x}),2)+pow(43.2-({y}),2))"
    dot = f"(pow(120-({x}),2) + (36.8-({y}))*(43.2-({y})))"
    return (
        f"case when ({x}) is null or ({y}) is null then null when {m1}*{m2} = 0 then 0 "
        f"else acos(greatest(-1, least(1, {dot}/nullif({m1}*{m2}, 0)))) end"
    )


def zone(dist: str, central: str) -> str:
    return (
        f"case when {dist} is null then null when {dist} <= 12 then case when {central} <= 10 then 'A' else 'B' end "
        f"when {dist} <= 20 then case when {central} <= 10 then 'C' else 'D' end "
        f"else case when {central} <= 10 then 'E' else 'F' end end"
    )


def closed_right(m: str) -> str:
    return (
        f"case when {m} <= 15 then '0-15' when {m} <= 30 then '16-30' when {m} <= 45 then '31-45' when {m} <= 60 then '46-60' "
        f"when {m} <= 75 then '61-75' when {m} <= 90 then '76-90' else '90+' end"
    )


def closed_left(m: str, fallback: str = "'Unknown'") -> str:
    return (
        f"case when {m} >= 0 and {m} < 15 then '0-15' when {m} >= 15 and {m} < 30 then '15-30' when {m} >= 30 and {m} < 45 then '30-45' "
        f"when {m} >= 45 and {m} < 60 then '45-60' when {m} >= 60 and {m} < 75 then '60-75' when {m} >= 75 and {m} < 90 then '75-90' "
        f"when {m} >= 90 and {m} < 121 then '90+' else {fallback} end"
    )


def score_state(d: str) -> str:
    return (
        f"case when {d} between -99 and -2 then 'Trailing 2+' when {d} = -1 then 'Trailing 1' when {d} = 0 then 'Level' "
        f"when {d} = 1 then 'Leading 1' when {d} between 2 and 99 then 'Leading 2+' else 'Unknown' end"
    )


def simple_state(d: str) -> str:
    return f"case when {d} > 0 then 'Leading' when {d} < 0 then 'Trailing' when {d} = 0 then 'Drawing' else 'Unknown' end"


_PATTERNS = "case trim(coalesce(pattern, '')) when 'From Corner' then 'Corner' when 'From Free Kick' then 'Indirect Free Kick' " \
    "when 'From Throw In' then 'Throw In' when 'From Goal Kick' then 'Goal Kick' when 'From Kick Off' then 'Kick Off' end"

SET_PIECE = (
    "case when shot_type = 'Penalty' then 'Penalty' when shot_type = 'Free Kick' then 'Direct Free Kick' "
    f"when {_PATTERNS} is not null then {_PATTERNS} when pattern like 'From %' then 'Other Restart' else 'Open Play' end"
)

ASSIST = """case when pattern in ('From Corner', 'From Free Kick', 'From Throw In', 'From Goal Kick') then 'Set Piece'
  when key_pass_id is null then case when pattern = 'From Counter' then 'Counter (solo)' else 'Unassisted' end
  when pattern = 'From Counter' and p_through then 'Counter Through Ball' when pattern = 'From Counter' then 'Counter Attack'
  when p_cut then 'Cutback' when p_cross then 'Cross' when p_through then 'Through Ball'
  when p_height = 'High Pass' then 'High Pass' when p_height in ('Low Pass', 'Ground Pass') then 'Ground Pass'
  when p_height is null then 'Assist (unspecified)' else 'Other Pass' end"""

RECIPIENT = """case when zx is null or zy is null then 'Unknown zone' when zx >= 102 and zy between 29.5 and 50.5 then 'Penalty area'
  else (case when zx >= 80 then 'Final third' when zx >= 40 then 'Middle third' else 'Build-up third' end) || ' - ' ||
  (case when zy < 80/3.0::double then 'Left' when zy > 2*(80/3.0::double) then 'Right' else 'Central' end) end"""


def trigger_label(p: str, role: bool, missing: str) -> str:
    prefix = "''"
    if role:
        prefix = f"case when {p}_team = team_id then '' when {p}_team = opponent_team_id then 'Opponent ' else 'Other ' end"
    sub = (
        f"case {p}_type when 'Duel' then case when {p}_k%2 = 0 then ' – Aerial Lost' else ' – Tackle' end "
        f"when 'Block' then case when {p}_k%2 = 0 then ' – Deflection' else '' end "
        f"when 'Interception' then case when {p}_k%2 = 1 then ' – Won' else ' – Lost Out' end else '' end"
    )
    return f"case when {p}_type is null then '{missing}' else {prefix} || {p}_type || {sub} end"


def context(tolerance: int = 60) -> str:
    goal = "case when shot_outcome = 'Goal' then 1 else 0 end"
    order = "order by period, minute, second, event_id rows between unbounded preceding and 1 preceding"
    return N + f""",
shots as (
  select *, cast(2*coalesce(sum({goal}) over (partition by match_id, team_id {order}), 0)
      - coalesce(sum({goal}) over (partition by match_id {order}), 0) as int) as diff
  from n where type = 'Shot'),
passes as (select * from n where type = 'Pass'),
kp as (
  select s.*, p.event_id as pass_seq, p.team_id as pass_team, coalesce(p.possession, s.possession) as chain_possession,
    p.style as p_style, p.height as p_height, p.cross_flag as p_cross, p.through_flag as p_through, p.cut_flag as p_cut,
    case when p.end_x is not null and p.end_y is not null then p.end_x else s.x end as zx,
    case when p.end_x is not null and p.end_y is not null then p.end_y else s.y end as zy
  from shots s left join passes p on p.match_id = s.match_id and 'e' || p.event_id = s.key_pass_id),
cp as (
  select kp.event_id, arg_max(r.type, r.event_id) as prev_type
  from kp join n r on r.match_id = kp.match_id and r.type in ('Carry', 'Dribble', 'Duel')
    and r.possession = kp.chain_possession and r.team_id = kp.pass_team and r.event_id <= kp.pass_seq
  group by 1),
trig as (
  select * from n where type in ('Pressure', 'Interception', 'Ball Recovery', 'Tackle', 'Block', 'Duel', 'Carry', 'Dribble')
    and team_id in (select team_id from shots)),
di as (
  select s.event_id, arg_max(t.event_id, t.sec*100000000::bigint + t.event_id) as def_seq
  from shots s join trig t on t.match_id = s.match_id and t.sec <= s.sec group by 1),
dp as (
  select s.event_id, arg_max(t.event_id, t.sec*100000000::bigint + t.event_id) as pos_seq
  from shots s join trig t on t.match_id = s.match_id and t.possession = s.possession and t.sec <= s.sec group by 1),
raw_ctx as (
  select kp.*, cp.prev_type, kp.sec - d.sec as gap, kp.sec - q.sec as pos_gap,
    case when kp.sec - d.sec <= {tolerance} then d.event_id end as d_seq, case when kp.sec - d.sec <= {tolerance} then d.type end as d_type,
    case when kp.sec - d.sec <= {tolerance} then d.k end as d_k, case when kp.sec - d.sec <= {tolerance} then d.team_id end as d_team,
    case when kp.sec - d.sec <= {tolerance} then d.possession end as d_possession,
    case when kp.sec - d.sec <= {tolerance} then d.x end as d_x, case when kp.sec - d.sec <= {tolerance} then d.y end as d_y,
    q.event_id as q_seq, q.type as q_type, q.k as q_k, q.team_id as q_team
  from kp left join cp using (event_id) left join di using (event_id) left join dp using (event_id)
    left join trig d on d.event_id = di.def_seq left join trig q on q.event_id = dp.pos_seq),
feet as (
  select player_id, case when count(*) filter (body_part = 'Left Foot') > count(*) filter (body_part = 'Right Foot') then 'Left Foot'
    when count(*) filter (body_part = 'Right Foot') > count(*) filter (body_part = 'Left Foot') then 'Right Foot' end as foot
  from shots where player_id is not null group by 1),
ctx as (
  select c.*, 'e' || c.event_id as shot_id, {distance('c.x', 'c.y')} as shot_distance, {angle('c.x', 'c.y')} as shot_angle,
    {closed_right('c.minute')} as feature_minute_bucket, {closed_left('c.minute')} as minute_bucket,
    {closed_left('c.minute', closed_right('c.minute'))} as minute_bucket_label,
    {score_state('diff')} as score_state, {simple_state('diff')} as simple_state,
    case when key_pass_id is null then 'Unassisted' else coalesce(case when prev_type = 'Duel' then 'Duel Win' else prev_type end, 'Direct')
      || ' + ' || coalesce(p_style, 'Assist Unknown') end as chain_label,
    {SET_PIECE} as set_piece_category,
    {ASSIST} as assist_category, {RECIPIENT} as recipient_zone,
    case when under_pressure then 'Under pressure' else 'Not under pressure' end as pressure_state,
    {trigger_label('d', False, 'No immediate defensive trigger')} as def_label,
    {trigger_label('q', True, 'No possession defensive trigger')} as possession_label,
    coalesce(c.possession = d_possession, false) as possession_alignment,
    case when body_part in ('Left Foot', 'Right Foot') then case when foot is null then 'Footed shot (unknown preference)'
      when foot = body_part then 'Strong Foot' else 'Weak Foot' end else 'Header' end as foot_finish_group,
    coalesce(shot_outcome = 'Goal', false) as goal
  from raw_ctx c left join feet using (player_id)),
cx as (
  select *, case set_piece_category when 'Penalty' then 'Direct' when 'Direct Free Kick' then 'Direct' when 'Open Play' then 'Open Play'
      else 'Restart' end as set_piece_group,
    case when set_piece_category in ('Penalty', 'Direct Free Kick') then 'Direct' when set_piece_category = 'Open Play' then 'Open Play'
      when key_pass_id is not null then 'First Phase' else 'Second Phase' end as set_piece_phase
  from ctx)"""


AWAY = "(l_orderkey%40 + 1 + (l_orderkey//40)%39)%40"
L = f"""
l as (
  select ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey as shot_id, l_orderkey as match_id, l_linenumber,
    cast(l_orderkey%40 as int) as home_team_id, cast({AWAY} as int) as away_team_id, l_linenumber%2 = 1 as is_home,
    cast(case when l_linenumber%2 = 1 then l_orderkey%40 else {AWAY} end as int) as team_id,
    cast(case when l_linenumber%2 = 1 then {AWAY} else l_orderkey%40 end as int) as opponent_team_id,
    l_partkey%200 as player_id, o_orderdate as match_date, cast(year(o_orderdate) as int) as season,
    60e0 + l_quantity*1.2e0 as location_x, cast(l_partkey%81 as double) as location_y, 0.02e0 + l_discount*4e0 + l_tax as xg,
    l_returnflag = 'R' and l_quantity > 35 as is_goal,
    case when l_returnflag = 'R' and l_quantity > 35 then 'Goal' when l_returnflag = 'A' then 'Saved'
      when l_returnflag = 'N' then 'Blocked' else 'Off T' end as outcome,
    l_linestatus = 'F' as under_pressure, cast(cast(floor(l_extendedprice) as bigint)%96 as int) as minute,
    cast(l_partkey%60 as int) as second,
    case l_linenumber when 1 then 'Penalty' when 2 then 'Corner' when 3 then 'Throw In' when 4 then 'Direct Free Kick'
      else 'Open Play' end as set_piece_category,
    case l_partkey%3 when 0 then 'Right Foot' when 1 then 'Left Foot' else 'Head' end as body_part
  from lineitem join orders on l_orderkey = o_orderkey)"""

LG = L + f""",
lg as (select *, {distance('location_x', 'location_y')} as shot_distance, {angle('location_x', 'location_y')} as shot_angle,
  abs(location_y - 40) as centrality from l)"""


def query(ctes: str, body: str, doubles: Sequence[str] = (), longs: Sequence[str] = (), digits: int = 9) -> str:
    """WITH ctes body, with the named columns rounded or widened in an outer select."""
    inner = f"with {ctes.strip()}\n{body}" if ctes else body
    parts = [f"round({c}, {digits}) + 0.0 as {c}" for c in doubles] + [f"cast({c} as bigint) as {c}" for c in longs]
    return f"select * replace ({', '.join(parts)}) from ({inner}) outermost" if parts else inner


LIFT = "count(*) as shots, sum(case when {g} then 1 else 0 end) as goals, avg({x}) as mean_xg, " \
    "sum(case when {g} then 1 else 0 end)/count(*) as goal_rate, " \
    "sum(case when {g} then 1 else 0 end)/count(*) - coalesce(avg({x}), 0) as lift"
LIFT_DOUBLES = ["mean_xg", "goal_rate", "lift"]
LIFT_LONGS = ["shots", "goals"]


def lift(goal: str = "goal", xg: str = "xg") -> str:
    return LIFT.format(g=goal, x=xg)
