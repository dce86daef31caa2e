"""Queries over the ingest path: dimensions, raw events, typed tables, scopes, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import sql as S
from touchline.catalog.common import TEST_TOLERANCE, context, documents, matches, register, shots
from touchline.functions import labels as L
from touchline.operators import joins as J
from touchline.operators import normalise as N
from touchline.operators.lift import top_abs
from touchline.operators.reports import row_counts, shot_predictions
from touchline.plans.context import modelling_dataset
from touchline.sources import documents as D
from touchline.sources.projections import table

# ---- competitions and matches -----------------------------------------------------------------------------------


def _competitions(spark, folder):
    """Nations stand in for competitions, their region for the season."""
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.selectExpr("cast(n_nationkey as long) as competition_id", "cast(n_regionkey as long) as season_id",
                             "n_name as competition_name", "r_name as season_name")


_COMP = "c as (select cast(n_nationkey as bigint) as competition_id, cast(n_regionkey as bigint) as season_id, n_name as competition_name, " \
    "r_name as season_name from nation join region on n_regionkey = r_regionkey)"

_FILTERS = [{"competition_id": 3, "season_id": 1}, {"name": "A", "season": "E"}, {"competition_id": 2, "season_id": 0}]
_FILTER_SQL = "(competition_id = 3 and season_id = 1) or (contains(competition_name, 'A') and contains(season_name, 'E')) " \
    "or (competition_id = 2 and season_id = 0)"


@register("discover_competitions", S.query(_COMP, f"select * from c where {_FILTER_SQL}"))
def discover_competitions(spark, folder):
    return D.discover_competitions(_competitions(spark, folder), _FILTERS)


@register("discover_matches", S.query(_COMP, f"""
select o_orderkey as match_id, competition_id, season_id, competition_name, season_name
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
join c on c.competition_id = c_nationkey and c.season_id = n_regionkey where {_FILTER_SQL}"""))
def discover_matches(spark, folder):
    games = (
        table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .selectExpr("o_orderkey as match_id", "cast(c_nationkey as long) as competition_id", "cast(n_regionkey as long) as season_id")
    )
    return D.discover_matches(games, D.discover_competitions(_competitions(spark, folder), _FILTERS))


@register("insert_competitions", S.query(_COMP, "select competition_id, season_id, competition_name from c where season_id <> 1"))
def insert_competitions(spark, folder):
    docs = _competitions(spark, folder)
    return J.insert_if_absent(docs, docs.where("season_id = 1"), ["competition_id", "season_id"]).drop("season_name")


def _match_documents(spark, folder):
    """One nested match document per order, with names that vary and dates that sometimes do not parse."""
    l = shots(spark, folder).groupBy("match_id", "home_team_id", "away_team_id", "match_date").agg(F.count(F.lit(1)).alias("n"))
    return l.selectExpr(
        "match_id", "0 as doc_seq", "match_id % 5 as competition_id", "match_id % 3 as season_id",
        "if(match_id % 7 = 0, 'n/a', date_format(match_date, 'yyyy-MM-dd')) as match_date",
        "if(match_id % 11 = 0, 'late', concat(lpad(match_id % 24, 2, '0'), ':45:00.000')) as kick_off",
        "named_struct('home_team_id', cast(home_team_id as long), 'home_team_name', if(match_id % 13 = 0, null, concat('T', home_team_id, '/', match_id % 4)), "
        "'id', cast(null as long), 'name', cast(null as string), 'country', named_struct('id', 1L, 'name', 'X')) as home_team",
        "named_struct('away_team_id', cast(null as long), 'away_team_name', cast(null as string), "
        "'id', cast(away_team_id as long), 'name', concat('T', away_team_id, '/', match_id % 4), 'country', named_struct('id', 1L, 'name', 'X')) as away_team",
        "named_struct('season_id', match_id % 3, 'season_name', concat('S', match_id % 3)) as season",
        "named_struct('competition_id', match_id % 5, 'competition_name', concat('C', match_id % 5)) as competition",
    )


_MD = S.L + ", m as (select distinct match_id, home_team_id, away_team_id, match_date from l)"


@register("team_dimension", S.query(_MD, """
select team_id, arg_max(name, match_id) as name from (
  select home_team_id as team_id, case when match_id%13 <> 0 then 'T' || home_team_id || '/' || match_id%4 end as name, match_id from m
  union all select away_team_id, 'T' || away_team_id || '/' || match_id%4, match_id from m) q where name is not null group by 1"""))
def team_dimension(spark, folder):
    return N.team_rows(_match_documents(spark, folder)).select("team_id", "name")


@register("match_table_rows", S.query(_MD, """
select match_id, home_team_id, away_team_id, case when match_id%7 <> 0 then match_date end as match_date,
  case when match_id%11 <> 0 then timestamp '1970-01-01 00:45:00' + to_hours(match_id%24) end as kickoff_time from m"""))
def match_table_rows(spark, folder):
    return N.match_rows(_match_documents(spark, folder)).select(
        "match_id", "home_team_id", "away_team_id", "match_date", "kickoff_time"
    )


@register("missing_competitions", S.query(_MD, """
select distinct match_id%5 as competition_id, match_id%3 as season_id, 'C' || match_id%5 as competition_name, 'S' || match_id%3 as season
from m where match_id%5 <> 1"""))
def missing_competitions(spark, folder):
    docs = _match_documents(spark, folder)
    known = docs.where("competition_id = 1").selectExpr("competition_id", "concat('S', season_id) as season").distinct()
    return N.missing_competitions(docs, known)


# ---- events -----------------------------------------------------------------------------------------------------


@register("raw_event_dedupe", S.query(S.N, """
select match_id, 'p' || k//2 as id, min(event_id) as event_seq, arg_min(type, event_id) as type from n group by 1, 2"""))
def raw_event_dedupe(spark, folder):
    from touchline.sources.projections import flat_documents

    keys = flat_documents(spark, folder).selectExpr("match_id", "cast(event_id as int) as event_seq", "concat('p', k div 2) as pair")
    docs = documents(spark, folder).join(keys, ["match_id", "event_seq"]).drop("id").withColumnRenamed("pair", "id")
    return N.raw_event_rows(docs).select("match_id", "id", "event_seq", F.col("type.name").alias("type"))


@register("anti_backlog", S.query(S.N, "select match_id, 'e' || event_id as id from n where k%3 <> 0"))
def anti_backlog(spark, folder):
    raw = documents(spark, folder)
    done = N.event_rows(raw.where("cast(substring(timestamp, 10) as int) % 3 = 0"))
    return N.backlog(raw, done).select("match_id", "id")


@register("normalised_events", S.query(S.N, """
select match_id, 'e' || event_id as event_id, case when team_id%10 <> 3 then team_id else 0 end as team_id, player_id, type, period, minute, second,
  possession, x as location_x, y as location_y, under_pressure,
  case type when 'Pass' then case when k%4 = 0 then 'Incomplete' end when 'Shot' then shot_outcome when 'Duel' then duel_outcome
    when 'Interception' then case when k%2 = 1 then 'Won' else 'Lost Out' end end as outcome from n""", ["location_x", "location_y"]))
def normalised_events(spark, folder):
    raw = documents(spark, folder)
    teams = raw.select(F.col("team.id").alias("team_id")).distinct().where("team_id % 10 <> 3")
    return N.event_rows(raw, teams).drop("event_seq", "timestamp")


@register("player_dimension", S.query(S.N, """
select player_id, coalesce(arg_min(name, seen) filter (name is not null and seen = first_seen), 'Player ' || player_id) as name from (
  select *, min(seen) over (partition by player_id) as first_seen from (
    select player_id, case when k%10 <> 9 then 'P' || player_id end as name, event_id*2 as seen from n where player_id is not null
    union all select recipient_id, case when k%10 <> 9 then 'P' || recipient_id end, event_id*2 + 1 from n
      where type = 'Pass' and recipient_id is not null) u) v group by 1"""))
def player_dimension(spark, folder):
    return N.player_rows(documents(spark, folder))


_DETAIL_SQL = {
    "passes": ("'Pass'", "k*0.5::double as length, k*0.01::double as angle, height as pass_height, pass_type, body_part, "
               "case when k%4 = 0 then 'Incomplete' end as outcome, recipient_id as recipient_player_id, cross_flag as is_cross, through_flag as is_through_ball",
               ["length", "angle"]),
    "dribbles": ("'Dribble'", "case when k%2 = 0 then 'Complete' else 'Incomplete' end as outcome, k%6 = 1 as overrun, k%9 = 1 as nutmeg", []),
    "carries": ("'Carry'", "x as start_x, y as start_y, case when k%7 <> 0 then coalesce(x, 60) - 1 end as end_x, case when k%7 <> 0 then coalesce(y, 40) + 1 end as end_y, "
                "case when k%7 <> 0 and x is not null then sqrt(2.0) end as length", ["start_x", "start_y", "end_x", "end_y", "length"]),
    "clearances": ("'Clearance'", "case when k%3 = 0 then 'Head' else 'Right Foot' end as body_part, cast(null as varchar) as outcome, under_pressure", []),
    "duels": ("'Duel'", "case when k%2 = 0 then 'Aerial Lost' else 'Tackle' end as duel_type, duel_outcome as outcome, coalesce(duel_outcome = 'Won', false) as is_success", []),
    "blocks": ("'Block'", "case when k%2 = 0 then 'Deflection' end as block_type, k%2 = 0 as is_deflection, k%3 = 0 as is_save_block", []),
    "interceptions": ("'Interception'", "case when k%2 = 1 then 'Won' else 'Lost Out' end as outcome, k%2 = 1 as is_success", []),
    "pressures": ("'Pressure'", "k*0.1::double as duration_seconds", ["duration_seconds"]),
    "ball_receipts": ("'Ball Receipt*'", "k%4 <> 3 as clean_receipt", []),
}


def _detail(name: str):
    kind, columns, doubles = _DETAIL_SQL[name]

    @register(f"detail_{name}", S.query(S.N, f"select match_id, 'e' || event_id as event_id, {columns} from n where type = {kind}", doubles))
    def run(spark, folder):
        return N.DETAIL_TABLES[name](documents(spark, folder))

    return run


for _name in _DETAIL_SQL:
    _detail(_name)


@register("missing_details", S.query(S.N, "select match_id, 'e' || event_id as event_id from n where type = 'Pass' and period = 2"))
def missing_details(spark, folder):
    raw = documents(spark, folder)
    return N.missing_details(raw, N.pass_rows(raw.where("period = 1")), "passes").select("match_id", "event_id")


@register("shot_table", S.query(S.N, """
select match_id, 'e' || event_id as shot_id, team_id, opponent_team_id, player_id, xg as statsbomb_xg, body_part,
  case when k%5 = 0 then 'Volley' else 'Normal' end as technique, shot_type, shot_outcome as outcome, k%3 = 0 as first_time, key_pass_id,
  shot_outcome = 'Blocked' as is_blocked, k%2 = 0 as is_home from n where type = 'Shot'""", ["statsbomb_xg"]))
def shot_table(spark, folder):
    return N.shot_rows(documents(spark, folder), matches(spark, folder)).select(
        "match_id", "shot_id", "team_id", "opponent_team_id", "player_id", "statsbomb_xg", "body_part", "technique", "shot_type",
        "outcome", "first_time", "key_pass_id", "is_blocked", "is_home",
    )


@register("shot_features", S.query(S.context(TEST_TOLERANCE), f"""
, pf as (select event_id, row_number() over w as len, cast(sec - first(sec) over w as double) as dur, cast(coalesce(sec - lag(sec) over w, 0) as double) as gap0,
    coalesce(sum(case when type in ('Pressure', 'Block', 'Interception', 'Clearance', 'Duel', 'Tackle') then 1 else 0 end) over (partition by match_id, possession
      order by event_id rows between 5 preceding and 1 preceding), 0) as acts
  from n where possession is not null window w as (partition by match_id, possession order by event_id))
select shot_id, diff as score_diff_at_shot, feature_minute_bucket as minute_bucket, pf.len as possession_sequence_length, pf.dur as possession_duration,
  pf.gap0 as previous_action_gap, pf.acts as recent_def_actions_count,
  0.5*(case when under_pressure then 1 else 0 end) + 0.3*(coalesce(pf.acts, 0) - 1.0) + 0.2*(1.0::double/(1 + coalesce(pf.dur, 0)) - 1.0::double/6)/(3.0::double/25) as pressure_proxy_score
from cx left join pf on pf.event_id = cx.event_id where x is not null and shot_id not in (select 'e' || event_id from n where k%4 = 1)""",
    ["possession_duration", "previous_action_gap", "pressure_proxy_score"], ["recent_def_actions_count"]))
def shot_features(spark, folder):
    raw = documents(spark, folder)
    features = N.shot_feature_rows(N.shot_rows(raw, matches(spark, folder)), N.event_rows(raw))
    stored = raw.where("cast(substring(timestamp, 10) as int) % 4 = 1").select("match_id", F.col("id").alias("shot_id"), F.lit("v1").alias("version_tag"))
    return N.missing_features(features, stored).select(
        "shot_id", "score_diff_at_shot", "minute_bucket", "possession_sequence_length", "possession_duration", "previous_action_gap",
        "recent_def_actions_count", "pressure_proxy_score",
    )


@register("event_details_join", S.query(S.N, """
select 'e' || event_id as event_id, type, case when type = 'Duel' then case when k%2 = 0 then 'Aerial Lost' else 'Tackle' end end as duel_type,
  case when type = 'Duel' then duel_outcome end as duel_outcome, case when type = 'Block' and k%2 = 0 then 'Deflection' end as block_type,
  case when type = 'Interception' then case when k%2 = 1 then 'Won' else 'Lost Out' end end as interception_outcome,
  case when type = 'Pressure' then k*0.1::double end as pressure_duration
from n where type in ('Pressure', 'Interception', 'Ball Recovery', 'Tackle', 'Block', 'Duel', 'Carry', 'Dribble')""", ["pressure_duration"]))
def event_details_join(spark, folder):
    from touchline.config import TRIGGER_TYPES

    raw = documents(spark, folder)
    rows = N.event_rows(raw).where(F.col("type").isin(TRIGGER_TYPES))
    return N.events_with_details(rows, N.duel_rows(raw), N.block_rows(raw), N.interception_rows(raw), N.pressure_rows(raw)).select(
        "event_id", "type", "duel_type", "duel_outcome", "block_type", "interception_outcome", "pressure_duration"
    )


@register("base_shot_scan", S.query(S.context(TEST_TOLERANCE), """
select shot_id, 'C' || match_id%5 as competition_name, diff as score_diff_at_shot, k%2 = 0 as is_home,
  case when team_id%10 <> 3 then 'T' || team_id else 'Team ' || team_id end as team_name,
  case when opponent_team_id%10 <> 3 then 'T' || opponent_team_id else 'Team ' || opponent_team_id end as opponent_name
from cx where x is not null"""))
def base_shot_scan(spark, folder):
    from touchline.plans.context import base_shots

    raw, games = documents(spark, folder), matches(spark, folder)
    stored = N.shot_rows(raw, games).drop("is_home")
    features = N.shot_feature_rows(stored, N.event_rows(raw)).select("match_id", "shot_id", "version_tag", "score_diff_at_shot")
    both = features.unionByName(features.withColumns({"version_tag": F.lit("v0"), "score_diff_at_shot": F.lit(99)}))
    competitions = games.selectExpr("competition_id", "season_id", "concat('C', competition_id) as competition_name").distinct()
    teams = raw.select(F.col("team.id").alias("team_id"), F.col("team.name").alias("name")).distinct().where("team_id % 10 <> 3")
    return base_shots(stored, both, games, competitions, teams).select(
        "shot_id", "competition_name", "score_diff_at_shot", "is_home", "team_name", "opponent_name"
    )


@register("lineage_counts", S.query(S.N, """
select 'raw' as "table", count(*) as rows from n union all select 'shots', count(*) from n where type = 'Shot'
union all select 'passes', count(*) from n where type = 'Pass'"""))
def lineage_counts(spark, folder):
    raw = documents(spark, folder)
    return row_counts({"raw": raw, "shots": N.shot_rows(raw), "passes": N.pass_rows(raw)})


@register("observed_ingest", S.query(S.N, """
select match_id, sum(case when event_id%11 <> 0 then 1 else 0 end) as accepted, sum(case when event_id%11 = 0 or event_id%13 = 0 then 1 else 0 end) as rejected,
  (select sum(case when event_id%11 <> 0 then 1 else 0 end) from n) as all_accepted,
  (select sum(case when event_id%11 = 0 or event_id%13 = 0 then 1 else 0 end) from n) as all_rejected from n group by 1"""))
def observed_ingest(spark, folder):
    """A text for each event: some end too early, some have a second document with a field of another type."""
    import uuid

    from touchline.plans.ingest import ingest_documents
    from touchline.plans.staging import shared_folder
    from touchline.schemas import EVENT_DOC

    texts = table(spark, folder, "events").selectExpr(
        "user_id as match_id",
        "concat('[{\"id\": \"e', event_id, '\", \"period\": 1}', if(event_id % 13 = 0, ', {\"id\": \"x\", \"period\": \"one\"}', ''), if(event_id % 11 = 0, '', ']')) as value",
    )
    good, bad, counts = ingest_documents(texts, "value", EVENT_DOC, "event_seq", f"{shared_folder(spark)}/observed/{uuid.uuid4().hex}")
    both = good.selectExpr("match_id", "1 as a", "0 as r").unionByName(bad.selectExpr("match_id", "0 as a", "1 as r"))
    return both.groupBy("match_id").agg(F.sum("a").alias("accepted"), F.sum("r").alias("rejected")).withColumns(
        {"all_accepted": F.lit(counts["accepted"]), "all_rejected": F.lit(counts["rejected"])}
    )


_FIRST = "r as (select l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() over (partition by l_partkey " \
    "order by l_orderkey desc, l_linenumber desc, l_suppkey, l_quantity) as i from lineitem)"


@register("first_label", S.query(_FIRST, """
select p_partkey, l_orderkey, l_suppkey, l_quantity from part left join r on l_partkey = p_partkey and i = 1"""))
def first_label(spark, folder):
    """Labels that differ within a key: the first by position stays, not the smallest."""
    lines = table(spark, folder, "lineitem").selectExpr("l_partkey as p_partkey", "l_orderkey", "l_suppkey", "l_quantity", "-l_orderkey as o", "-l_linenumber as n")
    return J.attach(table(spark, folder, "part").select("p_partkey"), lines, ["p_partkey"], ["l_orderkey", "l_suppkey", "l_quantity"], order=["o", "n", "l_suppkey", "l_quantity"])


@register("modelling_dataset", S.query(S.context(TEST_TOLERANCE), """
select shot_id, match_id, team_id, opponent_team_id, player_id, k%2 = 0 as is_home, match_id%5 as competition_id,
  '20' || (15 + match_id%3) || '/' || (16 + match_id%3) as competition_season, xg as statsbomb_xg, goal as is_goal, shot_outcome,
  chain_label, def_label, gap as time_gap_seconds, possession_alignment as possession_match from cx""", ["statsbomb_xg", "time_gap_seconds"]))
def modelling_dataset_query(spark, folder):
    return modelling_dataset(context(spark, folder), matches(spark, folder)).select(
        "shot_id", "match_id", "team_id", "opponent_team_id", "player_id", "is_home", "competition_id", "competition_season",
        "statsbomb_xg", "is_goal", "shot_outcome", "chain_label", "def_label", "time_gap_seconds", "possession_match",
    )


# ---- joins ------------------------------------------------------------------------------------------------------


@register("star_join", S.query("", """
select r_name, count(*) as shots, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"""))
def star_join(spark, folder):
    t = lambda name: table(spark, folder, name)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("shots"), F.sum("l_quantity").alias("quantity"))


@register("teams_joined_twice", S.query(S.L, """
select shot_id, h.n_name as team_name, o.n_name as opponent_name from l left join nation h on h.n_nationkey = team_id
left join nation o on o.n_nationkey = opponent_team_id"""))
def teams_joined_twice(spark, folder):
    names = table(spark, folder, "nation")
    own = names.select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"))
    other = names.select(F.col("n_nationkey").alias("opponent_team_id"), F.col("n_name").alias("opponent_name"))
    return shots(spark, folder).join(own, "team_id", "left").join(other, "opponent_team_id", "left").select(
        "shot_id", "team_name", "opponent_name"
    )


@register("scope_semi", S.query(S.L, """
select shot_id from l where match_id in (select o_orderkey from orders join customer on c_custkey = o_custkey where c_nationkey in (2, 3, 5))"""))
def scope_semi(spark, folder):
    allowed = (
        table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .where(F.col("c_nationkey").isin(2, 3, 5)).select(F.col("o_orderkey").alias("match_id"))
    )
    return J.scope(shots(spark, folder), allowed, ["match_id"], ["shot_id"]).select("shot_id")


@register("attach_labels", S.query("", """
select d.doc_id, lang, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id"""))
def attach_labels(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return J.attach(docs, table(spark, folder, "labels"), ["doc_id"], ["quality", "toxic"])


@register("side_prior_join", S.query(S.L, """
, p as (select match_id, is_home, round(avg(xg), 6) as lg from l where player_id%3 <> 0 group by 1, 2)
select l.shot_id, coalesce(f.lg, 0) as finishing_bias_logit, coalesce(exp(f.lg), 1) as finishing_bias_multiplier,
  coalesce(c.lg, 0) as concession_bias_logit, coalesce(exp(c.lg), 1) as concession_bias_multiplier
from l left join p f on f.match_id = l.match_id and f.is_home = l.is_home left join p c on c.match_id = l.match_id and c.is_home <> l.is_home""",
    ["finishing_bias_logit", "finishing_bias_multiplier", "concession_bias_logit", "concession_bias_multiplier"]))
def side_prior_join(spark, folder):
    rows = shots(spark, folder)
    base = rows.where("player_id % 3 <> 0").groupBy("match_id", "is_home").agg(F.round(F.avg("xg"), 6).alias("lg"))

    def prior(name):
        return base.select("match_id", "is_home", F.col("lg").alias(f"{name}_logit"), F.exp("lg").alias(f"{name}_multiplier"))

    out = J.attach_side_prior(rows, prior("finishing_bias"), "finishing_bias")
    out = J.attach_side_prior(out, prior("concession_bias"), "concession_bias", opponent=True)
    return out.select("shot_id", "finishing_bias_logit", "finishing_bias_multiplier", "concession_bias_logit", "concession_bias_multiplier")


@register("bucket_keys_prior_join", S.query(S.LG, """
, b as (select *, case when under_pressure then 'Under pressure' else 'Not under pressure' end as ps,
    case when shot_distance >= 0 and shot_distance < 12 then '0-12' when shot_distance >= 12 and shot_distance < 18 then '12-18'
      when shot_distance >= 18 and shot_distance < 24 then '18-24' when shot_distance >= 24 then '24+' else 'Unknown' end as distance_bin,
    case when degrees(shot_angle) < 20 then '0-20' when degrees(shot_angle) < 40 then '20-40' else '40+' end as angle_bin from lg),
g as (select ps, distance_bin, angle_bin, avg(is_goal::int) as p, count(*) as n from b group by 1, 2, 3 having count(*) >= 500)
select shot_id, b.ps || '|' || b.distance_bin || '|' || b.angle_bin as pressure_bucket, coalesce(p, 0) as pressure_logit,
  coalesce(exp(p), 1) as pressure_multiplier, p as pressure_modeled_prob
from b left join g on g.ps = b.ps and g.distance_bin = b.distance_bin and g.angle_bin = b.angle_bin""",
    ["pressure_logit", "pressure_multiplier", "pressure_modeled_prob"]))
def bucket_keys_prior_join(spark, folder):
    from touchline import config as C
    from touchline.catalog.common import located_shots
    from touchline.plans.pipeline import pressure_buckets

    rows = located_shots(spark, folder).withColumn("pressure_state", L.pressure_state(F.col("under_pressure")))
    rows = pressure_buckets(rows, angle_unit="degrees")
    goal = F.avg(F.col("is_goal").cast("int"))
    priors = (
        rows.groupBy(*C.PRESSURE_BUCKET).agg(goal.alias("bucket_logit"), F.exp(goal).alias("odds_multiplier"), goal.alias("modeled_prob"), F.count(F.lit(1)).alias("n"))
        .where("n >= 500")
    )
    key = L.bucket_key(*[F.col(c) for c in C.PRESSURE_BUCKET])
    out = J.attach_bucket_prior(rows.withColumn("pressure_bucket", key), priors, F.col("pressure_bucket"), C.PRESSURE_BUCKET, "pressure")
    return out.select("shot_id", "pressure_bucket", "pressure_logit", "pressure_multiplier", "pressure_modeled_prob")


@register("trigger_bucket_keys", S.query(S.context(TEST_TOLERANCE), """
select shot_id, def_label || '|' || case when gap >= 0 and gap < 2 then '0-2s' when gap >= 2 and gap < 5 then '2-5s' when gap >= 5 and gap < 10 then '5-10s'
  when gap >= 10 and gap < 30 then '10-30s' when gap >= 30 then '30s+' else 'Unknown' end || '|' ||
  case when possession_alignment then 'Same' else 'Different' end as trigger_bucket from cx"""))
def trigger_bucket_keys(spark, folder):
    from touchline import config as C
    from touchline.plans.pipeline import trigger_buckets

    rows = context(spark, folder).withColumns(
        {"time_gap_seconds": F.col("seconds_since_def_action").cast("double"), "possession_match": F.col("possession_alignment")}
    )
    return trigger_buckets(rows).select("shot_id", L.bucket_key(*[F.col(c) for c in C.TRIGGER_BUCKET]).alias("trigger_bucket"))


_REG = "reg as (select p_partkey as model_id, p_brand as model_name, p_type || '-' || p_partkey as version, p_size as created_at from part)"


def _registry(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_partkey as model_id", "p_brand as model_name", "concat(p_type, '-', p_partkey) as version", "p_size as created_at"
    )


@register("model_registry", S.query(_REG, "select * from reg where model_name = 'Brand#11' order by version desc limit 1"))
def model_registry(spark, folder):
    return J.resolve_model(_registry(spark, folder), "Brand#11")


@register("model_predictions", S.query(S.L + ", " + _REG + """,
pick as (select model_id from reg where model_name = 'Brand#11' order by version desc limit 1)""", """
select l.shot_id, l.team_id, pred.model_id, pred.raw_probability from l join (
  select ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey as shot_id, l_partkey as model_id, l_discount as raw_probability,
    l_linenumber%2 = 0 as is_neutralized from lineitem) pred using (shot_id)
where pred.model_id in (select model_id from pick) and is_neutralized""", ["raw_probability"]))
def model_predictions(spark, folder):
    predictions = table(spark, folder, "lineitem").selectExpr(
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as shot_id", "l_partkey as model_id",
        "l_discount as raw_probability", "l_linenumber % 2 = 0 as is_neutralized",
    )
    model = J.resolve_model(_registry(spark, folder), "Brand#11")
    return shot_predictions(predictions, shots(spark, folder), model, only_neutral=True).select(
        "shot_id", "team_id", "model_id", "raw_probability"
    )


@register("normalised_keys", S.query("", """
select p_partkey, lower(trim(regexp_replace(trim(p_type), '[^a-zA-Z0-9_-]+', '-', 'g'), '-')) as slug,
  replace(replace(lower(trim(' ' || p_brand || ' - ' || p_size)), ' ', ''), '-', '/') as season_key, p_size%3 = 1 as home_flag from part"""))
def normalised_keys(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", L.slug(F.col("p_type")).alias("slug"),
        L.season_key(F.concat(F.lit(" "), "p_brand", F.lit(" - "), F.col("p_size").cast("string"))).alias("season_key"),
        L.home_flag((F.col("p_size") % 3).cast("string")).alias("home_flag"),
    )


@register("top_k_abs", S.query("", """
select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 10""", ["c_acctbal"]))
def top_k_abs(spark, folder):
    return top_abs(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, "c_custkey")


@register("defensive_actions", S.query(S.N, """
select type, type in ('Pressure', 'Block', 'Interception', 'Clearance', 'Duel', 'Tackle', 'Foul Committed', 'Shield') as is_defensive, count(*) as n
from n group by 1, 2"""))
def defensive_actions(spark, folder):
    kind = F.col("type.name")
    return documents(spark, folder).select(kind.alias("type"), L.is_defensive_action(kind).alias("is_defensive")).groupBy(
        "type", "is_defensive"
    ).agg(F.count(F.lit(1)).alias("n"))
