"""Football-shaped views of the generic test tables, so that every operator runs on them.

``match_events``: one user is a match, purchases are shots, 400 real seconds are one match second.
``order_shots``: one order is a match, every line item is a shot.
``event_documents``: the first view as nested JSON documents, parsed back with the source schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.blocks import OrderedScan
from touchline.schemas import EVENT_DOC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _plain_events(spark: SparkSession, folder: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, folder, "events").selectExpr(
        "event_id", "user_id as match_id", f"{k} as k", "event_type", "value",
        "cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 400 as int) as sec",
    )


def match_events(spark: SparkSession, folder: str) -> DataFrame:
    return _event_view(_plain_events(spark, folder))


def _event_view(base: DataFrame, *more: str) -> DataFrame:
    return base.selectExpr(
        "event_id", "match_id", "k", "match_id * 2 + k % 2 as team_id", "match_id * 2 + 1 - k % 2 as opponent_team_id",
        "case event_type when 'click' then 'Pressure' when 'view' then 'Pass' when 'error' then 'Duel' "
        "when 'signup' then 'Carry' else 'Shot' end as type",
        "sec", "120 - value % 60 as x", "k * 0.8D as y", "value > 115 as is_goal", "(k + 1) / 120D as xg",
        "event_id % 4 = 0 as under_pressure", "sec div 60 as minute", "sec % 60 as second", "sec div 120 as possession", *more,
    )


def order_shots(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    away = "(l_orderkey % 40 + 1 + (l_orderkey div 40) % 39) % 40"
    return joined.selectExpr(
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as shot_id",
        "l_orderkey as match_id", "l_linenumber", "cast(l_orderkey % 40 as int) as home_team_id",
        f"cast({away} as int) as away_team_id", "l_linenumber % 2 = 1 as is_home",
        f"cast(case when l_linenumber % 2 = 1 then l_orderkey % 40 else {away} end as int) as team_id",
        f"cast(case when l_linenumber % 2 = 1 then {away} else l_orderkey % 40 end as int) as opponent_team_id",
        "l_partkey % 200 as player_id", "o_orderdate as match_date", "cast(year(o_orderdate) as int) as season",
        "60e0 + l_quantity * 1.2e0 as location_x", "cast(l_partkey % 81 as double) as location_y",
        "0.02e0 + l_discount * 4e0 + l_tax as xg", "l_returnflag = 'R' and l_quantity > 35 as is_goal",
        "case when l_returnflag = 'R' and l_quantity > 35 then 'Goal' when l_returnflag = 'A' then 'Saved' "
        "when l_returnflag = 'N' then 'Blocked' else 'Off T' end as outcome",
        "l_linestatus = 'F' as under_pressure",
        "cast(cast(floor(l_extendedprice) as bigint) % 96 as int) as minute", "cast(l_partkey % 60 as int) as second",
        "case l_linenumber when 1 then 'Penalty' when 2 then 'Corner' when 3 then 'Throw In' "
        "when 4 then 'Direct Free Kick' else 'Open Play' end as set_piece_category",
        "case l_partkey % 3 when 0 then 'Right Foot' when 1 then 'Left Foot' else 'Head' end as body_part",
    )


def flat_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Flat fields of the synthetic event documents, derived from the event view by arithmetic on ``k`` and the id."""
    # passes are the views but those that become receipts; only the few plain columns move to find the last one
    passes = F.expr("if(event_type = 'view' and not coalesce(k % 8 = 7, false), event_id, null)")
    linked = OrderedScan(_plain_events(spark, folder), ["match_id"], ["sec", "event_id"]).last_seen("last_pass", passes).result()
    flat = _event_view(linked, "last_pass").selectExpr(
        "match_id", "event_id", "k", "team_id", "opponent_team_id", "sec", "minute", "second", "is_goal", "xg", "under_pressure",
        "case when type = 'Pressure' and k % 5 = 4 then 'Block' when type = 'Pass' and k % 8 = 7 then 'Ball Receipt*' "
        "when type = 'Duel' and k % 4 = 1 then 'Interception' when type = 'Duel' and k % 4 = 2 then 'Clearance' "
        "when type = 'Duel' and k % 4 = 3 then 'Ball Recovery' when type = 'Carry' and k % 3 = 1 then 'Dribble' "
        "else type end as type",
        "case when sec < 3300 then 1 else 2 end as period",
        "case when event_id % 53 <> 0 then possession end as possession",
        "case when k % 33 <> 32 then x end as x", "case when k % 33 <> 32 then y end as y",
        "case k % 9 when 0 then 'Regular Play' when 1 then 'From Corner' when 2 then 'From Free Kick' when 3 then 'From Throw In' "
        "when 4 then 'From Goal Kick' when 5 then 'From Counter' when 6 then 'From Keeper' when 7 then 'From Kick Off' end as pattern",
        "case when k % 50 <> 49 then match_id * 100 + k % 11 end as player_id",
        "case when k % 9 <> 8 then match_id * 100 + (k + 1) % 11 end as recipient_id",
        "case when k % 13 <> 0 then 100.0D + k % 20 end as end_x", "case when k % 13 <> 0 then k * 0.8D end as end_y",
        "case when k % 6 = 4 then 'Low Pass' when k % 3 = 0 then 'High Pass' when k % 3 = 1 then 'Ground Pass' end as height",
        "case k % 5 when 1 then 'Corner' when 2 then 'Throw-in' end as pass_type",
        "case when is_goal then 'Goal' else case k % 6 when 0 then 'Saved' when 1 then 'Blocked' when 2 then 'Off T' "
        "when 3 then 'Post' when 4 then 'Wayward' else 'Saved To Post' end end as shot_outcome",
        "case k % 4 when 0 then 'Head' when 2 then 'Left Foot' else 'Right Foot' end as body_part",
        "case k % 20 when 19 then 'Penalty' when 18 then 'Free Kick' else 'Open Play' end as shot_type",
        "case k % 3 when 0 then 'Won' when 1 then 'Lost In Play' end as duel_outcome", "last_pass",
    )
    return flat.withColumn(
        "key_pass_id",
        F.when((F.col("type") == "Shot") & (F.col("k") % 4 != 3), F.concat(F.lit("e"), F.col("last_pass").cast("string"))),
    ).drop("last_pass")


def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Nested event documents: built as JSON text, then parsed with the source schema."""
    f = flat_documents(spark, folder)
    named = "named_struct('name', {})".format
    blocks = {
        "pass": "Pass", "shot": "Shot", "dribble": "Dribble", "carry": "Carry", "clearance": "Clearance", "duel": "Duel",
        "block": "Block", "interception": "Interception", "pressure": "Pressure", "ball_receipt": "Ball Receipt*",
    }
    bodies = {
        "pass": "named_struct('length', k * 0.5D, 'angle', k * 0.01D, 'end_location', if(end_x is null, null, array(end_x, end_y)), "
        f"'height', {named('height')}, 'type', {named('pass_type')}, 'body_part', {named('body_part')}, "
        f"'outcome', {named('if(k % 4 = 0, ' + repr('Incomplete') + ', null)')}, "
        "'recipient', named_struct('id', recipient_id, 'name', if(k % 10 = 9, null, concat('P', recipient_id))), "
        "'cross', if(k % 10 = 0, true, null), 'through_ball', if(k % 12 = 5, true, null), "
        "'cut_back', if(k % 14 = 2, true, null), 'switch', if(k % 16 = 9, true, null))",
        "shot": f"named_struct('statsbomb_xg', xg, 'outcome', {named('shot_outcome')}, 'body_part', {named('body_part')}, "
        f"'technique', {named('if(k % 5 = 0, ' + repr('Volley') + ', ' + repr('Normal') + ')')}, 'type', {named('shot_type')}, "
        "'first_time', if(k % 3 = 0, true, null), 'key_pass_id', key_pass_id)",
        "dribble": f"named_struct('outcome', {named('if(k % 2 = 0, ' + repr('Complete') + ', ' + repr('Incomplete') + ')')}, "
        "'overrun', if(k % 6 = 1, true, null), 'nutmeg', if(k % 9 = 1, true, null))",
        "carry": "named_struct('end_location', if(k % 7 = 0, null, array(coalesce(x, 60D) - 1, coalesce(y, 40D) + 1)))",
        "clearance": f"named_struct('body_part', {named('if(k % 3 = 0, ' + repr('Head') + ', ' + repr('Right Foot') + ')')})",
        "duel": f"named_struct('type', {named('if(k % 2 = 0, ' + repr('Aerial Lost') + ', ' + repr('Tackle') + ')')}, "
        f"'outcome', {named('duel_outcome')})",
        "block": "named_struct('deflection', if(k % 2 = 0, true, null), 'save_block', if(k % 3 = 0, true, null))",
        "interception": f"named_struct('outcome', {named('if(k % 2 = 1, ' + repr('Won') + ', ' + repr('Lost Out') + ')')})",
        "pressure": "named_struct('duration', k * 0.1D)",
        "ball_receipt": "named_struct('clean_receipt', k % 4 <> 3)",
    }
    doc = F.struct(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.expr(named("type")).alias("type"),
        "period", "minute", "second",
        F.expr("concat('00:', lpad(minute % 60, 2, '0'), ':', lpad(second, 2, '0'), '.', k)").alias("timestamp"),
        "possession",
        F.expr("if(x is null, array(1D), array(x, y))").alias("location"),
        F.expr("if(under_pressure, true, null)").alias("under_pressure"),
        F.expr("if(pattern is null, null, named_struct('name', pattern))").alias("play_pattern"),
        F.expr("named_struct('id', team_id, 'name', concat('T', team_id))").alias("team"),
        F.expr("if(player_id is null, null, named_struct('id', player_id, 'name', if(k % 10 = 9, null, concat('P', player_id))))").alias("player"),
        *[F.expr(f"if(type = '{blocks[b]}', {body}, null)").alias(b) for b, body in bodies.items()],
    )
    text = f.select("match_id", F.col("event_id").cast("int").alias("event_seq"), F.to_json(doc).alias("json"))
    return text.select("match_id", "event_seq", F.from_json("json", EVENT_DOC).alias("d")).select("match_id", "event_seq", "d.*")


def document_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Match table that goes with the event documents: the even team is at home."""
    ids = table(spark, folder, "events").select(F.col("user_id").alias("match_id")).distinct()
    return ids.selectExpr(
        "match_id", "match_id % 5 as competition_id", "match_id % 3 as season_id",
        "concat('20', lpad(15 + match_id % 3, 2, '0'), '/', lpad(16 + match_id % 3, 2, '0')) as season",
        "match_id * 2 as home_team_id", "match_id * 2 + 1 as away_team_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(match_id % 90 as int)) as match_date",
    )
