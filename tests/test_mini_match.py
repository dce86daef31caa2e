"""A hand-made match through the JSON readers, typed tables and the shot context. Expected rows stand next to the events."""

import json

import pytest
from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.operators import normalise as N
from touchline.operators.joins import insert_if_absent
from touchline.plans.context import modelling_dataset, shot_context, trigger_events, with_triggers
from touchline.sources import documents as D

HOME, AWAY = 10, 20


def event(eid, kind, minute, second, team=HOME, period=1, possession=1, player=1, **extra):
    doc = {"id": eid, "type": {"id": 1, "name": kind}, "period": period, "minute": minute, "second": second,
           "timestamp": f"00:{minute:02d}:{second:02d}.000", "team": {"id": team, "name": f"T{team}"}, "location": [60.0, 40.0]}
    if possession is not None:
        doc["possession"] = possession
    if player is not None:
        doc["player"] = {"id": player, "name": f"Player name {player}"}
    return {**doc, **extra}


def shot(outcome, xg=0.1, foot="Right Foot", kind="Open Play", **more):
    return {"shot": {"statsbomb_xg": xg, "outcome": {"name": outcome}, "body_part": {"name": foot}, "technique": {"name": "Normal"},
                     "type": {"name": kind}, **more}, "location": [108.0, 40.0]}


EVENTS = [
    event("c1", "Carry", 1, 0, team=AWAY, carry={"end_location": [50.0, 44.0]}),
    event("p1", "Pass", 1, 1, **{"pass": {"length": 10.0, "angle": 0.1, "end_location": [104.0, 40.0], "height": {"name": "Ground Pass"},
                                          "recipient": {"id": 2, "name": None}}}),
    event("d1", "Duel", 1, 3, team=AWAY, duel={"type": {"name": "Tackle"}, "outcome": {"name": "Won"}}),
    event("s1", "Shot", 1, 3, player=2, under_pressure=True, **shot("Goal", key_pass_id="p1")),
    event("b1", "Block", 2, 0, team=AWAY, possession=2, block={"deflection": True}),
    event("s2", "Shot", 2, 5, possession=2, **shot("Saved")),
    event("i1", "Interception", 3, 0, team=AWAY, possession=3, interception={"outcome": {"name": "Won"}}),
    event("s3", "Shot", 3, 6, possession=None, **shot("Off T", foot="Left Foot")),
    event("k2", "Carry", 10, 0, possession=4, carry={"end_location": [63.0, 44.0]}),
    event("p2", "Pass", 10, 2, possession=4, **{"pass": {"length": 5.0, "cross": True, "height": {"name": "High Pass"}}}),
    event("s4", "Shot", 10, 3, possession=4, play_pattern={"name": "From Corner"}, **shot("Goal", key_pass_id="p2")),
    event("pen", "Shot", 46, 30, team=AWAY, possession=5, player=None, **shot("Goal", xg=0.78, kind="Penalty")),
    event("o1", "Own Goal For", 46, 45, team=AWAY, possession=6),
    event("r1", "Pressure", 45, 10, team=HOME, period=2, possession=7, pressure={"duration": 0.5}),
    event("s5", "Shot", 46, 31, team=AWAY, period=2, possession=8, location=[100.0], shot={"outcome": {"name": "Blocked"}}),
    event("br", "Ball Receipt*", 46, 40, period=2, possession=8, ball_receipt={}),
    event("cl", "Clearance", 46, 41, period=2, possession=8, under_pressure=True, clearance={"body_part": {"name": "Head"}}),
    event("dr", "Dribble", 46, 42, period=2, possession=8, dribble={"outcome": {"name": "Complete"}, "nutmeg": True}),
    event("so", "Shot", 120, 0, team=AWAY, period=5, possession=9, **shot("Goal", kind="Penalty")),
]
MATCHES = [
    {"match_id": 100, "match_date": "2016-05-01", "kick_off": "17:30:00.000", "home_team": {"home_team_id": HOME, "home_team_name": "Old"},
     "away_team": {"id": AWAY, "name": "Away"}, "competition": {"competition_id": 2, "competition_name": "League"}, "season": {"season_id": 27, "season_name": "2015/2016"}},
    {"match_id": 101, "match_date": "bad", "kick_off": None, "home_team": {"home_team_id": HOME, "home_team_name": "New"},
     "away_team": {"id": None, "name": "Nobody"}, "competition": {"competition_id": 2, "competition_name": "League"}, "season": {"season_id": 27, "season_name": "2015/2016"}},
    {"match_id": 101, "match_date": "2016-05-02", "kick_off": None, "home_team": {"home_team_id": HOME, "home_team_name": "New"},
     "away_team": {"id": AWAY, "name": "Away"}, "season": {"season_id": 27, "season_name": "2015/2016"}},
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("source")
    (base / "matches" / "2").mkdir(parents=True)
    (base / "events").mkdir()
    comps = [{"competition_id": 2, "season_id": 27, "competition_name": "Premier League", "season_name": "2015/2016"},
             {"competition_id": 9, "season_id": 1, "competition_name": "Other Cup", "season_name": "2020"}]
    (base / "competitions.json").write_text(json.dumps(comps))
    (base / "matches" / "2" / "27.json").write_text(json.dumps(MATCHES))
    (base / "events" / "100.json").write_text(json.dumps([*EVENTS, EVENTS[0]]))
    (base / "events" / "101.json").write_text("[]")
    return str(base)


@pytest.fixture(scope="module")
def raw(spark, root):
    return N.raw_event_rows(D.read_events(spark, root)).cache()


@pytest.fixture(scope="module")
def games(spark, root):
    return N.match_rows(D.read_matches(spark, root))


@pytest.fixture(scope="module")
def ctx(raw, games):
    return {r["shot_id"]: r for r in shot_context(raw, games).collect()}


def test_competitions(spark, root):
    comps = D.read_competitions(spark, root)
    assert [r["competition_id"] for r in D.discover_competitions(comps).collect()] == [2]
    by_name = D.discover_competitions(comps, [{"name": "Cup", "season": "2020"}, {"competition_id": 9, "season_id": 1}])
    assert [r["competition_id"] for r in by_name.collect()] == [9]
    assert D.read_competitions(spark, root + "/absent").count() == 0
    rows = N.competition_rows(comps)
    assert insert_if_absent(rows, rows.where("competition_id = 2"), ["competition_id", "season_id"]).count() == 1
    picked = D.discover_matches(D.read_matches(spark, root), D.discover_competitions(comps))
    assert {r["competition_name"] for r in picked.collect()} == {"Premier League"}


def test_match_and_team_tables(spark, root, games):
    by_id = {r["match_id"]: r for r in games.collect()}
    assert set(by_id) == {100, 101}
    assert by_id[100]["match_date"].isoformat() == "2016-05-01T00:00:00"
    assert by_id[100]["kickoff_time"].isoformat() == "1970-01-01T17:30:00"
    assert by_id[101]["kickoff_time"] is None
    names = {r["team_id"]: r["name"] for r in N.team_rows(D.read_matches(spark, root)).collect()}
    assert names == {HOME: "New", AWAY: "Away"}
    assert N.missing_competitions(D.read_matches(spark, root), N.competition_rows(D.read_competitions(spark, root))).where("competition_name is not null").count() == 0


def test_events_keep_array_order_and_dedupe(raw):
    assert raw.count() == len(EVENTS)
    order = [r["id"] for r in raw.orderBy("event_seq").collect()]
    assert order == [e["id"] for e in EVENTS]


def test_typed_tables(spark, raw):
    events = {r["event_id"]: r for r in N.event_rows(raw).collect()}
    assert events["s5"]["location_x"] is None and events["s1"]["under_pressure"] is True
    assert events["d1"]["outcome"] == "Won" and events["c1"]["outcome"] is None
    known = spark.createDataFrame([(HOME,)], "team_id long")
    assert {r["event_id"]: r["team_id"] for r in N.event_rows(raw, known).collect()}["c1"] == 0
    carries = {r["event_id"]: r for r in N.carry_rows(raw).collect()}
    assert carries["k2"]["length"] == 5.0
    assert N.duel_rows(raw).first()["is_success"] is True
    assert N.block_rows(raw).first()["block_type"] == "Deflection"
    assert N.ball_receipt_rows(raw).first()["clean_receipt"] is False
    assert N.clearance_rows(raw).first()["under_pressure"] is True
    assert N.dribble_rows(raw).first()["nutmeg"] is True
    assert N.pressure_rows(raw).first()["duration_seconds"] == 0.5
    players = {r["player_id"]: r["name"] for r in N.player_rows(raw).collect()}
    assert players == {1: "Player name 1", 2: "Player 2"}
    todo = N.backlog(raw, N.event_rows(raw.where("period = 1")))
    assert todo.count() == raw.where("period <> 1").count()
    assert [r["id"] for r in N.backlog(raw, N.event_rows(raw.where("period = 1")), 100, 1).collect()] == ["r1"]
    assert N.backlog(raw, N.event_rows(raw.limit(0)), from_match=101).count() == 0


def test_schemas_match_the_tables(raw, games):
    shots = N.shot_rows(raw, games)
    tables = {
        "EVENTS": N.event_rows(raw), "PASSES": N.pass_rows(raw), "CARRIES": N.carry_rows(raw), "DUELS": N.duel_rows(raw), "BLOCKS": N.block_rows(raw),
        "INTERCEPTIONS": N.interception_rows(raw), "PRESSURES": N.pressure_rows(raw), "BALL_RECEIPTS": N.ball_receipt_rows(raw),
        "CLEARANCES": N.clearance_rows(raw), "DRIBBLES": N.dribble_rows(raw), "SHOTS": shots, "MATCHES": games,
        "SHOT_FEATURES": N.shot_feature_rows(shots, N.event_rows(raw)),
    }
    for name, df in tables.items():
        for field in getattr(SC, name).fields:
            assert df.schema[field.name].dataType == field.dataType, (name, field.name)


def test_features_skip_shots_without_location(raw, games):
    features = N.shot_feature_rows(N.shot_rows(raw, games), N.event_rows(raw))
    rows = {r["shot_id"]: r for r in features.collect()}
    assert "s5" not in rows and rows["s1"]["shot_distance"] == 12.0 and rows["s1"]["zone_id"] == "A"
    assert rows["s1"]["possession_sequence_length"] == 4 and rows["s1"]["possession_duration"] == 3.0
    assert rows["s1"]["recent_def_actions_count"] == 1
    assert N.missing_features(features, features.where("shot_id = 's1'")).count() == len(rows) - 1


def test_running_score(ctx):
    assert {k: r["score_diff_at_shot"] for k, r in ctx.items()} == {
        "s1": 0, "s2": 1, "s3": 1, "s4": 1, "pen": -2, "s5": -1, "so": -1,
    }


def test_score_options(raw, games):
    from touchline.operators.sequences import counts_as_goal, running_score

    rows = raw.where(F.col("type.name").isin("Shot", "Own Goal For")).select(
        "id", "match_id", "period", "minute", "second", "event_seq", F.col("team.id").alias("team_id"),
        F.col("type.name").alias("kind"), F.col("shot.outcome.name").alias("outcome"),
    )
    goal = counts_as_goal(F.col("outcome"), F.col("kind"), F.col("period"), include_own_goals=True, exclude_shootout=True)
    scored = running_score(rows, "match_id", "team_id", ["period", "minute", "second", "event_seq"], goal)
    assert {r["id"]: r["score_diff_at_shot"] for r in scored.collect()}["so"] == 0


def test_chains_use_the_passing_team(ctx):
    # the carry before p1 belongs to the other team; the one before p2 counts
    assert ctx["s1"]["chain_label"] == "Direct + Ground Pass"
    assert ctx["s4"]["chain_label"] == "Carry + Cross"
    assert ctx["s2"]["chain_label"] == "Unassisted"


def test_triggers(ctx):
    assert ctx["s1"]["def_label"] == "Duel – Tackle" and ctx["s1"]["seconds_since_def_action"] == 0
    assert ctx["s1"]["possession_label"] == "Opponent Duel – Tackle" and ctx["s1"]["possession_alignment"] is True
    assert ctx["s2"]["def_label"] == "Block – Deflection" and ctx["s2"]["seconds_since_def_action"] == 5
    assert ctx["s3"]["def_label"] == "No immediate defensive trigger" and ctx["s3"]["seconds_since_def_action"] == 6
    assert ctx["s3"]["possession_label"] == "No possession defensive trigger" and ctx["s3"]["possession_alignment"] is False
    # the clock ignores the period: pressure at 45:10 of the second half precedes the 46:30 penalty of the first
    assert ctx["pen"]["seconds_since_def_action"] == 80


def test_period_aware_clock(raw, games):
    from touchline.plans.context import scored_shots

    rows = with_triggers(scored_shots(raw, games), trigger_events(raw), use_period=True)
    by_id = {r["shot_id"]: r["seconds_since_def_action"] for r in rows.collect()}
    assert by_id["pen"] == 46 * 60 + 30 - 600 and by_id["so"] is None


def test_labels(ctx):
    assert ctx["s4"]["set_piece_category"] == "Corner" and ctx["s4"]["set_piece_phase"] == "First Phase"
    assert ctx["pen"]["set_piece_category"] == "Penalty" and ctx["pen"]["set_piece_phase"] == "Direct"
    assert ctx["s4"]["assist_category"] == "Set Piece" and ctx["s1"]["assist_category"] == "Ground Pass"
    assert ctx["s1"]["recipient_zone"] == "Penalty area"
    assert ctx["s1"]["pressure_state"] == "Under pressure"
    # player 1 shot right, left, right
    assert ctx["s3"]["foot_finish_group"] == "Weak Foot" and ctx["s2"]["foot_finish_group"] == "Strong Foot"
    assert ctx["pen"]["foot_finish_group"] == "Footed shot (unknown preference)"
    assert ctx["so"]["minute_bucket_label"] == "90+"


def test_dataset_columns(spark, raw, games):
    from touchline import config as C

    dataset = modelling_dataset(shot_context(raw, games), games)
    assert dataset.columns == C.DATASET_COLUMNS
    row = dataset.where("shot_id = 's1'").first()
    assert row["competition_season"] == "2015/2016" and row["is_home"] is True and row["opponent_team_id"] == AWAY
