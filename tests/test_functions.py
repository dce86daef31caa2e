import math

import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import labels as L
from touchline.functions import numeric as X
from touchline.functions import timing as T
from touchline.functions.geometry import distance, geometry_columns, shot_angle


def values(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_geometry_probes(spark):
    g = geometry_columns(F.col("x"), F.col("y"))
    got = values(spark, "x double, y double", [(108.0, 40.0), (100.0, 50.0), (100.0, 30.0), (None, 1.0)], **g)
    assert got[0][0] == 12 and got[0][2] == 0 and got[0][3] == 12 and got[0][4] == "A"
    assert got[1][2] == got[2][2] == 10 and got[1][3] == 20
    assert got[3][1] is None and got[3][4] is None


def test_angle_grows_near_goal_and_is_zero_on_a_post(spark):
    got = values(spark, "x double, y double", [(60.0, 40.0), (110.0, 40.0), (120.0, 36.8), (120.0, 40.0)], a=shot_angle(F.col("x"), F.col("y")))
    assert got[0][0] < got[1][0]
    assert got[2][0] == 0.0
    assert got[3][0] == pytest.approx(math.pi)


def test_distance_to_other_target(spark):
    assert values(spark, "x double, y double", [(3.0, 4.0)], d=distance(F.col("x"), F.col("y"), 0, 0)) == [(5.0,)]


@pytest.mark.parametrize("dist,central,expected", [
    (10, 5, "A"), (10, 15, "B"), (15, 5, "C"), (15, 15, "D"), (25, 5, "E"), (25, 15, "F"), (12, 10, "A"), (20, 10, "C"), (20.01, 10.01, "F"),
])
def test_zones(spark, dist, central, expected):
    from touchline.functions.geometry import zone

    assert values(spark, "d double, c double", [(float(dist), float(central))], z=zone(F.col("d"), F.col("c"))) == [(expected,)]


def test_minute_buckets_on_every_edge(spark):
    minutes = [(m,) for m in (0, 14, 15, 16, 30, 31, 45, 46, 60, 61, 75, 76, 90, 91, 120, 121, None)]
    got = values(spark, "m int", minutes, right=T.minute_bucket_closed_right(F.col("m")), left=T.minute_bucket_closed_left(F.col("m")))
    assert [r[0] for r in got] == ["0-15"] * 3 + ["16-30"] * 2 + ["31-45"] * 2 + ["46-60"] * 2 + ["61-75"] * 2 + ["76-90"] * 2 + ["90+"] * 3 + [None]
    assert [r[1] for r in got] == ["0-15", "0-15", "15-30", "15-30", "30-45", "30-45", "45-60", "45-60", "60-75", "60-75", "75-90", "75-90", "90+", "90+", "90+", "Unknown", "Unknown"]


def test_timestamps_read_the_fraction_as_milliseconds(spark):
    got = values(spark, "t string", [("00:00:15.123",), ("01:02:03",), ("00:00:01.5",)], s=T.timestamp_seconds(F.col("t")), d=T.timestamp_of_day(F.col("t")))
    assert [r[0] for r in got] == [15.123, 3723.0, 1.005]
    assert got[0][1].isoformat() == "1900-01-01T00:00:15.123000"
    assert values(spark, "a string, b string", [("00:00:01.000", "00:01:00.500")], d=T.possession_duration(F.col("a"), F.col("b"))) == [(59.5,)]


def test_score_states(spark):
    got = values(spark, "d int", [(-100,), (-99,), (-2,), (-1,), (0,), (1,), (2,), (100,), (None,)], s=L.score_state(F.col("d")))
    assert [r[0] for r in got] == ["Unknown", "Trailing 2+", "Trailing 2+", "Trailing 1", "Level", "Leading 1", "Leading 2+", "Unknown", "Unknown"]


def test_simple_state_precedence(spark):
    rows = [(True, True, None), (None, True, True), (False, None, True), (None, None, None)]
    got = values(spark, "a boolean, b boolean, c boolean", rows, s=L.simple_state(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in got] == ["Leading", "Trailing", "Drawing", "Unknown"]


def test_bins_are_closed_left(spark):
    label = X.bin_left_closed(F.col("v"), C.TIME_GAP_EDGES, C.TIME_GAP_LABELS, "Unknown")
    got = values(spark, "v double", [(0.0,), (2.0,), (4.99,), (5.0,), (30.0,), (1e9,), (-0.1,), (None,)], b=label)
    assert [r[0] for r in got] == ["0-2s", "2-5s", "2-5s", "5-10s", "30s+", "30s+", "Unknown", "Unknown"]


def test_edge_bins_use_literal_doubles(spark):
    edges = X.linspace(0, 1, 11)
    got = values(spark, "p double", [(0.3,), (0.6,), (0.7,), (0.1,), (1.0,), (0.0,)], b=X.edge_bin(F.col("p"), edges), c=X.edge_bin(F.col("p"), edges, True))
    assert [r[0] for r in got] == [2, 5, 6, 1, None, 0]
    assert got[4][1] == 9


def test_even_bin_edges(spark):
    got = values(spark, "v double", [(0.0,), (4.999,), (5.0,), (120.0,), (120.1,), (-1.0,), (None,)], b=X.even_bin(F.col("v"), 0.0, 120.0, 24))
    assert [r[0] for r in got] == [0, 0, 1, 23, None, None, None]


def test_ratio_logit_shrink(spark):
    got = values(spark, "n int, m double, g double", [(0, None, 0.2), (50, 0.4, 0.2), (None, None, 0.1)],
                 r=X.safe_ratio(F.col("m"), F.col("n")), s=X.shrink(F.col("n"), F.col("m"), F.col("g")), z=X.logit(F.col("g") * 0))
    assert got[0][0] is None and got[0][1] == 0.2 and got[2][1] == 0.1
    assert got[1][1] == pytest.approx(0.3)
    assert got[0][2] == pytest.approx(math.log(1e-4 / (1 - 1e-4)))


def test_pressure_proxy_defaults(spark):
    got = values(spark, "p boolean, a int, d double", [(True, 1, 5.0), (None, 2, 0.0)], s=X.pressure_proxy(F.col("p"), F.col("a"), F.col("d")))
    assert got[0][0] == pytest.approx(0.5)
    assert got[1][0] == pytest.approx(0.3 + 0.2 * (1 - 1 / 6) / (3 / 25))


def test_pass_style_order(spark):
    rows = [
        (False, None, None, None, None, None, None), (True, True, True, None, True, "High Pass", None), (True, None, True, True, None, None, None),
        (True, None, None, True, True, None, None), (True, None, None, None, True, "High Pass", None), (True, None, None, None, None, "High Pass", "Corner"),
        (True, None, None, None, None, "Low Pass", None), (True, None, None, None, None, None, "Corner"), (True, None, None, None, None, None, None),
    ]
    names = "abcdefg"
    schema = "a boolean, b boolean, c boolean, d boolean, e boolean, f string, g string"
    got = values(spark, schema, rows, s=L.pass_style(*[F.col(c) for c in names]))
    assert [r[0] for r in got] == ["Assist Unknown", "Cutback", "Through Ball", "Switch", "Cross", "High Pass", "Ground Pass", "Corner", "Other Pass"]


def test_chain_labels(spark):
    rows = [(None, "Cross", "Carry"), ("", "Cross", None), ("k", None, None), ("k", "Cross", "Duel"), ("k", "Cross", "Carry")]
    got = values(spark, "k string, s string, p string", rows, c=L.chain_label(F.col("k"), F.col("s"), F.col("p")))
    assert [r[0] for r in got] == ["Unassisted", "Unassisted", "Direct + Assist Unknown", "Duel Win + Cross", "Carry + Cross"]


def test_set_piece_rules(spark):
    rows = [("Penalty", "From Corner"), ("Free Kick", None), (None, "From Corner"), (None, "From Counter"), (None, "From Keeper"), (None, "Regular Play"), (None, None)]
    cat = L.set_piece_category(F.col("t"), F.col("p"))
    got = values(spark, "t string, p string", rows, c=cat, g=L.set_piece_group(cat), f=L.set_piece_phase(cat, F.lit("k")))
    assert [r[0] for r in got] == ["Penalty", "Direct Free Kick", "Corner", "Other Restart", "Other Restart", "Open Play", "Open Play"]
    assert [r[1] for r in got] == ["Direct", "Direct", "Restart", "Restart", "Restart", "Open Play", "Open Play"]
    assert [r[2] for r in got] == ["Direct", "Direct", "First Phase", "First Phase", "First Phase", "Open Play", "Open Play"]


def test_foot_finish_and_trigger_labels(spark):
    rows = [("Left Foot", "Left Foot"), ("Left Foot", "Right Foot"), ("Right Foot", None), ("Head", None), (None, None), ("Other", None)]
    got = values(spark, "b string, f string", rows, g=L.foot_finish(F.col("b"), F.col("f")))
    assert [r[0] for r in got] == ["Strong Foot", "Weak Foot", "Footed shot (unknown preference)", "Header", "Unknown body part", "Other"]
    rows = [("Block", "Opponent", None, "Deflection"), ("Duel", "Own", "Tackle", None), ("Carry", "Other", None, " "), (None, None, None, None)]
    label = L.trigger_label(F.col("t"), F.col("r"), [F.col("a"), F.col("b")], "none")
    got = values(spark, "t string, r string, a string, b string", rows, g=label)
    assert [r[0] for r in got] == ["Opponent Block – Deflection", "Duel – Tackle", "Other Carry", "none"]


def test_small_helpers(spark):
    got = values(spark, "s string", [(" 2015 - 2016 ",), (None,)], k=L.season_key(F.col("s")), h=L.is_holdout(F.lit(2), F.col("s")))
    assert got == [("2015/2016", True), ("", False)]
    assert values(spark, "s string", [("Premier League!! 15/16 ",), (None,)], g=L.slug(F.col("s"))) == [("premier-league-15-16",), ("",)]
    assert values(spark, "s string", [("True",), ("1",), ("0",), ("x",), (None,)], h=L.home_flag(F.col("s"))) == [(True,), (True,), (False,), (False,), (False,)]
    assert values(spark, "a string, b string", [("x", None)], k=L.bucket_key(F.col("a"), F.col("b"))) == [("x|Unknown",)]
    assert values(spark, "b boolean", [(True,), (False,), (None,)], p=L.possession_state(F.col("b"))) == [("Same",), ("Different",), ("Unknown",)]


def test_archetype_and_profile_rules(spark):
    rows = [(0.06, 0.0, 10.0, 0.0, 0.0), (-0.2, 0.0, 10.0, 0.06, 0.0), (0.0, 0.0, 18.5, 0.0, 0.0), (0.0, -0.2, 10.0, 0.0, 0.0), (0.0, 0.0, 10.0, 0.0, 0.0), (-0.07, 0.0, None, None, None)]
    got = values(spark, "a double, d double, m double, t double, c double", rows, k=L.team_archetype(*[F.col(c) for c in "admtc"]))
    assert [r[0] for r in got] == ["high_press", "counter", "direct", "defensive", "balanced", "possession"]
    rows = [(5.0, "Head", None, None, None), (30.0, None, None, "Corner", None), (23.0, None, None, None, None), (9.0, None, "Carry + Cutback", None, None),
            (15.0, None, None, None, "Through Ball"), (11.0, None, None, None, None), (None, None, None, None, None)]
    got = values(spark, "d double, b string, c string, s string, a string", rows, k=L.shot_profile(*[F.col(c) for c in "dbcsa"]))
    assert [r[0] for r in got] == ["aerial", "set_piece", "long_range", "poacher", "counter_shot", "poacher", "creator"]


def test_match_times_parse_whole_values(spark):
    import datetime as dt

    from touchline.operators.normalise import match_rows
    from touchline.schemas import MATCH_DOC

    schema = "match_id long, competition_id long, season_id long, doc_seq int"
    texts = [("2016-05-01T15:00:00", "19:45"), ("2016-05-01", "19:45:00.000"), ("2016-05-01junk", "late"), (None, None), ("2016", "25:10")]
    rows = spark.createDataFrame([(i, 1, 1, i) for i in range(len(texts))], schema)
    for field in MATCH_DOC.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    for i, (date, kick) in enumerate(texts):
        rows = rows.withColumns({
            "match_date": F.when(F.col("match_id") == i, F.lit(date)).otherwise(F.col("match_date")),
            "kick_off": F.when(F.col("match_id") == i, F.lit(kick)).otherwise(F.col("kick_off")),
        })
    found = [(r.match_date, r.kickoff_time) for r in match_rows(rows).orderBy("match_id").collect()]
    day, kick = dt.datetime(2016, 5, 1), dt.datetime(1970, 1, 1, 19, 45)
    assert found == [(day.replace(hour=15), kick), (day, kick), (None, None), (None, None), (None, None)]


def test_first_row_per_key_is_the_same_in_every_run(spark):
    from touchline.operators.joins import first_per_key

    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "b"), (1, 2, "a"), (2, None, None), (None, 1, "x")], "k int, o int, v string")
    for parts in (1, 3):
        got = {tuple(r) for r in first_per_key(rows.repartition(parts), ["k"], ["o"]).collect()}
        assert got == {(1, 1, "b"), (2, None, None), (None, 1, "x")}


def test_unreadable_documents_fail(spark, tmp_path):
    import pytest

    from touchline.sources.documents import read_events, read_matches

    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "7.json").write_text('[{"id": "a", "period": 1}, {"id": "b", ')
    (tmp_path / "matches" / "1").mkdir(parents=True)
    (tmp_path / "matches" / "1" / "2.json").write_text('[{"match_id": "seven"}]')
    for read in (read_events, read_matches):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark, str(tmp_path)).collect()
