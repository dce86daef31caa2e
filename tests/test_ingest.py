"""Keep-first by position, and files that can be read in part."""

import json

from pyspark.sql import functions as F

from touchline.operators.filters import apply_modelling_filters
from touchline.operators.joins import attach, first_rows
from touchline.operators.normalise import match_rows, raw_event_rows
from touchline.plans.ingest import ingest_events, write_tables


def test_first_rows(spark):
    rows = [(1, 3, "c", {"a": 1}), (1, 1, "b", None), (1, 2, "a", {}), (2, None, None, {"b": 2}), (None, 2, "y", {}), (None, 1, "x", {}), (3, 1, "t", {}), (3, 1, "t", {})]
    df = spark.createDataFrame(rows, "k int, o int, v string, m map<string, int>").withColumn("s", F.struct("m"))
    for parts in (1, 4):
        got = sorted(((r.k or 0, r.o, r.v) for r in first_rows(df.repartition(parts), ["k"], ["o"]).collect()))
        assert got == [(0, 1, "x"), (1, 1, "b"), (2, None, None), (3, 1, "t")]
    assert first_rows(df, ["k"], ["o"]).schema.simpleString() == df.schema.simpleString()
    assert first_rows(df.where("false"), ["k"], ["o"]).count() == 0
    odd = df.selectExpr("k as `a.b`", "v as `__k`", "o")
    assert first_rows(odd, ["a.b"], ["o"]).columns == odd.columns and first_rows(odd.select("o"), ["o"], []).count() == 4


def test_ties_do_not_depend_on_partitions(spark):
    df = spark.range(2000).selectExpr("id % 7 as k", "1 as o", "id as v")
    assert len({tuple(sorted(map(tuple, first_rows(df.repartition(n), ["k"], ["o"]).collect()))) for n in (1, 3, 8)}) == 1


def test_only_repeated_events_move_whole(spark, tmp_path):
    spark.range(100).selectExpr(
        "1L as match_id", "cast(id as int) as event_seq", "concat('e', id div 2) as id", "named_struct('id', 1L, 'name', 'Pass') as type", "1 as period", "0 as minute", "0 as second"
    ).write.parquet(f"{tmp_path}/docs")
    out = raw_event_rows(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(r.event_seq for r in out.collect()) == list(range(0, 100, 2))


def test_labels_and_matches_keep_the_first(spark):
    base, labels = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "z", 0), (1, "a", 1)], "k int, v string, at int")
    assert {tuple(r) for r in attach(base, labels, ["k"], ["v"], order=["at"]).collect()} == {(1, "z"), (2, None)}
    assert {tuple(r) for r in attach(base, labels, ["k"], ["v"]).collect()} == {(1, "a"), (2, None)}
    team = "struct<home_team_id: long, home_team_name: string, id: long, name: string>"
    docs = spark.createDataFrame([(5, i, 1, 1, d, None) for i, d in ((1, "2016-01-01"), (0, "2017-01-01"))],
                                 "match_id long, doc_seq int, competition_id long, season_id long, match_date string, kick_off string")
    docs = docs.withColumns({"home_team": F.lit(None).cast(team), "away_team": F.lit(None).cast(team.replace("home", "away")),
                             "season": F.lit(None).cast("struct<season_id: long, season_name: string>")})
    assert match_rows(docs).first()["match_date"].year == 2017


def test_bad_files_are_counted_rejects(spark, tmp_path):
    (tmp_path / "events").mkdir()
    one = {"id": "a", "period": 1, "type": {"id": 1, "name": "Pass"}}
    texts = {1: json.dumps([one, one, {"id": "b"}]), 2: '[{"id": "a"}, {"id": ', 3: '{"id": "a"}x', 4: "[]", 5: json.dumps([{"id": "c", "period": "one"}, None, {"id": "d"}]), 6: ""}
    for k, t in texts.items():
        (tmp_path / "events" / f"{k}.json").write_text(t)
    raw, rejects, counts = ingest_events(spark, str(tmp_path), f"{tmp_path}/out")
    assert sorted((r.match_id, r.id, r.event_seq) for r in raw.collect()) == [(1, "a", 0), (1, "b", 2), (5, "d", 2)]
    found = sorted((r.match_id, -1 if r.event_seq is None else r.event_seq) for r in rejects.collect())
    assert [f for f in found if f[0] != 6] == [(2, -1), (3, -1), (5, 0), (5, 1)]
    assert counts == {"accepted": 4, "rejected": len(found), "raw": 3}


def test_counts_come_with_the_write(spark, tmp_path):
    tables = {"a": spark.range(10), "b": spark.range(1000).where("id % 3 = 0"), "c": spark.range(0)}
    assert {tuple(r) for r in write_tables(tables, str(tmp_path)).collect()} == {("a", 10), ("b", 334), ("c", 0)}
    assert spark.read.parquet(f"{tmp_path}/b").count() == 334


def test_filters_keep_the_same_shot(spark):
    from touchline.catalog.priors import _allowed, _audit_rows
    from tests.conftest import SMALL

    rows = _audit_rows(spark, SMALL)
    twice = rows.unionByName(rows)
    assert apply_modelling_filters(twice, _allowed(spark, SMALL)).count() == apply_modelling_filters(rows, _allowed(spark, SMALL)).count() > 0
