import json

import pytest
from builders import dimension
from pyspark.sql import functions as F

from impactframe.functions import seasons as S
from impactframe.functions import text as X
from impactframe.operators import coverage, scopes, teams
from impactframe.sources import csv_files as C
from impactframe.sources import payloads as P


def column(spark, values, rule, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()]


def test_minutes_and_numbers(spark):
    texts = ["48:00", "PT47M30S", "12.5", "0:00", "DNP - Coach's Decision", None, "bad", "PT", "PT30S", "nan"]
    assert column(spark, texts, X.played_minutes) == [48.0, 47.5, 12.5, 0.0, None, None, None, None, 0.5, None]
    assert column(spark, ["5", "-3.5", "", "true", "inf", "nan", ".5"], X.number) == [5.0, -3.5, None, None, None, None, 0.5]
    assert column(spark, ["12", "12.0", "12.5", "x", None], X.whole_number) == [12, 12, None, None, None]


def test_signature_and_decimals(spark):
    message = "bad row for game '0020301176' player_id=445 player_name='Wesley Person'  in v2"
    assert column(spark, [message], X.message_signature) == [
        "bad row for game '<value>' player_id=<num> player_name='<value>' in v2"
    ]
    assert column(spark, [10.0, 10.004, 10.005], X.two_decimals, "double") == ["10.00", "10.00", "10.01"]


def test_seasons(spark):
    ids = column(spark, ["2014", "2014-15", "2014-14", "1999-00", "x"], lambda c: S.season_id(c, F.lit("reg. season")))
    assert ids == ["2014-15:REGULAR", "2014-15:REGULAR", None, "1999-00:REGULAR", None]
    assert column(spark, ["2014-15:playoff", "2014-15:cup", "2014-15"], S.canonical_season_id) == ["2014-15:PLAYOFFS", None, None]
    history = scopes.all_history(spark, 1947)
    assert history.count() == 4 and history.first().start_year == 1947


def test_club_names(spark):
    spans = teams.club_spans(spark)
    dim = teams.team_seasons(spans, 2025)
    short = {r.abbreviation for r in dim.filter("start_year = 1983").collect()}
    assert {"SDC", "KCK"} <= short and not {"LAC", "SAC"} & short
    asked = spark.createDataFrame([("NOH", "2003-03-10"), ("SDC", "1980-12-01"), ("NOH", "2020-12-01")], "abbreviation string, day string")
    found = {(r.abbreviation, r.day): r.resolved_team_id for r in teams.resolve_abbreviations(asked, spans, day=F.col("day").cast("date")).collect()}
    assert found == {("NOH", "2003-03-10"): 1610612740, ("SDC", "1980-12-01"): 1610612746, ("NOH", "2020-12-01"): None}
    aliases = spark.createDataFrame([("SDC",), ("lac",), ("CHH",), ("???",)], "abbreviation string")
    got = {r.abbreviation: r.resolved_team_id for r in teams.resolve_aliases(aliases, spans).collect()}
    assert got == {"SDC": 1610612746, "lac": 1610612746, "CHH": 1610612766, "???": None}
    current = {r.team_id: r.current_abbreviation for r in teams.current_labels(dim).collect()}
    assert current[1610612740] == "NOP"


@pytest.fixture()
def csv_folder(tmp_path):
    games = ["gameId,gameType,gameDateTimeEst,hometeamId,awayteamId,homeScore,awayScore"]
    games += ["1,Regular Season,2022-11-01 19:00:00,1,2,100,90", "1,Regular Season,2022-11-01 19:00:00,1,2,100,90"]
    games += ["2,NBA Cup,2022-11-02 19:00:00,2,1,80,85", "3,All-Star Game,2022-11-03 19:00:00,1,2,1,2"]
    games += ["4,Regular Season,2022-11-04 19:00:00,1,77,1,2", "5,Exhibition,2022-11-05 19:00:00,1,2,1,2"]
    games += ["6,Playoffs,2023-05-05 19:00:00,1,2,1,2"]
    players = ["gameId,home,personId,firstName,lastName,numMinutes,points"]
    for game in (1, 2, 3):
        for home in (0, 1):
            players += [f"{game},{home},{home}{i},Ann,Other{i},{20 + i},0" for i in range(1, 6)]
    players += ["1,1,16,,,,3", "1,1,17,No,Show,,0", "1,0,99,,,5,0", '6,1,11,Ann,"Quoted, Name",30,0']
    names = ["personId,firstName,lastName", "16,Old,Name", "16,Dora,Dict", ",X,Y"]
    for name, lines in (("Games", games), ("PlayerStatistics", players), ("Players", names)):
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode() + b"\n")
    return str(tmp_path)


def test_csv_folder(spark, csv_folder):
    result = C.ingest_folder(spark, csv_folder, dimension(spark, [1, 2], range(2020, 2025)), refuse=False)
    games = {(r.game_id, r.team_id): (r.margin, r.is_home, r.season) for r in result.games.collect()}
    assert games == {
        ("1", 1): (10.0, True, "2022-23"),
        ("1", 2): (-10.0, False, "2022-23"),
        ("2", 2): (-5.0, True, "2022-23"),
        ("2", 1): (5.0, False, "2022-23"),
    }
    extra = {r.player_id: r for r in result.game_players.filter("game_id = '1' and player_id in (16, 17)").collect()}
    assert (extra[16].player_name, extra[16].appeared, extra[16].minutes) == ("Dora Dict", True, 0.0)
    assert extra[17].appeared is False
    loads = {r.team_id: (r.games_row_count, r.expected_games_row_count, r.skipped_games_row_count) for r in result.loads.collect()}
    assert loads == {1: (2, 2, 2), 2: (2, 2, 1)}
    assert result.loads.first().source_snapshot.startswith("kaggle-v1:Games.csv:")
    messages = {(r.table, r.message) for r in result.issues.collect()}
    assert messages == {("games", "unsupported gameType Exhibition"), ("game_players", "blank player name")}
    profile = {(r.file, r.column): r.type for r in C.column_profile(spark, csv_folder, ["Games.csv", "Players.csv"]).collect()}
    assert profile["Games.csv", "gameId"] == "bigint" and profile["Games.csv", "gameDateTimeEst"] == "timestamp"
    assert profile["Players.csv", "firstName"] == "string"


def test_differing_repeats_are_set_apart(spark):
    raw = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("2", "b")], "gameId string, x string")
    rows, conflicting = C.distinct_games(raw)
    assert [r.gameId for r in rows.collect()] == ["1"]
    assert sorted(r.x for r in conflicting.collect()) == ["a", "b"]


def test_a_bad_game_refuses_its_team_seasons(spark):
    days = ["2022-11-01 19:00:00", "2022-11-02 19:00:00", "2021-11-02 19:00:00"]
    rows = [("1", days[0], "1", "2", "100"), ("2", days[1], "1", "3", "?"), ("3", days[2], "1", "2", "90")]
    games = spark.createDataFrame(
        [(i, "Regular Season", day, h, a, score, "80") for i, day, h, a, score in rows],
        "gameId string, gameType string, gameDateTimeEst string, hometeamId string, awayteamId string, homeScore string, awayScore string",
    )
    players = spark.createDataFrame(
        [(g, h, f"{h}{n}", "A", "B", "20") for g in "123" for h in "01" for n in range(5)],
        "gameId string, home string, personId string, firstName string, lastName string, numMinutes string",
    )
    names = spark.createDataFrame([], "personId string, firstName string, lastName string")
    result = C.normalize(games, players, names, dimension(spark, [1, 2, 3], range(2020, 2025)))
    counts = {(r.team_id, r.season): (r.games_row_count, r.expected_games_row_count) for r in result.loads.collect()}
    assert counts[1, "2022-23"] == (1, 2) and counts[2, "2022-23"] == (1, 1)
    failures = {(r.team_id, r.season, r.failure_kind, r.message) for r in result.failures.collect()}
    assert failures == {(t, "2022-23", "partial_scope_error", "missing or invalid score") for t in (1, 3)}
    whole = C.whole_scopes(result)
    kept = {(1, "2021-22"), (2, "2021-22"), (2, "2022-23")}
    for table in (whole.games, whole.game_players, whole.loads):
        assert {(r.team_id, r.season) for r in table.collect()} == kept



@pytest.mark.parametrize(
    ("failure", "left"),
    [
        ((1, "2021-22", "A"), 7),
        ((None, "2021-22", "A"), 6),
        ((None, "2021-22", None), 4),
        ((2, None, None), 4),
        ((None, None, "B"), 4),
        ((None, None, None), 0),
        ((3, "2021-22", None), 8),
    ],
)
def test_what_is_null_in_a_failure_refuses_all(spark, failure, left):
    scopes_ = [(t, s, k) for t in (1, 2) for s in ("2021-22", "2022-23") for k in "AB"]
    loads = spark.createDataFrame(scopes_, "team_id long, season string, season_type string")
    failures = spark.createDataFrame([failure] * 2, loads.schema)
    whole = C.whole_scopes(C.Ingested(loads, loads, loads, None, failures))
    plan = whole.loads._jdf.queryExecution().toString()
    assert whole.loads.count() == left and "NestedLoop" not in plan and "Cartesian" not in plan


def _sets(player_rows, team_rows):
    return {
        "resultSets": [
            {"name": "PlayerStats", "headers": ["GAME_ID", "TEAM_ID", "PLAYER_ID", "PLAYER_NAME", "MIN", "PTS"], "rowSet": player_rows},
            {"name": "TeamStats", "headers": ["TEAM_ID", "PTS", "PLUS_MINUS"], "rowSet": team_rows},
        ]
    }


def _live(team, score, minutes):
    entries = [{"personId": team * 10, "firstName": "A", "familyName": "B", "statistics": {"minutes": minutes, "minutesCalculated": ""}}]
    return {"teamId": team, "score": score, "statistics": {"plusMinusPoints": None}, "players": entries}


@pytest.fixture()
def payload_folder(tmp_path):
    (tmp_path / "team_seasons").mkdir()
    (tmp_path / "boxscores").mkdir()

    def schedule(label, team, rows):
        headers = ["TEAM_ID", "TEAM_ABBREVIATION", "GAME_ID", "GAME_DATE", "MATCHUP"]
        body = {"resultSets": [{"headers": headers, "rowSet": [[team, label, *r] for r in rows]}]}
        (tmp_path / "team_seasons" / f"{label}_2022-23_regular_season_leaguegamefinder.json").write_text(json.dumps(body))

    def box(name, body):
        (tmp_path / "boxscores" / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))

    schedule("T01", 1, [["001", "2022-11-01", "T01 vs. T02"], ["002", "2022-11-02", "T01 @ T02"], ["001", "2022-11-01", "T01 vs. T02"]])
    schedule("T02", 2, [["001", "2022-11-01", "T02 @ T01"], ["003", "2022-11-03", "T02 vs. T01"]])
    box("001_boxscoretraditionalv2", _sets([], []))
    box(
        "001_boxscoretraditionalv3",
        _sets(
            [["001", 1, 11, "One", "12:30", 2], ["001", 1, 12, "Two", None, 0], ["001", 1, 0, "", None, None], ["001", 2, 21, "Three", None, 4], ["001", 2, 22, "Four", "9", 0]],
            [[1, 100, 7], [2, 93, -7]],
        ),
    )
    box("002_boxscorelive", {"game": {"homeTeam": _live(2, 90, "PT10M"), "awayTeam": _live(1, 99, "PT20M30S")}})
    box("003_boxscoretraditionalv2", "{broken")
    return str(tmp_path)


def test_payload_folder(spark, payload_folder):
    spans = spark.createDataFrame([(t, f"T0{t}", "C", "N", 2000, None, f"T0{t}") for t in (1, 2)], teams.SPANS)
    result = P.normalize_folder(spark, payload_folder, spans, teams.team_seasons(spans, 2025))
    games = {(r.game_id, r.team_id): (r.is_home, r.margin, r.opponent_team_id) for r in result.games.collect()}
    # Team 2 is refused as a whole: one game has no readable box score, another a row without minutes.
    assert games == {("001", 1): (True, 7.0, 2), ("002", 1): (False, 9.0, 2)}
    players = {(r.game_id, r.player_id): (r.player_name, r.minutes) for r in result.game_players.collect()}
    assert players == {("001", 11): ("One", 12.5), ("002", 10): ("A B", 20.5)}
    failures = {(r.team_id, r.game_id): r.message for r in result.failures.collect()}
    assert failures == {(2, "001"): "player row with unreadable MIN", (2, "003"): "no box score for the game"}
    load = result.loads.first()
    assert (load.team_id, load.games_row_count, load.game_players_row_count) == (1, 2, 2)
    assert P.failure_kinds(result.failures).first().scopes == 1
    files = P.read_files(spark, f"{payload_folder}/boxscores/*.json")
    names = {r.player_id: r.player_name for r in P.player_names(P.parse_box_scores(files)).collect()}
    assert names == {11: "One", 12: "Two", 21: "Three", 22: "Four", 10: "A B", 20: "A B"}


def test_findings_of_a_batch(spark):
    def lineup(minutes, ids=None):
        return list(zip(ids or range(1, len(minutes) + 1), minutes, strict=True))

    good = lineup([48.0] * 5)
    cases = [
        ("good", "2022-23", 3.0, good, None),
        ("late", "2022-23", 3.0, good, "date '2024-02-01' falls outside season '2022-23'"),
        ("margin", "2022-23", float("inf"), good, "margin must be finite"),
        ("minus", "2022-23", 3.0, lineup([-1.0] + [48.0] * 5), "minutes must be finite and not negative"),
        ("long", "2022-23", 3.0, lineup([80.5] + [48.0] * 5), "implausible minutes 80.5"),
        ("limit", "2022-23", 3.0, lineup([80.0] + [35.0] * 4), None),
        ("twice", "2022-23", 3.0, lineup([40.0] * 6, [7, 3, 7, 3, 1, 2]), "duplicate player row 3"),
        ("few", "2022-23", 3.0, lineup([60.0] * 4), "expected at least 5 appeared players, found 4"),
        ("many", "2022-23", 3.0, lineup([10.0] * 26), "expected at most 25 player rows, found 26"),
        ("short", "2022-23", 3.0, lineup([43.9] * 5), "implausible total minutes 219.5"),
        ("problem", "2022-23", None, [], None),
    ]
    rows = spark.createDataFrame(
        [(g, s, m, 1, 2, players, "unreadable" if g == "problem" else None) for g, s, m, players, _ in cases],
        "game_id string, season string, margin double, team_id long, opponent_team_id long, "
        "lineup array<struct<player_id:long,minutes:double>>, problem string",
    ).withColumn("game_date", F.when(F.col("game_id") == "late", "2024-02-01").otherwise("2023-01-05").cast("date"))
    found = {r.game_id: r.f and r.f.message for r in rows.select("game_id", P.batch_finding(P.BatchLimits()).alias("f")).collect()}
    assert found == {g: message for g, _, _, _, message in cases}


def test_a_finding_refuses_the_team_season(spark, payload_folder):
    spans = spark.createDataFrame([(t, f"T0{t}", "C", "N", 2000, None, f"T0{t}") for t in (1, 2)], teams.SPANS)
    result = P.ingest_folder(spark, payload_folder, spans, teams.team_seasons(spans, 2025))
    assert result.games.isEmpty() and result.game_players.isEmpty() and result.loads.isEmpty()
    failures = {(r.team_id, r.failure_kind, r.game_id, r.message) for r in result.failures.collect()}
    # The first finding of team 1; team 2 has unreadable games and is not checked as a batch.
    assert failures == {
        (1, "validation_error", "001", "expected at least 5 appeared players, found 1"),
        (2, "partial_scope_error", "001", "player row with unreadable MIN"),
        (2, "partial_scope_error", "003", "no box score for the game"),
    }
    details = json.loads(result.failures.filter("game_id = '001' and team_id = 2").first().details)
    assert [list(row) for row in details] == [["game_id", "minutes", "player_id", "player_name", "team_id"]] * 2
    assert details[0]["minutes"] is None


def test_quarter_coverage(spark):
    rows = [("1", "2001-01-01 00:00:00", "C", "N", "5", None, "3", None), ("2", "2002-01-01 00:00:00", "C", "N", "5", "1", "3", "4")]
    df = spark.createDataFrame(rows, "gameId string, gameDateTimeEst string, teamCity string, teamName string, q1Points string, q2Points string, q3Points string, q4Points string")
    got = {r.name: r.gameId for r in coverage.quarter_coverage(df).collect()}
    assert got == {"q1Points": "1", "q2Points": "2", "q3Points": "1", "q4Points": "2", "all_quarters": "2"}
