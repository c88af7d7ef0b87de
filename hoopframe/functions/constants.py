"""Fixed values.

Everything in this file is a plain value (weights, thresholds, names, label
spellings) that a result depends on.  Operators take them as parameters, these
are the defaults.
"""

# --- box score columns -------------------------------------------------------
CAREER_STATS = ("pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "to",
                "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "plus_minus")
SEASON_STATS = CAREER_STATS + ("pf",)
LINE_STATS = ("pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "to",
              "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")

# --- scoring weights ---------------------------------------------------------
FANTASY_WEIGHTS = {"pts": 1.0, "reb": 1.0, "ast": 2.0, "stl": 3.0, "blk": 3.0, "to": -1.0}
FRACTIONAL_FANTASY_WEIGHTS = {"pts": 1.0, "reb": 1.2, "ast": 1.5, "stl": 3.0, "blk": 3.0,
                              "to": -1.0}
# free throws: -0.4 made, +0.4 attempted (a missed one adds 0.4)
GAME_SCORE_WEIGHTS = {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftm": -0.4, "fta": 0.4,
                      "oreb": 0.7, "dreb": 0.3, "stl": 1.0, "blk": 0.7, "ast": 0.7,
                      "pf": -0.4, "to": -1.0}
IMPACT_WEIGHTS = {"pts": 1.0, "reb": 0.75, "ast": 1.0}
BENCH_WEIGHTS = {"pts": 1.0, "ast": 0.5, "reb": 0.25}

# --- boards ------------------------------------------------------------------
MULTIPLIER_FLOOR = 0.6
BENCH_MAX_START_SHARE = 0.40
RACE_SIZE = 10
LEADER_STATS = ("pts", "reb", "ast", "stl", "blk", "fg3m", "plus_minus")
ALLTIME_SIZE = 25
ALLTIME_MIN_GP = 41
# efficiency board -> (attempt column, attempts per game needed)
ATTEMPT_FLOORS = {"fgp": ("fga", 5.0), "fg3p": ("fg3a", 2.0), "ftp": ("fta", 1.0),
                  "efg": ("fga", 5.0), "ts": ("fga", 5.0)}
LADDER_SIZE = 25
LADDER_MIN_GP = 82
LADDER_WEIGHTS = {"production": 0.35, "honours": 0.30, "peak": 0.25, "championships": 0.10}
PRODUCTION_BLEND = 0.5
PRODUCTION_WEIGHTS = {"pts": 0.35, "reb": 0.15, "ast": 0.15, "stl": 0.10, "blk": 0.10,
                      "fg3m": 0.05, "plus_minus": 0.10}
SNAPSHOT_TOP = 25
SNAPSHOT_CAP = 90
TREND_TOP = 6
FINALS_TRACKER_SIZE = 10
RECENT_RESULTS = 15
NEXT_FIXTURES = 25
PROJECTION_HORIZON_DAYS = 21
LEADER_DEPTH = 30
GAP_PROBE_DAYS = 7
ACTIVE_TTL_DAYS = 7
STATIC_TTL_DAYS = 180

# --- features and models -----------------------------------------------------
FEATURE_COLUMNS = (
    "is_home", "rest_days", "back_to_back", "season_game_count", "career_game_count",
    "played_last_game", "minutes_last_game", "games_played_last_5",
    "fantasy_points_avg_last_3", "min_avg_last_3", "pts_avg_last_3",
    "fantasy_points_avg_last_5", "min_avg_last_5", "pts_avg_last_5",
    "reb_avg_last_5", "ast_avg_last_5",
    "fantasy_points_avg_last_10", "min_avg_last_10",
    "team_form_pf", "team_form_pa", "opp_form_pa", "opp_form_pf",
    "new_player_baseline",
)
ROLLING_STATS = ("fantasy_points", "min", "pts", "reb", "ast")
ROLLING_WINDOWS = (3, 5, 10)
FIRST_KNOWN_SEASON = 2010
LAST_KNOWN_SEASON = 2039
VALIDATION_SEASON = "2024-25"
HOLDOUT_SEASON = "2025-26"
GATE_TOLERANCE = 0.005

# --- line-ups ----------------------------------------------------------------
POSITION_BUCKETS = {"PG": "G", "SG": "G", "G": "G", "SF": "F", "PF": "F", "F": "F", "C": "C"}
LINEUP_SLOTS = {"G": 2, "F": 2, "C": 1, "UTIL": 2}
FORMATION = {"G": 2, "F": 2, "C": 1}

# --- leagues -----------------------------------------------------------------
# label: "split" labels are '2010-11' (named after the year the season starts),
# "single" labels are '2026'.
LEAGUES = {
    "nba": {"label": "split", "first_year": 2010, "min_teams": 30,
            "champion_first_year": 1970, "finals_mvp_type": 43,
            "sixth_award": "Sixth Man of the Year", "verified_champions": {}},
    "wnba": {"label": "single", "first_year": 2010, "min_teams": 10,
             "champion_first_year": 1997, "finals_mvp_type": 257,
             "sixth_award": "Sixth Player of the Year",
             "verified_champions": {1997: 4, 1998: 4, 1999: 4, 2000: 4, 2001: 6, 2002: 6}},
}
HONOUR_POINTS = {
    "nba": {
        "MVP": 6.0, "Finals MVP": 5.0, "Defensive Player of the Year": 4.5,
        "All-NBA 1st Team": 3.0, "All-Defensive 1st Team": 2.5, "All-NBA 2nd Team": 2.0,
        "NBA Western Conference Finals MVP": 2.0, "NBA Eastern Conference Finals MVP": 2.0,
        "All-Defensive 2nd Team": 1.5, "Rookie of the Year": 1.5,
        "Sixth Man of the Year": 1.5, "Most Improved Player": 1.5, "All-Star MVP": 1.5,
        "All-NBA 3rd Team": 1.0, "Clutch Player of the Year": 1.0, "NBA Cup MVP": 1.0,
        "NBA Cup All-Tournament Team": 0.5, "All-Rookie 1st Team": 0.5,
        "All-Rookie 2nd Team": 0.25, "Twyman-Stokes Teammate of the Year Award": 0.25,
    },
    "wnba": {
        "MVP": 6.0, "Finals MVP": 5.0, "Defensive Player of the Year": 4.5,
        "All-WNBA 1st Team": 3.0, "All-Defensive 1st Team": 2.5, "All-WNBA 2nd Team": 2.0,
        "All-Defensive 2nd Team": 1.5, "Rookie of the Year": 1.5,
        "Sixth Player of the Year": 1.5, "Most Improved Player": 1.5, "All-Star MVP": 1.5,
        "Commissioner's Cup MVP": 1.0, "All-Rookie Team": 0.5,
        "WNBA Sportsmanship Award": 0.25, "Seasonlong Community Assist Award": 0.25,
    },
}
RACE_AWARDS = {"mvp": "MVP", "dpoy": "Defensive Player of the Year",
               "mip": "Most Improved Player", "roy": "Rookie of the Year"}

# --- game states and report orders -------------------------------------------
FINAL = "STATUS_FINAL"
STARTED_STATES = ("in", "post")
STARTED_STATUSES = ("STATUS_FINAL", "STATUS_IN_PROGRESS")
INJURY_ORDER = {"Out": 0, "Doubtful": 1, "Questionable": 2, "Day-To-Day": 3}
NO_ROUND = "Round not recorded"

# --- landed payload spellings --------------------------------------------------
BOX_LABELS = {"MIN": "min", "PTS": "pts", "REB": "reb", "OREB": "oreb", "DREB": "dreb",
              "AST": "ast", "STL": "stl", "BLK": "blk", "TO": "to", "PF": "pf",
              "+/-": "plus_minus"}
BOX_SPLIT_LABELS = {"FG": ("fgm", "fga"), "3PT": ("fg3m", "fg3a"), "FT": ("ftm", "fta")}
STANDING_STATS = {
    "wins": ("wins", "int"), "losses": ("losses", "int"),
    "winPercent": ("win_percent", "string"), "playoffSeed": ("playoff_seed", "int"),
    "gamesBehind": ("games_behind", "string"), "streak": ("streak", "string"),
    "avgPointsFor": ("avg_points_for", "double"),
    "avgPointsAgainst": ("avg_points_against", "double"),
    "Last Ten Games": ("last_ten", "string"), "differential": ("differential", "double"),
}
TOTAL_STATS = {"gamesPlayed": "gp", "points": "pts", "rebounds": "reb", "assists": "ast",
               "fieldGoalsMade": "fgm", "fieldGoalsAttempted": "fga",
               "freeThrowsMade": "ftm", "freeThrowsAttempted": "fta",
               "offensiveRebounds": "oreb", "defensiveRebounds": "dreb",
               "steals": "stl", "blocks": "blk", "fouls": "pf", "turnovers": "to"}
CAREER_LINE_STATS = {
    "gamesPlayed": "gp", "gamesStarted": "starts", "minutes": "minutes", "points": "pts",
    "rebounds": "reb", "offensiveRebounds": "oreb", "defensiveRebounds": "dreb",
    "assists": "ast", "steals": "stl", "blocks": "blk", "turnovers": "to",
    "fieldGoalsMade": "fgm", "fieldGoalsAttempted": "fga",
    "threePointFieldGoalsMade": "fg3m", "threePointFieldGoalsAttempted": "fg3a",
    "freeThrowsMade": "ftm", "freeThrowsAttempted": "fta",
}
SEASON_AVERAGE_LABELS = {"GP": "gp", "MIN": "min", "PTS": "pts", "REB": "reb", "AST": "ast",
                         "STL": "stl", "BLK": "blk", "FG%": "fg_pct", "3P%": "fg3_pct"}
PERCENT_METRICS = ("fg_pct", "fg3_pct")
STAMP_COLUMNS = ("_generated_utc", "last_run_utc", "updated_utc", "stamp")
