"""Shared SQL fragments of the oracles (common table expressions and formulas)."""

from __future__ import annotations

from ..functions import constants as K

STATS = ("pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "to", "pf",
         "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")


def hu(x: str, n: int) -> str:
    return f"(floor(({x})*1e{n}+5e-1)/1e{n})"


def num(x: float) -> str:
    """A DOUBLE literal (plain 0.4 would be DECIMAL)."""
    return f"{x!r}e0"


def wsum(weights: dict[str, float]) -> str:
    return "(0e0" + "".join(f' + ({num(w)})*coalesce("{s}",0)' for s, w in weights.items()) + ")"


def pg(stat: str, gp: str = "gp") -> str:
    return hu(f'("{stat}")::DOUBLE/{gp}', 1)


def pct(made: str, att: str) -> str:
    return f"(CASE WHEN ({att})<>0 THEN {hu(f'100e0*({made})/({att})', 1)} END)"


EFF = {
    "fgp": pct("fgm", "fga"), "fg3p": pct("fg3m", "fg3a"), "ftp": pct("ftm", "fta"),
    "efg": pct("fgm+5e-1*fg3m", "fga"), "ts": pct("pts", "2e0*(fga+44e-2*fta)"),
}
GS = wsum(K.GAME_SCORE_WEIGHTS)

_dnp = "(min(l_returnflag)='R')"
_raw = {
    "pts": "l_quantity::BIGINT", "oreb": "floor(l_discount*100+5e-1)::BIGINT", "dreb": "l_linenumber",
    "ast": "l_partkey%11", "stl": "l_partkey%4", "blk": "floor(l_tax*100+5e-1)::BIGINT",
    "to": "l_orderkey%5", "pf": "l_linenumber%6", "fgm": "l_partkey%8", "miss": "l_linenumber",
    "fg3m": "l_partkey%3", "miss3": "l_partkey%2", "ftm": "l_suppkey%4", "missft": "l_orderkey%3",
    "min": "(l_partkey%8)*l_linenumber", "plus_minus": "l_partkey%21-10",
}
_val = {s: f'"{s}"' for s in STATS}
_val.update(reb="oreb+dreb", fga="fgm+miss", fg3a="fg3m+miss3", fta="ftm+missft")

BOX = f"""
teamcount AS (SELECT max(o_custkey)//25+1 AS t FROM orders),
g0 AS (SELECT 'nba' AS league, year(o_orderdate)::VARCHAR AS season, year(o_orderdate)::INT AS season_start,
        o_orderkey AS game_id, o_orderdate AS ts, o_custkey//25 AS home_id,
        (o_custkey//25+1+o_orderkey%(t-1))%t AS away_id, o_orderstatus FROM orders, teamcount),
b0 AS (SELECT l_orderkey, l_suppkey, {_dnp} AS did_not_play, (min(l_linenumber)=1) AS starter,
        {', '.join(f'sum({e})::BIGINT AS "{n}"' for n, e in _raw.items())}
        FROM lineitem GROUP BY ALL),
b1 AS (SELECT *, (l_suppkey+l_orderkey)%2=0 AS is_home FROM b0 JOIN g0 ON l_orderkey=game_id),
box AS (SELECT league, season, season_start, game_id, ts,
        CASE WHEN is_home THEN home_id ELSE away_id END AS team_id,
        'T'||lpad((CASE WHEN is_home THEN home_id ELSE away_id END)::VARCHAR,4,'0') AS team_abbrev,
        CASE WHEN is_home THEN away_id ELSE home_id END AS opponent_id, is_home,
        l_suppkey AS player_id, 'Supplier#'||lpad(l_suppkey::VARCHAR,9,'0') AS player_name,
        starter, did_not_play,
        (CASE WHEN did_not_play THEN 0 WHEN (l_orderkey+l_suppkey)%101<>0 THEN "min" END)::BIGINT AS "min",
        {', '.join(f'(CASE WHEN did_not_play THEN 0 ELSE {_val[s]} END)::BIGINT AS "{s}"' for s in STATS)},
        CASE WHEN NOT did_not_play THEN plus_minus END AS plus_minus
        FROM b1)"""
GAMES = """
sc AS (SELECT game_id, coalesce(sum(pts) FILTER (is_home),0)::BIGINT AS home_score,
        coalesce(sum(pts) FILTER (NOT is_home),0)::BIGINT AS away_score FROM box GROUP BY game_id),
games AS (SELECT league, season, season_start, g0.game_id, ts, home_id,
        'T'||lpad(home_id::VARCHAR,4,'0') AS home_abbrev, home_score, away_id,
        'T'||lpad(away_id::VARCHAR,4,'0') AS away_abbrev, away_score,
        CASE WHEN o_orderstatus='P' THEN 'STATUS_SCHEDULED' ELSE 'STATUS_FINAL' END AS status,
        CASE WHEN g0.game_id%50=0 THEN 'True' ELSE 'False' END AS neutral
        FROM g0 JOIN sc ON g0.game_id=sc.game_id)"""
_sums = ", ".join(f'sum(coalesce("{s}",0))::BIGINT AS "{s}"' for s in K.SEASON_STATS)


def totals(source: str = "box", by: str = "league, season, season_start", name: str = "totals") -> str:
    return f"""
{name}_c AS (SELECT {by}, player_id, team_abbrev, count(*) AS n, min(game_id::VARCHAR) AS seen
    FROM {source} WHERE NOT did_not_play GROUP BY ALL),
{name}_t AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY {by}, player_id
    ORDER BY n DESC, seen)=1),
{name}_s AS (SELECT {by}, player_id, count(*) AS gp, (count(*) FILTER (starter)) AS starts,
    sum(coalesce("min",0))::BIGINT AS minutes, min(player_name) AS player_name, {_sums}
    FROM {source} WHERE NOT did_not_play GROUP BY ALL),
{name} AS (SELECT s.*, t.team_abbrev FROM {name}_s s JOIN {name}_t t USING ({by}, player_id))"""


TOTALS = totals()
RECORDS = f"""
fin AS (SELECT * FROM games WHERE status='STATUS_FINAL'),
sides AS (SELECT league, season, season_start, game_id, home_abbrev AS team_abbrev, home_score AS scored,
        away_score AS allowed, home_score>away_score AS won FROM fin
    UNION ALL SELECT league, season, season_start, game_id, away_abbrev, away_score, home_score,
        home_score<=away_score FROM fin),
records AS (SELECT league, season, season_start, team_abbrev, count(*) FILTER (won) AS wins,
        count(*) FILTER (NOT won) AS losses, sum(scored)::BIGINT AS points_for,
        sum(allowed)::BIGINT AS points_allowed, count(*) AS games,
        {hu('(count(*) FILTER (won))::DOUBLE/count(*)', 3)} AS win_pct,
        {hu('sum(allowed)::DOUBLE/count(*)', 1)} AS opp_pg FROM sides GROUP BY ALL)"""
BARS = """
bars AS (SELECT league, season, season_start, max(games) AS max_games,
        greatest(1, least(8, greatest(1,(max(games)+1)//2)), max(games)//2) AS min_gp
        FROM records GROUP BY ALL),
qual AS (SELECT t.*, coalesce(b.min_gp,1) AS min_gp FROM totals t LEFT JOIN bars b
        USING (league, season, season_start) WHERE gp >= coalesce(b.min_gp,1))"""
SEASON = ", ".join([BOX, GAMES, TOTALS, RECORDS, BARS])
