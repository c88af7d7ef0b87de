"""Scalar functions over text, numbers, positions, dates and game states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .core import as_col, case_map

DASH = r"\s+[-–—]\s+"


# --- numbers -------------------------------------------------------------------

def to_double(c: Column | str) -> Column:
    """Number from text or null; '.682' and '.5%' (leading dot only) are read too."""
    s = as_col(c).cast("string")
    s = F.when(s.startswith("."), F.regexp_replace(s, "%", "")).otherwise(s)
    v = s.try_cast("double")
    return F.when(~F.isnan(v), v)


def to_long(c: Column | str) -> Column:
    """Whole number from text ('125' or '125.0'), fraction cut off, or null."""
    return as_col(c).cast("string").try_cast("double").try_cast("bigint")


def clean_score(c: Column | str) -> Column:
    """'94.0' -> '94'; text that is no number stays as it is."""
    s = as_col(c).cast("string")
    v = to_long(s)
    return F.when(v.isNotNull() & (v.cast("double") == s.try_cast("double")), v.cast("string")).otherwise(s)


def made(c: Column | str) -> Column:
    """'6-13' -> 6."""
    s = as_col(c)
    return F.when(s.contains("-"), to_long(F.split_part(s, F.lit("-"), F.lit(1))))


def attempted(c: Column | str) -> Column:
    """'6-13' -> 13 (everything after the first hyphen)."""
    s = as_col(c)
    return F.when(s.contains("-"), to_long(F.substr(s, F.locate("-", s) + 1)))


def leading_number(c: Column | str) -> Column:
    """'7.9-18.9' -> 7.9; anything unreadable is 0."""
    part = F.split_part(as_col(c).cast("string"), F.lit("-"), F.lit(1))
    return F.coalesce(part.try_cast("double"), F.lit(0.0))


def clip_zero(c: Column | str) -> Column:
    return F.when(as_col(c).isNotNull(), F.greatest(as_col(c), F.lit(0.0)))


def games_behind(c: Column | str) -> Column:
    """'-' (leads the table) -> 0.0."""
    s = as_col(c).cast("string")
    return F.when(F.trim(s) == "-", F.lit(0.0)).otherwise(to_double(s))


# --- ids and labels ----------------------------------------------------------------

def ref_id(c: Column | str) -> Column:
    """Last path segment of a link, query string dropped: '.../athletes/4251?lang=en' -> '4251'."""
    path = F.rtrim(F.split_part(as_col(c), F.lit("?"), F.lit(1)), F.lit("/"))
    seg = F.element_at(F.split(path, "/"), -1)
    return F.when(seg != "", seg)


def ref_number(c: Column | str, segment: str) -> Column:
    """The number behind a named path segment: ref_number(link, 'teams')."""
    s = F.regexp_extract(as_col(c), f"/{segment}/(\\d+)", 1)
    return F.when(s != "", s.try_cast("bigint"))


def round_label(c: Column | str) -> Column:
    """Text before the first dash with blanks around it; blank text has no round."""
    s = F.trim(F.split(F.trim(as_col(c)), DASH, 2)[0])
    return F.when(s != "", s)


def round_display(c: Column | str) -> Column:
    """Title case per run of letters, ordinals low ('1st'), acronyms high ('NBA')."""
    runs = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    text = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    for suffix in ("St", "Nd", "Rd", "Th"):
        text = F.regexp_replace(text, rf"(\d){suffix}\b", rf"$1{suffix.lower()}")
    for word in ("Nba", "Wnba"):
        text = F.regexp_replace(text, rf"\b{word}\b", word.upper())
    return text


def round_rank(c: Column | str) -> Column:
    """0 play-in, 1 opening rounds, 2 semifinals, 3 conference finals, 4 finals, 9 other."""
    t = F.lower(F.coalesce(as_col(c), F.lit("")))
    has = lambda *words: F.lit(False) if not words else _any(t, words)
    return (F.when(F.trim(t) == "", 9)
            .when(has("play-in", "play in"), 0)
            .when(has("semifinal", "semi-final", "semis"), 2)
            .when(has("conference final") | (has("finals") & has("east", "west")), 3)
            .when(has("finals"), 4)
            .when(has("1st round", "first round", "second round", "round of 16"), 1)
            .otherwise(9))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def has_round(c: Column | str) -> Column:
    """Whether a round is recorded at all ('nan' and 'none' are empty cells)."""
    s = as_col(c).cast("string")
    return s.isNotNull() & ~F.lower(F.trim(s)).isin("", "nan", "none")


# --- positions and states -------------------------------------------------------------

def position_bucket(c: Column | str) -> Column:
    """PG/SG/G -> G, SF/PF/F -> F, C -> C, anything else null."""
    return case_map(F.upper(F.trim(as_col(c))), K.POSITION_BUCKETS)


def game_started(state: Column | str, status: Column | str) -> Column:
    """Scores mean something: by state when there is one, else by status name."""
    st = as_col(state)
    by_name = F.coalesce(as_col(status).isin(*K.STARTED_STATUSES), F.lit(False))
    return F.when(F.coalesce(st, F.lit("")) != "", st.isin(*K.STARTED_STATES)).otherwise(by_name)


def is_neutral(c: Column | str) -> Column:
    """The flag arrives as the text 'True'/'False' (or as a boolean)."""
    return F.coalesce(F.lower(as_col(c).cast("string")) == "true", F.lit(False))


def seed_zone(league: Column | str, seed: Column | str, played: Column) -> Column:
    """'playoff' / 'play_in' / '' from the seed; '' for tables nobody has played in."""
    lg = F.lit(league) if isinstance(league, str) else league
    s = as_col(seed)
    single = [k for k, v in K.LEAGUES.items() if v["label"] == "single"]
    return (F.when(~played | s.isNull(), "")
            .when(lg.isin(*single), F.when(s <= 8, "playoff").otherwise(""))
            .when(s <= 6, "playoff").when(s <= 10, "play_in").otherwise(""))


# --- dates -----------------------------------------------------------------------------

def utc_time(c: Column | str) -> Column:
    """Timestamp (session zone UTC) from 'T23:00Z' / 'T23:30:00Z' / date text, or null."""
    text = F.regexp_replace(as_col(c).cast("string"), r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    return text.try_cast("timestamp")


def local_date(c: Column | str, zone: str) -> Column:
    """Calendar date in a zone; null for text that is no time."""
    return _local(c, zone, "yyyy-MM-dd")


def local_stamp(c: Column | str, zone: str) -> Column:
    """Date and minute in a zone; null for text that is no time."""
    return _local(c, zone, "yyyy-MM-dd HH:mm")


def _local(c: Column | str, zone: str, fmt: str) -> Column:
    return F.date_format(F.from_utc_timestamp(utc_time(c), zone), fmt)


def day_buckets(ts: Column | str) -> Column:
    """Feed days that can hold a game of the local day starting at ``ts``: day-1, day, day+1."""
    d = F.to_date(as_col(ts))
    return F.transform(F.sequence(F.date_sub(d, 1), F.date_add(d, 1)),
                       lambda x: F.date_format(x, "yyyyMMdd"))


def game_buckets(ts: Column | str) -> Column:
    """Feed days worth asking for one game: the day before and the day."""
    d = F.to_date(as_col(ts))
    return F.transform(F.array(F.date_sub(d, 1), d), lambda x: F.date_format(x, "yyyyMMdd"))


def gap_days(last_regular: Column | str, first_post: Column | str,
             most: int | None = None) -> Column:
    """Days strictly between two dates (the first ``most`` of them, if given)."""
    lo = F.date_add(F.to_date(as_col(last_regular)), 1)
    hi = F.date_sub(F.to_date(as_col(first_post)), 1)
    return F.when(lo <= hi, F.sequence(lo, hi if most is None else F.least(hi, F.date_add(lo, most - 1)))).otherwise(
        F.array().cast("array<date>"))


def newest_stamp(note: Column | str) -> Column:
    """The last UTC stamp written in a note."""
    found = F.regexp_extract_all(
        as_col(note), F.lit(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?Z)"), F.lit(1))
    return utc_time(F.try_element_at(found, F.lit(-1)))


def age_seconds(note: Column | str, now: Column) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(newest_stamp(note))
    return F.when(age.isNotNull(), F.greatest(age, F.lit(0)))  # greatest() skips nulls


def age_text(note: Column | str, now: Column) -> Column:
    """' (just now)', ' (5 min ago)', ' (3 h ago)', ' (2 d ago)', '' without a stamp."""
    s = age_seconds(note, now)
    n = lambda unit, word: F.concat(F.lit(" ("), F.floor(s / unit).cast("string"), F.lit(f" {word} ago)"))
    return (F.when(s.isNull(), "").when(s < 60, " (just now)").when(s < 3600, n(60, "min"))
            .when(s < 48 * 3600, n(3600, "h")).otherwise(n(86400, "d")))


def is_fresh(fetched: Column | str, ttl_days: Column | int, now: Column) -> Column:
    """Younger than its time to live; never fetched is not fresh."""
    ttl = ttl_days if isinstance(ttl_days, Column) else F.lit(ttl_days)
    age = F.unix_timestamp(now) - F.unix_timestamp(utc_time(fetched))
    return F.coalesce(age < ttl * 86400, F.lit(False))
