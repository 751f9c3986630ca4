"""Column expressions: text clean-up, keys, odds, outcome labels and inclusion rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words dropped from club names, and text accepted as a boolean.
CLUB_WORDS = ("fc", "cf", "sc", "afc", "fk", "sk")
TRUE_TEXT = ("true", "1", "yes")

# The inclusion checks in audit order, and the reason reported for each, by priority.
MATCH_CHECKS = (
    "completed_match",
    "football_data_match",
    "score_matches_football_data",
    "closing_odds_available",
    "player_data_available",
    "twenty_two_starters",
    "starter_identity_complete",
    "starter_minutes_complete",
    "player_team_ids_valid",
)
EXCLUSION_PRIORITY = {
    "football_data_match": "not_top_division_match",
    "completed_match": "match_not_completed",
    "score_matches_football_data": "score_disagreement",
    "closing_odds_available": "missing_closing_odds",
    "player_data_available": "no_player_data",
    "twenty_two_starters": "invalid_starter_count",
    "starter_identity_complete": "missing_starter_identity",
    "starter_minutes_complete": "missing_starter_minutes",
    "player_team_ids_valid": "invalid_player_team_assignment",
}

# Last matchday of the regular season per league (None: no later phase), and its successor.
PHASE_CUTOFFS = {
    "scotland": (33, "post_split"),
    "netherlands": (34, "playoffs"),
    "portugal": (34, "playoffs"),
    "turkey": (None, None),
    "greece": (None, None),
}
SEASON_PHASE_CUTOFFS = {
    ("belgium", "2020-21"): (34, "playoffs"),
    ("belgium", "2021-22"): (34, "playoffs"),
    ("belgium", "2022-23"): (34, "playoffs"),
    ("belgium", "2023-24"): (30, "playoffs"),
    ("belgium", "2024-25"): (30, "playoffs"),
    ("belgium", "2025-26"): (30, "playoffs"),
}
STAGE_TOKENS = ("playoff", "play-off", "championship", "relegation")

# Odds columns in order of preference, and whether they are closing prices.
ODDS_CANDIDATES = (
    ("market_average_closing", ("AvgCH", "AvgCD", "AvgCA"), True),
    ("bet365_closing", ("B365CH", "B365CD", "B365CA"), True),
    ("pinnacle_closing", ("PSCH", "PSCD", "PSCA"), True),
    ("market_average_preclosing", ("AvgH", "AvgD", "AvgA"), False),
    ("bet365_preclosing", ("B365H", "B365D", "B365A"), False),
    ("pinnacle_preclosing", ("PSH", "PSD", "PSA"), False),
)


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def parse_bool(column: str | Column) -> Column:
    """true/1/yes (any case) is true; everything else, null included, is false."""
    return F.coalesce(F.lower(_col(column)).isin(*TRUE_TEXT), F.lit(False))


def to_number(column: str | Column, errors: str = "coerce") -> Column:
    """Text to double; unreadable text becomes null, or an error with ``errors='raise'``."""
    value = _col(column)
    parsed = F.trim(value).try_cast("double")
    if errors == "coerce":
        return parsed
    message = F.concat(F.lit("not a number: "), value)
    return F.when(value.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def iso_date(column: str | Column) -> Column:
    """Timestamp (or ISO text) to yyyy-MM-dd in UTC."""
    return F.date_format(F.to_timestamp(_col(column)), "yyyy-MM-dd")


def parse_day(column: str | Column) -> Column:
    """dd/MM/yyyy or dd/MM/yy to a date; any other text is an error."""
    text = F.trim(_col(column))
    long = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    # two-digit years 69-99 belong to the 1900s, as in POSIX
    year = F.element_at(F.split(text, "/"), -1)
    century = F.when(year >= "69", "19").otherwise("20")
    expanded = F.regexp_replace(text, r"/(\d{2})$", F.concat(F.lit("/"), century, F.lit("$1")))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(expanded, F.lit("d/M/yyyy")))
    parsed = F.coalesce(long, short)
    message = F.concat(F.lit("unsupported date: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed).cast("date")


@lru_cache(maxsize=1)
def _ascii_rules() -> tuple[str, str, dict[str, str]]:
    """One-to-one replacements of the compatibility decomposition below U+10000, and the characters that expand."""
    source, target, longer = [], [], []
    for code in (c for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF):
        char = chr(code)
        plain = _decomposed(char)
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif len(plain) > 1:
            longer.append(char)
    return "".join(source), "".join(target), "".join(longer)


def _decomposed(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(StringType())
def _decompose_rare(texts: pd.Series) -> pd.Series:
    return texts.map(_decomposed, na_action="ignore")


def to_ascii(column: str | Column) -> Column:
    """NFKD to ASCII, dropping what has no ASCII form.

    Plain text and letters with one ASCII form stay in the JVM; only texts with a character that expands, or one
    beyond U+FFFF, go through Python (others are null there).
    """
    source, target, longer = _ascii_rules()
    text = _col(column)
    # translate looks characters up in a hash map; a regular expression class of this size does not
    rare = (F.length(F.translate(text, longer, "")) < F.length(text)) | text.rlike(r"[\x{10000}-\x{10FFFF}]")
    common = F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]", "")
    return F.coalesce(_decompose_rare(F.when(rare, text)), common)


def normalize_name(column: str | Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Comparable club name: ASCII, lower case, club words and everything but letters and digits dropped."""
    text = F.lower(to_ascii(F.coalesce(_col(column), F.lit(""))))
    text = F.regexp_replace(text, r"\b(" + "|".join(CLUB_WORDS) + r")\b", "")
    text = F.regexp_replace(text, "[^a-z0-9]", "")
    if not aliases:
        return text
    table = F.create_map(*[F.lit(v) for pair in sorted(aliases.items()) for v in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def match_key(season: str, date: str, home: str, away: str, aliases: Mapping[str, str] | None = None) -> Column:
    """season|date|home|away with normalised names: the key two providers share."""
    return F.concat_ws(
        "|", F.col(season).cast("string"), F.col(date).cast("string"),
        normalize_name(home, aliases), normalize_name(away, aliases),
    )


def result_3way(home: str | Column, away: str | Column) -> Column:
    """H, D or A; null when a score is missing."""
    h, a = _col(home), _col(away)
    return F.when(h > a, "H").when(h < a, "A").when(h == a, "D")


def all_above_one(*odds: str | Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(_col(o) > 1.0, F.lit(False)) for o in odds])


def devig(home: str | Column, draw: str | Column, away: str | Column, strict: bool = True) -> Column:
    """struct(overround, home, draw, away) of normalised inverse odds.

    Odds of one or less are an error when strict, otherwise the struct is null.
    """
    inverse = [F.lit(1.0) / _col(o) for o in (home, draw, away)]
    total = inverse[0] + inverse[1] + inverse[2]
    fields = F.struct(
        total.alias("overround"), (inverse[0] / total).alias("home"),
        (inverse[1] / total).alias("draw"), (inverse[2] / total).alias("away"),
    )
    valid = all_above_one(home, draw, away)
    if strict:
        return F.when(valid, fields).otherwise(F.raise_error(F.lit("decimal odds must be above 1")))
    return F.when(valid, fields)


def log_odds_vs_draw(home: str | Column, draw: str | Column, away: str | Column) -> tuple[Column, Column]:
    """log(home/draw) and log(away/draw)."""
    h, d, a = _col(home), _col(draw), _col(away)
    return F.log(h / d), F.log(a / d)


def competition_phase(
    league: str | Column, season: str | Column, matchday: str | Column, stage: str | Column,
    cutoffs: Mapping[str, tuple] = PHASE_CUTOFFS,
    season_cutoffs: Mapping[tuple[str, str], tuple] = SEASON_PHASE_CUTOFFS,
    stage_tokens: Sequence[str] = STAGE_TOKENS,
) -> Column:
    """Phase of the competition: a named stage first, then the matchday against the league's cut-off.

    A matchday that is not a positive whole number, or a league without a rule, is an error.
    """
    lg, day = _col(league), _col(matchday).try_cast("double")
    text = F.lower(F.trim(F.coalesce(_col(stage).cast("string"), F.lit(""))))
    named = reduce(lambda a, b: a | b, [text.contains(t) for t in stage_tokens])
    after = {name: label or "playoffs" for name, (_, label) in cutoffs.items()}
    after.update({name: label for (name, _), (_, label) in season_cutoffs.items()})
    by_stage = reduce(
        lambda acc, item: acc.when(lg == item[0], item[1]), list(after.items()), F.when(F.lit(False), "")
    ).otherwise(F.raise_error(F.lit("no competition-phase rule for this league")))

    def by_day(last, label):
        return F.lit("regular_season") if last is None else F.when(day <= last, "regular_season").otherwise(label)

    rule = F.when(~F.coalesce((day > 0) & (day == F.floor(day)), F.lit(False)), F.raise_error(F.lit("invalid matchday")))
    rule = rule.when(named, by_stage)
    for (name, when), (last, label) in season_cutoffs.items():
        rule = rule.when((lg == name) & (_col(season) == when), by_day(last, label))
    for name, (last, label) in cutoffs.items():
        rule = rule.when(lg == name, by_day(last, label))
    return rule.otherwise(F.raise_error(F.lit("no competition-phase rule for this league and season")))


def meets_all(checks: Sequence[str]) -> Column:
    """Every check holds; an unknown check does not."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in checks])


def exclusion_reason(priority: Mapping[str, str]) -> Column:
    """Reason of the first failing check by priority, null when all hold."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(r)) for c, r in priority.items()])


def failed_checks(checks: Sequence[str]) -> Column:
    """Names of all failing checks joined by |, empty when all hold."""
    return F.concat_ws("|", *[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in checks])


def consistency_error(checks: Sequence[str], reasons: Sequence[str], ready: str = "model_ready", reason: str = "exclusion_reason") -> Column:
    """What contradicts itself in a row that carries its own verdict, null when nothing does.

    In this order: the verdict against the checks, a row left out without a reason, a used row with a failed check or a
    reason, a reason that is not declared.
    """
    used, why = F.coalesce(F.col(ready), F.lit(False)), F.col(reason)
    holds = meets_all(checks)
    return (
        F.when(used & ~holds, "ready_with_failed_check").when(used != holds, "verdict_disagrees")
        .when(~used & why.isNull(), "excluded_without_reason").when(used & why.isNotNull(), "ready_with_reason")
        .when(why.isNotNull() & ~why.isin(*reasons), "undeclared_reason"))


def season_label(start_year: str | Column) -> Column:
    """2020 -> 2020-21."""
    y = _col(start_year).cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def season_code(start_year: str | Column) -> Column:
    """2015 -> 1516."""
    y = _col(start_year).cast("int")
    two = [F.lpad(F.pmod(v, F.lit(100)).cast("string"), 2, "0") for v in (y, y + 1)]
    return F.concat(*two)


def qualify_id(league: str | Column, identifier: str | Column) -> Column:
    """league:id; an empty id is an error."""
    value = F.trim(_col(identifier).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(F.lit("empty identifier"))).otherwise(
        F.concat_ws(":", _col(league).cast("string"), value))


def home_away_diff(features: Sequence[str]) -> list[Column]:
    """diff_x = home_x - away_x for every feature, to be used in one select."""
    return [(F.col(f"home_{f}") - F.col(f"away_{f}")).alias(f"diff_{f}") for f in features]


def group_indicators(column: str, values: Sequence, prefix: str) -> list[Column]:
    """0/1 columns for every sorted value but the first."""
    ordered = sorted(values)
    if len(ordered) < 2:
        raise ValueError("indicators need at least two groups")
    return [(F.col(column) == v).cast("double").alias(f"{prefix}{v}") for v in ordered[1:]]


def benchmark_label(model: str | Column, relative: str | Column, baseline: str, very_close: float = 0.01, close: float = 0.02) -> Column:
    """How a score compares with the benchmark's."""
    r = _col(relative)
    return (
        F.when(_col(model) == baseline, "baseline").when(r < 0, "outperforms_market")
        .when(r <= very_close, "within_1_percent").when(r <= close, "within_2_percent")
        .otherwise("worse_by_more_than_2_percent")
    )


def predicted_class(home: str | Column, draw: str | Column, away: str | Column) -> Column:
    """Most probable class; the first of H, D, A wins a tie."""
    h, d, a = _col(home), _col(draw), _col(away)
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def team_side(team: str | Column, home: str | Column, away: str | Column) -> Column:
    """home or away; a team that is neither is an error."""
    t = _col(team)
    return F.when(t == _col(home), "home").when(t == _col(away), "away").otherwise(
        F.raise_error(F.lit("a row belongs to neither side of its fixture")))


def match_week(date: str | Column) -> Column:
    """Tuesday-to-Monday week as start/end."""
    end = F.next_day(F.date_sub(_col(date).cast("date"), 1), "MON")
    return F.concat_ws("/", F.date_sub(end, 6).cast("string"), end.cast("string"))


def first_complete_candidate(candidates: Sequence[tuple[str, Sequence[str], bool]] = ODDS_CANDIDATES) -> Column:
    """struct(source, is_closing, home, draw, away) of the first triplet whose three prices exceed 1."""
    options = []
    for label, columns, closing in candidates:
        h, d, a = [F.trim(F.col(c).cast("string")).try_cast("double") for c in columns]
        fields = F.struct(
            F.lit(label).alias("source"), F.lit(closing).alias("is_closing"),
            h.alias("home"), d.alias("draw"), a.alias("away"),
        )
        options.append(F.when(all_above_one(h, d, a), fields))
    return F.coalesce(*options)
