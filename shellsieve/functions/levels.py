"""Risk levels: order, names and parsing."""

from pyspark.sql import functions as F

from shellsieve.schemas import RISK_LEVELS

# Display names of the levels per language.
LEVEL_NAMES = {
    "en": {"Critical": "Critical", "High": "High", "Medium": "Medium", "Low": "Low"},
    "tr": {"Critical": "Kritik", "High": "Yüksek", "Medium": "Orta", "Low": "Düşük"},
}

# Score band [low, high) of each level.
SCORE_BANDS = {
    "Critical": (9.0, 10.0),
    "High": (7.0, 9.0),
    "Medium": (4.0, 7.0),
    "Low": (1.0, 4.0),
}


def _lookup(mapping):
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*pairs)


def rank_of(level):
    """1 for the Python string ``Low`` up to 4 for ``Critical``; any letter case."""
    ranks = {name.lower(): i + 1 for i, name in enumerate(RISK_LEVELS)}
    try:
        return ranks[level.lower()]
    except KeyError:
        raise ValueError(f"unknown risk level {level!r}, expected one of {RISK_LEVELS}") from None


def risk_rank(level):
    return F.try_element_at(_lookup({n: i + 1 for i, n in enumerate(RISK_LEVELS)}), level)


def risk_level_name(level, language="en"):
    return F.try_element_at(_lookup(LEVEL_NAMES[language]), level)


def risk_level_code(level):
    """Lower-case level name, also the CSS class of a report card."""
    return F.lower(level)


def parse_risk_level(text):
    """Level for an English or Turkish name in any letter case, else NULL."""
    accepted = {
        names[level].lower(): level for names in LEVEL_NAMES.values() for level in RISK_LEVELS
    }
    return F.try_element_at(_lookup(accepted), F.lower(text))


def score_band(level):
    """Struct ``(lo, hi)`` of a level column."""
    lows = _lookup({level: low for level, (low, _) in SCORE_BANDS.items()})
    highs = _lookup({level: high for level, (_, high) in SCORE_BANDS.items()})
    return F.struct(
        F.try_element_at(lows, level).alias("lo"), F.try_element_at(highs, level).alias("hi")
    )


def risk_score(level, *identity):
    """Score inside the level's band, the same on every run for the same finding.

    Twenty bits of an MD5 over the identifying columns pick the place in the band. Twenty
    bits stay exact in a FLOAT, so the upper end of the band is never reached.
    """
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in identity]))
    step = F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    band = score_band(level)
    return (band["lo"] + step * (band["hi"] - band["lo"])).cast("float")
