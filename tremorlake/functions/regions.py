"""Tectonic region of a place description, as one CASE column."""

from typing import NamedTuple

from pyspark.sql import functions as F


class Rule(NamedTuple):
    region: str
    words: tuple        # found anywhere in the text
    token: str = None   # found as a whole word


class RuleSet(NamedTuple):
    rules: tuple
    ignore_case: bool = True


DEFAULT_REGION = "GLOBAL_OTHER"

# Region names, words and tokens, first match wins.
FULL17 = RuleSet((
    Rule("CALIFORNIA", ("CALIFORNIA",), "CA"),
    Rule("ALASKA", ("ALASKA",), "AK"),
    Rule("HAWAII", ("HAWAII",), "HI"),
    Rule("JAPAN", ("JAPAN",)),
    Rule("INDONESIA", ("INDONESIA",)),
    Rule("CHILE", ("CHILE",)),
    Rule("PHILIPPINES", ("PHILIPPINES",)),
    Rule("MEXICO", ("MEXICO",)),
    Rule("NEW_ZEALAND", ("NEW ZEALAND", "KERMADEC")),
    Rule("PUERTO_RICO", ("PUERTO RICO",), "PR"),
    Rule("TURKEY", ("TURKEY", "TÜRKIYE", "KAHRAMANMARAS", "PAZARCIK")),
    Rule("SOUTH_PACIFIC", ("FIJI", "TONGA", "VANUATU", "LOYALTY", "PAPUA", "SOLOMON")),
    Rule("TAIWAN", ("TAIWAN",)),
    Rule("ICELAND", ("ICELAND",)),
    Rule("MEDITERRANEAN", ("GREECE", "ITALY")),
    Rule("SOUTH_ATLANTIC", ("SANDWICH",)),
    Rule("CARIBBEAN", ("JAMAICA", "CARIBBEAN", "HAITI")),
))

# The warehouse variant, words only.
WAREHOUSE12 = RuleSet((
    Rule("CALIFORNIA", ("CALIFORNIA",)),
    Rule("ALASKA", ("ALASKA",)),
    Rule("HAWAII", ("HAWAII",)),
    Rule("JAPAN", ("JAPAN",)),
    Rule("INDONESIA", ("INDONESIA",)),
    Rule("CHILE", ("CHILE",)),
    Rule("PHILIPPINES", ("PHILIPPINES",)),
    Rule("MEXICO", ("MEXICO",)),
    Rule("NEW_ZEALAND", ("NEW ZEALAND",)),
    Rule("PUERTO_RICO", ("PUERTO RICO",)),
    Rule("TURKEY", ("TURKEY", "TÜRKIYE")),
    Rule("SOUTH_PACIFIC", ("FIJI", "TONGA")),
))

# The documented variant, case-sensitive.
DOCUMENT6 = RuleSet((
    Rule("HAWAII", ("Hawaii",)),
    Rule("CALIFORNIA", ("California",)),
    Rule("ALASKA", ("Alaska",)),
    Rule("JAPAN", ("Japan",)),
    Rule("INDONESIA", ("Indonesia",)),
    Rule("CHILE", ("Chile",)),
), ignore_case=False)


def _token_pattern(token):
    # (?U) keeps the word boundary Unicode-aware on every Java version.
    return rf"(?U)\b{token}\b"


def classify_region(place, ruleset=FULL17):
    """Column with the region of ``place``; null or unmatched text is GLOBAL_OTHER."""
    if isinstance(place, str):
        return F.expr(region_sql(place, ruleset))
    text = F.upper(place) if ruleset.ignore_case else place
    region = F
    for rule in ruleset.rules:
        hit = text.contains(rule.words[0])
        for word in rule.words[1:]:
            hit = hit | text.contains(word)
        if rule.token:
            # The plain search spares most rows the regular expression.
            hit = hit | (text.contains(rule.token) & text.rlike(_token_pattern(rule.token)))
        region = region.when(hit, F.lit(rule.region))
    return region.otherwise(F.lit(DEFAULT_REGION))


def region_sql(place="place", ruleset=FULL17):
    """The same decision as SQL text, for SQL functions and ``spark.sql`` users."""
    text = f"upper({place})" if ruleset.ignore_case else place
    arms = []
    for rule in ruleset.rules:
        tests = [f"contains({text}, '{word}')" for word in rule.words]
        if rule.token:
            tests.append(
                f"(contains({text}, '{rule.token}') AND {text} RLIKE r'{_token_pattern(rule.token)}')"
            )
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{rule.region}'")
    return f"CASE {' '.join(arms)} ELSE '{DEFAULT_REGION}' END"
