"""Fixed values of the event-coding scheme and the scorer."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# ---- Fixed values: code dictionaries -------------------------------------------------
ROOT_LABEL = {
    "01": "Public Statement", "02": "Appeal", "03": "Intent to Cooperate",
    "04": "Consult", "05": "Diplomatic Cooperation", "06": "Material Cooperation",
    "07": "Provide Aid", "08": "Yield", "09": "Investigate", "10": "Demand",
    "11": "Disapprove", "12": "Reject", "13": "Threaten", "14": "Protest",
    "15": "Military Posture", "16": "Reduce Relations", "17": "Coerce",
    "18": "Assault", "19": "Fight", "20": "Mass Violence",
}
ROOT_SHORT = {
    "01": "STATEMENT", "02": "APPEAL", "03": "INTENT", "04": "CONSULT",
    "05": "DIPLOMACY", "06": "MAT·COOP", "07": "AID", "08": "YIELD",
    "09": "INVESTIGATE", "10": "DEMAND", "11": "DISAPPROVE", "12": "REJECT",
    "13": "THREATEN", "14": "PROTEST", "15": "MIL·POSTURE", "16": "REDUCE REL",
    "17": "COERCE", "18": "ASSAULT", "19": "FIGHT", "20": "MASS VIOLENCE",
}
QUAD_LABEL = {
    "1": "Verbal Cooperation", "2": "Material Cooperation",
    "3": "Verbal Conflict", "4": "Material Conflict",
}
# The ten countries of the default view: FIPS code, name, ISO code.
TOP_COUNTRIES = (
    ("US", "United States", "USA"), ("IS", "Israel", "ISR"), ("UP", "Ukraine", "UKR"),
    ("RS", "Russia", "RUS"), ("IN", "India", "IND"), ("UK", "United Kingdom", "GBR"),
    ("PK", "Pakistan", "PAK"), ("NI", "Nigeria", "NGA"), ("DJ", "Djibouti", "DJI"),
    ("AS", "Australia", "AUS"),
)
# Further FIPS names; the ten above win where both lists hold a code.
OTHER_COUNTRY_NAMES = {
    "CH": "China", "FR": "France", "GM": "Germany", "IT": "Italy", "JA": "Japan",
    "BR": "Brazil", "SF": "South Africa", "EG": "Egypt", "IR": "Iran", "IZ": "Iraq",
    "SY": "Syria", "YM": "Yemen", "AF": "Afghanistan", "TU": "Turkey",
    "SA": "Saudi Arabia", "UAE": "United Arab Emirates", "LE": "Lebanon", "JO": "Jordan",
    "CA": "Canada", "MX": "Mexico", "AR": "Argentina", "CL": "Chile", "CO": "Colombia",
    "VE": "Venezuela", "PE": "Peru", "BO": "Bosnia and Herzegovina", "RO": "Romania",
    "PL": "Poland", "HU": "Hungary", "CZ": "Czech Republic", "AU": "Austria",
    "SW": "Sweden", "NO": "Norway", "FI": "Finland", "DA": "Denmark", "SP": "Spain",
    "PO": "Portugal", "GR": "Greece", "BU": "Bulgaria", "AL": "Albania", "HR": "Croatia",
    "SR": "Serbia", "MK": "North Macedonia", "NG": "Nigeria", "KE": "Kenya",
    "ET": "Ethiopia", "GH": "Ghana", "SN": "Senegal", "TZ": "Tanzania", "UG": "Uganda",
    "MO": "Morocco", "TN": "Tunisia", "LY": "Libya", "SD": "Sudan", "SO": "Somalia",
    "TH": "Thailand", "MY": "Malaysia", "ID": "Indonesia", "PH": "Philippines",
    "VN": "Vietnam", "MM": "Myanmar", "BD": "Bangladesh", "NP": "Nepal",
    "LK": "Sri Lanka", "KZ": "Kazakhstan", "UZ": "Uzbekistan", "TM": "Turkmenistan",
    "KG": "Kyrgyzstan", "TJ": "Tajikistan", "NZ": "New Zealand", "FJ": "Fiji",
}
TARGET_ROOTS = ("14", "18", "19", "20")
CONFLICT_QUADS = ("3", "4")

# ---- Fixed values: windows, scorer weights and thresholds ------------------------------
WINDOW_DAYS = 7
MAX_IN_DEGREE = 2
MIN_GROUP_EVENTS = 3
ACTOR_MAX_SHARE = 0.05
ACTOR_PROBES = 3
SPIKE_PERCENTILE = 0.75
CHANNEL_WEIGHTS = {
    "documented": 2.6, "corroboration": 1.4, "prior": 1.1,
    "contrastive": 1.3, "actors": 0.9, "contradiction": -3.0,
}
INTERCEPT = -3.2
CONFIDENCE_FLOOR = 0.08
FULL_OUTLETS = 40
KEPT_GRADES = ("confirmed", "reported", "pattern")
STOP_ACTORS = (
    "THE", "AND", "FOR", "OF", "A", "AN", "IN", "ON", "TO",
    "GOVERNMENT", "PRESIDENT", "MINISTER", "OFFICIAL", "OFFICIALS",
    "AUTHORITY", "AUTHORITIES", "POLICE", "MILITARY", "COUNTRY", "STATE",
)

# ---- Fixed values: review vocabulary ----------------------------------------------------
RELATIONS = (
    "TRIGGERS", "MOTIVATES", "MOBILIZES", "ENABLES",
    "ESCALATES", "PROMPTS_RESPONSE", "CONTRIBUTES_TO",
)
REJECT_REASONS = (
    "NO_CAUSAL_EVIDENCE", "TEMPORALLY_INVALID", "WRONG_EVENT_MATCH", "DUPLICATE_EVENT",
    "CORRELATED_ONLY", "INSUFFICIENT_EVIDENCE", "WRONG_DIRECTION", "OTHER",
)
EVIDENCE_QUALITIES = ("explicit", "implicit")
SEARCH_STATUSES = (
    "PARENTS_FOUND", "NO_SUPPORTED_PARENT_FOUND", "NOT_YET_REVIEWED",
    "UNVERIFIABLE", "OUT_OF_SCOPE",
)

FIPS_NAME = {code: name for code, name, _ in TOP_COUNTRIES}
ISO_TO_FIPS = {iso: code for code, _, iso in TOP_COUNTRIES}
COUNTRY_NAME = {**OTHER_COUNTRY_NAMES, **FIPS_NAME}


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Decode ``key`` through a literal map; unknown keys give ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def or_default(value: Column, default: str) -> Column:
    """The value, or ``default`` when it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def padded_root(value: Column) -> Column:
    """A two-digit root code; empty codes become ``00``."""
    return F.lpad(or_default(value, "00"), 2, "0")


def number_or(value: Column, default: float = 0.0) -> Column:
    """NULL and NaN become ``default``."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(default))

# Labels of an extracted condition, and what stands for anything else.
CONDITION_LABELS = {
    "status": (("ongoing", "ended", "unclear"), "unclear"),
    "kind": (("policy", "shortage", "violence", "economic", "governance", "other"), "other"),
    "role": (("protest_cause", "context"), "context"),
}
