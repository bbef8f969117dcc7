"""The phrases and patterns that decide what a listing text says.

Patterns are matched case-insensitively with Unicode word and space classes; ``.`` stops at a newline only.
"""

from __future__ import annotations

GARDEN_YES = [
    r"\bprivate garden\b", r"\bshared garden\b", r"\brear garden\b", r"\bfront garden\b", r"\bsouth.facing garden\b",
    r"\bgarden access\b", r"\bgarden to the\b", r"\bwith garden\b", r"\bhas a garden\b",
    r"\bbenefits from.{0,30}garden\b", r"\bgarden area\b",
]
GARDEN_NO = [r"\bno garden\b", r"\bno outdoor space\b", r"\bwithout a garden\b"]
BALCONY_YES = [
    r"\bbalcony\b", r"\bjuliet balcony\b", r"\bprivate terrace\b", r"\bsouth.facing terrace\b", r"\boutside terrace\b",
    r"\bterrace off\b", r"\bterrace to the\b", r"\bwith a terrace\b", r"\bhas a terrace\b", r"\bpatio\b",
    r"\bjuliette balcony\b",
]
BALCONY_NO = [r"\bno balcony\b", r"\bno terrace\b"]
BILLS_YES = [
    r"\bbills included\b", r"\bincluding bills\b", r"\bwith bills included\b", r"\butility bills.{0,20}included\b",
    r"\bincluded in the rent\b", r"\bincluded in the rental\b", r"\bwater.{0,20}included\b",
    r"\brates.{0,20}included\b", r"\bgas.{0,20}electric.{0,20}included\b", r"\bcouncil tax included\b", r"\ball bills\b",
]
BILLS_NO = [
    r"\bbills not included\b", r"\bexcluding bills\b", r"\bbills are not included\b",
    r"\btenant.{0,30}responsible for.{0,20}bills\b", r"\bbills are excluded\b",
]
FURNISHED_BULLETS = [
    ("part furnished", "part_furnished"), ("partially furnished", "part_furnished"), ("part-furnished", "part_furnished"),
    ("unfurnished", "unfurnished"), ("furnished", "furnished"),
]
FURNISHED_TEXT = [
    (r"\bpart.?furnished\b|\bpartially furnished\b", "part_furnished"),
    (r"\bunfurnished\b", "unfurnished"),
    (r"\bfully furnished\b|\bfurnished\b", "furnished"),
]
COUNCIL_BAND = [
    r"\bcouncil tax band[:\s]+([A-H])\b", r"\bcouncil tax band is ([A-H])\b", r"\bctb[:\s]+([A-H])\b",
    r"\btax band[:\s]+([A-H])\b",
]
MONTH_WORDS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
)
ORDINAL_DAY = r"(?:\d{1,2}(?:st|nd|rd|th)?)"
AVAILABLE = [
    rf"available\s+from\s*:\s*({ORDINAL_DAY}\s+(?:{MONTH_WORDS})\s+\d{{4}})",
    rf"available\s+from\s*:\s*({ORDINAL_DAY}\s+(?:{MONTH_WORDS}))",
    rf"available\s+from\s+({ORDINAL_DAY}\s+(?:{MONTH_WORDS})\s+\d{{4}})",
    rf"available\s+from\s+({ORDINAL_DAY}\s+(?:{MONTH_WORDS}))",
    rf"available\s+(?:\w+\s+){{0,5}}from\s+({ORDINAL_DAY}\s+(?:{MONTH_WORDS})\s+\d{{4}})",
    rf"available\s+(?:\w+\s+){{0,5}}from\s+({ORDINAL_DAY}\s+(?:{MONTH_WORDS}))",
    rf"available\b.{{0,60}}?({ORDINAL_DAY}\s+(?:{MONTH_WORDS})\s+\d{{4}})",
    r"available\s+(now|immediately)\b",
    r"available\s+from\s+(now)\b",
]
SQFT = r"([\d,]{2,7})\s*(?:sq\.?\s*ft|ft²|square\s+fe?e?t)"
SQM = r"([\d,]{2,6})\s*(?:sq\.?\s*m(?:etres?|eters?)?(?!\w)|m²|square\s+me?t(?:re|er)s?)"
DISPLAY_SQFT = r"([\d,]{2,7})\s*sq\.?\s*ft"
DISPLAY_SQM = r"([\d,]{2,5})\s*sq\.?\s*m(?!\w)"
RATING = [
    r"\bEPC\s*(?:rating|band|:)?\s*[:\-]?\s*([A-G])\b",
    r"\benergy\s+efficiency(?:\s+rating)?\s*[:\-]?\s*([A-G])\b",
    r"\benergy\s+performance\s+(?:certificate|cert)\s*[:\-]?\s*([A-G])\b",
]
REJECT_REASONS = [
    (r"\bbasement\b", "basement_or_lower"),
    (r"\bstudio\b", "wrong_neighbourhood"),
    (r"both\s*bedrooms.*carpet|carpets?\s*in\s*both", "bedroom_carpet"),
    (r"\bcarpet", "bedroom_carpet"),
    (r"\bnot\s*enough\s*photos|not\s*enough\s*pictures", "bad_photos"),
    (r"\b(?:low|small)\s*ceiling|ceiling\s*low\b", "low_ceiling"),
    (r"\bno\s*privacy|no\s*door\b", "no_privacy"),
    (r"\bnot\s*enough\s*light|too\s*dark\b|\blight\s*$", "too_dark"),
    (r"\bkitchen\s*(?:too\s*)?small|small.*kitchen", "kitchen_too_small"),
    (r"\bweird.layout|bad\s*layout|layout.*not\s*good", "poor_floorplan"),
    (r"\b40th\s*floor|too\s*high\s*floor|high\s*floor", "high_floor"),
    (r"\blet\s*agreed\b", "agent_red_flag"),
]
# --- end of fixed values ----------------------------------------------------------------------------------


def insensitive(pattern: str) -> str:
    """The pattern with the flags described above, for Spark's regex engine."""
    return "(?iUd)" + pattern


def any_of(patterns: list[str]) -> str:
    return insensitive("|".join(f"(?:{p})" for p in patterns))
