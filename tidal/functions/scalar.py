"""Scalar column functions (JVM-side expressions only, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country-name overrides applied after title-casing (the lookup
# tries the title-cased name first, then the stripped raw name).
NAME_ALIASES = {
    "United States of America": "United States",
    "USA": "United States",
    "US": "United States",
    "Republic of Korea": "South Korea",
    "Korea, Republic of": "South Korea",
    "Korea, Democratic People's Republic of": "North Korea",
    "Russian Federation": "Russia",
    "Viet Nam": "Vietnam",
    "Czechia": "Czech Republic",
}

# Risk bands.  low [0, .45), medium [.45, .55), high [.55, 1].
BAND_LOW_MAX = 0.45
BAND_MEDIUM_MAX = 0.55
BANDS = ("low", "medium", "high")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c) -> Column:
    """Coerce to double; unparseable text, NaN and +-inf become NULL."""
    return finite_or_null(F.trim(_c(c).cast("string")).try_cast("double"))


def finite_or_null(c) -> Column:
    """NaN and +-inf become NULL."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def title_case(c) -> Column:
    """Python ``str.title``: capitalise the first letter after every non-letter."""
    c = _c(c)
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def strip(c) -> Column:
    """White space of every kind removed from both ends."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def standardize_name(c, aliases: dict[str, str] | None = None) -> Column:
    """strip -> collapse whitespace -> title-case -> alias (title-cased, then raw stripped)."""
    aliases = NAME_ALIASES if aliases is None else aliases
    raw = strip(_c(c).cast("string"))
    norm = title_case(F.regexp_replace(raw, WS + "+", " "))
    amap = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    mapped = F.coalesce(F.element_at(amap, norm), F.element_at(amap, raw), norm)
    return F.when(raw == "", raw).otherwise(mapped)


# The characters Python's ``str.split()`` / ``\s`` treat as
# whitespace, spelled out so the JVM regex and the RE2 oracle agree.
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"


def clean_text(c) -> Column:
    """Collapse whitespace runs (Python's definition) to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def safe_filename(c) -> Column:
    """Drop characters other than word characters, whitespace and '-', strip, spaces to '_'.

    An empty result becomes ``Unknown``.
    """
    inner = WS[1:-1]
    kept = F.regexp_replace(_c(c), r"[^\p{L}\p{N}_" + inner + "-]", "")
    stripped = F.regexp_replace(kept, f"^{WS}+|{WS}+$", "")
    under = F.replace(stripped, F.lit(" "), F.lit("_"))
    return F.when(under == "", F.lit("Unknown")).otherwise(under)


def preview(c, n: int) -> Column:
    """First ``n`` characters plus ``...`` when the text is longer."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def risk_band(score, policy: str = "raw") -> Column:
    """Score -> low / medium / high.

    ``raw``: NULL -> medium, negative -> low, thresholds on the raw score.
    ``rounded``: NULL or negative -> medium, score rounded half-even to 3 places.
    ``recommend``: NULL, NaN or negative -> medium, raw thresholds.
    """
    s = _c(score)
    if policy == "rounded":
        r = F.bround(s, 3)
        return (F.when(s.isNull() | F.isnan(s) | (s < 0), "medium")
                .when(r < BAND_LOW_MAX, "low").when(r < BAND_MEDIUM_MAX, "medium")
                .otherwise("high"))
    if policy == "raw":
        return (F.when(s.isNull() | F.isnan(s), "medium").when(s < 0, "low")
                .when(s < BAND_LOW_MAX, "low").when(s < BAND_MEDIUM_MAX, "medium")
                .otherwise("high"))
    if policy == "recommend":
        return (F.when(s.isNull() | F.isnan(s) | (s < 0), "medium")
                .when(s < BAND_LOW_MAX, "low").when(s < BAND_MEDIUM_MAX, "medium")
                .otherwise("high"))
    raise ValueError(f"unknown band policy {policy!r}")


def effective_band(pred, score) -> Column:
    """Predicted label (trimmed, lower-cased) if it is a known band, else the score's band."""
    p = F.lower(strip(_c(pred)))
    return F.when(p.isin(*BANDS), p).otherwise(risk_band(score, "recommend"))


def risk_reduction_pct(score, n) -> Column:
    """(1 - score) / factor * 100 with factor 3 for n >= 3, 9 for n = 1, 9 / n otherwise."""
    s, n = _c(score), _c(n)
    factor = F.when(n >= 3, F.lit(3.0)).when(n == 1, F.lit(9.0)).otherwise(F.try_divide(F.lit(9.0), n))
    return F.try_divide(1 - s, factor) * 100
