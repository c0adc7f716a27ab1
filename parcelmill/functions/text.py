"""Column expressions for recognised text: anchors, numbers, units, identifiers, times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ANCHORS, DIGITS, MISREAD, TIME_FORMATS


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """A column of one value a row that is worked out once: filters and columns that follow can't repeat its expression."""
    return F.explode(F.array(value))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def normalise_awb(x: Column) -> Column:
    """Upper-case letters and digits of an identifier; null unless 8 to 30 long with six digits."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(strip(x)), r"[^A-Z0-9 -]", ""), r"[\s-]+", "")
    digits = F.length(F.regexp_replace(clean, "[^0-9]", ""))
    return F.when(F.length(clean).between(8, 30) & (digits >= 6), clean)


def corrected(x: Column) -> Column:
    return F.translate(x, MISREAD, DIGITS)


def number(x: Column) -> Column:
    """First number, after correction; a comma is a decimal point."""
    found = F.regexp_extract(corrected(x), r"[-+]?\d+(?:[.,]\d+)?", 0)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def warned(x: Column) -> Column:
    return (corrected(x) != x).cast("int")


def has_anchor(text: Column, field: str) -> Column:
    return text.rlike("(?i)" + ANCHORS[field])


def anchor_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(has_anchor(text, f).cast("int"), F.lit(0)) for f in ANCHORS])


def lines(text: Column) -> Column:
    """Lines with white space folded, without blank ones."""
    each = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(each, lambda x: x != "")


def field_line(text: Column, field: str, own: Column | None = None) -> Column:
    """What follows a field's anchor: the rest of the first line that has it and more, or the line after
    it; failing both, the rest of the flattened text up to the next anchor.  ``own``: the text's ``lines``, where they are at hand."""
    anchor = "(?i)" + ANCHORS[field]
    head = r"(?i)\A.*?" + ANCHORS[field]
    rest = lambda x: F.regexp_replace(F.regexp_replace(x, head, ""), r"\A[ :.\-]+", "")

    def of(own: Column) -> Column:
        at = F.transform(own, lambda x, i: F.when(x.rlike(anchor), F.coalesce(F.nullif(rest(x), F.lit("")), F.get(own, i + 1))))
        return F.get(F.filter(at, lambda x: x.isNotNull()), F.lit(0))

    flat = F.regexp_replace(text, r"\s+", " ")
    stop = r"(?is)(" + "|".join(ANCHORS.values()) + r").*\z"
    tail = F.when(flat.rlike(anchor), F.nullif(F.trim(F.regexp_replace(rest(flat), stop, "")), F.lit("")))
    return F.coalesce(let(lines(text) if own is None else own, of), tail)


def awb_token(raw: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(raw, r"[A-Za-z0-9][A-Za-z0-9 -]{6,34}", 0)), F.lit(""))


def awb_fixed(token: Column) -> Column:
    """Misread digits are mended only where no certain letter shows that letters are meant."""
    return F.when(F.upper(token).rlike("[A-HJ-NP-RT-Z]"), token).otherwise(corrected(token))


def confidence(base: Column, warnings: Column) -> Column:
    """Never under zero (a token that needed mending on doubtful text)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), base + 0.05 - 0.15 * warnings))


def unit(raw: Column, pattern: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(raw, rf"(?i)\b({pattern})\b", 1)), F.lit(""))


def centimetres(value: Column, u: Column) -> Column:
    cm = F.when(u == "mm", value / 10).when(u == "m", value * 100).when(u.isin("in", "inch", "inches"), value * 2.54).otherwise(value)
    return F.round(cm, 4)


def location(raw: Column) -> Column:
    cut = F.get(F.split(raw, r"(?i)\s+(?=AW[8B]\b|Length\b|Width\b|Height\b|R\.?\s*Vol|W\s*eight\b|Time\b)"), F.lit(0))
    clean = F.regexp_replace(cut, r"\A[ :.\-]+|[ :.\-]+\z", "")
    compact = F.regexp_replace(clean, r"[\s_()]+", "")
    shouted = (compact == F.upper(compact)) & (compact != F.lower(compact))
    named = F.when(clean.contains("_") | shouted, F.regexp_replace(clean, r"\s+(?!\()", "_")).otherwise(clean)
    return F.when(F.length(named).between(2, 100), named)


def timestamp(raw: Column) -> Column:
    clean = F.regexp_replace(strip(raw), r"\s+", " ")
    clean = F.regexp_replace(clean, r"(?<=\d{4})(?=\d{1,2}:\d{2}:\d{2})", " ")
    clean = F.upper(F.regexp_replace(clean, r"(?i)(?<=\d)(?=[AP]M\z)", " "))
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)) for f in TIME_FORMATS)).cast("timestamp_ntz")


def humanised(x: Column) -> Column:
    words = F.lower(F.trim(F.replace(x, F.lit("_"), F.lit(" "))))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000))


def worded(x: Column, texts: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(v) for kv in texts.items() for v in kv))
    return F.coalesce(F.try_element_at(table, x), humanised(x))


def excel_text(x: Column) -> Column:
    return F.when(x.rlike(r"\A[A-Z0-9-]{1,40}\z"), F.concat(F.lit('="'), x, F.lit('"'))).otherwise(F.lit(""))


def safe_name(path: Column) -> Column:
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._() -]+", "_"), r"\A[ .]+|[ .]+\z", "")
    return F.coalesce(F.nullif(F.left(clean, F.lit(180)), F.lit("")), F.lit("unnamed-image"))


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, for 1e-4 <= |x| < 1e6."""
    whole = F.greatest(F.lit(0), F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))) + 1).cast("int")
    scaled = F.round(x * F.pow(F.lit(10.0), 6 - whole)) / F.pow(F.lit(10.0), 6 - whole)
    text = scaled.cast("decimal(20,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")


def truthy(x: Column) -> Column:
    return F.lower(strip(x)).isin("1", "true", "yes", "on")
