"""Money columns: parsing to whole cents, tolerances, currencies. Comparisons are exact, in cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import null_if_empty, once

#: ISO codes in order of preference, and symbols.
ISO = ["SGD", "USD", "EUR", "GBP", "JPY", "MYR", "HKD", "TWD", "AUD", "NZD", "CAD", "CNY", "RMB"]
SYMBOLS = {"US$": "USD", "S$": "SGD", "A$": "AUD", "HK$": "HKD", "NT$": "TWD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}


def cents(c: Column) -> Column:
    """Whole cents of an amount in units, half away from zero."""
    return F.round(c * 100).cast("long")


def units(c: Column) -> Column:
    return c / F.lit(100.0)


def parse_amount(c: Column) -> Column:
    """Double of a loosely written amount, null if it is none.

    Brackets are a minus; O, l, I and S are read as digits; commas and blanks
    separate; one dot or hyphen may trail. A currency sign makes it no amount.
    """

    def number(s: Column) -> Column:
        digits = F.translate(F.regexp_replace(s, r"^[()]+|[()]+$", ""), "OolIS", "00115")
        digits = F.regexp_replace(F.regexp_replace(digits, r"[,\s]+", ""), r"([0-9])[.-]$", "$1")
        value = once(digits, lambda d: F.when(d.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), d.try_cast("double")))
        return F.when(s.rlike(r"^\(.*\)$"), -value).otherwise(value)

    # Most amounts are plain figures, which one look tells.
    return once(F.trim(c), lambda s: F.when(s.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), s.try_cast("double")).otherwise(number(s)))


def plain_amount(c: Column) -> Column:
    """Like :func:`parse_amount`, with everything but digits, dot and minus left out first."""
    s = F.regexp_replace(c, r"[,\s]", "")
    digits = F.regexp_replace(s, "[^0-9.-]", "")
    value = F.coalesce(parse_amount(digits), F.lit(0.0))
    return F.when(s.rlike(r"^\(.*\)$"), -value).otherwise(value)


def nonzero(c: Column) -> Column:
    return F.abs(c) > 0.004


def within(book: Column, item: Column, tol: int, pct: int = 0) -> Column:
    """Row tolerance: at most ``tol`` cents apart, or ``pct`` percent of the item; null book never."""
    apart = F.abs(book - item)
    near = apart <= tol
    if pct:
        near = near | ((item != 0) & (apart * 100 <= F.abs(item) * pct))
    return F.coalesce(near, F.lit(False))


def total_tolerance(c: Column, tol: int, pct: int = 0) -> Column:
    """Tolerance of totals in hundredths of a cent: the larger of ``tol`` and ``pct`` percent."""
    return F.greatest(F.lit(tol * 100).cast("long"), F.abs(c) * pct)


def sum_tolerance(c: Column, tol: int, pct: int = 0, tol_abs: int | None = None) -> Column:
    """Tolerance of document sums in hundredths of a cent; ``tol_abs``, where set, is all that counts."""
    return F.lit(tol_abs * 100).cast("long") if tol_abs is not None else total_tolerance(c, tol, pct)


def gross_up(c: Column, pct: int = 109) -> Column:
    """Cents with tax on top, half away from zero."""
    up = F.floor((F.abs(c) * pct + 50) / 100).cast("long")
    return F.when(c < 0, -up).otherwise(up)


def page_currency(text: Column, default: str = "SGD") -> Column:
    """The first ISO code of the list that stands in a text, else its first symbol's, else ``default``."""
    by_code = [F.when(text.rlike(rf"(?i)\b{iso}\b"), F.lit(iso)) for iso in ISO]
    sign = F.upper(F.regexp_extract(text, r"(?i)(US\$|S\$|A\$|HK\$|NT\$|€|£|¥|\$)", 1))
    by_sign = once(sign, lambda found: F.coalesce(*[F.when(found == s, F.lit(iso)) for s, iso in SYMBOLS.items()]))
    return F.coalesce(*by_code, by_sign, F.lit(default))


def token_currency(token: Column, page: Column) -> Column:
    """The currency a token names; a bare dollar sign and unknown codes are the page's."""
    key = F.regexp_extract(token, r"(US\$|S\$|A\$|HK\$|NT\$|C\$|RM|NTD|€|£|¥|\$|\b[A-Z]{2,3}\b)", 1)
    named = lambda k: F.coalesce(*[F.when(k == s, F.lit(iso)) for s, iso in SYMBOLS.items() if s != "$"], F.when(k.isin(ISO), k))
    return F.coalesce(once(key, named), page)


def repair_ocr_digits(c: Column) -> Column:
    """Letters that scanners read for digits."""
    return F.translate(c, "OolISB", "001158")


def tidy_amounts(line: Column) -> Column:
    """A line with usual blanks, ``S$`` in one piece, digits in place of look-alikes and cents joined once."""
    s = F.translate(line, "   ", "   ")
    s = F.regexp_replace(s, r"\bS\s+\$", r"S\$")
    s = F.regexp_replace(s, r"([$€£¥])\s+(?=[0-9])", "$1")
    s = F.regexp_replace(s, r"(?<=[0-9])[Oo](?=[0-9.,]|$|\b)", "0")
    s = F.regexp_replace(s, r"(?<=[0-9])[lI](?=[0-9.,]|\b)", "1")
    s = F.regexp_replace(s, r"(?<=[0-9])['’](?=[0-9]{3})", "")
    return join_cents(s)


def join_cents(line: Column) -> Column:
    """``123 O 45`` is ``123.45``: only across blanks, only at a word's end, only once."""
    return F.regexp_replace(line, r"\b([0-9]{2,})(?:\s+[oO]\s*|\s*[oO]\s+)([0-9]{2})(?![0-9.,])", "$1.$2")


#: How a currency stands at a figure, and how a figure is written.
AT_FIGURE = "(?:" + "|".join(ISO) + r"|US\$|S\$|A\$|HK\$|NT\$|\$|€|£|¥)"
FIGURE = r"\(?-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?\)?"


def figure_parts(line: Column) -> Column:
    """A line cut at its figures and the currencies at them: every second part is a figure. Dates are ``#``."""
    clean = F.regexp_replace(line, r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "#")
    marked = F.regexp_replace(clean, rf"(?<![\w.])((?:{AT_FIGURE}\s*)?{FIGURE}(?:\s*{AT_FIGURE})?)(?![\w])", "\u0001$1\u0002")
    return F.split(marked, "[\u0001\u0002]")


def counts(part: Column) -> Column:
    """Whether a figure is an amount: a currency stands at it or it has cents."""
    return part.rlike(AT_FIGURE) | part.rlike(r"\.[0-9]{2}\)?\s*\D*$")


def figure_value(part: Column) -> Column:
    return parse_amount(F.replace(F.regexp_extract(part, rf"({FIGURE})", 1), F.lit(","), F.lit("")))


def amounts(line: Column, page: Column) -> Column:
    """The amounts of a line: array of (amount, currency, start), from the left.

    A figure counts if a currency stands at it or it has cents. Signs and brackets
    are kept, group separators may be missing. Dates give no amounts.
    """
    parts = F.filter(F.transform(figure_parts(line), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda p: p["i"] % 2 == 1)
    return F.transform(F.filter(parts, lambda p: counts(p["s"])), lambda p: F.struct(figure_value(p["s"]).alias("amount"), token_currency(p["s"], page).alias("currency"), p["i"].alias("start")))


def best_amount(line: Column, found: Column, page: Column) -> Column:
    """Of a line's amounts the one in the page's currency that stands furthest right, else the last."""
    ranked = F.transform(found, lambda a: F.struct((a["currency"] == page).cast("int").alias("own"), a["start"].alias("start"), a["amount"].alias("amount"), a["currency"].alias("currency")))
    return F.array_max(ranked)


def context_score(left: Column, currency: Column, preferred: Column, position: Column) -> Column:
    """How likely a figure is the total to take, from the words on its left."""
    says = lambda p: F.when(left.rlike(p), 1.0).otherwise(0.0)
    return (
        says(r"(?i)(?:incl(?:uding|\.)?|inc\.?|with)\s+gst") * 50
        + says(r"(?i)(?:excl(?:uding|\.)?|without)\s+gst") * 10
        - says(r"(?i)\bgst\s*(?:payable|tax)\b") * 30
        - says(r"(?i)\b(?:vat|voucher|cash\s*advance|shipping|delivery|discount|service\s*charge|fees?|charges?)\b") * 15
        + F.when(currency == preferred, 2.0).otherwise(0.0)
        + position * 0.001
    )


def first_symbol(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, "([$€£¥])", 1))
