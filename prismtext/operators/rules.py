"""The catalogue of masking rules, in the order in which they apply.

A rule finds candidates by a pattern, may check them, and says what of a
candidate is masked. A pattern of three groups keeps the first and third.
Patterns are flat (no free-spacing) Java expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismtext.functions import validators as v


@dataclass(frozen=True)
class Rule:
    tag: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    grouped: bool = False
    record: Callable[[Column], Column] = lambda c: c
    kind: str = "plain"
    #: Cheap test of a text, given its number of digits too, without which the rule masks nothing. Many rules share these.
    gate: Callable[[Column, Column], Column] | None = None


# Patterns, month names, currencies, country codes with the lengths of their account numbers.
PL_MONTHS = (
    "styczeń|stycznia|sty|luty|lutego|lut|marzec|marca|mar|kwiecień|kwietnia|kwi|maj|maja|czerwiec|czerwca|cze|lipiec|lipca|lip|"
    "sierpień|sierpnia|sie|wrzesień|września|wrz|październik|października|paź|listopad|listopada|lis|grudzień|grudnia|gru"
)
EN_MONTHS = "January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug|September|Sep|October|Oct|November|Nov|December|Dec"
SYMBOLS = "[$€£¥₽₹]"
CODES = "USD|EUR|GBP|PLN|CHF|CAD|AUD|JPY|NOK|SEK|DKK|CZK|HUF|RUB|CNY|INR"
WORDS = (
    r"zł|zł\.|złoty|złote|złotych|złotymi|dolar|dolara|dolarów|dolary|dolarami|euro|eur\.|eura|eurów|eurem|"
    r"funt|funty|funtów|funtami|rubel|rubla|rubli|rublami"
)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BH": 18, "BR": 29, "BY": 29,
    "CH": 21, "CR": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IQ": 23, "IR": 26, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 30, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "UK": 22, "VA": 22, "VG": 24,
}

_AMOUNT = r"\d{1,3}(?:[ ,. ]\d{3})*(?:[.,]\d{1,2})?"
_SCALE = r"(?:\s*(?:tys\.|mln|mld))?"
_BEFORE, _AFTER = f"(?:{SYMBOLS}|{CODES})", f"(?:{SYMBOLS}|{CODES}|{WORDS})"
_MONEY = rf"(?<!\w)[_*]*(?:{_BEFORE}\s*?{_AMOUNT}{_SCALE}(?:\s*{_AFTER})?|{_AMOUNT}{_SCALE}\s*{_AFTER})[_*]*(?!\w)"
_DATE_WORD = (
    rf"(?<!\w)(?:\d{{1,2}}\s+(?:{PL_MONTHS})\s+\d{{4}}|\d{{4}}\s+(?:{PL_MONTHS})\s+\d{{1,2}}|"
    rf"(?:{EN_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*|\s+)\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{EN_MONTHS})\s+\d{{4}})(?!\w)"
)
_MONTH, _DAY = "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_DATE_NUMBER = rf"(?<!\d)(?:\d{{4}}\s*[-./]\s*{_MONTH}\s*[-./]\s*{_DAY}|{_DAY}\s*[-./]\s*{_MONTH}\s*[-./]\s*\d{{4}})(?!\d)"
_URL = (
    r"https?://(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?:[/:][^\s)]*)?"
    r"|https?://(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|localhost)(?::\d+)?(?:/[^\s)]*)?"
    r"|(?<![A-Za-z0-9_])www\.[A-Za-z0-9-]+\.[A-Za-z]{2,}(?:[/:][^\s)]*)?(?![A-Za-z0-9_()])"
)
_IP = r"\b(localhost|(?:\d{1,3}\.){3}\d{1,3}|(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4})(?::(\d{1,5}))?\b"
_GAP, _GAPS = r"[ \t\n\r\x0B\f-]?", r"[ \t\r\x0B\f-]*"
_HEAD = rf"(?:{_GAP}\d\d|{_GAP}[A-Za-z0-9]{_GAP}[A-Za-z0-9](?=[^a-zA-Z]|\z))"
_COUNTRIES = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
IBAN = r"\b(?:" + "|".join(f"(?:{c}){_HEAD}(?:{_GAPS}[A-Za-z0-9]){{{n - 4}}}" for n, c in _COUNTRIES.items()) + ")"
_IBAN_HEAD = rf"(?iU)\b(?:{'|'.join(IBAN_LENGTHS)}){_HEAD}"
_NRB = r"(?<![A-Z]{2})(?<![A-Z]{2}\s)(?<![A-Z]{2}-)(?<!\d)\d{2}(?:[-\s]?\d{4}){6}(?!\d)"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s-]", "")


def _digits(n: int) -> Callable[[Column, Column], Column]:
    return lambda text, digits: digits >= n


def _has(*parts: str) -> Callable[[Column, Column], Column]:
    def gate(text: Column, digits: Column) -> Column:
        found = [F.contains(F.lower(text), F.lit(p)) for p in parts]
        return found[0] if len(found) == 1 else found[0] | found[1]

    return gate


def _address_gate(text: Column, digits: Column) -> Column:
    return (digits >= 4) | F.contains(text, F.lit("localhost")) | (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) >= 7)


def _iban(c: Column) -> Column:
    """A number with an X in it is one that someone has masked in part; it needs no check digits."""
    return c.rlike("[Xx]") | v.valid_iban(c)


def catalogue(compat: bool = True) -> list[Rule]:
    """All 33 rules in order.

    ``compat`` keeps the known peculiarities (MAC addresses are never masked,
    VIN letters are counted through, the alternative weights of long REGON
    numbers); without it the published definitions hold.
    """
    return [
        Rule("EMAIL", r"(?i)_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?", gate=_has("@")),
        Rule("URL", f"(?i){_URL}", gate=_has("http", "www.")),
        Rule("IP", f"(?U){_IP}", v.valid_ipv4, kind="address", gate=_address_gate),
        Rule("PESEL_TAGGED", r"(?iU)(\bPESEL[:\s]+)(\d{11})\b()", v.valid_pesel, grouped=True, gate=_digits(11)),
        Rule("PESEL", r"(?U)(?<!\w)([_*]*)(\d{11})([_*]*)(?!\w)", v.valid_pesel, grouped=True, gate=_digits(11)),
        Rule("NIP", r"(?U)(?<!\d)([_*]*)(\d{3}-?\d{3}-?\d{2}-?\d{2})([_*]*)(?!\d)", v.valid_nip, grouped=True, gate=_digits(10)),
        Rule("REGON", r"(?U)\b\d{2}\s?\d{3}\s?\d{4}(?:\s?\d{5})?\b", lambda c: v.valid_regon(c, official=not compat), gate=_digits(9)),
        Rule("DATE", f"(?iuU){_DATE_WORD}", gate=_digits(5)),
        Rule("DATE", f"(?U){_DATE_NUMBER}", gate=_digits(8)),
        Rule("TIME", r"(?U)\b(?<!\d)(?:[01]\d|2[0-3])[:.][0-5]\d(?!\d)\b", gate=_digits(4)),
        Rule("MONEY", f"(?iuU){_MONEY}", gate=_digits(1)),
        Rule("VIN", r"(?iU)\b[A-HJ-NPR-Z0-9]{17}\b", lambda c: v.valid_vin(c, iso=not compat), gate=lambda text, digits: (digits >= 1) | F.contains(F.lower(text), F.lit("x"))),
        Rule("BANK_ACCOUNT", f"(?iU){IBAN}", _iban, kind="account", gate=lambda text, digits: F.regexp_like(text, F.lit(_IBAN_HEAD))),
        Rule("CAR_PLATE", r"(?iU)(?<![A-Z]{2})(?<![A-Z]{2}-)\b[A-Z]{2,3}\s?\d{2,5}[A-Z]{0,2}\b", lambda c: v.valid_plate(c), gate=_digits(2)),
        # That no slash follows on the line is asked last, once a code is found: a line is not read again at every character.
        Rule("POSTAL_CODE", r"(?dU)(?<!\d)[_*]*(?:\d{2}-\d{3}|(?<!/)\d{5}(?!\d))[_*]*(?!\d)(?!.*/)", gate=_digits(5)),
        Rule("NRB", f"(?U){_NRB}", v.valid_nrb, record=_stripped, gate=_digits(26)),
        Rule("KRS", r"(?U)(?<!\w)(?:\d{3}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}|\d{10})(?!\w)", lambda c: v.valid_krs(_stripped(c)), record=_stripped, gate=_digits(10)),
        Rule("PASSPORT", r"(?iU)\b[A-Z]{2}\d{7}\b", gate=_digits(7)),
        Rule("ID_CARD", r"(?iU)\b[A-Z]{3}\d{6}\b", gate=_digits(6)),
        Rule("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b", v.valid_ssn, gate=_digits(9)),
        Rule("HEALTH_CODE", r"(?U)\b\d{8}/\d{3}\b", gate=_digits(11)),
        Rule("PHONE_INTERNATIONAL", r"(?U)\+\d{1,3}(?:[\s-]?\d{1,4}){2,5}(?!\d)", gate=_digits(3)),
        Rule("PHONE", r"(?U)\b\d{9}\b|(?<!\S)\d{2,5}(?:[\s-]\d{1,4}){2,4}(?!\S)", v.valid_phone, gate=_digits(9)),
        Rule("MAC_ADDRESS", r"(?U)\b(?:[0-9A-Fa-f]{2}[:-]?){5}[0-9A-Fa-f]{2}\b", (lambda c: F.lit(False)) if compat else v.valid_mac, gate=(lambda text, digits: F.lit(False)) if compat else None),
        Rule("CREDIT_CARD", r"(?U)\b(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})\b", v.valid_card, gate=_digits(13)),
        Rule("SSL_CERT", r"(?U)(?<![A-Z]{2}\d)\b[0-9A-Fa-f]{16,40}\b", v.valid_ssl_serial),
        Rule("JWT", r"(?U)\b[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", v.possible_jwt),
        Rule("INVOICE_NUMBER", r"(?iU)\b(?:FV|INV|INVOICE)[/-]\d{4}[/-]\d{3,6}\b", gate=_digits(7)),
        Rule("ORDER_NUMBER", r"(?iU)\b(?:ORD|ORDER)[-_]?\d{3,10}\b", gate=_digits(3)),
        Rule("TRANSACTION_REF", r"(?iU)(?<![A-Z]{2}-)(?<![A-Z]{2}\d)\b[A-Z]{2,5}[-_](?!\d{2}[-_])\d{4,8}[-_]\d{3,6}\b", v.possible_transaction, gate=_digits(7)),
        Rule("SIM_CARD", r"(?U)\b(?:\d{4}\s?){4}\d{1,4}\b", v.valid_iccid, gate=_digits(19)),
        Rule("SOCIAL_ID", r"(?iU)\bfbid\d{8,}\b", gate=_digits(8)),
        Rule("EU_VAT", r"(?iU)\b[A-Z]{2}[A-Z0-9]{8,12}\b", v.valid_eu_vat, gate=_digits(4)),
    ]


RULES = catalogue()
