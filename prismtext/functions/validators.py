"""Checks of identifiers as native columns: each takes a string column and gives a boolean one.

A null stays null-safe: every check gives false for null and for empty text.
Digits are ASCII digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check-digit weights.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5, 6)
REGON14_OFFICIAL_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
# Letters a VIN may hold, and their numbers (counted through; as ISO 3779 has them).
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_COUNTED = tuple(range(1, 24))
VIN_ISO = (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9)
# First digits of Polish phone numbers.
PHONE_PREFIXES = ("45", "50", "51", "53", "60", "66", "69", "72", "73", "78", "79")
FREE_PHONE_PREFIX = "800"
# Layouts of car plates.
PLATE_LAYOUTS = r"[A-Z]{2}(?:\d{5}|\d{2}[A-Z]{2}|\d{3}[A-Z]{2}|\d{4}[A-Z])|[A-Z]{3}(?:\d{2}[A-Z]\d{2}|\d{4,5}[A-Z]?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column, pattern: str) -> Column:
    """Does the pattern match all of the text?"""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def bare(text: Column, dropped: str = r"[\s-]") -> Column:
    return F.regexp_replace(text, dropped, "")


def weighed(text: Column, weights: Sequence[int]) -> Column:
    """Sum of the first digits times their weights; callers have checked that these are digits."""
    terms = [F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights) if w]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def digit(text: Column, place: int) -> Column:
    return F.substring(text, place, 1).cast("int")


def _checked(text: Column, pattern: str, rule: Callable[[Column], Column]) -> Column:
    """``rule`` where the text has the form, else false; the form guards the casts."""
    return F.when(whole(text, pattern), F.coalesce(rule(text), F.lit(False))).otherwise(False)


def valid_pesel(text: Column) -> Column:
    return _checked(text, "[0-9]{11}", lambda t: (10 - weighed(t, PESEL_WEIGHTS) % 10) % 10 == digit(t, 11))


def valid_nip(text: Column) -> Column:
    """A remainder of ten is no digit, so such numbers are never valid."""
    return let(bare(text, "[ -]"), lambda t: _checked(t, "[0-9]{10}", lambda t: weighed(t, NIP_WEIGHTS) % 11 == digit(t, 10)))


def valid_krs(text: Column) -> Column:
    return whole(bare(text, "[ -]"), "[0-9]{10}")


def valid_regon(text: Column, official: bool = False) -> Column:
    """Nine digits, or fourteen of which the first nine are valid too. ``official`` takes the published weights for fourteen."""
    weights = REGON14_OFFICIAL_WEIGHTS if official else REGON14_WEIGHTS
    nine = lambda t: weighed(t, REGON9_WEIGHTS) % 11 % 10 == digit(t, 9)
    return let(
        bare(text),
        lambda t: _checked(t, "[0-9]{9}", nine) | _checked(t, "[0-9]{14}", lambda t: nine(t) & (weighed(t, weights) % 11 % 10 == digit(t, 14))),
    )


def _luhn_sum(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _luhn(text: Column, pattern: str) -> Column:
    return let(bare(text), lambda t: _checked(t, pattern, _luhn_sum))


def valid_card(text: Column) -> Column:
    return _luhn(text, "[0-9]{13,19}")


def valid_iccid(text: Column) -> Column:
    return let(bare(text, r"\s"), lambda t: _checked(t, "[0-9]{19,20}", _luhn_sum))


def valid_nrb(text: Column) -> Column:
    return whole(bare(text), "[0-9]{26}")


def valid_iban(text: Column) -> Column:
    """Remainder one modulo 97 of the number that the moved and spelt-out text stands for; no length table."""

    def rest(t: Column) -> Column:
        moved = F.concat(F.substring(t, 5, 64), F.substring(t, 1, 4))
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        step = lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
        return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1

    return let(F.upper(bare(text)), lambda t: _checked(t, "[A-Z0-9]{5,64}", rest))


def valid_vin(text: Column, iso: bool = False) -> Column:
    numbers = VIN_ISO if iso else VIN_COUNTED

    def rule(t: Column) -> Column:
        value = F.create_map(*[F.lit(x) for c, n in zip(VIN_LETTERS, numbers) for x in (c, n)], *[F.lit(x) for d in range(10) for x in (str(d), d)])
        total = F.aggregate(
            F.zip_with(F.split(t, ""), F.array(*[F.lit(w) for w in VIN_WEIGHTS]), lambda c, w: F.element_at(value, c) * w), F.lit(0), lambda a, x: a + x
        )
        return F.substring(t, 9, 1) == F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))

    return let(F.upper(text), lambda t: _checked(t, f"[{VIN_LETTERS}0-9]{{17}}", rule))


def valid_plate(text: Column) -> Column:
    return whole(F.upper(F.replace(text, F.lit(" "), F.lit(""))), PLATE_LAYOUTS)


def valid_ssn(text: Column) -> Column:
    return whole(text, r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")


def valid_eu_vat(text: Column) -> Column:
    return let(F.upper(text), lambda t: whole(t, "[A-Z]{2}[A-Z0-9]{8,12}") & (F.regexp_count(F.substring(t, 3, 12), F.lit("[0-9]")) >= 4))


def valid_mac(text: Column) -> Column:
    """Six pairs, with one separator throughout or none."""
    return whole(text, r"[0-9A-Fa-f]{2}([:-]?)[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}")


def possible_token(text: Column, least: int = 32) -> Column:
    kinds = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in ("[a-z]", "[0-9]", "[_-]")), F.coalesce(text.rlike("[A-Z]"), F.lit(False)).cast("int"))
    return whole(text, f"[A-Za-z0-9_-]{{{least},}}") & (kinds >= 2)


def possible_jwt(text: Column) -> Column:
    return whole(text, r"[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2}")


def valid_ssl_serial(text: Column) -> Column:
    return whole(text, "[0-9A-F]{16,40}")


def possible_transaction(text: Column) -> Column:
    return F.coalesce(F.length(text).between(8, 64) & (F.regexp_count(text, F.lit("[0-9]+")) >= 2), F.lit(False))


def valid_phone(text: Column) -> Column:
    return let(bare(text), lambda t: whole(t, "[0-9]{9}") & (F.substring(t, 1, 2).isin(*PHONE_PREFIXES) | F.startswith(t, F.lit(FREE_PHONE_PREFIX))))


def valid_ipv4(text: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return whole(text, r"(?=[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z)" + rf"{octet}(?:\.{octet}){{3}}")


def valid_port(text: Column) -> Column:
    return _checked(text, "[0-9]{1,5}", lambda t: t.cast("int").between(1, 65535))
