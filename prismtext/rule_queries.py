"""A query for each masking rule over texts made from the keys of orders: hits, misses, what may adjoin a value and what may not.

A case is a text and what the rule finds in it, both in the SQL that Spark and
DuckDB share; ``s`` is the value and ``ok`` its check in DuckDB. The key picks
the case. Spark knows only the texts; DuckDB works out what is to be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtext.operators import mask
from prismtext.operators.rules import RULES, Rule, catalogue


def groups(*sizes: int, by: str = " ", of: str = "s") -> str:
    """The value cut into groups."""
    at, parts = 1, []
    for n in sizes:
        parts.append(f"substr({of}, {at}, {n})")
        at += n
    return f" || '{by}' || ".join(parts)


def _n(factor: int, width: int) -> str:
    return f"lpad(cast((o_orderkey * {factor}) % {10**width} as varchar), {width}, '0')"


def _rule(tag: str, nth: int = 0, compat: bool = True) -> Rule:
    return [r for r in (RULES if compat else catalogue(False)) if r.tag == tag][nth]


_MONTH = "case o_orderkey % 3 when 0 then 'maja' when 1 then 'sierpnia' else 'grudnia' end"
_DAY = "cast(1 + o_orderkey % 28 as varchar)"
_SUM = "cast(1 + o_orderkey % 900 as varchar)"
_OCTETS = "cast(o_orderkey % 300 as varchar) || '.' || cast(o_orderkey % 7 as varchar) || '.0.' || cast(o_orderkey % 256 as varchar)"
_OCTETS_OK = "o_orderkey % 300 < 256"
HIT = "s"


def cases(checks: dict[str, tuple[str, str]]) -> dict[str, tuple[Rule, str, str, list[tuple[str, str]]]]:
    """name: (rule, value, its check, [(text, found)]). ``checks`` has the values of identifiers and their checks in SQL."""
    pesel, nip, regon, vin, iban, plate, card, iccid, phone, ssn, vat, mac, jwt, serial = (checks[k] for k in (
        "valid_pesel", "valid_nip", "valid_regon9", "valid_vin_compat", "valid_iban_compact", "valid_car_plate", "valid_luhn", "valid_iccid", "valid_phone_pl", "valid_ssn", "valid_eu_vat", "valid_mac_strict", "valid_jwt", "valid_ssl_serial"))
    always = "true"
    dashed, spaced3, spaced4 = groups(3, 3, 2, 2, by="-"), groups(3, 3, 3), groups(4, 4, 4, 4)
    return {
        "detect_email": (_rule("EMAIL"), "'a.b' || cast(o_orderkey as varchar) || '@mail.example'", always, [("'to ' || s || ', x'", HIT), ("'<' || s || '>'", HIT), ("replace(s, '@', ' at ')", "''"), ("s || '1'", HIT)]),
        "detect_url": (_rule("URL"), "'http://site' || cast(o_orderkey as varchar) || '.example.org/p?q=' || cast(o_orderkey as varchar)", always, [("'see ' || s || ' now'", HIT), ("'(' || s || ')'", HIT), ("replace(s, '://', ' ')", "''"), ("'at www.a-' || cast(o_orderkey as varchar) || '.example/x y'", "'www.a-' || cast(o_orderkey as varchar) || '.example/x'")]),
        "detect_ip": (_rule("IP"), _OCTETS, _OCTETS_OK, [("'ip ' || s || ':8080 x'", "s || '|8080'"), ("'host ' || s || ' x'", HIT), ("'v' || s", "''"), ("replace(s, '.', '-')", "''")]),
        "detect_pesel_tagged": (_rule("PESEL_TAGGED"), *pesel, [("'PESEL: ' || s", HIT), ("'pesel ' || s || ' x'", HIT), ("'PESEL-' || s", "''"), ("'PESEL: ' || s || '5'", "''")]),
        "detect_pesel": (_rule("PESEL"), *pesel, [("'nr ' || s || ' ok'", HIT), ("'nr x' || s", "''"), ("'**' || s || '** 7'", HIT), ("s || '1'", "''")]),
        "detect_nip": (_rule("NIP"), *nip, [("'nip ' || s", HIT), ("'nip ' || " + dashed, dashed), ("'x' || s || 'y'", HIT), ("'7' || s", "''")]),
        "detect_regon": (_rule("REGON"), *regon, [("'r ' || s", HIT), ("'r ' || " + groups(2, 3, 4), groups(2, 3, 4)), ("s || 'x'", "''"), ("'(' || s || ')'", HIT)]),
        "detect_date_word": (_rule("DATE"), f"{_DAY} || ' ' || {_MONTH} || ' 2023'", always, [("'dnia ' || s || ' x'", HIT), (f"'May ' || {_DAY} || 'th, 2024 x'", f"'May ' || {_DAY} || 'th, 2024'"), ("'a' || s", "''"), (f"'2022 ' || {_MONTH} || ' ' || {_DAY} || '.'", f"'2022 ' || {_MONTH} || ' ' || {_DAY}")]),
        "detect_money": (_rule("MONEY"), _SUM, always, [("'pay ' || s || ' PLN now'", "s || ' PLN'"), ("'$' || s || '.50 x'", "'$' || s || '.50'"), ("s || ' apples'", "''"), ("'about ' || s || ' euro, x'", "s || ' euro'")]),
        "detect_vin": (_rule("VIN"), *vin, [("'vin ' || s", HIT), ("'vin ' || lower(s)", "lower(s)"), ("s || '1'", "''"), ("'x-' || s", HIT)]),
        "detect_bank_account": (_rule("BANK_ACCOUNT"), *iban, [("'acc ' || s || ' ok'", HIT), ("'acc ' || " + groups(4, 4, 4, 4, 4, 2), groups(4, 4, 4, 4, 4, 2)), ("'x' || s", "''"), ("'acc ' || substr(s, 1, 20)", "''")]),
        "detect_car_plate": (_rule("CAR_PLATE"), *plate, [("'1. ' || s", HIT), ("'1. ' || substr(s, 1, 3) || '1'", "''"), ("'x' || s", "''"), ("'1. ' || substr(s, 1, 2) || ' 123'", "''")]),
        "detect_nrb": (_rule("NRB"), f"{_n(7919, 13)} || {_n(104729, 13)}", always, [("'nrb ' || s", HIT), ("'nrb ' || " + groups(2, 4, 4, 4, 4, 4, 4), HIT), ("'PL' || s", "''"), ("'1' || s", "''")]),
        "detect_ssn": (_rule("SSN"), *ssn, [("'ssn ' || s", HIT), ("s || '1'", "''"), ("'(' || s || ')'", HIT), ("replace(s, '-', ' ')", "''")]),
        "detect_phone_international": (_rule("PHONE_INTERNATIONAL"), phone[0], always, [("'tel +48 ' || " + spaced3 + " || ' x'", "'+48 ' || " + spaced3), ("'+48' || s || ' x'", "'+48' || s"), ("'48 ' || s", "''"), ("'+ 48'", "''")]),
        "detect_phone": (_rule("PHONE"), *phone, [("'tel ' || s || ' ok'", HIT), ("'tel ' || " + groups(3, 3, 3, by="-"), groups(3, 3, 3, by="-")), ("'x' || s", "''"), ("'(' || " + spaced3 + " || ')'", "''")]),
        "detect_mac_strict": (_rule("MAC_ADDRESS", compat=False), *mac, [("'mac ' || s || ' x'", HIT), ("'mac ' || s || 'F'", "''"), ("'(' || s || ')'", HIT)]),
        "detect_mac": (_rule("MAC_ADDRESS"), mac[0], "false", [("'mac ' || s || ' x'", "''"), ("replace(s, '-', ':')", "''")]),
        "detect_credit_card": (_rule("CREDIT_CARD"), *card, [("'card ' || s", HIT), ("'card ' || " + spaced4, spaced4), ("s || 'x'", "''"), ("'a' || s", "''")]),
        "detect_ssl_cert": (_rule("SSL_CERT"), *serial, [("'sn ' || s", HIT), ("s || 'z'", "''"), ("substr(s, 1, 15)", "''"), ("'sn:' || s || '.'", HIT)]),
        "detect_jwt": (_rule("JWT"), *jwt, [("'jwt ' || s || ' end'", HIT), ("substr(s, 1, 7) || ' x'", "''"), ("'\"' || s || '\"'", HIT)]),
        "detect_transaction_ref": (_rule("TRANSACTION_REF"), f"'TRX-' || {_n(7919, 6)} || '-' || {_n(31, 4)}", always, [("'ref ' || s", HIT), ("'AB-' || s", "''"), (f"'TRX-12-' || {_n(31, 4)}", "''"), ("lower(s) || '.'", "lower(s)")]),
        "detect_sim_card": (_rule("SIM_CARD"), *iccid, [("'sim ' || s", HIT), ("'sim ' || " + groups(4, 4, 4, 4, 3), groups(4, 4, 4, 4, 3)), ("s || '12'", "''"), ("'x' || s", "''")]),
        "detect_eu_vat": (_rule("EU_VAT"), *vat, [("'vat ' || s", HIT), ("s || '123'", "''"), ("substr(s, 1, 9)", "''"), ("lower(s) || '!'", "lower(s)")]),
        "detect_passport": (_rule("PASSPORT"), f"'AB' || {_n(7919, 7)}", always, [("'no ' || s", HIT), ("'x' || s", "''"), ("s || '1'", "''"), ("lower(s)", "lower(s)")]),
        "detect_id_card": (_rule("ID_CARD"), f"'ABC' || {_n(7919, 6)}", always, [("'no ' || s", HIT), ("'x' || s", "''"), ("s || '1'", "''")]),
        "detect_health_id": (_rule("HEALTH_CODE"), f"{_n(7919, 8)} || '/' || {_n(3, 3)}", always, [("'no ' || s", HIT), ("'1' || s", "''"), ("replace(s, '/', '-')", "''")]),
        "detect_invoice_number": (_rule("INVOICE_NUMBER"), f"'FV/2024/' || {_n(7919, 5)}", always, [("'no ' || s", HIT), ("'x' || s", "''"), ("replace(s, 'FV', 'inv')", "replace(s, 'FV', 'inv')"), ("s || '77'", "''")]),
        "detect_order_number": (_rule("ORDER_NUMBER"), f"'ORDER-' || {_n(7919, 7)}", always, [("'no ' || s", HIT), ("'x' || s", "''"), ("replace(s, 'ER-', '')", "replace(s, 'ER-', '')"), ("substr(s, 1, 8)", "''")]),
        "detect_social_id": (_rule("SOCIAL_ID"), f"'fbid' || {_n(7919, 9)}", always, [("'user ' || s", HIT), ("'x' || s", "''"), ("upper(s)", "upper(s)"), ("substr(s, 1, 11)", "''")]),
    }


def _pick(values: list[str]) -> str:
    return f"case o_orderkey % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def queries(checks: dict[str, tuple[str, str]]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries (o_orderkey, found) and their SQL."""

    def query(rule: Rule, value: str, texts: list[str]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(value.replace("as varchar", "as string")).alias("s"))
            made = rows.select("o_orderkey", F.expr(_pick(texts).replace("as varchar", "as string")).alias("text"))
            return made.select("o_orderkey", F.array_join(mask.detect(F.col("text"), rule), "|").alias("found"))

        return run

    found = {name: query(rule, value, [t for t, _ in texts]) for name, (rule, value, _, texts) in cases(checks).items()}
    sql = {
        name: f"select o_orderkey, case when {ok} then {_pick([f for _, f in texts])} else '' end as found from (select o_orderkey, {value} as s from orders)"
        for name, (_, value, ok, texts) in cases(checks).items()
    }
    return found, sql
