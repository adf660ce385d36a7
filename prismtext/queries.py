"""Queries over the test tables, and the SQL that gives the same rows.

Most identifiers do not occur in the tables, so the checks run over numbers
made from the keys of orders: the same text in Spark and in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtext.functions import text as t
from prismtext.functions import validators as v
from prismtext.operators import clusters, guard, mapping, mask, retrieval, route, terms
from prismtext.operators.rules import RULES
from prismtext.rule_queries import queries as rule_queries
from prismtext.storage import new_path, read_batches
from prismtext.streaming.pseudonyms import mask_with_store

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, orders, customer, conversations, embeddings = (_table(n) for n in ("documents", "orders", "customer", "conversations", "embeddings"))


def number(factor: int, width: int, add: int = 0) -> tuple[str, str]:
    """A digit string of a width from o_orderkey, as Spark SQL and as DuckDB SQL (they are the same)."""
    sql = f"lpad(cast((o_orderkey * {factor} + {add}) % {10**width} as string), {width}, '0')"
    return sql, sql.replace("as string", "as varchar")


def upper_letters(factor: int, count: int) -> str:
    """Letters from o_orderkey, the same in both dialects."""
    return " || ".join(f"chr(cast(65 + (o_orderkey * {factor + 13 * i} + {7 * i}) % 26 as int))" for i in range(count))


def _sum(weights: tuple[int, ...], text: str = "s") -> str:
    return " + ".join(f"cast(substr({text}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights) if w)


def _check(spark_text: str, rule: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: orders(spark, sf_dir).select("o_orderkey", F.expr(spark_text).alias("s")).select("o_orderkey", "s", rule(F.col("s")).alias("valid"))


def _check_sql(text: str, rule: str) -> str:
    return f"select o_orderkey, s, {rule} as valid from (select o_orderkey, {text} as s from orders)"


def _luhn(text: str) -> str:
    double = f"list_transform(range(1, len({text}) + 1), lambda i: case when (len({text}) - i) % 2 = 1 then cast(substr({text}, cast(i as int), 1) as int) * 2 else cast(substr({text}, cast(i as int), 1) as int) end)"
    return f"list_sum(list_transform({double}, lambda d: case when d > 9 then d - 9 else d end)) % 10 = 0"


VIN_TEXT = "'WVWZZZ1J' || substr('0123456789X', cast(o_orderkey % 11 as int) + 1, 1) || " + number(7919, 8)[0]
PESEL, NIP, REGON9, REGON14, CARD, ICCID, PHONE = number(7919, 11), number(104729, 10), number(31337, 9), number(15485863, 14), number(49979687, 16), number(86028121, 19), number(6700417, 9)
IBAN = tuple("'GB' || " + a + " || 'WEST' || " + b for a, b in zip(number(1, 2), number(86028121, 14)))
SSN = tuple(f"{a} || '-' || {b} || '-' || {c}" for a, b, c in zip(number(1, 3), number(7, 2), number(3, 4)))
PLATE = tuple(upper_letters(1, 3) + " || ' ' || " + n for n in number(7919, 4))
VAT = tuple(upper_letters(3, 4) + " || " + n for n in number(7919, 8))
_mac = [f"substr(upper(md5({k})), 1, 2) || ':' || substr(upper(md5({k})), 3, 2) || '-AA:BB:CC:' || substr(upper(md5({k})), 5, 2)" for k in ("cast(o_orderkey as string)", "cast(o_orderkey as varchar)")]
MAC = tuple(f"case when o_orderkey % 2 = 0 then replace({m}, '-', ':') else {m} end" for m in _mac)
TOKEN = tuple(f"md5({k}) || '_' || md5({k})" for k in ("cast(o_orderkey as string)", "cast(o_orderkey as varchar)"))
SERIAL = tuple(f"case when o_orderkey % 2 = 0 then upper({x}) else {x} end" for x in ("md5(cast(o_orderkey as string))", "md5(cast(o_orderkey as varchar))"))
JWT = tuple(f"substr({a}, 1, cast(8 + o_orderkey % 5 as int)) || '.' || {a} || '.' || {a}" for a in ("md5(cast(o_orderkey as string))", "md5(cast(o_orderkey as varchar))"))
TXN = tuple(f"'TRX-' || {a} || case when o_orderkey % 3 = 0 then '' else '-' || {b} end" for a, b in zip(number(7919, 6), number(31, 4)))

_vin_sum = " + ".join(
    f"(case when strpos('{v.VIN_LETTERS}', substr(s, {i + 1}, 1)) > 0 then [{', '.join(map(str, '%s'))}][strpos('{v.VIN_LETTERS}', substr(s, {i + 1}, 1))] else cast(substr(s, {i + 1}, 1) as int) end) * {w}"
    for i, w in enumerate(v.VIN_WEIGHTS)
    if w
)


def _vin_sql(numbers: tuple[int, ...]) -> str:
    total = _vin_sum.replace("[%, s]", str(list(numbers)))
    total = total.replace("cast(substr(s, 9, 1) as int)", "0")
    return f"substr(s, 9, 1) = case when ({total}) % 11 = 10 then 'X' else cast(({total}) % 11 as varchar) end"


_IBAN_SQL = "list_reduce(list_prepend(0, list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)), lambda r, d: (r * (case when d > 9 then 100 else 10 end) + d) % 97) = 1"
_REGON9_SQL = f"({_sum(v.REGON9_WEIGHTS)}) % 11 % 10 = cast(substr(s, 9, 1) as int)"

CHECKS: dict[str, tuple[tuple[str, str], Callable[[Column], Column], str]] = {
    "valid_pesel": (PESEL, v.valid_pesel, f"(10 - ({_sum(v.PESEL_WEIGHTS)}) % 10) % 10 = cast(substr(s, 11, 1) as int)"),
    "valid_nip": (NIP, v.valid_nip, f"({_sum(v.NIP_WEIGHTS)}) % 11 = cast(substr(s, 10, 1) as int)"),
    "valid_krs": (NIP, v.valid_krs, "regexp_full_match(s, '[0-9]{10}')"),
    "valid_regon9": (REGON9, v.valid_regon, _REGON9_SQL),
    "valid_regon14": (REGON14, v.valid_regon, f"{_REGON9_SQL} and ({_sum(v.REGON14_WEIGHTS)}) % 11 % 10 = cast(substr(s, 14, 1) as int)"),
    "valid_luhn": (CARD, v.valid_card, _luhn("s")),
    "valid_iccid": (ICCID, v.valid_iccid, _luhn("s")),
    "valid_iban_compact": (IBAN, v.valid_iban, _IBAN_SQL),
    "valid_vin_compat": ((VIN_TEXT, VIN_TEXT.replace("as string", "as varchar")), v.valid_vin, _vin_sql(v.VIN_COUNTED)),
    "valid_vin_iso": ((VIN_TEXT, VIN_TEXT.replace("as string", "as varchar")), lambda c: v.valid_vin(c, iso=True), _vin_sql(v.VIN_ISO)),
    "valid_ssn": (SSN, v.valid_ssn, "substr(s, 1, 3) not in ('000', '666') and substr(s, 1, 1) <> '9' and substr(s, 5, 2) <> '00' and substr(s, 8, 4) <> '0000'"),
    "valid_car_plate": (PLATE, v.valid_plate, "regexp_full_match(replace(s, ' ', ''), '[A-Z]{3}[0-9]{4,5}[A-Z]?')"),
    "valid_phone_pl": (PHONE, v.valid_phone, "substr(s, 1, 2) in (" + ", ".join(f"'{p}'" for p in v.PHONE_PREFIXES) + ") or substr(s, 1, 3) = '800'"),
    "valid_eu_vat": (VAT, v.valid_eu_vat, "regexp_full_match(s, '[A-Z]{2}[A-Z0-9]{8,12}') and len(regexp_extract_all(substr(s, 3), '[0-9]')) >= 4"),
    "valid_mac_strict": (MAC, v.valid_mac, "regexp_full_match(s, '([0-9A-F]{2}:){5}[0-9A-F]{2}')"),
    "valid_token": (TOKEN, v.possible_token, "len(s) >= 32 and cast(regexp_matches(s, '[A-Z]') as int) + cast(regexp_matches(s, '[a-z]') as int) + cast(regexp_matches(s, '[0-9]') as int) + cast(regexp_matches(s, '[_-]') as int) >= 2"),
    "valid_jwt": (JWT, v.possible_jwt, "regexp_full_match(s, '[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}')"),
    "valid_ssl_serial": (SERIAL, v.valid_ssl_serial, "regexp_full_match(s, '[0-9A-F]{16,40}')"),
    "valid_txn_ref": (TXN, v.possible_transaction, "len(s) between 8 and 64 and len(regexp_extract_all(s, '[0-9]+')) >= 2"),
}

#: Masks and finds in texts made from keys: name, rule, text, and the SQL for the masked text.
_RULE = {r.tag: r for r in RULES}
MASKS = {
    "mask_passport": ("PASSPORT", tuple(f"'pass ' || {upper_letters(5, 2)} || {n} || ' end'" for n in number(7919, 7)), r"\b[A-Za-z]{2}[0-9]{7}\b"),
    "mask_id_card": ("ID_CARD", tuple(f"'card ' || {upper_letters(5, 3)} || {n} || ' end'" for n in number(7919, 6)), r"\b[A-Za-z]{3}[0-9]{6}\b"),
    "mask_health_id": ("HEALTH_CODE", tuple(f"'id ' || {a} || '/' || {b}" for a, b in zip(number(7919, 8), number(3, 3))), r"\b[0-9]{8}/[0-9]{3}\b"),
    "mask_order_number": ("ORDER_NUMBER", tuple(f"'see ORDER-' || {n} || '.'" for n in number(7919, 7)), r"(?i)\b(ORD|ORDER)[-_]?[0-9]{3,10}\b"),
    "mask_invoice_number": ("INVOICE_NUMBER", tuple(f"'FV/2024/' || {n} || ' paid'" for n in number(7919, 5)), r"(?i)\b(FV|INV|INVOICE)[/-][0-9]{4}[/-][0-9]{3,6}\b"),
    "mask_social_id": ("SOCIAL_ID", tuple(f"'user fbid' || {n}" for n in number(7919, 9)), r"(?i)\bfbid[0-9]{8,}\b"),
}


def _mask(tag: str, text: str) -> Query:
    return lambda spark, sf_dir: orders(spark, sf_dir).select("o_orderkey", mask.apply_rule(F.expr(text), _RULE[tag]).alias("masked"))


def _detect(rule, text: str) -> Query:
    return lambda spark, sf_dir: orders(spark, sf_dir).select("o_orderkey", F.array_join(mask.detect(F.expr(text), rule), "|").alias("found"))


# A number between marks, letters or other digits: what may adjoin it differs from rule to rule.
_AROUND = tuple(f"case o_orderkey % 3 when 0 then 'no ' || {n} || ' x' when 1 then 'no 7' || {n} || ' x' else 'no ' || {n} end" for n in NIP)
_DATES = tuple(f"'on ' || {a} || '-' || {b} || '-' || {c} || ' ok'" for a, b, c in zip(number(1, 4), number(3, 2), number(7, 2)))
_CLOCK = tuple(f"'at ' || {a} || ':' || {b} || ' ok'" for a, b in zip(number(3, 2), number(7, 2)))
_POST = tuple(f"'box ' || {a} || '-' || {b} || case when o_orderkey % 2 = 0 then ' a/b' else '' end" for a, b in zip(number(3, 2), number(7, 3)))
DETECTS = {
    "detect_krs": (_RULE["KRS"], _AROUND, "array_to_string(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: len(x) = 10), '|')"),
    "detect_date_number": (
        next(r for r in RULES if r.pattern.startswith("(?U)(?<!\\d)(?:\\d{4}")),
        _DATES,
        "coalesce(array_to_string(regexp_extract_all(s, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])'), '|'), '')",
    ),
    "detect_time": (_RULE["TIME"], _CLOCK, "coalesce(array_to_string(regexp_extract_all(s, '([01][0-9]|2[0-3]):[0-5][0-9]'), '|'), '')"),
    "detect_postal_code": (_RULE["POSTAL_CODE"], _POST, "case when s like '%/%' then '' else array_to_string(regexp_extract_all(s, '[0-9]{2}-[0-9]{3}'), '|') end"),
}

WORDS_SQL = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))"
#: A catalogue of the form that ``route.load_routing`` reads: eight intents, terms in English and in the tables' made-up syllables.
CATALOGUE = {
    "settings": {"len_thresholds_max": {"simple": 25, "medium": 150}, "default_models": {"simple": "small", "medium": "middle", "complex": "large"}, "intent_adjustment": {"code": "medium", "math": "medium", "analysis": "complex", "creative": "simple", "translation": "simple", "data": "complex", "planning": "medium"}},
    "intents": {
        "code": {"keywords": ["code", "py", "class", "function", "bug", "compile", "script", "git"], "phrases": ["write code:5", "debug", " stack trace : 4"], "patterns": ["git\\s+(commit|push)", "def\\s+\\w+", "(unclosed"], "weights": {"code": 3, "function": 2}},
        "math": {"keywords": ["math", "sum", "integral", "prove", "equation", "algebra"], "phrases": ["matrix:2", "square root:3"], "patterns": ["\\b\\d+\\s*[+*/-]\\s*\\d+\\b"], "weights": {"sum": 2}},
        "analysis": {"keywords": ["analyse", "compare", "evaluate", "tion", "reason"], "phrases": ["pros and cons:4", "root cause:3"], "patterns": ["why\\s+(is|are|do|does)"], "weights": {"tion": 0.5}},
        "creative": {"keywords": ["story", "poem", "la", "novel", "lyric"], "phrases": ["once upon:3"], "patterns": [], "weights": {"story": 2}},
        "translation": {"keywords": ["translate", "French", "ung", "ment"], "phrases": ["in german:3", "how do you say:4"], "patterns": [], "weights": {"ung": 0.5}},
        "data": {"keywords": ["table", "query", "column", "csv", "join"], "phrases": ["group by:3", "data frame:3"], "patterns": ["select\\s+.+\\s+from"], "weights": {"query": 2}},
        "planning": {"keywords": ["plan", "schedule", "deadline", "ste"], "phrases": ["step by step:3"], "patterns": [], "weights": {}},
        "general": {"keywords": ["how", "co", "ne", "hello", "thanks"], "phrases": ["what is:4"], "patterns": [], "weights": {}},
    },
}
ROUTING = route.load_routing(CATALOGUE, ["small", "middle", "large"])


def _points(intent: route.Intent, text: str) -> str:
    terms = [(k, float(intent.weights.get(k, 1))) for k in intent.keywords] + [route._weight(p) for p in intent.phrases]
    parts = [f"case when contains({text}, '{k}') then {w} else 0.0 end" for k, w in terms] + [f"case when regexp_matches({text}, '{p}') then 3.0 else 0.0 end" for p in intent.patterns if p.count("(") == p.count(")")]
    return "cast(" + " + ".join(parts) + " as double)"


_SCORES_SQL = "select conv_id, turn, text, " + ", ".join(f"{_points(i, 'lower(text)')} as {i.name}_score" for i in ROUTING.intents) + " from conversations"
_BEST = "greatest(" + ", ".join(f"{i.name}_score" for i in ROUTING.intents) + ")"
_CLASS_SQL = f"select conv_id, turn, text, case when {_BEST} <= 0 then 'none' " + " ".join(f"when {i.name}_score = {_BEST} then '{i.name}'" for i in ROUTING.intents) + f" end as intent from ({_SCORES_SQL})"
_LEVEL_SQL = f"case when floor({WORDS_SQL} * 1.25) <= 25 then 'simple' when floor({WORDS_SQL} * 1.25) <= 150 then 'medium' else 'complex' end"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir)


def intent_scores(spark, sf_dir):
    s = _turns(spark, sf_dir).select("conv_id", "turn", route.scores(F.col("text"), ROUTING).alias("s"))
    return s.select("conv_id", "turn", *[F.col("s")[k]["score"].alias(f"{i.name}_score") for k, i in enumerate(ROUTING.intents)])


def select_model(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", route.select_model(route.classify(F.col("text"), ROUTING), route.complexity(F.col("text"), ROUTING), ROUTING).alias("model"))


def route_model(spark, sf_dir):
    """What model each turn is sent to: every third asks for one by name, the others leave it to the routing; every fifth has no text."""
    rows = _turns(spark, sf_dir).withColumn("asked", F.when(F.col("turn") % 3 == 2, "own").otherwise("auto")).withColumn("given", F.when(F.col("turn") % 5 != 4, F.col("text")))
    return rows.select("conv_id", "turn", route.route(F.col("asked"), F.col("given"), ROUTING).alias("model"))


def last_statement(spark, sf_dir):
    """The text to route by, of payloads that hold it in a different field each: the messages, the last statement, query, prompt or input."""
    last = _turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    only = lambda k, value: F.when(F.col("conv_id") % 5 == k, value)
    messages = only(0, F.array(F.struct(F.lit("user").alias("role"), F.lit("first").alias("content")), F.struct(F.lit("user").alias("role"), F.col("last").alias("content"))))
    return last.select("conv_id", t.user_text(messages, *[only(k, F.col("last")) for k in (1, 2, 3, 4)]).alias("text"))


def search_texts(spark, sf_dir):
    """The text to search by: the last statement of even conversations, else the last message."""
    last = _turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.max_by("role", "turn").alias("role"))
    messages = F.array(F.struct(F.col("role"), F.concat(F.lit("m "), F.col("last")).alias("content")))
    return last.select("conv_id", t.search_text(messages, F.when(F.col("conv_id") % 2 == 0, F.col("last"))).alias("text"))


def search_payloads(spark, sf_dir):
    """The text to search by of payloads as JSON text: objects with messages or a last statement, plain text, arrays, objects without either."""
    last = _turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.max_by("role", "turn").alias("role"))
    one = F.struct("role", F.col("last").alias("content"))
    shapes = [F.to_json(F.struct(F.array(F.struct("role", F.lit("first").alias("content")), one).alias("messages"))), F.to_json(F.struct(F.array(one).alias("messages"), F.concat("last", F.lit("!")).alias("user_last_statement"))), F.concat(F.lit("say "), "last"), F.to_json(F.array("role")), F.to_json(F.struct("role"))]
    payload = F.coalesce(*[F.when(F.col("conv_id") % 5 == k, x) for k, x in enumerate(shapes)])
    return last.select("conv_id", t.search_text_of(payload).alias("text"))


def index_build(spark, sf_dir):
    """All documents cleared, cut, numbered and embedded: of each chunk its number, first word and length, and whether its vector has unit length."""
    built = retrieval.index_texts(documents(spark, sf_dir), "doc_id", "text")
    return built.select("doc_id", "chunk_id", "chunk_no", F.regexp_extract("chunk", "^[^ ]+", 0).alias("first_word"), F.length("chunk").alias("n_chars"), _unit())


def _unit() -> Column:
    norm = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x * x)
    return (F.abs(norm - 1) < 1e-3).alias("unit")


def index_update(spark, sf_dir):
    """A store of all documents after a second batch: every seventh text edited, every eleventh gone. The second batch runs twice."""
    docs, store = documents(spark, sf_dir).select("doc_id", "text"), new_path(spark, "store")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    retrieval.update_index(docs, "doc_id", "text", store, "a")
    for _ in range(2):
        kept = retrieval.update_index(edited, "doc_id", "text", store, "b")
    return kept.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.substring_index("chunk", " ", -1).alias("last_word"))


def mask_in_turn(spark, sf_dir):
    """Two maskers over every turn, with their mappings united: addresses, then order numbers."""
    texts = _turns(spark, sf_dir).select("conv_id", "turn", F.concat("text", F.lit(" ask a.b@c.org, ORDER-1234")).alias("text"))
    done = mask.mask_in_turn(texts, "text", [mask.masker([_RULE["EMAIL"]]), mask.masker([_RULE["ORDER_NUMBER"]])])
    return done.select("conv_id", "turn", F.right("text", F.lit(31)).alias("tail"), F.try_element_at("mappings", F.lit("{{EMAIL}}")).alias("email"), F.try_element_at("mappings", F.lit("{{ORDER_NUMBER}}")).alias("order_number"))


def findings_by_tag_lang(spark, sf_dir):
    """Findings of e-mail addresses and IPv4 addresses by tag and language."""
    found = mask.findings(mask.spread(documents(spark, sf_dir)), "text", ["lang"], [_RULE["EMAIL"], _RULE["IP"]])
    return found.groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))


#: Texts in which one rule meets what another would take, by o_orderkey % 10: how Spark and DuckDB spell them, and what all rules make of them.
_N = {w: number(7919, w) for w in (2, 3, 5)} | {"pesel": number(700123, 9), 9: REGON9, 10: NIP, 16: CARD}
_ORDER_TEXTS = [
    tuple(f"'pay ' || lpad(cast(o_orderkey % 24 as {k}), 2, '0') || '.' || lpad(cast(o_orderkey % 60 as {k}), 2, '0') || ' PLN'" for k in ("string", "varchar")),
    tuple(f"'+48' || {n}" for n in _N["pesel"]),
    tuple(f"'n: ' || {n} || '.'" for n in _N[9]),
    tuple(f"'vat: PL' || {n}" for n in _N[10]),
    tuple(f"'no: ' || {n}" for n in _N[10]),
    tuple(f"'INV-2023-' || {n}" for n in _N[5]),
    tuple(f"'FV/2023/' || {n}" for n in _N[5]),
    tuple(f"'ORDER-2023-' || {n}" for n in _N[3]),
    tuple(f"'c: ' || {n}" for n in _N[16]),
    tuple(f"'http://u' || cast(o_orderkey as {k}) || '@h.com'" for k in ("string", "varchar")),
]
_NIP_OK = f"({_sum(v.NIP_WEIGHTS, 'right(s, 10)')}) % 11 = cast(right(s, 1) as int)"
_PESEL_OK = f"(10 - ({_sum(v.PESEL_WEIGHTS, 'right(s, 11)')}) % 10) % 10 = cast(right(s, 1) as int)"
_REGON_OK = f"({_sum(v.REGON9_WEIGHTS, 'substr(s, 4, 9)')}) % 11 % 10 = cast(substr(s, 12, 1) as int)"
_PHONE_OK = "substr(s, 4, 2) in (" + ", ".join(f"'{p}'" for p in v.PHONE_PREFIXES) + ") or substr(s, 4, 3) = '800'"
_ORDER_MASKS = [
    "'pay {{TIME}} PLN'",
    f"case when {_PESEL_OK} then '+{{{{PESEL}}}}' else '{{{{PHONE_INTERNATIONAL}}}}' end",
    f"case when {_REGON_OK} then 'n: {{{{REGON}}}}.' when {_PHONE_OK} then 'n: {{{{PHONE}}}}.' else s end",
    f"case when {_NIP_OK} then 'vat: PL{{{{NIP}}}}' else 'vat: {{{{EU_VAT}}}}' end",
    f"case when {_NIP_OK} then 'no: {{{{NIP}}}}' else 'no: {{{{KRS}}}}' end",
    "'INV-2023-{{POSTAL_CODE}}'",
    "'{{INVOICE_NUMBER}}'",
    "'{{ORDER_NUMBER}}-' || right(s, 3)",
    f"case when {_luhn('right(s, 16)')} then 'c: {{{{CREDIT_CARD}}}}' else 'c: {{{{SSL_CERT}}}}' end",
    "'http://{{EMAIL}}'",
]


def _by_key(parts) -> str:
    return "case " + " ".join(f"when o_orderkey % {len(parts)} = {i} then {x}" for i, x in enumerate(parts)) + " end"


def mask_rule_order(spark, sf_dir):
    """All 33 rules over texts that more than one of them could take: the order of the rules decides."""
    texts = mask.spread(orders(spark, sf_dir)).select("o_orderkey", F.expr(_by_key([x for x, _ in _ORDER_TEXTS])).alias("s"))
    return mask.mask_text(texts, "s").select("o_orderkey", "s", "masked")


def _account(country: str, digits: str, size: int, k: int) -> str:
    """An account number with the right check digits for even keys: country, check digits, ``size`` digits. k: the dialect."""
    own, spelt = number(86028121, 12)[k], "".join(str(ord(c) - 55) for c in country)
    body = f"right({own} || {own}, {size})"
    whole = f"cast({body} || '{spelt}00' as {('decimal(38,0)', 'hugeint')[k]})"
    kind = ("string", "varchar")[k]
    return f"'{country}' || lpad(cast(98 - ({whole} % 97) - o_orderkey % 2 as {kind}), 2, '0') || {body}"


def _apart(text: str, by: str, k: int) -> str:
    return f"regexp_replace({text}, '(.{{4}})', '{('$1', chr(92) + '1')[k]}{by}'{', ' + chr(39) + 'g' + chr(39) if k else ''})"


_ACCOUNT_TEXTS = [
    [f"'iban ' || {_apart(_account('DE', '', 18, k), ' ', k)} || '.'", f"'iban ' || {_apart(_account('PL', '', 24, k), '-', k)}", f"'to ' || {_account('NO', '', 11, k)} || ' now'", f"'x: ' || substr({_account('PL', '', 24, k)}, 1, 4) || ' XXXX XXXX XXXX XXXX XXXX XXXX'", f"'cut ' || substr({_account('DE', '', 18, k)}, 1, 10) || chr(10) || substr({_account('DE', '', 18, k)}, 11)"]
    for k in (0, 1)
]


def mask_accounts(spark, sf_dir):
    """Account numbers of several countries: apart by blanks or hyphens, solid, masked by X, and cut by a line break; right check digits for even keys."""
    texts = orders(spark, sf_dir).select("o_orderkey", F.expr(_by_key(_ACCOUNT_TEXTS[0])).alias("s"))
    return texts.select("o_orderkey", "s", mask.apply_rule(F.col("s"), _RULE["BANK_ACCOUNT"]).alias("masked"))


def mask_full(spark, sf_dir):
    """All 33 rules over every document: masked text and number of findings."""
    return mask.mask_text(mask.spread(documents(spark, sf_dir).select("doc_id", "text")), "text").select("doc_id", "masked", F.size("findings").alias("n_findings"))


def mapping_dim(spark, sf_dir):
    """Pseudonyms of all that the whole catalogue finds."""
    found = mask.findings(mask.spread(documents(spark, sf_dir)), "text", ["doc_id"])
    return mapping.mapping_table(found)


def pseudonym_round_trip(spark, sf_dir):
    """E-mail addresses of all rows replaced by pseudonyms and put back by a join: equal to the text without the braces' trace."""
    hidden = mask.mask_text(documents(spark, sf_dir).select("doc_id", "text"), "text", [_RULE["EMAIL"]], mask.pseudonym("salt"))
    table = hidden.select(F.explode("findings").alias("f")).select(F.expr("substring(f.replacement, 2, length(f.replacement) - 2)").alias("pseudonym"), "f.original").distinct()
    back = mapping.restore(hidden, "masked", table, keep_braces=False)
    return back.select("doc_id", F.md5(F.col("restored").cast("binary")).alias("restored"), F.regexp_count("masked", F.lit(r"\{EMAIL_[g-v]{20}\}")).alias("n_hidden"))


def mapping_batches(spark, sf_dir):
    """Names of e-mail addresses kept over three batches: documents of even ids, all of them, and the first batch once more."""
    docs, store = documents(spark, sf_dir), new_path(spark, "names")
    for batch, rows in (("a", docs.where("doc_id % 2 = 0")), ("b", docs), ("a", docs.where("doc_id % 2 = 0"))):
        kept = mapping.get_or_create(mask.findings(mask.spread(rows), "text", ["doc_id"], [_RULE["EMAIL"]]), store, batch)
    return kept.select("original", "pseudonym", "tag", "number")


def mask_stored(spark, sf_dir):
    """Documents in a second batch under the names that a first batch of even ids and the batch itself gave: the names in each text, in order."""
    docs, store = documents(spark, sf_dir).select("doc_id", "text"), new_path(spark, "names")
    mapping.get_or_create(mask.findings(docs.where("doc_id % 2 = 0"), "text", ["doc_id"], [_RULE["EMAIL"]]), store, "a")
    out = mapping.mask_stored(docs, "text", store, "b", [_RULE["EMAIL"]])
    return out.select("doc_id", F.array_join(F.regexp_extract_all("masked", F.lit(r"\{(EMAIL_[0-9]+)\}")), "|").alias("names"), F.length("masked").alias("n_chars"))


def stream_pseudonyms(spark, sf_dir):
    """The documents as a stream, masked under names that are kept: the stream's rows put back by its mapping."""
    store, out = new_path(spark, "names"), new_path(spark, "stream")
    table = documents(spark, sf_dir).select("doc_id", "text")
    stream = spark.readStream.schema(documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    mask_with_store(stream, "text", store, out, new_path(spark, "offsets"), [_RULE["EMAIL"]]).awaitTermination()
    rows = read_batches(spark, out, f"{table.schema.simpleString()[7:-1].replace(':', ' ')}, masked string")
    back = mapping.restore(rows, "masked", mapping.kept_mapping(spark, store), keep_braces=False)
    return back.select("doc_id", F.md5(F.col("restored").cast("binary")).alias("restored"), F.regexp_count("masked", F.lit(r"\{EMAIL_[0-9]+\}")).alias("n_hidden"))


def mask_json_turns(spark, sf_dir):
    """Turns as JSON of a form that is not told, in three shapes, with a key that is data: e-mail addresses in every string of them masked."""
    named = F.to_json(F.create_map(F.concat(F.lit("u"), "turn", F.lit("@b.org")), F.col("text")))
    content = F.concat("text", F.lit(" ask a.b@c.org"))
    shapes = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("role", F.array(F.struct(content.alias("content"))).alias("parts")))).when(F.col("turn") % 3 == 1, named).otherwise(content)
    return mask.mask_free_json(_turns(spark, sf_dir).select("conv_id", "turn", shapes.alias("payload")), "payload", [_RULE["EMAIL"]])


def chunk_windows(spark, sf_dir):
    return retrieval.chunks(documents(spark, sf_dir), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_no").alias("last_chunk"))


def chunk_ids(spark, sf_dir):
    """First chunk number of every row in one numbering over all, and how many chunks it has."""
    return retrieval.number_chunks(documents(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("first").alias("first_id"), "chunks")


def topk_clustered(spark, sf_dir):
    """The ten nearest rows of every hundredth vector, from a clustered store that is searched without reading all of it."""
    base, store = embeddings(spark, sf_dir), new_path(spark, "clusters")
    clusters.write_clusters(base, store)
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found, _ = clusters.nearest_in_clusters(spark, store, queries)
    return found.select("query_id", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


def topk_inner_product(spark, sf_dir):
    """The ten nearest rows of every hundredth vector (ids divisible by 100), among all."""
    base = embeddings(spark, sf_dir)
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(base, queries).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def guard_rollup(spark, sf_dir):
    """Documents by the guard that blocks them: toxic ones first, then those of low quality."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = guard.guard(rows, [("toxic", F.col("toxic") == 0), ("quality", F.col("quality") == 1)])
    return judged.groupBy(F.coalesce("blocked_by", F.lit("none")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _judge() -> guard.Transport:
    """Stands in for two services: one takes no text with a word of 16 letters, the other none that ends without a point."""
    long = re.compile(r"[^\W\d_]{16}")

    def post(url: str, payload: dict) -> dict:
        safe = not long.search(payload["text"]) if url.endswith("words") else payload["text"].endswith(".")
        return {"results": {"safe": safe}, "message": f"{url} {len(payload['text'])}"}

    return post


_STAGES = [guard.Stage("words", guard.address("guards/", "/words")), guard.Stage("point", guard.address("guards", "point"))]


def guard_turns(spark, sf_dir):
    """Every turn judged by two services in turn, the second asked only about what the first lets pass."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct("text")).alias("payload"))
    return guard.remote_guards(rows, "payload", _STAGES, _judge).select("conv_id", "turn", "safe", "blocked_by", "message")


def guard_documents(spark, sf_dir):
    """Every document judged chunk by chunk."""
    return guard.guard_chunks(documents(spark, sf_dir).select("doc_id", "text"), "text", _STAGES[:1], _judge).select("doc_id", "safe", "blocked_by", "message", "n_chunks")


def terms_in_documents(spark, sf_dir):
    """In how many documents each word of three letters and more of the benchmark's items occurs, also inside of words."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"))).alias("term")).distinct()
    found = terms.terms_in(documents(spark, sf_dir).select("doc_id", "text"), "text", words)
    return found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def route_by_join(spark, sf_dir):
    """What the keywords and phrases of the routing catalogue give each turn by intent, with the catalogue as a table."""
    kinds = [(i.name, *t) for i in ROUTING.intents for t in [*((k, float(i.weights.get(k, 1))) for k in i.keywords), *map(route._weight, i.phrases)]]
    table = spark.createDataFrame(kinds, "intent string, term string, weight double")
    return terms.term_scores(_turns(spark, sf_dir).select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", table)


def mask_payload_turns(spark, sf_dir):
    """Turns as nested chat payloads, with e-mail addresses and orders' numbers masked in every string of them."""
    chats = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.concat("text", F.lit(" ask a.b@c.org, ORDER-1234")).alias("content")))).alias("messages"))
    return mask.mask_payload(chats, "messages", [_RULE["EMAIL"], _RULE["ORDER_NUMBER"]]).select("conv_id", F.to_json("messages").alias("payload"))


def inject_context(spark, sf_dir):
    """Every order's priority as a prompt, with two made-up chunks as context."""
    parts = F.array(F.concat(F.lit(" order "), F.col("o_orderkey").cast("string")), F.lit("second"))
    return orders(spark, sf_dir).select("o_orderkey", retrieval.with_context(F.col("o_orderpriority"), parts).alias("prompt"))


RULE_QUERIES, RULE_SQL = rule_queries({k: (text[1], sql) for k, (text, _, sql) in CHECKS.items()})
QUERIES: dict[str, Query] = {
    "findings_by_tag_lang": findings_by_tag_lang,
    **{k: _check(text[0], rule) for k, (text, rule, _) in CHECKS.items()},
    **{k: _mask(tag, text[0]) for k, (tag, text, _) in MASKS.items()},
    **{k: _detect(rule, text[0]) for k, (rule, text, _) in DETECTS.items()},
    "mask_email": lambda spark, sf_dir: mask.spread(documents(spark, sf_dir)).select("doc_id", mask.apply_rule(F.col("text"), _RULE["EMAIL"]).alias("masked")),
    "detect_ipv4": lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", F.array_join(mask.detect(F.col("text"), _RULE["IP"]), "|").alias("found")),
    "detect_card": lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", F.size(mask.detect(F.col("text"), _RULE["CREDIT_CARD"])).alias("n_cards")),
    "mask_full_placeholder": mask_full,
    "mask_rule_order": mask_rule_order,
    "mask_accounts": mask_accounts,
    "mask_payload_turns": mask_payload_turns,
    "mapping_dim": mapping_dim,
    "mapping_batches": mapping_batches,
    "mask_stored": mask_stored,
    "stream_pseudonyms": stream_pseudonyms,
    "mask_json_turns": mask_json_turns,
    "pseudonym_round_trip": pseudonym_round_trip,
    "estimate_tokens": lambda spark, sf_dir: _turns(spark, sf_dir).select("conv_id", "turn", t.estimate_tokens(F.col("text")).alias("tokens")),
    "complexity_level": lambda spark, sf_dir: _turns(spark, sf_dir).select("conv_id", "turn", route.complexity(F.col("text"), ROUTING).alias("level")),
    "intent_scores": intent_scores,
    "classify_intent": lambda spark, sf_dir: _turns(spark, sf_dir).select("conv_id", "turn", route.classify(F.col("text"), ROUTING).alias("intent")),
    "select_model": select_model,
    "route_model": route_model,
    "search_text": search_texts,
    "search_payloads": search_payloads,
    "index_build": index_build,
    "mask_in_turn": mask_in_turn,
    **RULE_QUERIES,
    "extract_user_text": last_statement,
    "clean_text": lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", t.clean_text(F.col("text")).alias("clean")),
    "chunk_windows": chunk_windows,
    "chunk_ids": chunk_ids,
    "topk_inner_product": topk_inner_product,
    "topk_clustered": topk_clustered,
    "index_update": index_update,
    "inject_context": inject_context,
    "guard_rollup_labels": guard_rollup,
    "guard_turns": guard_turns,
    "guard_documents": guard_documents,
    "terms_in_documents": terms_in_documents,
    "route_by_join": route_by_join,
}

#: Where the level of an intent's target stands among three models.
_AIM = {"simple": 0, "medium": 1, "complex": 2}
_PLACE = "case level when 'simple' then 0 when 'medium' then 1 else 2 end"
_HEAD_SQL = "'\n\n' || '" + retrieval.CONTEXT_HEAD + "\n    \n'"
_ADDRESS = r"regexp_extract_all(regexp_replace(text, '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?', '', 'g'), '\b(?:localhost|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4})(?::[0-9]{1,5})?\b')"
_OCTETS_OK = "not contains(string_split(x, ':')[1], '.') or len(list_filter(string_split(string_split(x, ':')[1], '.'), lambda o: cast(o as int) > 255)) = 0"
_MAILS = r"len(regexp_extract_all(text, '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?'))"
_CARD = r"regexp_extract_all(text, '\b(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})\b')"
_MAIL_LIST = r"regexp_extract_all(text, '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?')"
#: Addresses of even ids are numbered first, in order of code points, then the others.
_NAMES_SQL = f"with found as (select unnest({_MAIL_LIST}) as original, coalesce(doc_id % 2 <> 0, true) as later from documents), names as (select original, row_number() over (order by later, original) as number from (select original, min(later) as later from found group by 1))"
_SOLID_OK = _IBAN_SQL.replace("substr(s, 5) || substr(s, 1, 4)", "substr(x, 5) || substr(x, 1, 4)")
_is_account = lambda size, at: f"(select {_SOLID_OK} from (select substr(regexp_replace(s, '[ -]', '', 'g'), {at}, {size}) as x))"
_ACCOUNT_MASKS = [
    f"case when {_is_account(22, 5)} then 'iban {{{{BANK_ACCOUNT}}}}' || substr(s, 33) else s end",
    f"case when {_is_account(28, 5)} then 'iban {{{{BANK_ACCOUNT}}}}' || substr(s, 40) else s end",
    f"case when {_is_account(15, 3)} then 'to {{{{BANK_ACCOUNT}}}} now' else s end",
    "'x: {{BANK_ACCOUNT}}'",
    "s",
]
_JSON_SQL = r"select conv_id, turn, regexp_replace(case when turn % 3 = 0 then cast(to_json({'role': role, 'parts': [{'content': text || ' ask a.b@c.org'}]}) as varchar) when turn % 3 = 1 then cast(to_json(map {'u' || turn || '@b.org': text}) as varchar) else text || ' ask a.b@c.org' end, '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?', '{{EMAIL}}', 'g') as payload from conversations"
#: Chunks of 400 words every 300; rows are numbered in order of id and md5.
_CUT_SQL = r"with r as (select doc_id, text, regexp_extract_all(text, '[^ \t\n\r\f\v]+') as w from {rows}), doc_chunks as (select doc_id, w, coalesce(sum((len(w) + 299) // 300) over (order by doc_id nulls first, md5(coalesce(text, '')) rows between unbounded preceding and 1 preceding), 0) as first from r where text is not null), cut as (select *, cast(unnest(range((len(w) + 299) // 300)) as int) as no from doc_chunks) select doc_id, no as chunk_no, {columns} from cut as doc_chunks"
_TOPK_SQL = "select query_id, vec_id, rank from (select q.vec_id as query_id, b.vec_id as vec_id, row_number() over (partition by q.vec_id order by round(list_inner_product(cast(q.embedding as double[]), cast(b.embedding as double[])), 12) desc, b.vec_id) as rank from embeddings q, embeddings b where q.vec_id % 100 = 0) where rank <= 10"
SQL: dict[str, str] = {
    **RULE_SQL,
    "findings_by_tag_lang": f"select tag, lang, cast(sum(k) as bigint) as n from (select lang, 'EMAIL' as tag, {_MAILS} as k from documents union all select lang, 'IP', len(list_filter({_ADDRESS}, lambda x: {_OCTETS_OK})) from documents) where k > 0 group by tag, lang",
    "detect_ipv4": f"select doc_id, case when text is not null then coalesce(array_to_string(list_filter({_ADDRESS.replace(chr(95) + '?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+' + chr(92) + '.[A-Za-z]{2,}_?', chr(1))}, lambda x: {_OCTETS_OK}), '|'), '') end as found from documents",
    "detect_card": f"select doc_id, case when text is null then -1 else len(list_filter({_CARD}, lambda x: {_luhn("regexp_replace(x, '[ -]', '', 'g')").replace('lambda i:', 'lambda i:')} and len(regexp_replace(x, '[ -]', '', 'g')) between 13 and 19)) end as n_cards from documents",
    "mask_payload_turns": r"""select conv_id, to_json(list({'turn': turn, 'role': role, 'content': content} order by turn, role, content)) as payload from (select conv_id, turn, regexp_replace(role, '(?i)\b(ORD|ORDER)[-_]?[0-9]{3,10}\b', '{{ORDER_NUMBER}}', 'g') as role, regexp_replace(regexp_replace(text || ' ask a.b@c.org, ORDER-1234', '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?', '{{EMAIL}}', 'g'), '(?i)\b(ORD|ORDER)[-_]?[0-9]{3,10}\b', '{{ORDER_NUMBER}}', 'g') as content from conversations) group by conv_id""",
    "route_model": f"select conv_id, turn, case when turn % 3 = 2 then 'own' when turn % 5 = 4 or coalesce(text, '') = '' then 'small' else (['small', 'middle', 'large'])[1 + {{pick}}] end as model from (select *, {_LEVEL_SQL} as level from ({_CLASS_SQL}))",
    "search_text": "select conv_id, case when conv_id % 2 = 0 and coalesce(last, '') <> '' then last else nullif('m ' || last, '') end as text from (select conv_id, max_by(text, turn) as last from conversations group by conv_id)",
    "mask_in_turn": "select conv_id, turn, case when text is not null then 'ask {{EMAIL}}, {{ORDER_NUMBER}}' end as tail, case when text is not null then 'a.b@c.org' end as email, case when text is not null then 'ORDER-1234' end as order_number from conversations",
    "index_build": _CUT_SQL.format(rows="documents", columns="cast(doc_chunks.first + no as bigint) as chunk_id, w[1 + 300 * no] as first_word, cast(len(array_to_string(w[1 + 300 * no : 400 + 300 * no], ' ')) as int) as n_chars, true as unit"),
    "index_update": _CUT_SQL.format(rows="(select doc_id, case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then text || ' edited' else text end as text from documents)", columns="cast(len(array_to_string(w[1 + 300 * no : 400 + 300 * no], ' ')) as int) as n_chars, w[least(len(w), 400 + 300 * no)] as last_word"),
    **{k: _check_sql(text[1], rule) for k, (text, _, rule) in CHECKS.items()},
    **{k: f"select o_orderkey, regexp_replace({text[1]}, '{p}', '{{{{{tag}}}}}', 'g') as masked from orders" for k, (tag, text, p) in MASKS.items()},
    **{k: f"select o_orderkey, {rule} as found from (select o_orderkey, {text[1]} as s from orders)" for k, (_, text, rule) in DETECTS.items()},
    "mask_email": r"select doc_id, regexp_replace(text, '_?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}_?', '{{EMAIL}}', 'g') as masked from documents",
    "estimate_tokens": f"select conv_id, turn, cast(floor({WORDS_SQL} * 1.25) as int) as tokens from conversations",
    "complexity_level": f"select conv_id, turn, {_LEVEL_SQL} as level from conversations",
    "intent_scores": f"select * exclude (text) from ({_SCORES_SQL})",
    "classify_intent": f"select conv_id, turn, intent from ({_CLASS_SQL})",
    "select_model": f"select conv_id, turn, (['small', 'middle', 'large'])[1 + {{pick}}] as model from (select *, {_LEVEL_SQL} as level from ({_CLASS_SQL}))",
    "extract_user_text": "select conv_id, coalesce(nullif(max_by(text, turn), ''), '') as text from conversations group by conv_id",
    "clean_text": r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean from documents",
    "chunk_windows": f"select doc_id, cast(sum((n + 299) // 300) as bigint) as n_chunks, cast(max((n + 299) // 300) - 1 as int) as last_chunk from (select doc_id, {WORDS_SQL} as n from documents) where n > 0 group by doc_id",
    "chunk_ids": f"select doc_id, cast(coalesce(sum(chunks) over (order by doc_id nulls first, md5(coalesce(text, '')) rows between unbounded preceding and 1 preceding), 0) as bigint) as first_id, chunks from (select doc_id, text, cast(coalesce(({WORDS_SQL} + 299) // 300, 0) as bigint) as chunks from documents)",
    "topk_inner_product": _TOPK_SQL,
    "inject_context": f"select o_orderkey, o_orderpriority || {_HEAD_SQL} || 'order ' || cast(o_orderkey as varchar) || '\n\n\n\nsecond' as prompt from orders",
    "guard_turns": r"select conv_id, turn, blocked_by is null as safe, blocked_by, case when blocked_by is not null then 'guards/' || blocked_by || ' ' || len(text) end as message from (select *, case when regexp_matches(text, '[\p{L}]{16}') then 'words' when not ends_with(text, '.') then 'point' end as blocked_by from conversations)",
    "guard_documents": _CUT_SQL.replace(" select doc_id, no as chunk_no, {columns} from cut as doc_chunks", ", c as (select r, no, array_to_string(w[1 + 300 * no : 400 + 300 * no], ' ') as chunk from cut), j as (select r, count(*) as n, min(case when regexp_matches(chunk, '[\\p{{L}}]{{16}}') then {{'no': no, 'size': len(chunk)}} end) as f from c group by r) select doc_id, f is null as safe, case when f is not null then 'words' end as blocked_by, case when f is not null then 'guards/words ' || f.size end as message, coalesce(n, 0) as n_chunks from r left join j on r.r = j.r").replace("with r as (select doc_id,", "with r as (select row_number() over () as r, doc_id,").replace("doc_chunks as (select doc_id,", "doc_chunks as (select r, doc_id,").format(rows="documents"),
    "terms_in_documents": "select term, count(*) as n from (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) as term from benchmark) t join documents d on contains(d.text, t.term) group by term",
    "route_by_join": "select conv_id, turn, intent, cast(sum(weight) as double) as score from conversations, (values " + ", ".join(f"('{i.name}', '{k}', {w})" for i in ROUTING.intents for k, w in [*((k, float(i.weights.get(k, 1))) for k in i.keywords), *map(route._weight, i.phrases)]) + ") as t(intent, term, weight) where contains(lower(text), term) group by all",
    "guard_rollup_labels": "select case when toxic is null or toxic <> 0 then 'toxic' when quality is null or quality <> 1 then 'quality' else 'none' end as verdict, count(*) as n from labels group by 1",
    "pseudonym_round_trip": f"select doc_id, md5(text) as restored, cast({_MAILS} as int) as n_hidden from documents",
    "stream_pseudonyms": f"select doc_id, md5(text) as restored, cast({_MAILS} as int) as n_hidden from documents",
    "mapping_batches": f"{_NAMES_SQL} select original, 'EMAIL_' || number as pseudonym, 'EMAIL' as tag, number from names",
    "mask_stored": f"{_NAMES_SQL}, d as (select row_number() over () as r, doc_id, text, {_MAIL_LIST} as mails from documents), u as (select r, unnest(mails) as x, unnest(range(len(mails))) as i from d), j as (select r, string_agg('EMAIL_' || number, '|' order by i) as names, sum(len('{{EMAIL_' || number || '}}') - len(x)) as more from u join names on original = x group by r) select doc_id, case when text is not null then coalesce(j.names, '') end as names, cast(len(text) + coalesce(more, 0) as int) as n_chars from d left join j on d.r = j.r",
    "mask_json_turns": _JSON_SQL,
    "search_payloads": """select conv_id, case conv_id % 5 when 0 then last when 1 then last || '!' when 2 then 'say ' || last when 3 then '["' || role || '"]' end as text from (select conv_id, max_by(text, turn) as last, max_by(role, turn) as role from conversations group by conv_id)""",
    "mask_rule_order": f"select o_orderkey, s, {_by_key(_ORDER_MASKS)} as masked from (select o_orderkey, {_by_key([x for _, x in _ORDER_TEXTS])} as s from orders)",
    "mask_accounts": f"select o_orderkey, s, {_by_key(_ACCOUNT_MASKS)} as masked from (select o_orderkey, {_by_key(_ACCOUNT_TEXTS[1])} as s from orders)",
    "topk_clustered": _TOPK_SQL,
}
_PICK = "case intent " + " ".join(f"when '{i.name}' then greatest({_PLACE}, {_AIM[i.target]})" for i in ROUTING.intents if i.target) + f" else greatest(0, {_PLACE} - 1) end"
for _name in ("select_model", "route_model"):
    SQL[_name] = SQL[_name].replace("{pick}", _PICK)
