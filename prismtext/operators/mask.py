"""Masking as one native expression: a fold of the rules over a text, in order.

Each rule marks its candidates in the text, the marks split it, and the odd
parts are checked and replaced. All of this runs in the JVM: no Python worker.

A null stays null with no findings; a text that is one mask already stays as
it is. The non-character U+FDD0 marks candidates; should a text hold it, it
becomes U+FFFD.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtext.functions.validators import let, valid_port, whole
from prismtext.operators.rules import IBAN, RULES, Rule
from prismtext.storage import stored

MARK, PORT = "\ufdd0", "\ufdd1"
MASKED = r"\{[A-Z_]+_\d+(?:_\d+)?\}"
FINDING = "struct<tag:string,original:string,replacement:string,rule:int,ord:int>"
#: A piece of a text: what stands there, and for a value found its tag and the value as recorded.
PIECE = "struct<text:string,tag:string,original:string>"


def placeholder(tag: Column, original: Column) -> Column:
    """``{{TAG}}`` whatever the value."""
    return F.concat(F.lit("{{"), tag, F.lit("}}"))


#: Such names bring no digit, @ or address into a text, so what a text lacks at first it lacks throughout.
placeholder.plain = True


def pseudonym(salt: str = "") -> Callable[[Column, Column], Column]:
    """``{TAG_letters}`` from a keyed hash: equal values get equal names in every task and run.

    The letters g to v spell the hash, so that no later rule takes it for a number.
    """

    def name(tag: Column, original: Column) -> Column:
        spelt = F.translate(F.substring(F.sha2(F.concat(F.lit(salt + "\x1f"), original), 256), 1, 20), "0123456789abcdef", "ghijklmnopqrstuv")
        return F.concat(F.lit("{"), tag, F.lit("_"), spelt, F.lit("}"))

    name.plain = True
    return name


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files make fewer tasks than there are cores: masking is work, reading is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _piece(text: Column, tag: str | None = None, original: Column | None = None, hit: Column | None = None) -> Column:
    found = F.lit(tag).cast("string") if hit is None else F.when(hit, F.lit(tag))
    value = F.lit(None).cast("string") if original is None else original
    return F.struct(text.alias("text"), found.alias("tag"), value.alias("original"))


def _plain(rule: Rule, text: Column) -> Column:
    marked = F.regexp_replace(text, rule.pattern, f"$1{MARK}$2{MARK}$3" if rule.grouped else f"{MARK}$0{MARK}")

    def piece(c: Column, i: Column) -> Column:
        hit = i % 2 == 1
        return _piece(c, rule.tag, rule.record(c), hit if rule.valid is None else hit & rule.valid(c))

    return F.transform(F.split(marked, MARK, -1), piece)


def _address(rule: Rule, text: Column, compat: bool) -> Column:
    """Address and port are two values. With ``compat`` an address of bad octets loses its port, as it always did."""
    marked = F.regexp_replace(text, rule.pattern, f"{MARK}$1{PORT}$2{MARK}")

    def pieces(c: Column, i: Column) -> Column:
        host, port = F.substring_index(c, PORT, 1), F.substring_index(c, PORT, -1)
        bad = host.contains(".") & ~rule.valid(host)
        plain = _piece(F.concat(host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port))))
        return (
            F.when(i % 2 == 0, F.array(_piece(c)))
            .when(bad, F.array(_piece(host) if compat else plain))
            .when(port == "", F.array(_piece(host, "IP", host)))
            .when(valid_port(port), F.array(_piece(host, "IP", host), _piece(F.lit(":")), _piece(port, "PORT", port)))
            .otherwise(F.array(plain))
        )

    return F.flatten(F.transform(F.split(marked, MARK, -1), pieces))


def _account(rule: Rule, text: Column) -> Column:
    """Candidates may overlap: one that fails its check gives way to the next that begins inside it.

    The text is cut at every candidate's beginning; no candidate reaches over
    more than 17 of these parts, for each holds two letters at least.
    """
    cut = F.split(F.regexp_replace(text, f"(?iU)(?={IBAN})", MARK), MARK, -1)
    state = f"struct<pieces:array<{PIECE}>,skip:int>"

    def seen(parts: Column) -> Column:
        reach = lambda i: F.regexp_extract(F.array_join(F.slice(parts, i + 1, 17), ""), rf"\A{rule.pattern}", 0)
        return F.transform(parts, lambda c, i: F.struct(c.alias("c"), F.when(i > 0, reach(i)).otherwise("").alias("at")))

    def step(s: Column, x: Column) -> Column:
        c, at = x["c"], x["at"]
        size, reach = F.length(c), F.length(at)
        hit = (s["skip"] == 0) & (at != "") & rule.valid(at)
        found = F.array(_piece(at, rule.tag, at), _piece(F.substring(c, reach + 1, size)))
        added = F.when(hit, found).otherwise(F.array(_piece(F.substring(c, s["skip"] + 1, size))))
        skip = F.greatest(F.lit(0), F.when(hit, reach).otherwise(s["skip"]) - size)
        return F.struct(F.concat(s["pieces"], added).alias("pieces"), skip.alias("skip")).cast(state)

    start = F.struct(F.array().cast(f"array<{PIECE}>").alias("pieces"), F.lit(0).alias("skip")).cast(state)
    return let(cut, lambda parts: F.aggregate(seen(parts), start, step, lambda s: s["pieces"]))


def _pieces(rule: Rule, text: Column, compat: bool, digits: Column | None = None) -> Column:
    """The text cut into pieces by one rule; null where the rule has no candidate.

    With the text's number of digits the rule's gate is asked before its pattern.
    """
    if rule.kind == "address":
        cut = _address(rule, text, compat)
    else:
        cut = _account(rule, text) if rule.kind == "account" else _plain(rule, text)
    hit = F.regexp_like(text, F.lit(rule.pattern))
    return F.when(hit if digits is None or rule.gate is None else rule.gate(text, digits) & hit, cut)


def _joined(pieces: Column, name: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.when(p["tag"].isNull(), p["text"]).otherwise(name(p["tag"], p["original"]))), "")


def _unmarked(text: Column) -> Column:
    return F.translate(text, MARK + PORT, "\ufffd\ufffd")


def free(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each lengthened until no column (in whatever case) and no earlier one is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mask_text(
    df: DataFrame, text: str, rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder, compat: bool = True, names: tuple[str, str] = ("masked", "findings")
) -> DataFrame:
    """``df`` with masked and findings for a text column; findings in the order in which the rules met them.

    No rules, or an empty list, means the whole catalogue. Every rule is a
    projection of its own, so the analysis stays short with 33 of them. A
    column of ``df`` that is already called like one of ``names`` is refused;
    any other name is left alone.
    """
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"the table has columns called {sorted(clash)}; choose other names")
    left, hits, cut, count = free([*df.columns, *names], "text_left", "found", "pieces", "digits")
    done = F.coalesce(whole(F.col(text), MASKED), F.lit(True))
    out = df.withColumns({left: F.when(~done, _unmarked(F.col(text))), hits: F.array().cast(f"array<{FINDING}>")})
    digits = None
    if getattr(name, "plain", False):
        out, digits = out.withColumn(count, F.regexp_count(left, F.lit(r"(?U)\d"))), F.col(count)
    for k, rule in enumerate(rules or RULES):
        out = out.withColumn(cut, _pieces(rule, F.col(left), compat, digits))
        new = F.transform(
            F.filter(cut, lambda p: p["tag"].isNotNull()),
            lambda p, i: F.struct(p["tag"].alias("tag"), p["original"].alias("original"), name(p["tag"], p["original"]).alias("replacement"), F.lit(k).alias("rule"), i.alias("ord")),
        )
        found = F.when(F.col(cut).isNull(), F.col(hits)).otherwise(F.concat(hits, new))
        out = out.withColumns({left: F.coalesce(_joined(F.col(cut), name), F.col(left)), hits: found})
    return out.withColumns({names[0]: F.coalesce(left, text), names[1]: F.col(hits)}).drop(left, hits, cut, count)


def apply_rule(text: Column, rule: Rule, name: Callable[[Column, Column], Column] = placeholder, compat: bool = True) -> Column:
    """The text masked by one rule, as an expression."""
    free = ~F.coalesce(whole(text, MASKED), F.lit(True))
    return F.when(free, let(_unmarked(text), lambda t: F.coalesce(_joined(_pieces(rule, t, compat), name), t))).otherwise(text)


def detect(text: Column, rule: Rule, compat: bool = True) -> Column:
    """The values that one rule finds in a text, as recorded; null for null."""
    hits = F.filter(_pieces(rule, _unmarked(text), compat), lambda p: p["tag"].isNotNull())
    return F.when(text.isNotNull(), F.coalesce(F.transform(hits, lambda p: p["original"]), F.array().cast("array<string>")))


def walk(value: Column, kind: T.DataType, do: Callable[[Column], Column]) -> Column:
    """``do`` on every string below ``value``: list elements, struct fields, keys and values of maps. Other types stay."""
    if isinstance(kind, T.StringType):
        return do(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: walk(x, kind.elementType, do))
    if isinstance(kind, T.MapType):
        # Of keys that become equal the last one wins.
        entries = F.transform(F.map_entries(value), lambda e: F.struct(walk(e["key"], kind.keyType, do).alias("key"), walk(e["value"], kind.valueType, do).alias("value")))
        last = let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])))
        return F.map_from_entries(last)
    if isinstance(kind, T.StructType):
        fields = F.struct(*[walk(value[f.name], f.dataType, do).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    return value


def mask_payload(df: DataFrame, column: str, rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder, compat: bool = True) -> DataFrame:
    """``df`` with a nested column masked: rule by rule over all strings in it, which equals string by string over all rules."""
    kind = df.schema[column].dataType
    for rule in rules or RULES:
        df = df.withColumn(column, walk(F.col(column), kind, partial(apply_rule, rule=rule, name=name, compat=compat)))
    return df


def mask_json(df: DataFrame, column: str, schema: T.DataType, rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder) -> DataFrame:
    """A column of JSON texts of known form, masked. Give free-form objects a map type: their keys are data and are masked too."""
    parsed = df.withColumn(column, F.from_json(column, schema))
    return mask_payload(parsed, column, rules, name).withColumn(column, F.to_json(column))


def findings(df: DataFrame, text: str, keys: Sequence[str], rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder) -> DataFrame:
    """One row per finding: the keys, tag, original, replacement, rule, ord.

    A plain explode lets the optimizer ask for a non-empty list below all rules,
    and so work them all out twice; an outer one keeps empty lists until here.
    """
    own, masked, found = free(keys, "text", "masked", "findings")
    rows = mask_text(df.select(*keys, F.col(text).alias(own)), own, rules, name, names=(masked, found)).select(*keys, F.explode_outer(found).alias("f"))
    return rows.where(F.col("f.tag").isNotNull()).select(*keys, "f.*")


def masker(rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder, compat: bool = True) -> Callable[[DataFrame, str], DataFrame]:
    """A stage for ``mask_in_turn``: the rules, with the values they found as mappings (replacement to original)."""

    def stage(df: DataFrame, text: str) -> DataFrame:
        masked, found = free(df.columns, "masked", "findings")
        out = mask_text(df, text, rules, name, compat, (masked, found))
        pairs = F.transform(found, lambda f: F.struct(f["replacement"].alias("key"), f["original"].alias("value")))
        last = let(pairs, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])))
        return out.withColumn(text, F.col(masked)).withColumn("mappings", F.map_from_entries(last)).drop(masked, found)

    return stage


def mask_in_turn(df: DataFrame, text: str, stages: Sequence[Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Several maskers one after the other over a text column; ``mappings`` unites theirs, of equal keys the last wins.

    A stage takes (df, text) and gives ``df`` with the text masked and a map ``mappings``.
    """
    if "mappings" in {c.lower() for c in df.columns}:
        raise ValueError("the table has a column called mappings")
    kind, (united,) = "map<string,string>", free([*df.columns, "mappings"], "united")
    out = df.withColumn(united, F.create_map().cast(kind))
    for stage in stages:
        out = stage(out, text)
        new = F.coalesce(F.col("mappings"), F.create_map().cast(kind))
        kept = F.map_filter(united, lambda k, v: ~F.map_contains_key(new, k))
        out = out.withColumn(united, F.map_concat(kept, new)).drop("mappings")
    return out.withColumnRenamed(united, "mappings")


#: A string of a JSON text, with its quotes. Possessive, so that a long one takes no stack.
LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _dictionary(rows: DataFrame, mark: str, strings: Column, names: str, rules: Sequence[Rule] | None, name: Callable[[Column, Column], Column], compat: bool) -> DataFrame:
    """mark, names: for each value of ``mark`` a map of those of its strings that masking changes. Each distinct string is masked once."""
    asked = stored(rows.select(F.col(mark).alias("mark"), F.explode(F.array_distinct(strings)).alias("string")).distinct(), "strings")
    masked = mask_text(spread(asked.select("string").distinct()), "string", rules, name, compat).select("string", "masked")
    changed = stored(masked, "masked").where("masked <> string")
    return asked.join(changed, "string").groupBy(F.col("mark").alias(mark)).agg(F.map_from_entries(F.collect_list(F.struct("string", "masked"))).alias(names))


def mask_free_json(df: DataFrame, column: str, rules: Sequence[Rule] | None = None, name: Callable[[Column, Column], Column] = placeholder, compat: bool = True) -> DataFrame:
    """A column of JSON texts of any form, masked: every string at every depth, keys too; all else stays as it is written.

    A JSON text's strings can be told without its structure: a text is split at
    them, and joined again with those that masking changes replaced. There is
    no recursion over nodes, and depth does not matter. Strings are masked once
    each, however many rows hold them, and come back under the text's hash, so
    rows need no key. Where a key was masked, keys of an object may have become
    equal: such a text goes through a VARIANT, which keeps the last of them (and sorts keys). This asks for
    ``spark.sql.variant.allowDuplicateKeys``, which is set in the session.

    A text that is no JSON is masked as one string; null stays null.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    mark, cut, strings, names = free(df.columns, "mark", "cut", "strings", "names")
    clean = _unmarked(F.col(column))
    pieces = F.split(F.regexp_replace(clean, LITERAL, f"{MARK}$0{MARK}"), MARK, -1)
    out = df.withColumns({mark: F.sha2(column, 256), cut: F.when(F.try_parse_json(column).isNotNull(), pieces)})
    own = F.from_json(F.concat(F.lit("["), F.array_join(F.filter(cut, lambda p, i: i % 2 == 1), ","), F.lit("]")), "array<string>")
    out = out.withColumn(strings, F.when(F.col(cut).isNull(), F.array(clean)).otherwise(own))
    found = _dictionary(out.where(F.col(column).isNotNull()), mark, F.col(strings), names, rules, name, compat)
    out = out.join(found, mark, "left")

    new = F.transform(strings, lambda x: F.try_element_at(F.col(names), x))
    spelt = F.transform(new, lambda x: F.to_json(F.array(x)))
    literals = F.filter(cut, lambda p, i: i % 2 == 1)
    put = F.zip_with(F.zip_with(new, spelt, lambda n, x: F.when(n.isNotNull(), F.substring(x, F.lit(2), F.length(x) - 2))), literals, lambda n, x: F.coalesce(n, x))
    between = F.filter(cut, lambda p, i: i % 2 == 0)
    joined = F.array_join(F.zip_with(between, put, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    # What follows a string tells whether it is a key.
    renamed = F.exists(F.zip_with(new, F.slice(between, F.lit(2), F.size(between)), lambda n, p: n.isNotNull() & F.regexp_like(p, F.lit(r"\A\s*:"))), lambda x: x)
    united = F.when(renamed, F.to_json(F.parse_json(joined))).otherwise(joined)
    done = F.when(F.col(names).isNull(), F.col(column)).when(F.col(cut).isNull(), F.get(new, F.lit(0))).otherwise(united)
    return out.withColumn(column, done).select(*df.columns)
