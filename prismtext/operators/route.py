"""Choosing a model for a text: intent by weighted terms, complexity by length, both as native columns."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prismtext.functions.text import estimate_tokens
from prismtext.functions.validators import let


@dataclass(frozen=True)
class Intent:
    """Terms of an intent: keywords (weight 1 or as given), phrases ("text:weight", 2 without one), patterns (3 each)."""

    name: str
    keywords: Sequence[str] = ()
    phrases: Sequence[str] = ()
    patterns: Sequence[str] = ()
    weights: dict[str, float] = field(default_factory=dict)
    target: str = ""


@dataclass(frozen=True)
class Routing:
    intents: Sequence[Intent]
    models: Sequence[str]
    default_models: dict[str, str] = field(default_factory=dict)
    simple: int = 25
    medium: int = 150


def _weight(phrase: str) -> tuple[str, float]:
    text, colon, weight = phrase.rpartition(":")
    return (text.strip().lower(), float(weight)) if colon else (phrase.lower(), 2.0)


def usable(pattern: str) -> bool:
    """Is this an expression that Spark can match by? Others count for nothing instead of failing the job."""
    session = SparkSession.getActiveSession()
    try:
        if session is None:
            re.compile(pattern)
        else:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?U){pattern}")
    except (re.error, Py4JJavaError, PySparkException):
        return False
    return True


def score(text: Column, intent: Intent, compat: bool = True) -> Column:
    """Sum of the weights of the terms that occur in the lowered text, each once.

    With ``compat`` a keyword is compared as given, so one with capitals never occurs in a lowered text; without it
    keywords are lowered too.
    """
    terms = [(k if compat else k.lower(), float(intent.weights.get(k, 1))) for k in intent.keywords] + [_weight(p) for p in intent.phrases]
    points = [F.when(F.contains(text, F.lit(t)), w).otherwise(0.0) for t, w in terms]
    points += [F.when(F.regexp_like(text, F.lit(f"(?U){p}")), 3.0).otherwise(0.0) for p in intent.patterns if usable(p)]
    # Summing an array keeps the expression flat, however many terms there are.
    return F.aggregate(F.array(*points), F.lit(0.0), lambda a, x: a + x) if points else F.lit(0.0)


def scores(text: Column, routing: Routing) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return let(lowered, lambda t: F.array(*[F.struct(score(t, i).alias("score"), F.lit(-k).alias("place"), F.lit(i.name).alias("intent")) for k, i in enumerate(routing.intents)]))


def classify(text: Column, routing: Routing) -> Column:
    """The intent of the highest score; of equals the first; ``none`` if nothing scores."""
    return let(F.array_max(scores(text, routing)), lambda best: F.when(best["score"] > 0, best["intent"]).otherwise("none"))


def complexity(text: Column, routing: Routing) -> Column:
    n = estimate_tokens(F.coalesce(text, F.lit("")))
    return F.when(n <= routing.simple, "simple").when(n <= routing.medium, "medium").otherwise("complex")


def _level(target: str, models: Sequence[str], defaults: dict[str, str]) -> int:
    """Where a level's model stands, counted from the end of the list; by the level's usual place if it is not there."""
    if defaults.get(target) in models:
        return max(i for i, m in enumerate(models) if m == defaults[target])
    return {"simple": 0, "medium": len(models) // 2}.get(target, len(models) - 1)


def select_model(intent: Column, level: Column, routing: Routing) -> Column:
    """The stronger of what complexity and intent ask for; without an intent one step below the complexity's model."""
    n = len(routing.models)
    base = F.when(level == "simple", 0).when(level == "medium", n // 2).otherwise(n - 1)
    aims = [(i.name, _level(i.target, routing.models, routing.default_models)) for i in routing.intents if i.target]
    aim = F.coalesce(*[F.when(intent == name, place) for name, place in aims]) if aims else F.lit(None).cast("int")
    place = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.when(aim.isNotNull(), F.greatest(base, aim)).otherwise(base - 1)))
    return F.element_at(F.array(*[F.lit(m) for m in routing.models]), place + 1)


def route(model: Column, text: Column, routing: Routing) -> Column:
    """The model to use: as asked for unless ``auto``; for ``auto`` without text the simple one."""
    simple = routing.default_models.get("simple", routing.models[0])
    picked = select_model(classify(text, routing), complexity(text, routing), routing)
    return F.when(model == "auto", F.when(F.coalesce(text, F.lit("")) == "", simple).otherwise(picked)).otherwise(model)


def load_routing(settings: dict, models: Sequence[str], overrides: dict[str, str] | None = None) -> Routing:
    """A routing from the parsed JSON catalogue.

    ``overrides``: thresholds ("25|150"; malformed ones are ignored), models
    ("a|b"), default_model, and intent_<name> ("x|y:4"), which replaces the
    intent's terms: entries with a colon are phrases, the others keywords.
    """
    given = {k.lower(): v for k, v in (overrides or {}).items()}
    own = settings["settings"]
    limits = own["len_thresholds_max"]
    simple, medium = limits["simple"], limits["medium"]
    first, bar, second = given.get("thresholds", "").partition("|")
    if bar and first.strip().isdigit() and second.strip().isdigit():
        simple, medium = int(first), int(second)
    intents = []
    for name, terms in settings["intents"].items():
        if new := given.get(f"intent_{name}"):
            entries = [e.strip() for e in new.split("|") if e.strip()]
            terms = {"keywords": [e for e in entries if ":" not in e], "phrases": [e for e in entries if ":" in e]}
        target = own["intent_adjustment"].get(name, "")
        intents.append(Intent(name, terms.get("keywords", ()), terms.get("phrases", ()), terms.get("patterns", ()), terms.get("weights", {}), target))
    defaults = dict(own["default_models"])
    if given.get("default_model"):
        defaults["simple"] = given["default_model"]
    return Routing(intents, [m for m in given.get("models", "").split("|") if m] or list(models), defaults, simple, medium)


def read_routing(spark: SparkSession, path: str, models: Sequence[str], overrides: dict[str, str] | None = None) -> Routing:
    """A routing from a JSON catalogue in any store that Spark reads; see ``load_routing``."""
    return load_routing(json.loads(spark.read.text(path, wholetext=True).first()[0]), models, overrides)
