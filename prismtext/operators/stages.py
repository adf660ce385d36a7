"""Masking and routing as stages of a Spark ML pipeline, which can be saved and loaded."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtext.operators import route
from prismtext.operators.mask import free, mask_text, placeholder, pseudonym
from prismtext.operators.rules import catalogue


class Masker(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Masks ``inputCol`` into ``outputCol``: all rules or those of some ``tags``, under placeholders or keyed names."""

    tags = Param(Params._dummy(), "tags", "tags of the rules, in any order; none means all", TypeConverters.toListString)
    named = Param(Params._dummy(), "named", "write keyed names instead of placeholders", TypeConverters.toBoolean)
    salt = Param(Params._dummy(), "salt", "key of the names", TypeConverters.toString)
    compat = Param(Params._dummy(), "compat", "keep the known peculiarities of the checks", TypeConverters.toBoolean)
    findingsCol = Param(Params._dummy(), "findingsCol", "a column for the findings, if wanted", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="masked", tags=(), named=False, salt="", compat=True, findingsCol=""):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="masked", tags=[], named=False, salt="", compat=True, findingsCol="")
        self._set(**{k: list(v) if k == "tags" else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = lambda p: self.getOrDefault(p)
        unknown = set(get(self.tags)) - {r.tag for r in catalogue()}
        if unknown:
            raise ValueError(f"no rule has the tag {sorted(unknown)}")
        rules = [r for r in catalogue(get(self.compat)) if not get(self.tags) or r.tag in get(self.tags)]
        found = get(self.findingsCol) or free([*dataset.columns, self.getOutputCol()], "findings")[0]
        name = pseudonym(get(self.salt)) if get(self.named) else placeholder
        out = mask_text(dataset, self.getInputCol(), rules, name, get(self.compat), (self.getOutputCol(), found))
        return out if get(self.findingsCol) else out.drop(found)


class Router(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses a model for each text by a catalogue of intents, kept as JSON text: ``outputCol`` is the model's name."""

    intents = Param(Params._dummy(), "intents", "the catalogue as JSON text, as route.load_routing takes it", TypeConverters.toString)
    models = Param(Params._dummy(), "models", "the models, smallest first", TypeConverters.toListString)
    askedCol = Param(Params._dummy(), "askedCol", "a column with the model asked for, if any; 'auto' leaves it to the routing", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="model", intents="{}", models=(), askedCol=""):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="model", intents="{}", models=[], askedCol="")
        self._set(**{k: list(v) if k == "models" else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        import json

        routing = route.load_routing(json.loads(self.getOrDefault(self.intents)), self.getOrDefault(self.models))
        asked = F.col(self.getOrDefault(self.askedCol)) if self.getOrDefault(self.askedCol) else F.lit("auto")
        return dataset.withColumn(self.getOutputCol(), route.route(asked, F.col(self.getInputCol()), routing))
