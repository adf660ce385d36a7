"""Pipeline stages: saved, loaded and equal to the functions they stand for."""

import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from prismtext.operators import mask, route
from prismtext.operators.rules import RULES
from prismtext.operators.stages import Masker, Router
from prismtext.queries import CATALOGUE


def test_stages_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([("auto", "write code: a@b.org ORDER-123456"), ("own", "c@d.org"), ("auto", None), ("auto", "")], "asked string, text string")
    stages = [Masker(tags=["EMAIL", "ORDER_NUMBER"], findingsCol="found"), Masker(inputCol="text", outputCol="hidden", tags=["EMAIL"], named=True, salt="s"), Router(inputCol="masked", intents=json.dumps(CATALOGUE), models=["small", "middle", "large"], askedCol="asked")]
    Pipeline(stages=stages).fit(rows).write().overwrite().save(str(tmp_path / "p"))
    out = PipelineModel.load(str(tmp_path / "p")).transform(rows)
    assert out.columns == ["asked", "text", "masked", "found", "hidden", "model"]
    email = [r for r in RULES if r.tag == "EMAIL"]
    plain = mask.mask_text(rows, "text", [r for r in RULES if r.tag in ("EMAIL", "ORDER_NUMBER")], names=("masked", "found"))
    plain = mask.mask_text(plain, "text", email, mask.pseudonym("s"), names=("hidden", "f")).drop("f")
    plain = plain.withColumn("model", route.route(F.col("asked"), F.col("masked"), route.load_routing(CATALOGUE, ["small", "middle", "large"])))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))


def test_stages_refuse_what_they_do_not_know(spark):
    rows = spark.createDataFrame([("x", "y")], "text string, masked string")
    with pytest.raises(ValueError, match="NO_SUCH"):
        Masker(tags=["NO_SUCH"]).transform(rows)
    with pytest.raises(ValueError, match="masked"):
        Masker(tags=["EMAIL"]).transform(rows)
    assert Masker(tags=["EMAIL"], outputCol="m").transform(rows).columns == ["text", "masked", "m"]
