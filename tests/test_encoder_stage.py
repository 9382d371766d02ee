"""The encoder as a stage: fitted, saved and loaded without its classes passing the driver."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from retention.functions import constants as K
from retention.operators import encode as EN
from retention.operators.encoder_stage import CategoryEncoder, CategoryEncoderModel
from retention.plans.prepare import prepare


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_saved_stage_encodes_as_the_state(spark, tmp_out):
    p = prepare(spark, SF_SMALL)
    fitted = Pipeline(stages=[CategoryEncoder()]).fit(p.features.where("split = 'train'"))
    fitted.write().overwrite().save(tmp_out + "/enc")
    want = _rows(EN.encode(p.features, p.encoder).select("customerID", *K.CATEGORICAL))
    for stage in (fitted, PipelineModel.load(tmp_out + "/enc")):
        assert _rows(stage.transform(p.features).select("customerID", *K.CATEGORICAL)) == want


def test_ranges_number_classes_as_one_window_does(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "x"), ("\u00e9", "y"), ("B", ""), ("b", "x")], "p string, q string")
    for rows in (df, df.limit(0), df.select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("p"), "q")):
        assert _rows(EN.encoder_table_by_ranges(rows, ["p", "q"])) == _rows(EN.encoder_table(rows, ["p", "q"]))


@pytest.mark.parametrize("null_as, missing", [("nan", 2), ("first", 0)])
def test_missing_and_unseen_values(spark, tmp_out, null_as, missing):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    model = CategoryEncoder(inputCols=["p", "absent"], nullAs=null_as).fit(df)
    model.save(tmp_out + "/m")
    back = CategoryEncoderModel.load(tmp_out + "/m")
    assert back.uid == model.uid and back.getOrDefault(back.nullAs) == null_as
    new = spark.createDataFrame([("b", 1), (None, 2), ("zz", 3)], "p string, value int")
    assert [tuple(r) for r in back.transform(new).orderBy("value").collect()] == [(1, 1), (missing, 2), (0, 3)]


def test_a_stage_without_classes_round_trips(spark, tmp_out):
    CategoryEncoderModel(inputCols=["p"]).save(tmp_out + "/m")
    df = spark.createDataFrame([("a",)], "p string")
    assert CategoryEncoderModel.load(tmp_out + "/m").transform(df).collect() == df.collect()


def test_a_million_classes_stay_in_tables(spark, tmp_out):
    df = spark.range(1_000_000).select(F.format_string("v%07d", "id").alias("p"), F.col("id").cast("int").alias("want"))
    CategoryEncoder(inputCols=["p"]).fit(df).save(tmp_out + "/m")
    back = CategoryEncoderModel.load(tmp_out + "/m")
    assert back.state().codes == {} and list(back.state().tables) == ["p"]
    assert back.transform(df).agg(F.count("*"), F.sum((F.col("p") != F.col("want")).cast("int"))).first()[:] == (1_000_000, 0)
