"""Models.  Fitted numbers are not SQL-expressible, so these
register without oracle text (rows-only check); tests compare them with
planted-signal data and with Spark ML's own solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import features as FT
from quarry.operators import models as M
from quarry.operators import svm as S
from quarry.plans.registry import query
from quarry.sources.tables import Tables

_X = ["l_quantity", "l_discount", "l_tax"]


def _lineitem(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", *_X,
                     (F.col("l_returnflag") == "R").cast("int").alias("is_r"))


@query("ml_ols", section="2.12")
def ml_ols(spark, sf_dir):
    return M.ols(_lineitem(spark, sf_dir), "l_extendedprice", _X)


@query("ml_ols_by_group", section="2.12")
def ml_ols_by_group(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return M.ols_by(li, "l_extendedprice", _X, ["l_returnflag"])


@query("ml_vif", section="2.12")
def ml_vif(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return M.vif(li, _X + ["l_linenumber", "l_extendedprice"])


@query("ml_logit", section="2.12")
def ml_logit(spark, sf_dir):
    return M.logit(_lineitem(spark, sf_dir), "is_r", _X)


@query("ml_step_aic", section="2.12")
def ml_step_aic(spark, sf_dir):
    return M.step_aic(_lineitem(spark, sf_dir), "l_extendedprice", _X + ["l_linenumber"], "gaussian")


@query("ml_backward_eliminate", section="2.12")
def ml_backward_eliminate(spark, sf_dir):
    return M.backward_eliminate(_lineitem(spark, sf_dir), "l_extendedprice", _X + ["l_linenumber"],
                                "gaussian", max_vif=2.0, max_p=0.05)


@query("ml_step_aic_binomial", section="2.12")
def ml_step_aic_binomial(spark, sf_dir):
    return M.step_aic(_lineitem(spark, sf_dir), "is_r", _X, "binomial")


@query("ml_backward_eliminate_binomial", section="2.12")
def ml_backward_eliminate_binomial(spark, sf_dir):
    return M.backward_eliminate(_lineitem(spark, sf_dir), "is_r", _X, "binomial", max_vif=2.0, max_p=0.05)


def _split_lineitem(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        "l_extendedprice", *_X, (F.col("l_returnflag") == "R").cast("int").alias("is_r"))
    # model fits read their input many times: materialise it once (lineage cut)
    return FT.random_split(li, 0.7, "row_key", seed=100).checkpoint(eager=True)


@query("ml_predict_r2", section="2.12")
def ml_predict_r2(spark, sf_dir):
    s = _split_lineitem(spark, sf_dir)
    model = M.ols_spark_ml(s.where("split = 'train'"), "l_extendedprice", _X)
    scored = M.predict(model, s.where("split = 'test'"), _X, "yhat")
    return M.r2_holdout(scored, "l_extendedprice", "yhat")


@query("ml_predict_prob", section="2.12")
def ml_predict_prob(spark, sf_dir):
    s = _split_lineitem(spark, sf_dir)
    model = M._glm(s.where("split = 'train'"), "is_r", _X)
    return M.predict_prob(model, s.where("split = 'test'"), _X, "prob").select("row_key", "is_r", "prob")


def _digits(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("label").cast("double").alias("label"), "embedding")
    return FT.stratified_split(e, "label", 0.7, "vec_id", seed=1).checkpoint(eager=True)


@query("ml_linear_svm_multi", section="2.12")
def ml_linear_svm_multi(spark, sf_dir):
    d = _digits(spark, sf_dir)
    model = S.svm_pairs(d.where("split = 'train'"), "label", "embedding")
    return model.predict(d.where("split = 'test'"), "embedding").select("vec_id", "label", "prediction")


@query("ml_rff_svm", section="2.12")
def ml_rff_svm(spark, sf_dir):
    d = M.rff(_digits(spark, sf_dir), "embedding", dim=256, sigma=1.0, seed=7)
    d = M.to_vector(d, "rff").checkpoint(eager=True)
    model = M.svm_multi(d.where("split = 'train'"), "label", max_iter=50)
    return model.transform(d.where("split = 'test'")).select("vec_id", "label", "prediction")


@query("ml_grid_cv", section="2.12")
def ml_grid_cv(spark, sf_dir):
    train = _digits(spark, sf_dir).where("split = 'train'")
    return S.grid_cv(train, "label", "embedding", "vec_id", sigmas=[0.5, 1.0, 2.0], costs=[0.1, 1.0, 10.0], folds=3)
