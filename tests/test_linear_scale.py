"""The linear family's passes over few columns against the whole design matrix."""

import numpy as np
from pyspark.sql import functions as F
from test_scale import made

from quotelens.operators import enrich as EN
from quotelens.operators import linear as LN


def test_a_task_makes_the_same_matrix_from_few_columns(spark):
    q = EN.enriched_from_tables(*made(spark)).where("fold is not null")
    dsg, names = LN.design(q)
    assert names == LN.design_names()
    want = dsg.select("quote_id", "inner", *[LN._safe(n) for n in names]).toPandas()
    got = LN.compact(q, F.col("quote_id"), LN.inner_fold().alias("inner")).toPandas()
    rows = ["quote_id", "inner"]
    a = LN.expand({c: got[c].to_numpy(float) for c in got.columns if c not in ("quote_id", "inner", "fold")}, names).T
    b = want[[LN._safe(n) for n in names]].to_numpy(float)
    a, b = a[got.sort_values([*rows, "y_price"]).index], b[want.sort_values([*rows, LN._safe("y_price")]).index]
    assert len(a) > 300 and np.isnan(b).any() and np.array_equal(a, b, equal_nan=True)


def test_linear_fits_write_no_row(spark, monkeypatch):
    from quotelens.operators import stage
    q = EN.enriched_from_tables(*made(spark)).dropna()
    written = []
    monkeypatch.setattr(stage, "write_stage", lambda df, name="stage": written.append(name) or df)
    assert len(LN.fit_linear(q, ("M1", "M4"))) == 12 and "design" not in written
