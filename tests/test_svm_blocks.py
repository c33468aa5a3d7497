"""M6: many small blocks still close the gap, whatever the order of the rows."""

import numpy as np

from test_svm import data, frame

from threadlens.operators import svm


def test_blocks_close_the_gap_on_rows_in_order_of_their_label(spark):
    x, y = data(400, 10)
    order = np.argsort(y, kind="stable")
    fit = svm.fit_linear(frame(spark, x[order], y[order]).coalesce(1), "features", "label", block_rows=100)
    assert fit.gap <= 1e-3 and fit.rounds <= 30
