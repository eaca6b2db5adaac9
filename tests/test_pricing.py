"""How the product of positions and scenarios is run: over positions that are read once."""

from conftest import MEDIUM

from quillrisk.operators import portfolio
from quillrisk.plans import models as M


def test_pricing_reads_positions_once(spark):
    book = M.positions(spark, MEDIUM)
    priced = portfolio.revalue(book, M.scenarios(spark), M.BBB_BP)
    assert priced.rdd.getNumPartitions() == book.rdd.getNumPartitions()
