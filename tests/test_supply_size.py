"""What the queries over all order lines shuffle, and lines that do not fit the packed form."""

import datetime

import pytest

from factloom.queries import queries
from factloom.sources import supply

#: Bytes of shuffle a line: some 60 with key columns; ids of 64 digits in a shuffle take several hundred.
A_LINE = 150


def shuffled(spark, run):
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = total()
    run().write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name", ["whole_controller_repository", "whole_forbidden_first_match", "whole_layer_all", "whole_component_cycle", "whole_edge_facts", "whole_module_boundary", "whole_policy_denied", "whole_forbidden_coordinate_ga", "whole_forbidden_package", "whole_forbidden_coordinate_gav", "whole_layer_reverse", "whole_policy_all", "whole_cycle_members"])
def test_lines_meet_by_small_keys(spark, sf, name):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert shuffled(spark, lambda: queries()[name](spark, sf)) < A_LINE * n


def test_lines_of_any_values_come_back_whole(spark):
    day = datetime.datetime(1998, 9, 29)
    rows = [
        (1, 2, 3, 4, 10.25, day), (None, 2, 3, 4, 10.25, day), (1, None, None, None, None, None), (1, 2, 1 << 22, 4, 10.25, day), (-1, -2, -3, 4, 10.25, day),
        (1, 2, 3, 8, 10.25, day), (1, 2, 3, 4, 10.2512, day), (1, 2, 3, 4, 1e6, day), (1 << 40, 1 << 40, 3, 7, 0.0, datetime.datetime(1901, 1, 1)), (1, 2, 3, 4, 10.25, day.replace(hour=5)), (1, 2, (1 << 22) - 1, 7, 167772.15, datetime.datetime(2059, 9, 18)),
    ]
    made = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz")
    plain = supply.numbered(made)
    cols = list(supply._LINE)
    assert sorted(map(str, supply._met(plain, "l_orderkey").select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
