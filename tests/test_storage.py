"""What queries leave in the shared folder."""

import os

import pytest

from tessera import catalog
from tessera.storage import scratch, settled, shared_folder

FOLDER = "/root/testdata/sf0.001"


def files(uri):
    return [f for _, _, names in os.walk(uri.removeprefix("file://")) for f in names]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", ["k01_lexical_top100", "g03_shortest_distance", "s13_upsert", "s11_symbol_index"])
def test_a_querys_tables_go_when_its_result_is_read(spark, name):
    outer = shared_folder(spark)
    with scratch(spark) as own:
        rows = catalog.QUERIES[name](spark, FOLDER).collect()
        assert rows and files(own)
    assert not os.path.exists(own.removeprefix("file://")) and shared_folder(spark) == outer
    with scratch(spark):  # nothing of the folder that is gone is used again
        assert len(catalog.QUERIES[name](spark, FOLDER).collect()) == len(rows)


def test_tables_go_after_an_error_and_inner_scratches_first(spark):
    outer = shared_folder(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark) as a:
        settled(spark.range(3), "t")
        with scratch(spark) as b:
            settled(spark.range(3), "t")
        assert b.startswith(a) and not os.path.exists(b.removeprefix("file://")) and files(a)
        raise ZeroDivisionError
    assert not os.path.exists(a.removeprefix("file://")) and shared_folder(spark) == outer
