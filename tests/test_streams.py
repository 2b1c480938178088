"""Streams give the same rows however the input is sliced."""

import pytest

from attestry.catalog import streams
from attestry.catalog.registry import ORACLES
from attestry.fixtures import Ledger
from tests.oracle_check import connect


@pytest.mark.parametrize("slices", [1, 12])
def test_silences_do_not_depend_on_the_slices(spark, folder, slices):
    got = streams.t4(Ledger.at(spark, folder), slices)
    want = connect(folder).execute(ORACLES["t4_silence_stream"]).fetchall()
    assert sorted(map(tuple, got.select("ie_id", "last_ts", "threshold_s").collect())) == sorted(want)
