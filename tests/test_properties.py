"""Property: the number of input partitions does not change any result."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dispatchlens.operators import clean as CL
from dispatchlens.operators import features as FE
from dispatchlens.operators import reports as R
from dispatchlens.plans.catalog import finalize
from dispatchlens.sources import fixtures as FX

from .conftest import SF_SMALL

_BASE = {}


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def _reports(raw):
    clean = CL.clean_incidents(raw)
    return (_rows(finalize(R.borough_summary(clean))),
            _rows(finalize(R.histogram(clean))),
            _rows(finalize(FE.fit_lookups(clean).long_form)))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.integers(min_value=1, max_value=9))
def test_partitioning_does_not_change_results(spark, parts):
    raw = FX.incidents_events(spark, SF_SMALL)
    if "base" not in _BASE:
        _BASE["base"] = _reports(raw)
    assert _reports(raw.repartition(parts)) == _BASE["base"]
