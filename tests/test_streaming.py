"""Stream-static scoring and windowed KPIs agree with the batch operators."""

import os

from pyspark.sql import functions as F

from dispatchlens import config as C
from dispatchlens.operators import clean as CL
from dispatchlens.operators import features as FE
from dispatchlens.plans import catalog as K
from dispatchlens.sources import fixtures as FX
from dispatchlens.streaming import scoring as ST

from .conftest import SF_SMALL


def test_stream_scoring_matches_batch(spark, tmp_dir):
    raw = FX.incidents_events(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "incoming")
    raw.repartition(3).write.parquet(src)
    lookups = FE.fit_lookups(K.events_clean(spark, SF_SMALL))
    stream = ST.read_incident_stream(spark, src, raw.schema, max_files_per_trigger=1)
    scored = ST.score_stream(stream, lookups)
    q = (scored.select(C.KEY, "Borough_TargetEnc", C.TARGET).writeStream.format("memory")
               .queryName("scored_incidents").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_incidents")
    batch = CL.clean_incidents(raw)
    assert got.count() == batch.count()

    kpi = ST.borough_kpi_stream(CL.clean_incidents(ST.read_incident_stream(spark, src, raw.schema)),
                                window="1 day", watermark="1 day")
    q2 = kpi.writeStream.format("memory").queryName("borough_kpis").outputMode("complete").start()
    q2.processAllAvailable()
    q2.stop()
    total = spark.sql("SELECT sum(cases) FROM borough_kpis").first()[0]
    assert total == batch.count()
