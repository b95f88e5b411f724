"""Landed trace responses: more rows make more documents, not larger ones."""

import glob
import gzip
import json
import os
from collections import Counter

from compare import SF_DIR

from opsframe.operators import traces
from opsframe.plans import sources
from opsframe.plans.adapters import raw_traces
from opsframe.sources import readers


def test_documents_have_a_bounded_number_of_rows(spark, tmp_path):
    folder = str(tmp_path / "dump")
    raw = raw_traces(spark, SF_DIR).limit(500).repartition(3)
    raw = raw.unionByName(raw.limit(1))
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    sources._documents(raw, folder, "data", rows=8, broken=('{"data": [{"tr',))
    sizes = [len(json.loads(gzip.open(f, "rt").read())["data"]) for f in glob.glob(f"{folder}/*/*.gz")]
    assert sum(sizes) == 501 and max(sizes) == 8
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(traces.flatten_spans(readers.read_trace_dump(spark, folder))) == rows(traces.flatten_spans(raw))
    assert readers.rejected_trace_dump(spark, folder).count() == 1
    assert not [f for f in glob.glob(f"{folder}/*/*.txt") if os.path.getsize(f) > 100]
