"""Readers and writers of landed files."""

import glob

from pyspark.sql import functions as F

from opsframe import schemas
from opsframe.sources import readers, sinks


def test_metric_csv_round_trip(spark, tmp_path):
    rows = [(i, "n.p", "container_network_receive_bytes_total.eth0" if i % 2 else "container_memory_rss", i / 8) for i in range(40)]
    table = spark.createDataFrame(rows, schemas.KPI_TABLE)
    folder = str(tmp_path / "m")
    sinks.write_metrics(table, folder, "csv")
    sinks.write_metrics(table.withColumn("timestamp", F.col("timestamp") + 100), folder, "csv")
    assert len(glob.glob(folder + "/kpi=*")) == 2
    back = readers.read_metrics_csv(spark, folder + "/kpi=*")
    assert sorted(map(tuple, back.collect()))[:40] == rows and back.count() == 80
    for path in glob.glob(folder + "/kpi=*/*.csv"):
        with open(path) as text:
            times = [int(line.split(",")[0]) for line in text.read().splitlines()[1:]]
        assert times == sorted(times)


def test_span_csv_round_trip(spark, tmp_path):
    rows = [("t", "a", "ROOT", "geo", "op", 5, 6, True, "5xx")]
    sinks.write_spans(spark.createDataFrame(rows, schemas.SPAN_TABLE), str(tmp_path / "s"), "csv")
    assert [tuple(r) for r in readers.read_traces_csv(spark, str(tmp_path / "s")).collect()] == rows


def test_slices(spark, tmp_path):
    logs = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_100).alias("ts"), "id")
    for per, count in (("day", 1), ("slice", 20)):
        folder = str(tmp_path / per)
        sinks.write_logs_sliced(logs, folder, folder_per=per)
        assert len(glob.glob(f"{folder}/slice_*")) == count
        back = sinks.read_logs_sliced(spark, folder)
        assert back.count() == 100 and back.select("slice_start").distinct().count() == 20


def test_session_results_layout(spark, tmp_path):
    rows = [("1", "a", "org/m", 1.0), ("2", "b", "org/x/m", 2.0)]
    folder = str(tmp_path / "r")
    sinks.write_session_results(spark.createDataFrame(rows, "session_id STRING, agent STRING, model STRING, score DOUBLE"), folder)
    assert sorted(p[len(folder) + 1:] for p in glob.glob(folder + "/*/*")) == ["agent=a/model_safe=org_m", "agent=b/model_safe=org_x_m"]


def test_cluster_trace_files(spark, tmp_path):
    (tmp_path / "pai_job_table.csv").write_text("job_name,inst_id,user,status,start_time,end_time\nbert_train_1,i1,alice,Terminated,1,9\n")
    for name, file in readers.GPU_TRACE_FILES.items():
        if name != "job":
            header = ",".join(c.strip().split(" ")[0].strip("`") for c in schemas.GPU_TRACE[name].split(","))
            (tmp_path / file).write_text(header + "\n")
    tables = readers.read_gpu_trace(spark, str(tmp_path))
    assert set(tables) == set(schemas.GPU_TRACE)
    assert [tuple(r) for r in tables["job"].collect()] == [("bert_train_1", "i1", "alice", "Terminated", 1.0, 9.0)]
    assert tables["group_tag"].count() == 0 and "group" in tables["group_tag"].columns


def test_metric_dump_file(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"metric": {"__name__": "up", "pod": "p"}, "values": [[1700000000.781, "0.5"], [1700000015, "NaN"]]}\n')
    rows = readers.read_metric_dump(spark, str(tmp_path)).select("metric", "pod", F.unix_seconds("ts"), "value").collect()
    assert rows[0] == ("up", "p", 1700000000, 0.5) and str(rows[1][3]) == "nan"
