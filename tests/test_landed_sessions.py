"""Landed sessions: files by the number of sessions, and sessions of one id stay apart."""

import glob

from compare import assert_same, connect

from opsframe.plans import sources
from opsframe.plans.registry import CATALOG
from opsframe.session import shared_dir
from opsframe.sources import readers

BAD = ('{"session_id": "cu', '{"session_id": "typed", "start_time": "noon"}')


def _landed(spark):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/sessions-*"))


def _connect(tmp_path):
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return con


def test_a_table_of_sessions_lands_in_few_files(spark, tmp_path):
    rows = [(i % 590, f"a{i}\nb c \"{{}}\\ ],[\n") for i in range(600)]
    rows += [(None, "x\ny"), (None, "z"), (600, ""), (601, None)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = _landed(spark)
    entry = CATALOG["source_sessions"]
    df = entry.build(spark, str(tmp_path))
    assert assert_same(df, _connect(tmp_path), entry.sql) == 1803
    (folder,) = _landed(spark) - before
    assert len(glob.glob(f"{folder}/*/part-*")) == 2 + len(BAD)
    assert {r.text.strip() for r in readers.unreadable_sessions(spark, folder).collect()} == set(BAD)


def test_a_list_is_as_long_as_asked(spark, tmp_path):
    folder = str(tmp_path / "lists")
    df = spark.range(0, 21, 1, 3).selectExpr("cast(id AS string) AS session_id")
    sources._documents(df, folder, None, rows=4, broken=BAD)
    assert sorted(int(r.session_id) for r in readers.read_sessions(spark, folder).collect()) == list(range(21))
    assert len(glob.glob(f"{folder}/*/*.gz")) == 6
