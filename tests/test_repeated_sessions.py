"""Sessions of one id are one session, as in the SQL counterparts, which group by it."""

import pytest
from compare import assert_same, connect

from opsframe.plans import catalog  # noqa: F401
from opsframe.plans.registry import CATALOG

# Texts of an id differ in no turn that they share: an ORDER BY of turns leaves nothing open.
ROWS = [(1, "a\nb\nc"), (1, "a"), (1, "a\nb"), (2, "x\ny"), (2, "x\ny"), (3, "one\ntwo\nthree"), (4, "p\nq\nr"), (4, "p\nq\nr\ns"),
        (5, "\n".join(f"{i}" * 301 for i in range(9))), (None, "n\nm"), (None, "n\nm"), (None, "n"), (6, "t"), (6, ""), (6, None)]


@pytest.mark.parametrize("name", ["judge_requests", "session_render", "session_service_view", "session_tail_summary"])
def test_an_id_gives_one_row(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, "doc_id LONG, text STRING").repartition(4).write.parquet(path)
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert assert_same(CATALOG[name].build(spark, str(tmp_path)), con, CATALOG[name].sql) == 7


@pytest.mark.parametrize("name", ["judge_requests", "session_render", "session_service_view", "session_tail_summary"])
def test_a_repeated_id_without_messages_is_kept_once(spark, tmp_path, name):
    rows = [(1, ""), (1, None), (2, None), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in CATALOG[name].build(spark, str(tmp_path)).collect()]
    assert sorted(r[0] for r in found) == ["1", "2", "3"] and len({r[1:] for r in found}) == 1
