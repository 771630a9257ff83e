"""Records of symbols and chunks, whose rows come from costly reading of files."""

import pytest

from codeloom.functions import embedding

ROWS = [("a.py", "function", "run", None, "def run():\n    return 1", 1, 2, "x"), ("b.py", "class", "C", None, "class C:\n    pass", 1, 2, "x"), ("b.py", "method", "run", "C", "def run(self): pass", 4, 5, "y")]


@pytest.mark.parametrize("records", [embedding.symbol_summaries, embedding.chunk_records])
def test_rows_are_made_once(spark, tmp_path, records):
    log = f"{tmp_path}/log"

    def run(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("r" * len(batch))
            yield batch

    rows = spark.createDataFrame(ROWS, "path string, kind string, name string, class_name string, source string, start_line int, end_line int, content string")
    got = records(rows.mapInArrow(run, rows.schema), "r", 16).collect()
    assert len(got) == 3 and all(len(r.vec) == 16 for r in got)
    with open(log) as f:
        assert f.read() == "rrr"
