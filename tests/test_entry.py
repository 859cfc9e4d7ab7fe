import subprocess
import sys

import __spark_entry__
from tracklake.plans import queries


def test_every_query_runs_with_a_stable_schema(spark):
    for name, f in queries.QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert len(set(df.columns)) == len(df.columns), name
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_training_data_package():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tracklake.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'mota_per_frame' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0], timeout=120)
