import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from phraseforge.session import get_session

    # spark.checkpoint.dir is read from the session; phraseforge.session.checkpoint_dir
    # creates a scratch folder only when it is unset (local runs)
    s = get_session("local[4]", shuffle_partitions=4, app_name="phraseforge-tests",
                    extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


def tagged_docs(spark, texts: dict):
    """Documents of ``word_TAG`` text -> parsed tokens."""
    from phraseforge.operators.tokens import parse_tagged

    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    return parse_tagged(df)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
