"""The oracle SQL needs no file outside the repository: neither a jar nor a JVM."""
import builtins
import os
import zipfile

import pyspark

from quarry.functions import stopwords
from quarry.plans import catalog


def test_oracles_build_without_the_spark_jars(monkeypatch):
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    real_open = builtins.open

    def guarded(path, *a, **k):
        assert not str(path).startswith(jars), path
        return real_open(path, *a, **k)

    def no_zip(*a, **k):
        raise FileNotFoundError("jar folder hidden")

    monkeypatch.setattr(builtins, "open", guarded)
    monkeypatch.setattr(zipfile, "ZipFile", no_zip)
    oracles = catalog.oracle_sql()
    assert len(oracles) >= 49
    assert all(isinstance(v, str) and v.strip() for v in oracles.values())
    assert set(oracles) <= set(catalog.queries())


def test_stop_list_is_the_public_one(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert stopwords.english() == list(StopWordsRemover.loadDefaultStopWords("english"))
