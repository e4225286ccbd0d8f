"""Accents are stripped in Python only where a text has other than ASCII characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstat.operators import pairs


def test_ascii_texts_stay_out_of_python(spark, monkeypatch):
    sent = []
    real = F.pandas_udf
    monkeypatch.setattr(pairs.F, "pandas_udf", lambda f, t: lambda c: sent.append(c) or real(f, t)(c))
    texts = ["plain text\nof two lines", "Élan vital", "naïve\n", "", None, "ﬁ ligature", "日本", "tab\tand \x00 nul", "trailing\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = df.select("id", pairs.strip_accents(F.col("t")).alias("s"), "t")
    assert [r.s for r in out.orderBy("id").collect()] == ["plain text\nof two lines", "Elan vital", "naive\n", "", None, "ﬁ ligature", "日本", "tab\tand \x00 nul", "trailing\n"]
    # what goes to Python is null for ASCII
    assert [r[0] for r in df.orderBy("id").select(sent[0]).collect()] == [None, "Élan vital", "naïve\n", None, None, "ﬁ ligature", "日本", None, None]
