"""Every engine query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evispark.functions import redaction
from evispark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = got.toPandas()
    assert len(got.columns) == len(set(got.columns))
    assert len(found) > 0
    if name not in SQL:
        return
    expected = duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_redaction_of_every_document(spark, tmp_path):
    shown = {
        "secret: abc, then": "secret=[REDACTED], then",
        "PASSWORD='a b' in it": "PASSWORD=[REDACTED] in it",
        'api_key="q r"; api-key = z': "api_key=[REDACTED]; api-key=[REDACTED]",
        "Authorization: Basic dXNlcg== and more": "Authorization: [REDACTED]",
        "it said bearer abc.def and more": "it said Bearer [REDACTED]",
        "go to mongodb+srv://user:pass@host.net now": "go to mongodb+srv:[path-redacted]",
        "the key sk-abcdefgh12 leaks": "the key [REDACTED] leaks",
        "see /usr/local/bin/x now": "see [path-redacted]",
        "in 'C:\\work\\a.txt' now": "in '[path-redacted]' now",
        "token = [REDACTED]": "token = [REDACTED]",
        "tokens and a/b stay": "tokens and a/b stay",
        "": "",
        None: None,
    }
    rows = [(i, t) for i, t in enumerate(shown)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in QUERIES["redaction_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: shown[t] for i, t in rows}
    alone = spark.createDataFrame([("at mongodb+srv://user:pass@host.net now",)], "t string").select(redaction.without_secrets(F.col("t")).alias("t"))
    assert alone.first().t == "at mongodb+srv://[REDACTED]@host.net now"


def test_climbing_paths_and_public_text(spark):
    shown = {
        "could not read src/../../etc/shadow: denied": "could not read [path-redacted]: denied",
        "cannot OPEN my files/../x.ts, sorry": "cannot OPEN [path-redacted], sorry",
        "loading of my own dir/../up failed; next": "loading [path-redacted]; next",
        "cause: our notes/../b.md. Then more": "cause: [path-redacted]. Then more",
        "../up/file.ts is out": "[path-redacted]",
        "(../up/file.ts) is out": "([path-redacted]) is out",
        'in "a b/../c d" and "../e"': 'in "[path-redacted]" and "[path-redacted]"',
        "a/..\\b.ts]: no": "[path-redacted]]: no",
        "wait... what, no path": "wait... what, no path",
        "a..b and 1/2 stay": "a..b and 1/2 stay",
        "//host/share name/x: gone": "[path-redacted]: gone",
        "C:\\a b\\c.txt. End": "[path-redacted]. End",
        "at /a/b:12:3 now": "at [path-redacted]",
        "/ends here /and there": "[path-redacted]",
    }
    rows = spark.createDataFrame([(k,) for k in shown], "t string").select("t", redaction.redacted(F.col("t")).alias("once")).withColumn("twice", redaction.redacted(F.col("once"))).collect()
    assert {r.t: r.once for r in rows} == shown
    assert all(r.once == r.twice for r in rows)
    long = spark.createDataFrame([("token: a\nb\tc\x7fd",), ("é" * 4000,), ("\U0001f600" * 9000,), ("",), (None,)], "t string")
    first, *cut, empty, none = [r.t for r in long.select(redaction.public_text(F.col("t")).alias("t")).collect()]
    assert first == "token=[REDACTED] b c d" and empty == "" and none is None
    assert all(2040 < len(t.encode()) <= 2048 and t.endswith("... [truncated]") and "\ufffd" not in t for t in cut)
