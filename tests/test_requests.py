"""Request bodies."""

from querywarden.functions import rules as R
from querywarden.sources import requests as RQ


def test_request_bodies(spark):
    bodies = [
        (1, '{"query": "hello", "categories": "news"}'),
        (2, '{"query": "hello"}'),
        (3, "{}"),
        (4, "not json"),
        (5, "[1, 2]"),
        (6, '"text"'),
        (7, '{"k": 1}'),
        (8, '{"query": "' + "x" * (R.MAX_BODY_BYTES) + '"}'),
        (9, ""),
        (10, None),
        (11, '{"query": "a"} x'),
        (12, '{"query": "a"}{"query": "b"}'),
        (13, '{"query": "a"},0]'),
        (14, '{"query": "a"},{"query": "b"}'),
        (15, '{"query": "a"}]'),
        (16, ' {"query": "x]y", "l": [1, [2]]} '),
    ]
    df = spark.createDataFrame(bodies, "id long, body string")
    got = {r.id: (r.status, r.raw, r.categories) for r in RQ.parse_requests(df).collect()}
    assert got[1] == (200, "hello", "news")
    assert got[2] == (200, "hello", "general")
    assert got[3][0] == 400 and got[4][0] == 400 and got[5][0] == 400 and got[6][0] == 400
    assert got[7] == (200, "", "general")
    assert got[8][0] == 413
    assert got[9][0] == 400 and got[10][0] == 400
    assert all(got[i][0] == 400 for i in range(11, 16))
    assert got[16] == (200, "x]y", "general")
