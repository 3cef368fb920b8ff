"""Request intake (S1-S3): body size guard, JSON check, field defaults.

Order: a body over the size limit is rejected (413) before it is parsed; a
body that is not JSON, not an object, or an empty object is rejected (400);
otherwise ``query`` defaults to "" and ``categories`` to "general".
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import rules as R

# request bodies derived from ``events`` (valid, empty, broken, oversized)
REQUEST_BODY_SQL = """case when event_id % 97 = 0 then repeat('x', 17000)
 when event_id % 97 = 1 then '{"query": "a"} x'
 when event_id % 97 = 2 then '{"query": "a"}{"query": "b"}'
 when event_id % 97 = 3 then '{"query": "a"},0]'
 when event_id % 97 = 4 then '{"query": "list]", "categories": "news", "more": [1, {"k": "]"}]}'
 when event_id % 5 = 0 then props
 when event_id % 5 = 1 then '{}'
 when event_id % 5 = 2 then 'not json'
 when event_id % 5 = 3 then '{"query": "' || cast(user_id as string) || ' weather", "categories": "news"}'
 else '{"query": " user ' || cast(user_id as string) || ' schedule "}' end"""


@F.pandas_udf(ST.BooleanType())
def _strict(bodies: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        try:
            json.loads(b)
            return True
        except ValueError:
            return False
    return bodies.map(one)


def one_json_value(b: Column) -> Column:
    """Whether the text is one JSON value and nothing else.

    Spark's JSON functions stop at the end of the first value. Put into a
    list before another element, a text that goes on makes the list longer
    or breaks it. Only a text with a ``]`` could close that list itself;
    those few are parsed strictly.
    """
    listed = F.json_array_length(F.concat(F.lit("["), b, F.lit(",0]"))) == 2
    return F.coalesce(listed, F.lit(False)) & F.coalesce(_strict(F.when(b.contains("]"), b)), F.lit(True))


def parse_requests(df: DataFrame, body: str = "body",
                   max_bytes: int = R.MAX_BODY_BYTES) -> DataFrame:
    """Adds ``status`` (413 / 400 / 200), ``raw`` and ``categories``."""
    b = F.col(body)
    too_big = F.octet_length(b) > max_bytes
    keys = F.json_object_keys(b)  # null unless the body is a JSON object
    bad = keys.isNull() | (F.size(keys) == 0) | ~one_json_value(b)
    status = F.when(too_big, F.lit(413)).when(bad, F.lit(400)).otherwise(F.lit(200))
    ok = status == 200
    return df.withColumns({
        "status": status,
        "raw": F.when(ok, F.coalesce(F.get_json_object(b, "$.query"), F.lit(""))),
        "categories": F.when(ok, F.coalesce(F.get_json_object(b, "$.categories"),
                                            F.lit("general"))),
    })
