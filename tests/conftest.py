import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clickspark.session import local_session
    s = local_session(4, shuffle_partitions=8, driver_memory="4g", app="clickspark-tests")
    yield s
    s.stop()


RAW_COLS = ["event_time", "event_type", "product_id", "category_id", "category_code", "brand",
            "price", "user_id", "user_session"]


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc)


@pytest.fixture()
def make_events(spark):
    """Build a cleaned event frame from short tuples
    (user, time, type[, product[, price[, brand[, category]]]])."""
    from clickspark.operators.cleaning import clean_events
    from clickspark.schema import RAW_EVENT_SCHEMA

    def make(rows, clean=True):
        out = []
        for r in rows:
            u, t, e = r[0], r[1], r[2]
            p = r[3] if len(r) > 3 else 1
            price = r[4] if len(r) > 4 else 10.0
            brand = r[5] if len(r) > 5 else "b"
            cat = r[6] if len(r) > 6 else "c"
            out.append((ts(t), e, p, 1, cat, brand, price, u, str(u)))
        df = spark.createDataFrame(out, RAW_EVENT_SCHEMA)
        return clean_events(df) if clean else df
    return make
