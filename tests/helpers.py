"""Small helpers shared by the tests."""

import datetime
import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def normalized(frame):
    """Rows of a pandas frame with columns by name, sorted, numbers as floats."""
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def approx_rows(frame, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in map(tuple, frame.collect()))
