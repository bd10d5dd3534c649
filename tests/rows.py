from tidemark.schema import FACT

DEFAULT = {"created_ms": 0, "received_ms": 0, "seq": 0, "bid": "", "kind": "page_load", "source": "https://a.com", "is_unique_user": False, "is_unique_page": False}


def frame(spark, *rows):
    """Fact rows from dicts; seq counts up where it is not given."""
    full = [{f.name: None for f in FACT} | DEFAULT | {"seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in FACT) for r in full], FACT)


def load(ms, unique=False, source="https://a.com", **more):
    return {"received_ms": ms, "is_unique_user": unique, "is_unique_page": unique, "pathname": "/home", "ua_browser": "Chrome", "ua_version": "120.0", "bid": "b", "source": source} | more


def exc(ms, group="g", source="https://a.com", **more):
    return {"received_ms": ms, "kind": "exception", "exc_group": group, "source": source, "exc_type": "TypeError", "exc_message": "boom", "exc_handled": False} | more


def custom(ms, name, sid=None, **more):
    return {"received_ms": ms, "kind": "custom", "event_name": name, "sid": sid, "bid": "b"} | more
