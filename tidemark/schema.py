"""The fact table, the small tables beside it, and the fixed limits."""

from __future__ import annotations

from pyspark.sql import types as T

_FIELDS = (
    "created_ms:long! received_ms:long! seq:long! bid:string! sid:string kind:string! source:string! pathname:string is_unique_user:boolean! is_unique_page:boolean! "
    "referrer_host:string referrer_group:string country:string language:string ua_browser:string ua_version:string ua_os:string ua_device:string "
    "utm_source:string utm_medium:string utm_campaign:string duration_ms:long event_name:string metadata_json:string app_version:string "
    "exc_type:string exc_message:string exc_stack:string exc_group:string exc_handled:boolean"
)
_KINDS = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType())}


def _field(spec: str) -> T.StructField:
    name, kind = spec.rstrip("!").split(":")
    return T.StructField(name, _KINDS[kind], not spec.endswith("!"))


def _struct(spec: str) -> T.StructType:
    return T.StructType([_field(x) for x in spec.split()])


#: One row for each page load, page unload, custom event, pixel hit or exception.
FACT = _struct(_FIELDS)
COLUMNS = FACT.fieldNames()
KINDS = ("page_load", "page_unload", "custom", "pixel", "exception")
PROJECT = _struct("id:string name:string slug:string created_at:timestamp")
SOURCE = _struct("uri:string project_id:string kind:string display_name:string created_at:timestamp first_seen:timestamp last_seen:timestamp")
PIXEL = _struct("id:string project_id:string name:string event_name:string metadata:map created_at:timestamp last_hit:timestamp")
TRIAGE = _struct("project_id:string group_id:string source:string resolved_at:timestamp muted_at:timestamp note:string updated_at:timestamp updated_by:string")
#: Wire payloads, by their short JSON keys.
HIT = _struct("b:string i:string e:string u:string r:string q:boolean p:boolean t:string m:long n:string d:map")
REPORT = _struct("u:string b:string i:string ty:string m:string s:string h:boolean v:string fp:string d:map")

TOP, TRACES, TREND, GROUPS, VARIANTS, TIMELINE = 25, 10, 20, 500, 50, 1000
BOUNCE_MS, MIN_SAMPLES, MAX_POINTS = (100, 5000), 5, 5000
DAY_MS = 86_400_000
MAX_PATH, KEEP_HOT_MS, EVERY_MS = 1024, 48 * 3_600_000, 3_600_000
MAX_FIELD, MAX_APP_FIELD, MAX_METADATA, MAX_VALUE, MAX_MESSAGE, MAX_STACK, MAX_SOURCES = 256, 120, 32, 1024, 1000, 16_000, 10_000
#: Bytes of a payload; larger ones are refused unread.
MAX_BODY = 16 * 1024
