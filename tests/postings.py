"""Small postings tables for tests: every column of the real one, null unless given."""

from pyspark.sql import types as T

STRINGS = (
    "job_id source_id platform url application_url title company location candidate_locations work_mode description description_status kind source_title source_description "
    "recruiter_email job_level job_type date_posted posted_at expires_at first_seen_at date_source active_status salary_currency salary_interval salary_text salary_source query_id search_track"
).split()
SCHEMA = T.StructType().add("posting_no", T.LongType()).add("batch_no", T.IntegerType())
for _n in STRINGS:
    SCHEMA = SCHEMA.add(_n, T.StringType())
for _n in ("captured_at", "last_seen_at"):
    SCHEMA = SCHEMA.add(_n, T.TimestampType())
for _n in ("aliases", "source_urls", "evidence_warnings"):
    SCHEMA = SCHEMA.add(_n, T.ArrayType(T.StringType()))
for _n in ("salary_min", "salary_max"):
    SCHEMA = SCHEMA.add(_n, T.DoubleType())
for _n in ("is_remote", "is_priority_location"):
    SCHEMA = SCHEMA.add(_n, T.BooleanType())

PLATFORMS = [
    ("Eastboard", "eastboard.example", "America/New_York", "mdy", "USD", "number ending the path"),
    ("Kontor", "kontor.example", "Europe/Berlin", "dmy", "EUR", "whole path"),
    ("Isoport", "isoport.example", "UTC", "ymd", "USD", "parameter jobid"),
    ("Bazaar", "bazaar.example", "Asia/Kolkata", "dmy", "INR", "number ending the path"),
]


def postings(spark, rows):
    """A table of dicts; ``posting_no`` counts up where it isn't given."""
    out = [tuple({"posting_no": i + 1, **r}.get(f.name) for f in SCHEMA) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def platforms(spark):
    return spark.createDataFrame(PLATFORMS, "platform string, host string, local_zone string, date_order string, home_currency string, listing_key string")
