from pyspark.sql import functions as F

from tidemark.functions import extract, markup, text
from tidemark.functions.extract import Cues
from tidemark.plans import settings


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    assert one(spark, text.clean_text, "  NaN ") == "" and one(spark, text.clean_text, None) == "" and one(spark, text.clean_text, " a b ") == "a b"
    assert one(spark, text.normalized, "  Café\t№ ﬁn ") == "cafe no fin" and one(spark, text.normalized, None) == ""
    assert one(spark, text.optional_bool, "Yes") is True and one(spark, text.optional_bool, "t") is None
    assert one(spark, text.optional_number, "1e400") is None and one(spark, text.optional_number, " 2.5 ") == 2.5 and one(spark, text.optional_number, "nan") is None


def test_urls(spark):
    url = lambda v: one(spark, text.canonical_url, v)
    assert url("HTTP://Www.A.example:80/x//?b=2&utm_source=q&a=1&trk=9#top") == "https://www.a.example/x?a=1&b=2"
    assert url("https://a.example:8443?flag") == "https://a.example:8443/?flag="
    assert url("ftp://a.example/") is None and url("https://me@a.example/") is None and url("https://a.example/a b") is None and url(None) is None
    collapse = (("net.example", r"^/jobs/view/(?:[^/]*-)?(\d+)$", "/jobs/view/$1"),)
    assert one(spark, lambda c: text.canonical_url(c, collapse), "https://de.net.example/jobs/view/some-role-77?x=1") == "https://de.net.example/jobs/view/77"
    assert one(spark, lambda c: text.host_allowed(c, ["a.example"]), "https://b.a.example/x") and not one(spark, lambda c: text.host_allowed(c, ["a.example"]), "https://ba.example/")


def test_markup():
    assert markup.html_text("<p>a <b>b</b></p><script>x</script><ul><li>c</li></ul>") == "a b\nc"
    assert markup.html_text("&lt;p&gt;a&lt;/p&gt;<br>b", False) == "a b" and markup.html_text(None) == "" and len(markup.html_text("<p>x</p>" * 20000)) > 20000
    page = '<script type="application/ld+json">{"@graph":[{"@type":"A"},{"itemListElement":[{"item":{"@type":"B"}}]}]}</script><script type="application/ld+json">{broken</script>'
    assert [o.get("@type") for o in markup.jsonld_objects(page)].count("B") == 1
    assert markup.embedded_json("var state = {\"a\": {\"b\": \"}\"}}; x()", "state") == '{"a": {"b": "}"}}' and markup.embedded_json("var state = {", "state") is None
    assert markup.locations([{"address": {"addressLocality": "X", "addressCountry": {"name": "Y"}}}, "Z", "Z", None]) == "X, Y; Z"


def requirements(spark, *texts, cues=settings.EXPERIENCE):
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "n int, t string, evidence_no int")
    return sorted((r.n, r.minimum_months, r.maximum_months, r.preferred) for r in extract.durations(rows, "t", cues).collect())


def test_requirements(spark):
    text = "At least three to five years of experience. A company founded 20 years ago. Four-year degree; 6 months experience preferred"
    assert requirements(spark, text, None, "", "5 years") == [(0, 6.0, None, True), (0, 36.0, 60.0, False)]
    assert requirements(spark, "1 to 3 years experience. A 4 year degree is required.", "0-2 years experience", "Five years of experience preferred") == [(0, 12.0, 36.0, False), (1, 0.0, 24.0, False), (2, 60.0, None, True)]
    assert requirements(spark, "x" * 100_000 + " 2 yrs experience, company history of 9 years, a firm with 3 months of experience") == [(0, 3.0, None, False), (0, 24.0, None, False)]


def test_context_ends_at_the_neighbouring_duration_and_at_its_reach(spark):
    far = Cues(asks=r"\bexperience\b")
    assert requirements(spark, "experience of 2 years 3 years", cues=far) == [(0, 24.0, None, False)]
    assert requirements(spark, "experience " + "x" * 70 + " 2 years", "experience " + "x" * 50 + " 2 years", cues=far) == [(1, 24.0, None, False)]


def split(spark, text):
    rows = spark.createDataFrame([(text,)], "t string")
    return [tuple(s) for s in extract.sections(rows, "t", settings.role_heading, settings.for_all).first().sections or []]


def test_sections(spark):
    post = "We hire.\nRole: Data Analyst\nKnows SQL.\n2) Software Engineer\nKnows Go.\nHow to apply: write"
    got = split(spark, post)
    assert [s[0] for s in got] == ["Data Analyst", "Software Engineer"] and all("We hire." in s[1] and "write" in s[1] for s in got) and "Go" not in got[0][1]
    assert split(spark, "Role: A role\nRole: a  ROLE") == [] and split(spark, None) == [] and split(spark, "") == []
    assert split(spark, "Role: Café manager\nx\nRole: Cafe manager\ny") == [] and split(spark, "Role: None\nx\nRole: Null\ny") == []
    assert len(split(spark, "\n".join(f"Role: Role {i}\n" + "x" * 2000 for i in range(60)))) == 60
