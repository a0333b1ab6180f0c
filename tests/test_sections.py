from tidemark.plans.core_queries import QUERIES


def test_a_post_that_is_not_split_stays_whole(spark, tmp_path):
    two = "We hire.\nRole: Data Analyst\nKnows SQL.\n2) Software Engineer\nKnows Go."
    rows = [
        (1, "lead", "full", "Jobs", two), (2, "lead", "snippet", "Cut", two), (3, "vacancy", "full", "Nurse", two), (4, "lead", "full", "One", "Role: Data Analyst\nx"),
        (5, None, None, None, None), (6, "lead", "full", "Empty", None),
    ]
    spark.createDataFrame(rows, "posting_no long, kind string, description_status string, title string, description string").write.parquet(f"{tmp_path}/postings.parquet")
    got = sorted(map(tuple, QUERIES["q_split_roles"](spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert [r[:3] for r in got[:2]] == [(1, 0, "Data Analyst"), (1, 1, "Software Engineer")]
    assert got[2:] == [(n, 0, title, text) for n, _, _, title, text in rows[1:]]


def test_every_posting_is_there(spark, data):
    postings = spark.read.parquet(f"{data}/postings.parquet")
    assert QUERIES["q_split_roles"](spark, data).select("posting_no").distinct().count() == postings.count() > 0

