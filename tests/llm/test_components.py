"""Connected components and the bitmap of ids, against plain Python."""

from gridframe.llm.common import among, components


def test_chain_cycle_and_star(spark):
    chain = [(k + 1, k) for k in range(10, 50)] + [(11, 10)]
    cycle, star = [(101, 102), (102, 103), (103, 101)], [(k, 200) for k in range(201, 260)]
    links = spark.createDataFrame(chain + cycle + star + [(7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links, "components").collect()}
    want = {**{k: 10 for k in range(11, 51)}, 102: 101, 103: 101, **{k: 200 for k in range(201, 260)}}
    assert {k: v for k, v in found.items() if k != v} == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "components").count() == 0


def test_among_hits_all_wanted_ids(spark):
    rows = spark.createDataFrame([(k, None if k % 7 else "x") for k in range(500)] + [(None, "y")], "doc_id long, text string")
    got = {r["doc_id"]: r["hit"] for r in among(rows, spark.createDataFrame([(k,) for k in range(0, 500, 5)], "doc_id long")).collect()}
    assert all(got[k] for k in range(0, 500, 5)) and sum(got.values()) <= 102 and len(got) == 501
    assert not any(r["hit"] for r in among(rows, spark.createDataFrame([], "doc_id long")).collect())
