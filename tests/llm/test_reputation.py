import pytest

from corpuscle.llm import reputation

PAGES = "page_id long, url string, host string, n long, good long, p double"


def judged(spark, pages, labels, **more):
    frame = spark.createDataFrame([(*p, "clash", 1, 1, 0.5) for p in pages], PAGES)
    rows = reputation.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int, host string, upper double"), **more)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in rows.collect()}


PLACES = [(i, f"http://h{i % 6}.d{i % 3}.net/{i}") for i in range(60)]


@pytest.mark.parametrize("outcome", [None, 0, 1])
def test_labels_that_do_not_differ(spark, outcome):
    labels = [] if outcome is None else [(i, outcome, "x", 0.1) for i in range(60)]
    got = judged(spark, PLACES, labels)
    assert len(got) == 60 and {v for _, v in got.values()} == {"block" if outcome == 0 else "allow"}


def test_one_label_a_host(spark):
    got = judged(spark, PLACES, [(i, i % 2, "x", 0.1) for i in range(6)])
    assert len(got) == 60 and {v for _, v in got.values()} <= {"allow", "block"}


def test_rules_nulls_repeats_and_empty_tables(spark):
    pages = [
        (1, None), (2, "no scheme"), (3, ""), (None, "http://A.Example.ORG/es/x?q#f"), (5, "http://example.org/en/1"), (5, "http://example.org/en/1"),
        (6, "http://notexample.org/es/"), (7, "x://b.com/de/"), (8, "http://com/fr/1"), (9, "http://u.net?p=/de/"), (10, "http://v.net/" + "long" * 100_000),
    ]
    got = judged(spark, pages, [(1, None, "x", 0.1), (None, 0, "x", 0.1)])
    assert got[1, "", ""][0] is None and got[2, "", ""][0] is None and got[3, "", ""][0] is None
    assert got[None, "a.example.org", "/es/x"] == ("example.org/es/", "block")
    assert got[5, "example.org", "/en/1"] == ("example.org/en/1", "block")
    assert got[6, "notexample.org", "/es/"] == ("org/", "allow")
    assert got[7, "b.com", "/de/"] == ("com/de/", "block") and got[8, "com", "/fr/1"] == ("com/fr/", "allow")
    assert got[9, "u.net", ""][0] is None and got[10, "v.net", "/" + "long" * 100_000][0] is None
    assert judged(spark, [], [(1, 1, "x", 0.1)]) == {}


def test_bad_hosts_are_blocked_and_good_ones_left(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.d{i % 10}.net/{i}") for i in range(400)]
    labels = [(i, int(i % 2 == 0), "x", 0.1) for i in range(0, 400)]
    got = judged(spark, pages, labels)
    assert {(h.split(".")[0], v) for (_, h, _), (_, v) in got.items()} == {("bad", "block"), ("good", "allow")}
