"""Cited places above ranked hits, within the owner that is asked about."""

from chronolex.operators import orchestration as O

WORKS = [(1, "출장 규정", "천문연구원"), (2, "출장규정", "지질연구원"), (3, "보안 규정", "천문연구원")]
PLACES = [(1, "a27"), (1, "a27.p1"), (2, "a27"), (3, "a5"), (1, "a1")]
ALIASES = [("천문연구원", "천문연구원"), ("천문연", "천문연구원"), ("지질연구원", "지질연구원"), ("연구원", "천문연구원"), ("연구원", "지질연구원")]
HITS = [(1, "a1", 3.0), (1, "a27", 1.0), (2, "a27", 9.0), (3, "a5", 5.0)]


def search(spark, question, chosen=None, size=10, places=PLACES):
    asked = spark.createDataFrame([("q", question, chosen)], "ask string, question string, chosen string")
    d = O.searched(
        asked, spark.createDataFrame([("q", *h) for h in HITS], "ask string, work int, article string, score double"), spark.createDataFrame(WORKS, "work int, title string, owner string"),
        spark.createDataFrame(places, "work int, path string"), spark.createDataFrame(ALIASES, "name string, owner string"), size,
    )
    return [(r["work"], r["article"], r["score"], r["pinned"], r["path"]) for r in d.orderBy("place").collect()]


def test_named_owner_and_citation(spark):
    # the cited article comes first with its own score, though others rank above it; the other owner's work isn't shown
    assert search(spark, "천문연 출장규정 제27조 제1항") == [(1, "a27", 1.0, True, "a27.p1"), (3, "a5", 5.0, False, None), (1, "a1", 3.0, False, None)]


def test_missing_paragraph_gives_the_article(spark):
    assert search(spark, "지질연구원 출장 규정 제27조 제4항") == [(2, "a27", 9.0, True, "a27")]


def test_without_an_owner_nothing_is_pinned(spark):
    assert [x[:2] for x in search(spark, "출장규정 제27조")] == [(2, "a27"), (3, "a5"), (1, "a1"), (1, "a27")]
    assert not any(x[3] for x in search(spark, "연구원 출장규정 제27조"))  # a name that two owners have


def test_chosen_owner_filters_before_the_named_one(spark):
    got = search(spark, "천문연 출장규정 제27조", "지질연구원")
    assert got == [(1, "a27", None, True, "a27"), (2, "a27", 9.0, False, None)]  # what is said finds the place, what is chosen filters the rest


def test_number_within_an_owner(spark):
    assert search(spark, "천문연구원 제5조")[0] == (3, "a5", 5.0, True, "a5")


def test_absent_places_and_size(spark):
    assert [x[:2] for x in search(spark, "천문연 출장규정 제99조")] == [(3, "a5"), (1, "a1"), (1, "a27")]
    assert search(spark, "천문연 출장규정 제27조", size=1) == [(1, "a27", 1.0, True, "a27")]
    assert [x[:2] for x in search(spark, None)] == [(2, "a27"), (3, "a5"), (1, "a1"), (1, "a27")]
    assert search(spark, "천문연 출장규정 제27조", places=[])[0][:4] == (3, "a5", 5.0, False)
