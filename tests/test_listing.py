"""Archived pages read at once and as a stream that stops and goes on."""

import json

from chronolex.sources import listing as L


def page(folder, number, entries, total=9):
    d = folder / f"page={number}"
    d.mkdir(parents=True)
    (d / "part-0.txt").write_text(json.dumps({"total": total, "rows": [{"seq": e} for e in entries]}) + "\n")
    (d / "_SUCCESS").write_text("")


def test_batch(spark, tmp_path):
    L.register(spark)
    for n in range(7):
        page(tmp_path, n, [f"{n}a", f"{n}b"])
    page(tmp_path, 9, [])
    d = spark.read.format("paged_listing").option("pagesPerPartition", 2).load(str(tmp_path))
    assert sorted((r["page"], r["place"], json.loads(r["entry"])["seq"]) for r in d.collect()) == [(n, k + 1, f"{n}{'ab'[k]}") for n in range(7) for k in range(2)]
    assert d.rdd.getNumPartitions() == 4
    some = d.filter("page >= 2 AND page < 4 AND place = 1")
    assert sorted(r["page"] for r in some.collect()) == [2, 3] and some.rdd.getNumPartitions() == 1
    assert d.filter("page = 5").count() == 2
    assert spark.read.format("paged_listing").load(str(tmp_path / "none")).count() == 0


def test_filters_leave_out_pages(tmp_path):
    for n in range(6):
        page(tmp_path, n, ["x"])
    r = L.Pages(str(tmp_path), 50)
    rest = list(r.pushFilters([L.GreaterThan(("page",), 1), L.LessThanOrEqual(("page",), 4), L.EqualTo(("place",), 1)]))
    assert [f.attribute for f in rest] == [("place",)] and [p.pages for p in r.partitions()] == [[2, 3, 4]]


def test_a_stream_goes_on_behind_its_last_page(spark, tmp_path):
    L.register(spark)
    pages, out = tmp_path / "pages", str(tmp_path / "out")

    def run():
        s = spark.readStream.format("paged_listing").option("pagesPerPartition", 1).load(str(pages))
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).option("path", out).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r["page"], r["entry"]) for r in spark.read.parquet(out).collect())

    page(pages, 1, ["a", "b"])
    page(pages, 2, ["c"])
    assert [p for p, _ in run()] == [1, 1, 2]
    page(pages, 3, ["d"])
    assert [p for p, _ in run()] == [1, 1, 2, 3] and [p for p, _ in run()] == [1, 1, 2, 3]
    batch = spark.read.format("paged_listing").load(str(pages))
    assert sorted((r["page"], r["entry"]) for r in batch.collect()) == run()
