import threading

from estrado.operators.history import History


def _asked(spark, name, n):
    return spark.createDataFrame([(name, f"q{i}", i) for i in range(n)], "username string, query string, ord int").repartition(3)


def test_batches_follow_each_other_in_the_order_asked(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.read().count() == 0
    assert [h.append(_asked(spark, "a", 30), "t1"), h.append(_asked(spark, "b", 0), "t2"), h.append(_asked(spark, "a", 5), "t3")] == [1, 2, 3]
    rows = History(spark, str(tmp_path / "h")).read().orderBy("id").collect()
    assert [(r["query"], r["fecha"]) for r in rows] == [(f"q{i}", "t1") for i in range(30)] + [(f"q{i}", "t3") for i in range(5)]
    assert [r["id"] for r in rows[:30]] == [History.BATCH + 1 + i for i in range(30)]
    last = h.latest(6).orderBy("lugar").collect()
    assert [(r["fecha"], r["query"]) for r in last] == [("t3", f"q{i}") for i in (4, 3, 2, 1, 0)] + [("t1", "q29")]


def test_writers_at_the_same_time_share_no_id(spark, tmp_path):
    path = str(tmp_path / "h")
    each = [threading.Thread(target=lambda i=i: History(spark, path).append(_asked(spark, f"w{i}", 20), "t")) for i in range(4)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    rows = History(spark, path).read().collect()
    assert len(rows) == 80 and len({r["id"] for r in rows}) == 80
    assert len({(r["username"], r["id"] // History.BATCH) for r in rows}) == 4


def test_a_number_that_is_taken_is_passed_over(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h._reserve() == 1 and not h._created(1)
    assert h.append(_asked(spark, "a", 2), "t") == 2
    (tmp_path / "h" / "rows" / "batch=7").mkdir()  # a write that never finished
    assert h.read().count() == 2
