"""Places in a global order against a sort in Python."""

from spotweave.operators import places


def test_places_of_groups_over_several_ranges(spark):
    rows = [(None if i % 5 == 0 else ["a", "b", "b", "b"][i % 4], (i * 7919) % 1009 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = places.placed(df, ["g"], ["v"]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r._at >> places.WITHIN for r in got if r.g == "b"}) > 1  # the large group lies in several ranges
    for g in (None, "a", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r._place)
        assert [r._place for r in own] == list(range(len(own))) and {r._size for r in own} == {len(own)}
        assert [r.v for r in own] == sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v))


def test_places_of_a_whole_table_and_of_none(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (1,)], "v long")
    assert [(r._place, r.v) for r in sorted(places.placed(df, [], ["v"]).collect(), key=lambda r: r._place)] == [(0, None), (1, 1), (2, 1), (3, 3)]
    assert places.placed(df.limit(0), [], ["v"]).collect() == []
