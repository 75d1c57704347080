"""Tables of versions: what is rewritten, who loses, what readers keep."""

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import versions

KIND = "id long, text string, n int"


def rows(spark, *made):
    return spark.createDataFrame(list(made), KIND)


def held(t):
    return sorted((tuple(r) for r in t.rows().collect()), key=repr)


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(0).alias("n"))
    one = versions.Table.create(df, str(tmp_path / "t"), buckets=16)
    two = one.upsert(rows(spark, (7, "new", 1), (7, "newer", 0), (1000, "more", 2)))
    changed = {b for b in two.files if two.files[b] != one.files.get(b)}
    assert 1 <= len(changed) <= 2 and set(two.files) == set(one.files)
    assert two.lookup([7, 1000, 5]).orderBy("id").collect() == [(5, "t5", 0), (7, "newer", 0), (1000, "more", 2)]
    assert one.lookup([7]).collect() == [(7, "t7", 0)] and one.rows().count() == 500 and two.rows().count() == 501
    files = two.lookup([7]).inputFiles()
    assert files and all(f"/__bucket={b}/" in f for f in files for b in changed if f.split("__bucket=")[1].split("/")[0] == str(b)) and len({f.split("__bucket=")[1].split("/")[0] for f in files}) == 1
    three = two.delete(spark.createDataFrame([(i,) for i in range(0, 500, 2)], "id long"))
    assert three.rows().where("id % 2 = 0 and id < 500").count() == 0 and three.rows().count() == 251
    assert versions.Table.open(spark, str(tmp_path / "t")).rows().count() == 251
    assert versions.Table.open(spark, str(tmp_path / "t"), one.version).rows().count() == 500


def test_of_two_writers_one_loses(spark, tmp_path):
    start = versions.Table.create(rows(spark, (1, "a", 1), (2, "b", 2)), str(tmp_path / "t"), buckets=4)
    first = start.upsert(rows(spark, (1, "x", 1)))
    for write in (lambda: start.upsert(rows(spark, (2, "y", 2))), lambda: start.delete(rows(spark, (1, "", 0))), lambda: start.overwrite(rows(spark))):
        with pytest.raises(versions.Conflict):
            write()
    now = versions.Table.open(spark, str(tmp_path / "t"))
    assert now.version == first.version and held(now) == [(1, "x", 1), (2, "b", 2)]
    assert held(now.upsert(rows(spark, (2, "y", 2)))) == [(1, "x", 1), (2, "y", 2)]


def test_a_commit_that_was_never_finished_is_not_there(spark, tmp_path):
    t = versions.Table.create(rows(spark, (1, "a", 1)), str(tmp_path / "t"), buckets=2)
    (tmp_path / "t" / "_commits" / f"{t.version + 1:012d}.json").write_text('{"files": {"0"')
    assert versions.Table.open(spark, str(tmp_path / "t")).version == t.version
    assert held(t.upsert(rows(spark, (2, "b", 2)))) == [(1, "a", 1), (2, "b", 2)]
    assert held(versions.Table.open(spark, str(tmp_path / "t"))) == [(1, "a", 1), (2, "b", 2)]


def test_full_refresh_insert_ignore_and_vacuum(spark, tmp_path):
    one = versions.Table.create(rows(spark, (1, "a", 1), (2, "b", 2), (None, "n", 0)), str(tmp_path / "t"), buckets=4)
    two = one.insert_ignore(rows(spark, (2, "other", 9), (3, "c", 3)))
    assert held(two) == sorted([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0)], key=repr)
    three = two.overwrite(rows(spark, (9, "z", 9)))
    assert held(three) == [(9, "z", 9)] and held(two) != held(three)
    gone = three.vacuum(1)
    assert gone and held(versions.Table.open(spark, str(tmp_path / "t"))) == [(9, "z", 9)]
    with pytest.raises(KeyError):
        versions.Table.open(spark, str(tmp_path / "t"), one.version)
    with pytest.raises(KeyError):
        versions.Table.open(spark, str(tmp_path / "none"))


def test_odd_rows(spark, tmp_path):
    wide = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (-(1 << 62), None, None)], KIND).selectExpr("*", "1 as __r")
    t = versions.Table.create(wide.select("id", "text", "n"), str(tmp_path / "t"), buckets=2)
    assert held(t) == sorted([(None, "a", 1), (None, "a", 1), (-(1 << 62), None, None)], key=repr)
    assert held(t.upsert(rows(spark))) == held(t) and t.upsert(rows(spark)) is t
    empty = versions.Table.create(rows(spark), str(tmp_path / "e"))
    assert held(empty) == [] and empty.lookup([1]).collect() == []
    assert held(empty.upsert(rows(spark, (1, "a", 1)))) == [(1, "a", 1)]
    assert held(empty.delete(rows(spark, (1, "a", 1)))) == []
