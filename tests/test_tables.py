from pyspark.sql import functions as F

from kveil.functions.anonymize import short_hash
from kveil.sources.tables import KeyedTable


def users(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("u"), "id", F.lit("@example.nl")).alias("email"))


def erase(rows, ids):
    return rows.withColumn("email", F.when(F.col("id").isin(ids), F.lit("deleted")).otherwise(F.col("email")))


def test_only_files_of_a_subject_are_copied(spark, tmp_path):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        table = KeyedTable(spark, str(tmp_path / "t"), "id")
        table.write(users(spark, 1_000_000))
        before, ids = table.files(), [3, 4, 5, 6, 7, 8, 9, 10, 999_998, 999_999]
        assert len(before) == 40
        subjects = spark.createDataFrame([(i,) for i in ids], "id long")
        touched = table.change(subjects, lambda rows: erase(rows, ids))
        assert len(touched) == 2 and not any((tmp_path / "t" / f).exists() for f in touched)
        assert set(before) - set(touched) <= set(table.files())
        got, want = table.read(), erase(users(spark, 1_000_000), ids)
        assert got.agg(F.sum(F.xxhash64("id", "email").cast("decimal(38,0)"))).first() == want.agg(F.sum(F.xxhash64("id", "email").cast("decimal(38,0)"))).first()
        assert table.change(spark.createDataFrame([(-1,), (None,)], "id long"), lambda rows: rows) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_keys_meet_the_files_in_a_join(spark, tmp_path, monkeypatch):
    from kveil.sources import tables

    monkeypatch.setattr(tables, "PUSHED_KEYS", 3)
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.write(users(spark, 1000))
    subjects = users(spark, 1000).where("id % 7 = 0").select("id")
    table.change(subjects, lambda rows: rows.join(subjects, "id", "left_anti"))
    assert table.read().count() == 1000 - subjects.count() and table.read().where("id % 7 = 0").count() == 0


def test_a_change_without_manifest_did_not_happen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.write(users(spark, 100))

    def crash(*args):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", crash)
        try:
            table.change(users(spark, 5).select("id"), lambda rows: erase(rows, [1]))
        except OSError:
            pass
    assert table.read().where("email = 'deleted'").count() == 0 and table.read().count() == 100
    table.change(users(spark, 5).select("id"), lambda rows: erase(rows, [1]))
    assert [r.id for r in table.read().where("email = 'deleted'").collect()] == [1]


def test_empty_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.write(users(spark, 0))
    assert table.read().count() == 0 and table.change(users(spark, 3).select("id"), lambda rows: rows) == []
    assert table.read().select(short_hash(F.col("id"))).count() == 0
