from datetime import datetime

from linkloom.operators.snapshots import manifest_changes

SCHEMA = "snapshot_no int, file_path string, content_hash string, loaded_at timestamp, key string, change string"


def changes(spark, rows):
    df = spark.createDataFrame([(n, p, h, datetime(2031, 1, 1, t), "other", "x") for n, p, h, t in rows], SCHEMA)
    return sorted((r.snapshot_no, r.file_path, r.change) for r in manifest_changes(df).collect())


def test_added_removed_changed_and_back_again(spark):
    rows = [(1, "a", "x", 0), (2, "a", "y", 0), (4, "a", "y", 0), (2, "b", "z", 0), (3, "c", "q", 0), (1, "d", "k", 0), (2, "d", "k", 0), (3, "d", "k", 0), (4, "d", "k", 0)]
    assert changes(spark, rows) == [(2, "a", "changed"), (2, "b", "added"), (3, "a", "removed"), (3, "b", "removed"), (3, "c", "added"), (4, "a", "added"), (4, "c", "removed")]


def test_spellings_of_paths_and_hashes_are_one(spark):
    rows = [(1, ".\\src\\\\a.py", " AB", 0), (2, "././src//a.py", "ab ", 1), (2, "src/A.py", "ab", 0)]
    assert changes(spark, rows) == [(2, "src/A.py", "added")]


def test_latest_arrival_counts_and_null_hash_is_no_change(spark):
    rows = [(1, "a", "x", 0), (2, "a", "y", 5), (2, "a", "x", 9), (1, "b", None, 0), (2, "b", "x", 0), (2, "b", "x", 0), (1, None, "x", 0), (2, None, "y", 0)]
    assert changes(spark, rows) == []


def test_empty_table(spark):
    assert changes(spark, []) == []
