import os

from folioforge.sources.store import Settings, VectorTable, input_files, stored_table
from tests.conftest import rows


def test_stored_table_is_made_once_per_files_and_settings(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in").selectExpr(f"id + {len(made)} as id")

    get = lambda **settings: rows(stored_table(spark, "test", settings, [f"{tmp_path}/in"], build))
    assert get(a=1) == [(1,), (2,), (3,)] == get(a=1) and len(made) == 1
    assert get(a=2) == [(2,), (3,), (4,)] and len(made) == 2
    file = next(f for f, _, _ in input_files(spark, [f"{tmp_path}/in"]) if f.endswith(".parquet"))
    os.utime(file.removeprefix("file:"), (10**9, 10**9))
    assert get(a=1) == [(3,), (4,), (5,)] and len(made) == 3


def test_a_lost_race_keeps_the_first_table(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/in")
    inner = lambda: spark.range(10)

    def build():  # another writer finishes while this one is still at work
        stored_table(spark, "race", {}, [f"{tmp_path}/in"], inner)
        return spark.range(20)

    assert stored_table(spark, "race", {}, [f"{tmp_path}/in"], build).count() == 10


def test_two_writers_of_a_vector_table_lose_nothing(spark, tmp_path):
    t, other = (VectorTable(spark, Settings(f"file://{tmp_path}", "ix"), 1).ensure() for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, "p", 0, "t", [1.0])], "chunk_id string, source_path string, chunk_index int, text string, embedding array<double>")
    real = t._create
    # the other writer takes the number that this one was about to claim
    t._create = lambda path, what: (setattr(t, "_create", real), other.upsert(row("b")), real(path, what))[-1]
    t.upsert(row("a"))
    assert rows(t.read("default"), "chunk_id") == [("a",), ("b",)] and t._version() == 3
