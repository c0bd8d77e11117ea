"""Job intake over triggers and restarts."""

import pytest

from ledgerline.streaming import intake


@pytest.fixture
def with_rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_names_stay_unique_over_triggers_and_restarts(with_rocks, tmp_path):
    spark, land = with_rocks, tmp_path / "land"
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def landed(*files):
        for path in files:
            place = land / path
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(f"text of {path}")
        entries = intake.named(intake.landing(spark, str(land)))
        intake.run(entries, lambda d: d, out, at).awaitTermination(120)
        return sorted((x["job_id"], x["file_name"], x["saved_name"]) for x in spark.read.parquet(out).collect())

    first = landed("7/a.txt", "8/a.txt", "7/b.txt")
    assert first == [("7", "a.txt", "a.txt"), ("7", "b.txt", "b.txt"), ("8", "a.txt", "a.txt")]
    second = landed("7/A.txt", "7/A_2.TXT.txt", "7/B.txt")
    assert set(second) - set(first) == {("7", "A.txt", "A_2.txt"), ("7", "A_2.TXT.txt", "A_2.TXT.txt"), ("7", "B.txt", "B_2.txt")}
    assert landed() == second  # nothing new, nothing twice
    assert len({(j, n.lower()) for j, _, n in second}) == len(second)
