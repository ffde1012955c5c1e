"""The result store: one computation for equal requests, another one for changed inputs."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.profiles import DEFAULT
from checks.telemetry import telemetry
from tellwise import Telemetry
from tellwise.plans import store as s
from tellwise.sources.folders import shared_folder
from tellwise.sources.telemetry import SOURCES

SF_DIR = "/root/testdata/sf0.001"
JOBS = ("jobs", "job_runs", "usage", "list_prices")


@pytest.fixture
def stored(spark, tmp_path):
    data = telemetry(spark, SF_DIR)
    paths = {name: f"{tmp_path}/in/{name}" for name in JOBS}
    for name, path in paths.items():
        getattr(data, name).write.parquet(path)
    return paths, s.ResultStore(spark, f"{tmp_path}/out")


def test_equal_requests_share_an_entry(spark, stored, monkeypatch):
    paths, store = stored
    first = store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    assert first.jobs.count() > 0 and first.warehouse is None
    monkeypatch.setattr(s, "recommend", None)  # nothing is computed again
    again = store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    assert sorted(map(tuple, again.jobs.collect())) == sorted(map(tuple, first.jobs.collect()))
    plan = again.jobs._jdf.queryExecution().executedPlan().toString()
    assert "job_runs" not in plan and "Exchange" not in plan
    entry, = store.entries()
    assert entry.sets == ("jobs",) and entry.as_of == DEFAULT.as_of


def test_changes_make_another_entry(spark, stored):
    paths, store = stored
    store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    store.get(Telemetry.from_parquet(spark, paths), cfg=replace(DEFAULT, min_confidence=90), selected=["jobs"])
    store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"], with_prompts=True)
    spark.read.parquet(paths["jobs"]).limit(1).write.mode("append").parquet(paths["jobs"])
    store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    filtered = replace(Telemetry.from_parquet(spark, paths), jobs=spark.read.parquet(paths["jobs"]).where(F.col("job_id") > "5"))
    store.get(filtered, cfg=DEFAULT, selected=["jobs"])
    assert len(store.entries()) == 5


def test_old_entries_can_be_removed(spark, stored):
    paths, store = stored
    assert store.entries() == []
    store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    kept, = store.entries()
    assert store.expire(kept.created) == [] and store.expire(kept.created + timedelta(seconds=1)) == [kept.key]
    assert store.entries() == [] and not store.has(kept.key)


def test_of_two_writers_the_first_wins(spark, stored):
    paths, store = stored
    first = store.get(Telemetry.from_parquet(spark, paths), cfg=DEFAULT, selected=["jobs"])
    entry, = store.entries()
    store._write(entry.key, s.Recommendations(jobs=first.jobs.limit(0)), DEFAULT, ["jobs"])
    assert store.entries() == [entry] and store.read(entry.key, ["jobs"]).jobs.count() == first.jobs.count()


def test_rows_without_files_need_a_version(spark):
    made = spark.createDataFrame([("w", "n", "r", datetime(2024, 1, 1), "c")], "workspace_id string, job_id string, job_name string, change_time timestamp_ntz, creator_id string")
    data = Telemetry.from_frames(jobs=made)
    with pytest.raises(ValueError, match="give its version"):
        s.input_versions(data)
    assert s.input_versions(data, {"jobs": "7"}) == {"jobs": "given:7"} and set(SOURCES) > {"jobs"}


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})
            self.sparkContext = self

        def getConf(self):
            return self.conf

    on = {"spark__master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_folder(Session(spark__sql__warehouse__dir="file:/tmp/w", **on))
    assert shared_folder(Session(spark__sql__warehouse__dir="hdfs://n/w", **on)) == "hdfs://n/w/_shared"
    assert shared_folder(Session(spark__sql__warehouse__dir="file:/tmp/w", spark__checkpoint__dir="s3://b/c/", **on)) == "s3://b/c"
