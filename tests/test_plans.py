"""Plans of the registered queries."""
from unittest import mock

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobweave.functions import parse_years
from jobweave.operators.gates import Places
from jobweave.operators.matching import match_count, read_bodies
from jobweave.plans.discovery import candidates, jobs_of
from jobweave.session import work_folder

SF_DIR = "/root/testdata/sf0.001"
STREAMS = {"typed_result_stream", "stream_before_close", "daily_usage_stream", "stream_first_urls", "stream_of_matches",
           "quota_stream", "feedback_stream"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - STREAMS))
def test_no_pairwise_join_and_no_row_python(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["verified_rows"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_postings_are_read_beside_their_results(spark):
    lines = entry.queries()["country_conflicts"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert not [line for line in lines[join:] if "regexp_extract" in line]


def test_matching_reads_each_text_once(spark):
    """No filter repeats the search of a text: neither of the texts of postings for the join's bucket, nor of locations."""
    places = spark.createDataFrame([("Nation 1", "N1"), ("Nation 2", "N2"), ("New Nation 2", "N1")], "place string, country string")
    known = Places(places)
    bodies = read_bodies(spark.createDataFrame([(0, "long enough" + " and so on" * 12), (1, "short")], "doc_id int, text string"), known)
    heads = spark.createDataFrame([("a", "Needs 5 years\n", "Nation 1", 0), ("b", "2 years\n", None, 0), ("c", "", "WFH", 1)],
                                  "url string, head string, location string, doc_id int")
    results = spark.createDataFrame([(1, "a", "Board", 1, "in nation 1"), (1, "b", "Board", 2, "b"), (1, "c", "Board", 3, "c")],
                                    "query_id int, url string, source string, rank int, title string")
    profiles = [(1, 1, 6.0, "nation 1", False), (2, 1, 6.0, "Nation 1 or nation 2", False), (3, 1, None, "new nation 2", False),
                (4, 1, 2.0, "nowhere", True), (5, 1, 6.0, "Nation 2", None), (6, 1, 6.0, None, False)]
    profiles = spark.createDataFrame(profiles, "profile_id int, query_id int, years double, location string, remote_only boolean")
    counts = match_count(candidates(profiles, known), jobs_of(results, heads.join(bodies, "doc_id"), known))
    assert {r.profile_id: r.matches for r in counts.collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1, 6: 2}
    lines = counts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    reading = [line for line in lines if any(f in line for f in ("regexp_extract", "RLIKE", "regexp_replace"))]
    assert reading and not [line[:200] for line in reading if "Join " in line or "Filter " in line]


def test_partitions_are_merged_to_three_a_core_at_least(spark):
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionNum")) == 3 * spark.sparkContext.defaultParallelism


def test_no_method_too_long_to_be_compiled(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_years_are_read_without_casting_empty_texts(spark):
    rows = spark.createDataFrame([("3-5 years",), ("4+ years",), ("none",), ("",), (None,)], "req string").repartition(1)
    plan = rows.select(parse_years(F.col("req")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract(" not in plan  # gives an empty text where nothing is found, and the cast an error
    assert [r[0] for r in rows.select(parse_years(F.col("req"))).collect()] == [3.0, 4.0, None, None, None]


def test_work_folder_follows_the_session():
    cluster = mock.Mock()
    cluster.conf.get.side_effect = {"spark.checkpoint.dir": "s3a://shared/work/"}.get
    assert work_folder(cluster, "x").startswith("s3a://shared/work/x-")
    unset = mock.Mock()
    unset.conf.get.return_value = unset.sparkContext.getCheckpointDir.return_value = None
    for master in ("yarn", "local[8]"):
        unset.sparkContext.master = master
        with pytest.raises(ValueError):
            work_folder(unset, "x")
