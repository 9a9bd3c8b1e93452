import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from jobweave.checks.compare import difference, oracle_rows
from jobweave.llm import quality
from tests.llm import brute
from tests.llm.conftest import SCHEMA, edge_rows, sentence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, labels):
    """Documents with copies, near copies, junk and personal data, and their labels."""
    rng, path = random.Random(21), tmp_path_factory.mktemp("corpus")
    rows = list(edge_rows())
    for i in range(1000, 1060):
        rows.append((i, sentence(rng, rng.randint(60, 200)).replace("#", "") + f"\nwrite me{i}@mail.example now", "en", f"s{i % 3}", 1))
    rows += [(2000 + i, rows[-i - 1][1] + " end", "en", "s0", 1) for i in range(10)]
    rows += [(3000 + i, " ".join(w + "###" for w in sentence(rng, 80).split()), "en", "s1", 1) for i in range(15)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(1000, 1060)] + [(3000 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(marks, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_against_a_plain_version(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        if name == "quality rules":
            verdict = quality.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            kept = Counter((r["doc_id"], r["text"]) for r in verdict.where("kept").collect())
            assert Counter((r["doc_id"], r["text"]) for r in after) == kept
            assert {r["doc_id"] for r in after} >= set(range(1000, 1060)) and not any((r["doc_id"] or 0) >= 3000 for r in after)
            for r in after:
                counts = brute.rule_counts(r["text"])
                assert counts[0] >= 50 and 2 * counts[4] <= counts[0]
        elif name == "near duplicates":
            group = brute.components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
            assert Counter(after) == Counter(r for r in before if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"])
            assert len(after) < len(before)
        elif name == "personal data":
            assert sorted(map(repr, ((r["doc_id"], r["source"]) for r in after))) == sorted(map(repr, ((r["doc_id"], r["source"]) for r in before)))
            assert all(not brute.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)
            assert sum("[EMAIL]" in r["text"] for r in after) >= 50
        elif name == "source mix":
            sizes, times = defaultdict(int), Counter(after)
            for r in before:
                sizes[r["source"]] += len(brute.words(r["text"]))
            got, goal = defaultdict(int), brute.targets(sizes)
            for r in after:
                got[r["source"]] += len(brute.words(r["text"]))
            assert set(times) <= set(before) and max(times.values()) <= 3 * max(Counter(before).values())
            longest = max(len(brute.words(r["text"])) for r in before)
            assert all(abs(got[s] - goal[s]) <= longest for s in sizes)
        else:
            check = defaultdict(int)
            for r in after:
                check[r["doc_id"]] += r["length"]
            total = defaultdict(int)
            for r in before:
                total[r["doc_id"]] += 1
            assert set(check) == set(total)


def test_run_is_the_stages_in_a_row(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_carry_columns_of_any_name(spark, folder):
    names = ["n_words", "kept", "_hash", "_id", "_h", "_terms", "all_spans", "base_spans", "_copies", "_copy", "_source", "taken", "size", "hash", "key", "ids", "a b", "TEXT2"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id < 1020").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in names)
    assert corpus_pipeline.packing_stage(spark, docs, folder).count() > 0


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_against_their_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert difference(df.columns, [tuple(r) for r in df.collect()], *oracle_rows(SF, entry.oracle_sql()[name])) == ""
