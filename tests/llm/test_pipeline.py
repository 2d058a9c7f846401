"""The corpus pipeline on a given table: each stage against a plain version of it."""

from collections import Counter

import pytest

import brute
import corpus_pipeline
from larder.llm import quality
from larder.llm.sampling import FOLDS
from larder.session import materialise

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], FOLDER), "test-pipeline"))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_filters_drop_what_they_should(steps, spark):
    before, good, distinct, clean, _, _ = steps
    columns = set(before[0])
    assert all(set(r) == columns for rows in (good, distinct, clean) for r in rows)
    assert FOLDS == 5 and quality.THRESHOLD == 0.3
    assert len(good) >= 0.8 * len(before)
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in distinct} == {d for d, (_, c) in groups.items() if d == c}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in distinct if any(i in r["text"] for i in items)}
    kept = {r["doc_id"] for r in clean}
    assert not kept & leaks
    assert len({r["doc_id"] for r in distinct} - kept - leaks) <= 2


def test_mix_and_token_files_hold_the_budgets(steps):
    clean, mixed, tokens = steps[3:]
    size = Counter()
    for r in clean:
        size[r["source"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(brute.words(r["text"]))
    assert {s: int(t) for s, t in brute.budgets(size).items()} == dict(taken)
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)
    starts = sorted((r["start"], r["n_tokens"]) for r in tokens)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_run_has_the_rows_of_the_stages(steps, spark):
    rows = [r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()]
    key = lambda r: (r["start"], r["ids_crc32"])
    assert sorted(rows, key=key) == sorted(steps[-1], key=key)
