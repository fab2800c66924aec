"""The corpus pipeline over a small table: each stage against a plainer computation on its own input."""

import collections

import pytest

import corpus_pipeline
from pixelweft.llm import decontamination, mixing, queries, sharding, toxicity

from .test_operators import awkward, frame
from .test_similar import groups_by_force

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents before the first stage and after each one."""
    docs = [queries.table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, docs[-1], SMALL).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_stages_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_toxicity_keeps_what_the_model_lets_pass(spark, steps):
    labels = queries.table(spark, SMALL, "labels")
    model = toxicity.fit(steps[0], labels)
    want = {r.doc_id for r in steps[0].collect() if model.severity(r.text) < 0.5}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_one_of_each_group_stays(steps):
    rows = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in steps[2].collect()} == {rows[k].doc_id for k in groups_by_force([r.text or "" for r in rows])}


def test_contaminated_ones_go(spark, steps):
    found = decontamination.contaminated(steps[2], queries.table(spark, SMALL, "benchmark"))
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in steps[2].collect()} - {r.doc_id for r in found.collect()}


def test_mix_and_shards(steps):
    plan = {r.doc_id: r.reps for r in mixing.mix_plan(steps[3]).collect() if r.reps}
    assert collections.Counter(r.doc_id for r in steps[4].collect()) == plan
    last = steps[5].collect()
    assert collections.Counter(r.doc_id for r in last) == plan
    shard = {r.doc_id: r.shard for r in sharding.shard_report(steps[3]).collect()}
    assert all(r.shard == shard[r.doc_id] for r in last)
    per = collections.defaultdict(list)
    for r in last:
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_whole_run_equals_its_stages(spark, steps):
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == collections.Counter(tuple(r) for r in steps[-1].collect())


def test_sharding_stage_on_awkward_rows(spark):
    docs = frame(spark)
    out = corpus_pipeline.sharding_stage(spark, docs, SMALL)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(awkward())
    assert corpus_pipeline.sharding_stage(spark, frame(spark, []), SMALL).count() == 0
