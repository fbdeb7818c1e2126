import corpus_pipeline as cp
from staysignal.llm import op8_toxicity
from staysignal.llm.common import written
from tests.llm.fixtures import words
from tests.llm.test_dedup import jaccard_brute
from tests.llm.test_models import check_placed
from tests.llm.test_repeats import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    before = docs
    for name, stage in cp.STAGES:
        after = written(stage(spark, before, SF), "test-stage")
        data = {r["doc_id"]: r["text"] for r in before.collect()}
        got = {r["doc_id"]: r for r in after.collect()}
        if name != "best-fit packing":
            assert after.columns == start and after.schema == docs.schema
        if name == "toxicity":
            bad = {r["doc_id"] for r in op8_toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
                   if r["predicted"]}
            assert set(got) == set(data) - bad and len(got) > 0.8 * len(data)
        elif name == "exact dedup":
            last = {}
            for i in sorted(data):
                last[data[i]] = i
            assert set(got) == set(last.values())
        elif name == "n-gram Jaccard join":
            assert set(got) == {r[0] for r in jaccard_brute(sorted(data.items())) if r[0] == r[1]}
        elif name == "substring dedup":
            want = {r[0]: r for r in brute(sorted(data.items()), 20, words, b" ")}
            for i, r in got.items():
                if want[i][2] == 0:
                    assert r["text"] == data[i]
                else:
                    assert len(words(r["text"])) == want[i][1] - want[i][2] and r["n_chars"] == len(r["text"])
            assert set(got) == set(data)
        else:
            n, sequences, tokens = check_placed(after, 2048)
            assert set(got) == set(data) and sequences <= 1.02 * tokens / 2048 + 1
        before = after
