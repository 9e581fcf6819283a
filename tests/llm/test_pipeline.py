"""The stages of the pipeline one after the other, each against a brute-force version on its own input."""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from twinsift.lineage import stage  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, "en", "src0", 0), (-2, "123 %%", "en", "src0", 6), (-3, "", None, None, 0), (-4, "жжжж", "en", None, 4)],
        given.schema)
    docs = given.unionByName(odd)
    languages = stage(steps["language ID"](spark, docs, SF), "one")
    assert languages.columns == given.columns
    assert sorted(texts(languages)) == sorted(texts(given))  # clean documents stay, the others go

    exact = stage(steps["exact dedup"](spark, languages, SF), "two")
    want = {doc for doc, (_, _, kept, _) in brute.exact_dedup(texts(languages)).items() if kept}
    assert {doc for doc, _ in texts(exact)} == want and exact.count() == len(want) < languages.count()

    near = stage(steps["MinHash near-dedup"](spark, exact, SF), "three")
    assert {doc for doc, _ in texts(near)} == set(brute.near_classes(texts(exact)).values())
    assert near.count() < exact.count()

    mixed = stage(steps["mixing sources"](spark, near, SF), "four")
    assert mixed.columns == given.columns
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in near.collect():
        sizes[r.source] += brute.size(r.text)
        largest[r.source] = max(largest[r.source], brute.size(r.text))
    for r in mixed.collect():
        taken[r.source] += brute.size(r.text)
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6

    packed = steps["best-fit packing"](spark, mixed, SF).collect()
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for members in by_sequence.values():
        ends = 0
        for offset, length in sorted(members):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(by_sequence) <= brute.fewest([r.length for r in packed], 2048) * 1.02 + 1
    assert sum(r.piece == 0 for r in packed) == mixed.count()
