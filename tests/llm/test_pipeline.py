import hashlib
import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp

from .test_ngram_join import brute as brute_groups
from .test_packing import check as check_packing
from .test_suffix import brute as brute_spans
from .test_sharding_mixing import fill

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34 !", None, None, 7), (9003, "", "de", "src1", 0)], docs.schema))
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, f in cp.STAGES:
        f(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns(stages):
    assert all(tuple(d.columns) == cp.COLUMNS for d in stages[:-1])


def test_language(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[:2])
    assert set(after) == {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.97 * len(after)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    groups = brute_groups(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_passages(stages):
    rows = stages[2].collect()
    left = {r.doc_id: r.text for r in stages[3].collect()}
    for r, (n, gone, spans, kept) in zip(rows, brute_spans([r.text for r in rows]), strict=True):
        if gone == 0:
            assert left[r.doc_id] == r.text
        elif r.doc_id in left:
            text = left[r.doc_id].encode()
            if len(text) == n - gone:  # no character was split
                assert hashlib.sha256(text).hexdigest() == kept
            else:
                assert n - gone - 6 * spans <= len(text) < n - gone
    assert set(left) <= {r.doc_id for r in rows}


def test_mix(stages):
    size, by, taken, largest = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[3].collect():
        size[r.doc_id] = len(WORDS.findall(r.text or ""))
        by[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    for r in stages[4].collect():
        taken[r.source] += size[r.doc_id]
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    for s, goal in zip(order, fill([by[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2), strict=True):
        assert abs(taken[s] - goal) <= max(2, 0.03 * by[s], largest[s] / 2)  # a few whole documents can't come nearer


def test_packing(stages):
    check_packing(stages[4], stages[4].collect())


def test_run(spark):
    assert cp.run(spark, SF).count() > 100
