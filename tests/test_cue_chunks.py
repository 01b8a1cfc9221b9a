from collections import defaultdict

from pairlens.operators import pairs as P
from pairlens.plans import catalog

SF = "/root/testdata/sf0.001"


def test_chunks_are_the_whole_document(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    c = c.unionByName(c.limit(3)).unionByName(spark.createDataFrame([(1, 99, None, "no role"), (1, 98, "user", None)], c.schema))
    rows, want, got = c.collect(), defaultdict(list), defaultdict(list)
    for r in sorted((r for r in rows if r.text is not None), key=lambda r: (r.conv_id, r.turn, r.text)):
        want[r.role].append(r.text)
    for r in sorted(P.cue_chunks(c, "role", "text", ["conv_id", "turn"], rows=7).collect(), key=lambda r: r.chunk):
        assert r.n_spans <= 7
        got[r.role].append(r.cue_doc)
    assert {k: " ".join(v) for k, v in got.items()} == {k: " ".join(v) for k, v in want.items()}
    assert sum(r.n_spans for r in catalog.QUERIES["cue_document_chunks"](spark, SF).collect()) == sum(r.text is not None for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
