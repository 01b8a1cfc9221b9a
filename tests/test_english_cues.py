"""Cues of the built-in codebook in texts whose letters, marks and white space lie beyond ASCII, by Spark and by SQL."""

import duckdb

from pairlens.plans import catalog

# Text, whether it asks for a choice, and whether a cue of overconfidence or one of confirmation stands in it.
ODD = [
    ("which is best?", 1, 0, 0), ("das besté", 0, 0, 0), ("éwhich", 0, 0, 0), ("whi\u0301ch", 0, 0, 0), ("best\u0301", 0, 0, 0), ("best\u0301 which", 1, 0, 0), ("\u0301best", 1, 0, 0),
    ("_\u0301best", 1, 0, 0), ("best²", 1, 0, 0), ("best٣", 0, 0, 0), ("beſt", 0, 0, 0), ("vs.x", 1, 0, 0), ("vs. é", 1, 0, 0), ("vsé", 0, 0, 0), ("should\x0bI", 1, 0, 0), ("should\u00a0I", 0, 0, 0), ("should\u0085I", 0, 0, 0),
    ("no\x0bdoubt", 0, 1, 0), ("I’m sure", 0, 1, 0), ("éI'm certain", 0, 0, 0), ("I think it, so validé confirm", 0, 0, 1), ("I still know\rright", 0, 0, 0),
    ("I still know\u2028right", 0, 0, 0), ("I still know\u0085right", 0, 0, 0), ("I still know é right", 0, 0, 1), ("I still knowé right", 0, 0, 0), (None, 0, 0, 0),
]


def test_odd_texts(spark, tmp_path):
    rows = [(i, 0, f"r{i}", text) for i, (text, *_) in enumerate(ODD)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.role: r.asDict() for r in catalog.QUERIES["english_cues"](spark, str(tmp_path)).collect()}
    assert [(r["decision_like"], r["overconfidence_cues"], r["confirmation_cues"]) for r in (got[f"r{i}"] for i in range(len(ODD)))] == [tuple(want) for _, *want in ODD]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE["english_cues"])
    assert {r[0]: dict(zip(want.columns, r, strict=True)) for r in want.fetchall()} == got
