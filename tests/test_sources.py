import json
import zipfile

from pyspark.sql import functions as F

from pairlens.functions import labels as L
from pairlens.sources import files as S


def test_summaries(spark, tmp_path):
    body = {"anchoring": {"sensitivity": 0.1, "total_runs": 5, "complexity_analysis": {"low": {"total_runs": 2, "sensitivity": 0.5}}}}
    for name in ("1_x.model=m1.json", "1_x.model=m1.bias_warning=True.json", "1_x.model=m1.chain_of_thought=True.data [a,'b'].json"):
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    d = S.name_flags(S.summaries(spark, str(tmp_path)), L.strategies(spark))
    assert {r.strategy for r in d.collect()} == {"Ø", "BW", "CoT"}
    assert S.tiers(d, ["strategy", "bias"]).where("tier = 'low'").select("tier_total_cases").distinct().collect()[0][0] == 2
    longest = S.longest_name(d, ["model"]).collect()
    assert len(longest) == 1 and longest[0].strategy == "CoT"


def test_paired_datasets(spark, tmp_path):
    pair = {"biased": "b", "unbiased": "u", "correct_option": "A"}
    (tmp_path / "1_dataset_x.json").write_text(json.dumps({"framing": [{**pair, "pair": "p9"}, {**pair, "valid": False}, pair, {**pair, "biased": " "}]}))
    assert sorted(r.pair_id for r in S.paired_datasets(spark, str(tmp_path)).collect()) == ["1_dataset_x:2", "1_dataset_x:p9"]
    (tmp_path / "t.csv").write_text("Bias Type;Unbiased prompt;Biased prompt\nframing; u ;b\n")
    assert [tuple(r) for r in S.paired_table(S.read_separated(spark, str(tmp_path / "t.csv"), ["bias type"])).collect()] == [("framing", "u", "b")]


def test_corpus(spark, tmp_path):
    talk = {"conversations": [{"role": "user", "content": " ask "}, {"role": "assistant", "content": "tell"}, {"role": "user", "content": "ask"}], "meta": {"title": "topic"}}
    (tmp_path / "a.json").write_text(json.dumps(talk))
    (tmp_path / "b.jsonl").write_text(json.dumps({"prompt": "one"}) + "\n{broken\n" + json.dumps({"question": "two"}) + "\n")
    (tmp_path / "c.json").write_text("version https://git-lfs.github.com/spec/v1\noid")
    got = [(r.file, r.prompt) for r in S.corpus(spark, str(tmp_path)).orderBy("file", "idx").collect()]
    assert got == [("a.json", "ask"), ("a.json", "topic"), ("b.jsonl", "one"), ("b.jsonl", "two")]


def test_archive_and_union(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/a.csv", "a,b,c\n1,2,3\n")
        z.writestr("__MACOSX/._a.csv", "junk")
    assert [(r.member, r.value) for r in S.archive(spark, str(tmp_path)).collect()] == [("x/a.csv", "a,b,c\n1,2,3\n")]
    (tmp_path / "1.csv").write_text("a,b,c\n1,2,3\n,5,6\n")
    (tmp_path / "2.csv").write_text("a,z\n1,2\n")
    assert [tuple(r) for r in S.union_required(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], ["a", "b"]).collect()] == [("1", "2")]
    S.write_csv(spark.range(1).select(F.lit("x").alias("p")), str(tmp_path / "out"), ["q", "p"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["q", "p"]


def test_attrition(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"discarded_dilemmas_count_by_filter_by_bias": {"f1": {"b1": 2, "b2": 3}, "f2": {"b1": 5}}}))
    got = {(r.bias, r["filter"]): r.discarded for r in S.attrition(spark, str(tmp_path)).collect()}
    assert got[(None, None)] == 10 and got[("b1", None)] == 7 and got[("b1", "f2")] == 5


def test_prompts_of_rows(spark):
    df = spark.createDataFrame([("", " q "), ("p", "q")], "prompt string, question string")
    assert [r[0] for r in df.select(S.first_prompt(df)).collect()] == ["q", "p"]


def test_corpus_layouts(spark, tmp_path):
    """Paths below the folder, line numbers, tables with their own headers."""
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text("".join(json.dumps({"prompt": f"p{i}"}) + "\n" for i in range(50)))
    (tmp_path / "x" / "t.csv").write_text('id,Question\n1,"one, two"\n2,\n3,three\n')
    (tmp_path / "t.tsv").write_text("text\tz\nfour\t1\n")
    got = {(r.file, r.idx): r.prompt for r in S.corpus(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[0] == "x/a.jsonl"} == {("x/a.jsonl", f"{i}:0"): f"p{i}" for i in range(50)}
    assert {k: v for k, v in got.items() if k[0] != "x/a.jsonl"} == {("x/t.csv", "0:0"): "one, two", ("x/t.csv", "2:0"): "three", ("t.tsv", "0:0"): "four"}


def test_pairs_with_fuzzy_names(spark, tmp_path):
    items = [{"Type": "framing", "Biased Prompt": " b ", "Neutral": "u"}, {"biased": "b", "unbiased": "u", "valid": False}, {"biased": "b", "unbiased": " "}, {"unbiased_text": "v", "text biased": "w", "valid": True}]
    (tmp_path / "l.json").write_text(json.dumps(items))
    assert [(r.place, r.bias, r.biased, r.unbiased) for r in S.paired_lists(spark, str(tmp_path)).orderBy("place").collect()] == [(0, "framing", "b", "u"), (3, "unknown", "w", "v")]
    table = spark.createDataFrame([("b", "u", "False"), ("c", "d", "true")], "biased string, unbiased string, valid string")
    assert [tuple(r) for r in S.paired_table(table).collect()] == [("unknown", "d", "c")] and S.paired_table(table).columns == ["bias", "unbiased", "biased"]


def test_data_models_of_names(spark):
    d = spark.createDataFrame([("1_x.model=m1.bias_warning=True.data_model_list=['b', 'a'].json",)], "file string")
    r = S.name_flags(d, L.strategies(spark)).first()
    assert r.data_models == ["a", "b"] and r.strategy == "BW"


def test_json_lines_sink(spark, tmp_path):
    S.write_jsonl(spark.createDataFrame([(1, "x")], "a long, b string"), str(tmp_path / "o"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "o")).collect()] == [(1, "x")]


def test_roles_at_any_depth(spark, tmp_path):
    talk = {"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "tell", "parts": [{"text": "inner"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(talk))
    assert [r.prompt for r in S.corpus(spark, str(tmp_path)).collect()] == ["ask"]
    assert [r.prompt for r in S.corpus(spark, str(tmp_path), legacy_recursive=True).orderBy("idx").collect()] == ["ask", "tell", "inner"]


def test_tables_of_many_headers_in_one_plan(spark, tmp_path):
    """Each file by its own header, all in one plan; keys by rank, not by place; quotes, line ends, marks, empty files."""
    keys = ("prompt", "text", "Question", "body")
    want = set()
    for i in range(120):
        names = [f"c{j}" for j in range(i % 7)] + [keys[i % 4]]
        (tmp_path / f"{i:03}.csv").write_text(",".join(names) + "\n" + ",".join("-" * (len(names) - 1)) + "," * (len(names) > 1) + f'"ask {i}, ""now""\nand then"\n' + "\n" + "," * (len(names) - 1) + " \n")
        want.add((f"{i:03}.csv", 0, f'ask {i}, "now"\nand then'))
    (tmp_path / "b.csv").write_text("\ufefftext,prompt\nlow,high\nonly,\n", encoding="utf-8")
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t.tsv").write_text("id\tmessage\n1\tsay, it\n")
    want |= {("b.csv", 0, "high"), ("b.csv", 1, "only"), ("d/t.tsv", 0, "say, it")}
    found = S.table_prompts(spark, str(tmp_path))
    assert {(r.file, r.line, r.prompt) for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan csv") <= 2
    (tmp_path / "nothing").mkdir()
    assert S.table_prompts(spark, str(tmp_path / "nothing")).count() == 0


def test_skipped_inputs_are_counted(spark, tmp_path):
    import warnings

    from pyspark.sql import Observation

    (tmp_path / "a.json").write_text(json.dumps({"prompt": "one"}))
    (tmp_path / "b.json").write_text("version https://git-lfs.github.com/spec/v1\noid")
    (tmp_path / "c.json").write_text(" \n")
    (tmp_path / "d.jsonl").write_text('{"prompt": "two"}\n{broken\n[1\n\n')
    skipped = Observation("skipped")
    assert {r.prompt for r in S.corpus(spark, str(tmp_path), skipped=skipped).collect()} == {"one", "two"}
    assert skipped.get == {"n_inputs": 7, "n_empty": 2, "n_pointer": 1, "n_broken": 2}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        S.warn_of_skipped(S.corpus_inputs(spark, str(tmp_path)), ["file", "line"], 3)
    assert [str(w.message) for w in said if "skipped" in str(w.message)] == ["skipped (pointer): b.json:0", "skipped (empty): c.json:0", "skipped (broken): d.jsonl:1"]


def test_flat_objects_like_nested_ones(spark):
    """Expressions over variants give what the table function gives."""
    import random

    rng = random.Random(4)
    values = ["x", " y ", "", None, 3, 1.5, True, "\u2003wide\u00a0", "x", "q\"uote", "a b"]
    docs = [json.dumps({k: rng.choice(values) for k in rng.sample([*S.PROMPT_KEYS, "other", "id"], rng.randrange(9))} | ({rng.choice(["role", "from", "author"]): rng.choice(["user", "Human", "assistant", None, 7, "system"])} if rng.random() < 0.6 else {})) for _ in range(300)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, value string")
    assert df.where(S.is_flat(F.col("value"))).count() == 300 and not spark.createDataFrame([('{"a": {"b": 1}}',), ("[1]",), ("3",)], "value string").where(S.is_flat(F.col("value"))).count()
    for whatever in (False, True):
        got = {r.i: r.p for r in df.select("i", S.flat_prompts(F.col("value"), whatever).alias("p")).collect()}
        assert got == {i: list(dict.fromkeys(S._prompts(json.loads(d), S.PROMPT_KEYS, whatever))) for i, d in enumerate(docs)}


def test_stream_scores_each_key_once(spark, tmp_path):
    """Over restarts, a batch that is run again, and answers that were null; buckets are read as they are needed."""
    from pairlens.streaming import resume

    asked, lost = [], {"b"}

    def scorer(d):
        asked.extend(r.key for r in d.select("key").collect())
        return d.select("key", F.when(~F.col("key").isin(list(lost) or [""]), F.upper("key")).alias("answer"))

    def feed(name, keys):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"key": k}) + "\n" for k in keys))
        stream = spark.readStream.schema("key string").json(str(tmp_path / "in"))
        resume.score_stream(stream, "key", scorer, str(tmp_path / "out"), str(tmp_path / "state"), buckets=8).awaitTermination()
        return sorted((r.key, r.answer) for r in resume.scored(spark, str(tmp_path / "out")).where("answer IS NOT NULL").collect())

    assert resume.scored(spark, str(tmp_path / "out")) is None
    assert feed("1", ["a", "a", "b", "c"]) == [("a", "A"), ("c", "C")] and sorted(asked) == ["a", "b", "c"]
    asked.clear()
    lost.clear()
    assert feed("2", ["c", "b", "d", "a"]) == [(k, k.upper()) for k in "abcd"] and sorted(asked) == ["b", "d"]
    asked.clear()
    # The last batch again, as after a failure before its commit.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert feed("3", []) == [(k, k.upper()) for k in "abcd"] and sorted(asked) == ["b", "d"]
