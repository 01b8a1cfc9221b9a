"""Readers and writers of experiment files: summaries, paired datasets, conversation corpora, archives, tables."""

from __future__ import annotations

import io
import json
import re
import warnings
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.functions import udtf

from pairlens.functions.labels import header_key
from pairlens.operators.pairs import dense_ids

SUMMARY = "map<string, struct<sensitivity double, harmfulness double, total_runs bigint, prolog_uncertainty double, complexity_analysis map<string, struct<total_runs bigint, sensitivity double, harmfulness double, prolog_uncertainty double, quartiles array<double>>>>>"
# The keys under which prompts are found, in order, and the roles that ask.
PROMPT_KEYS = ("prompt", "question", "query", "input", "user", "content", "text", "message", "instruction", "request", "title", "body", "Prompt", "Question")
ASKING_ROLES = ("user", "human", "prompter", "questioner")
GIT_LFS = "version https://git-lfs"


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files as rows (file, value): the name is read from metadata, so names with glob characters do no harm."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("file"), "value")


def root_of(spark: SparkSession, path: str) -> str:
    """A folder as files' metadata spell it, ending in a slash."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString().rstrip("/") + "/"


def relative_path(spark: SparkSession, path: str) -> Column:
    """A file's path below the folder ``path``."""
    plain = lambda c: F.regexp_replace(F.url_decode(c), r"^file:/+", "/")
    return F.replace(plain(F.col("_metadata.file_path")), plain(F.lit(root_of(spark, path))), F.lit(""))


def _state(value: Column) -> Column:
    """What is wrong with an input: "empty", "pointer" (to large-file storage), "broken" (no JSON), or null if it is sound."""
    return F.when(~F.coalesce(value, F.lit("")).rlike(r"\S"), "empty").when(value.startswith(GIT_LFS), "pointer").when(F.try_parse_json(value).isNull(), "broken")


def sound(files: DataFrame, skipped: Observation | None = None) -> DataFrame:
    """Files that are not empty, no pointer to large-file storage, and hold JSON.

    With ``skipped``, the others are counted as they pass, with no pass of their own: once the result has been computed,
    ``skipped.get`` has n_inputs, n_empty, n_pointer and n_broken.
    """
    d = files.withColumn("_state", _state(F.col("value")))
    if skipped is not None:
        d = d.observe(skipped, F.count(F.lit(1)).alias("n_inputs"), *[F.count_if(F.col("_state").eqNullSafe(k)).alias(f"n_{k}") for k in ("empty", "pointer", "broken")])
    return d.where("_state IS NULL").drop("_state")


def skipped_inputs(files: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` inputs (by ``keys``) that ``sound`` leaves out, with what is wrong: keys, reason. For a capped warning."""
    return files.select(*keys, _state(F.col("value")).alias("reason")).where("reason IS NOT NULL").orderBy(*keys).limit(most)


def warn_of_skipped(files: DataFrame, keys: list[str], most: int = 10) -> None:
    """A warning for each of ``skipped_inputs``."""
    for r in skipped_inputs(files, keys, most).collect():
        warnings.warn(f"skipped ({r.reason}): {':'.join(str(r[k]) for k in keys)}", stacklevel=2)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary files, a row for each (file, bias) with its measures."""
    rows = sound(whole_files(spark, path, "*.json"))
    return rows.select("file", F.explode(F.from_json("value", SUMMARY)).alias("bias", "s")).select("file", "bias", "s.*")


def name_flags(files: DataFrame, strategies: DataFrame, column: str = "file") -> DataFrame:
    """Add model, flags (as a set), data_models (a list) and strategy from names like ``1_....model=M.flag=True.json``."""
    d = files.withColumn("model", F.nullif(F.regexp_extract(column, r"model=(.+?)(?:\.[A-Za-z_]+=|\.json$)", 1), F.lit("")))
    d = d.withColumn("flags", F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\.([a-z_]+)=True"), F.lit(1)))))
    # Data models are a list of quoted names, whatever else the name holds and in whatever order.
    listed = F.regexp_extract(column, r"data_model_list=\[([^\]]*)\]", 1)
    d = d.withColumn("data_models", F.array_sort(F.array_distinct(F.regexp_extract_all(listed, F.lit(r"'([^']+)'"), F.lit(1)))))
    return d.join(F.broadcast(strategies.select("strategy", F.col("flags").alias("_flags"))), F.col("flags") == F.col("_flags"), "left").drop("_flags")


def longest_name(files: DataFrame, keys: list[str], column: str = "file") -> DataFrame:
    """Of several files of one key, those of the longest name."""
    top = files.select(*keys, column).distinct()
    top = top.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.length(column).desc(), column))).where("_n = 1").drop("_n")
    return files.join(top, [*keys, column], "left_semi")


def tiers(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The tiers of summaries as facts: keys, tier, tier_total_cases and rates."""
    long = summary.select(*keys, F.explode("complexity_analysis").alias("tier", "t"))
    return long.select(*keys, "tier", F.col("t.total_runs").alias("tier_total_cases"), F.col("t.sensitivity").alias("tier_sensitivity"), F.col("t.harmfulness").alias("tier_harmfulness"))


def attrition(spark: SparkSession, path: str) -> DataFrame:
    """Discard counts by bias and filter, with totals (nulls stand for all)."""
    schema = "struct<discarded_dilemmas_count_by_filter_by_bias map<string, map<string, bigint>>>"
    rows = sound(whole_files(spark, path, "*.json")).select("file", F.from_json("value", schema)["discarded_dilemmas_count_by_filter_by_bias"].alias("m"))
    long = rows.select("file", F.explode("m").alias("filter", "by")).select("file", "filter", F.explode("by").alias("bias", "n"))
    return long.rollup("file", "bias", "filter").agg(F.sum("n").alias("discarded")).where("file IS NOT NULL")


def paired_datasets(spark: SparkSession, path: str, glob: str = "*_dataset_*.json", models: list[str] | None = None) -> DataFrame:
    """Paired prompts from JSON maps of bias to lists: bias, pair_id (file:pair, or file:place), texts; valid ones only.

    All files of the folder are one dataset, with the data_model that each one's name ends in, or only those of ``models``.
    """
    schema = "map<string, array<struct<pair string, biased string, unbiased string, correct_option string, axioms_description string, inference_steps int, choice_steps int, AI_generated boolean, valid boolean>>>"
    rows = sound(whole_files(spark, path, glob)).select("file", F.explode(F.from_json("value", schema)).alias("bias", "pairs"))
    rows = rows.select("file", "bias", F.posexplode("pairs").alias("place", "p")).select("file", "bias", "place", "p.*")
    stem = F.regexp_replace("file", r"\.json$", "")
    rows = rows.withColumn("data_model", F.regexp_extract(stem, r"_dataset_(.+)$", 1))
    if models is not None:
        rows = rows.where(F.col("data_model").isin(*models))
    rows = rows.withColumn("pair_id", F.concat_ws(":", stem, F.coalesce("pair", F.col("place").cast("string"))))
    return rows.where(F.coalesce("valid", F.lit(True)) & (F.length(F.trim("biased")) > 0) & (F.length(F.trim("unbiased")) > 0))


# What names of a pair's fields look like, and the name of a bias that none is given for.
FIELDS = {"bias": r"^(bias|bias_type|bias_name|type|category|label)$", "unbiased": r"unbiased|neutral", "biased": r"^(?!.*unbiased).*biased", "valid": r"^valid$"}
UNKNOWN_BIAS = "unknown"


def _pairs(df: DataFrame) -> DataFrame:
    """Trimmed pairs of columns bias, biased, unbiased, valid (all strings): none that is blank or not valid."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ok = F.coalesce(F.lower(F.trim("valid")) != "false", F.lit(True)) & (text("biased") != "") & (text("unbiased") != "")
    return df.where(ok).withColumns({"bias": F.coalesce(F.nullif(text("bias"), F.lit("")), F.lit(UNKNOWN_BIAS)), "biased": text("biased"), "unbiased": text("unbiased")}).drop("valid")


def paired_table(df: DataFrame) -> DataFrame:
    """Paired prompts from a table whose headers only look like bias, biased, unbiased and valid."""
    names = {c: header_key(c) for c in df.columns}
    found = {k: next((c for c, n in names.items() if re.search(pattern, n)), None) for k, pattern in FIELDS.items()}
    if found["biased"] is None or found["unbiased"] is None:
        raise ValueError(f"no columns for biased and unbiased in {df.columns}")
    return _pairs(df.select(*[(F.col(f"`{v}`").cast("string") if v else F.lit(None).cast("string")).alias(k) for k, v in found.items()]))


def paired_lists(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Paired prompts from JSON lists of objects whose keys only look like bias, biased, unbiased and valid: file, place,
    bias, biased, unbiased. Of several such keys the first counts; files that hold no list have none."""
    rows = sound(whole_files(spark, path, glob)).where(F.ltrim("value").startswith("["))
    rows = rows.select("file", F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("place", "item"))
    fields = F.transform(F.map_entries("item"), lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), "[^a-z0-9]+", "_").alias("name"), e["value"].alias("value")))
    rows = rows.withColumn("_fields", fields)
    pick = lambda pattern: F.try_element_at(F.filter("_fields", lambda f: f["name"].rlike(pattern)), F.lit(1))["value"]
    return _pairs(rows.select("file", "place", *[pick(p).alias(k) for k, p in FIELDS.items()]))


def read_separated(spark: SparkSession, path: str, required: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """A table with headers; without ``sep``, the separator that gives the required (else the most) columns."""
    if sep is None:
        head = spark.read.text(path).limit(1).first()
        line = head[0] if head else ""
        fields = {s: {header_key(x.strip('"')) for x in line.split(s)} for s in (",", ";", "\t", "|")}
        want = {header_key(r) for r in required or ()}
        sep = max(fields, key=lambda s: (want <= fields[s], len(fields[s])))
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')


def union_required(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """The required columns of all tables that have them, without rows that lack one."""
    frames = [read_separated(spark, p, required) for p in paths]
    frames = [f.select(*required) for f in frames if set(required) <= set(f.columns)]
    if not frames:
        raise ValueError(f"no file has the columns {required}")
    return reduce(DataFrame.unionByName, frames).dropna(subset=required)


def asking_turns(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.lower("role").isin(*ASKING_ROLES))


def first_prompt(df: DataFrame, keys: tuple[str, ...] = PROMPT_KEYS) -> Column:
    """The first prompt column of a table that is not blank."""
    have = [k for k in keys if k in df.columns]
    return F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in have]) if have else F.lit(None).cast("string")


def _prompts(value, keys: tuple[str, ...], whatever_role: bool = False):
    """Prompts of nested JSON in order: strings under ``keys``; messages of other roles than asking ones are left out with
    all that they hold, unless ``whatever_role``."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            role = v.get("role", v.get("from", v.get("author")))
            if isinstance(role, dict):
                role = role.get("role")
            if whatever_role or role is None or str(role).lower() in ASKING_ROLES:
                yield from (v[k].strip() for k in keys if isinstance(v.get(k), str) and v[k].strip())
                todo += reversed([x for x in v.values() if isinstance(x, (dict, list))])


@udtf(returnType="pos int, prompt string")
class ExtractPrompts:
    """Distinct prompts of a JSON text, in order. Text that is no JSON has none."""

    def eval(self, text: str, whatever_role: bool):
        try:
            value = json.loads(text or "")
        except ValueError:
            return
        for i, p in enumerate(dict.fromkeys(_prompts(value, PROMPT_KEYS, whatever_role))):
            yield i, p


@udtf(returnType="member string, value string")
class ZipMembers:
    """Text members of an archive, without resource forks."""

    def eval(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/") and "__MACOSX" not in name and not name.rsplit("/", 1)[-1].startswith("._"):
                    yield name, z.read(name).decode("utf-8", "replace")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``line``, a row's number in its file: numbers over all rows, less the first of the file."""
    numbered = dense_ids(rows, ["file", *order], "_row")
    first = numbered.groupBy("file").agg(F.min("_row").alias("_first"))
    return numbered.join(first, "file").withColumn("line", F.col("_row") - F.col("_first")).drop("_row", "_first", *order)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of .jsonl files: file (below ``path``), line (from 0), value. Files of any size are split, not read whole."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = rows.select(relative_path(spark, path).alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return _numbered(rows, ["_block", "_at"])


def separated_rows(spark: SparkSession, path: str, glob: str, sep: str) -> DataFrame:
    """Rows of all files of a folder in one plan, whatever their headers: file (below ``path``), line (from 0), header and
    fields (arrays of strings).

    Rows are read without headers under one schema that is as wide as the widest header of all; the first row of a file
    is the header of its others. A field that quotes hold may hold line ends, so a file is read by one task.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = reader.text(path).where(F.col("_metadata.file_block_start") == 0)
    width = lines.agg(F.max(F.size(F.split("value", re.escape(sep))))).first()[0]  # no less than any first line's fields
    if not width:
        return spark.createDataFrame([], "file string, line long, header array<string>, fields array<string>")
    names = [f"_c{i}" for i in range(width)]
    rows = reader.csv(path, schema=", ".join(f"{n} string" for n in names), sep=sep, multiLine=True, escape='"')
    rows = rows.select(relative_path(spark, path).alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.array(*names).alias("fields"))
    numbered = _numbered(rows, ["_block", "_at"])
    header = F.transform("fields", lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "^\ufeff", ""))
    heads = numbered.where("line = 0").select(F.col("file").alias("_file"), header.alias("header"))
    return numbered.where("line > 0").join(heads, F.col("file") == F.col("_file")).select("file", (F.col("line") - 1).alias("line"), "header", "fields")


def table_prompts(spark: SparkSession, path: str, keys: tuple[str, ...] = PROMPT_KEYS) -> DataFrame:
    """Prompts of .csv and .tsv files: file (below ``path``), line (from 0), prompt, the first of the columns ``keys`` that is not
    blank. Files with any headers are read together."""
    rows = separated_rows(spark, path, "*.csv", ",").unionByName(separated_rows(spark, path, "*.tsv", "\t"))
    held = lambda k: F.get("fields", (F.array_position("header", F.lit(k)) - 1).cast("int"))
    prompt = F.coalesce(*[F.when(F.array_contains("header", k), F.nullif(F.trim(held(k)), F.lit(""))) for k in keys])
    return rows.select("file", "line", prompt.alias("prompt")).where("prompt IS NOT NULL")


_EDGE = r"[\s\x1C-\x1F\x85\p{Z}]+"


def flat_prompts(value: Column, whatever_role: bool = False) -> Column:
    """The distinct prompts of a JSON object without nested ones, in the order of ``PROMPT_KEYS``: an array of strings.

    Its fields are read as variants: only strings are prompts. An object of a role that does not ask has none, unless
    ``whatever_role``.
    """
    v = F.try_parse_json(value)
    field = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    text = lambda k: F.regexp_replace(F.try_variant_get(v, f"$.{k}", "string"), f"^{_EDGE}|{_EDGE}$", "")
    found = F.array(*[F.when(F.schema_of_variant(field(k)) == "STRING", F.nullif(text(k), F.lit(""))) for k in PROMPT_KEYS])
    role = F.coalesce(*[field(k) for k in ("role", "from", "author")])
    asks = F.coalesce(F.lower(F.try_variant_get(role, "$", "string")).isin(*ASKING_ROLES), F.lit(True))
    every = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    return every if whatever_role else F.when(asks, every).otherwise(F.array().cast("array<string>"))


def is_flat(value: Column) -> Column:
    """Whether a JSON text is one object in which no brace or bracket stands, in a string or not."""
    return F.coalesce(value.rlike(r"^\s*\{[^{}\[\]]*\}\s*$"), F.lit(False))


def corpus_inputs(spark: SparkSession, path: str) -> DataFrame:
    """The JSON inputs of a folder: file (below ``path``), line, value. A .json file is one, each line of a .jsonl file is one."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return whole.select(relative_path(spark, path).alias("file"), F.lit(0).cast("long").alias("line"), "value").unionByName(json_lines(spark, path).select("file", "line", "value"))


def corpus(spark: SparkSession, path: str, legacy_recursive: bool = False, skipped: Observation | None = None) -> DataFrame:
    """Prompts of .json, .jsonl, .csv and .tsv files: file (below ``path``), idx, prompt. A line or row is a document of its own.

    Of messages only those of asking roles count, unless ``legacy_recursive``. Flat objects are read by expressions, nested
    ones by a table function. ``skipped`` counts the JSON inputs that are left out (see ``sound``).
    """
    rows = sound(corpus_inputs(spark, path), skipped).withColumn("_flat", is_flat(F.col("value")))
    flat = rows.where("_flat").select("file", "line", F.posexplode(flat_prompts(F.col("value"), legacy_recursive)).alias("pos", "prompt"))
    nested = rows.where("NOT _flat").lateralJoin(ExtractPrompts(F.col("value").outer(), F.lit(legacy_recursive))).select("file", "line", "pos", "prompt")
    found = flat.unionByName(nested).select("file", F.concat_ws(":", "line", "pos").alias("idx"), "prompt")
    return found.unionByName(table_prompts(spark, path).select("file", F.concat_ws(":", "line", F.lit(0)).alias("idx"), "prompt"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Members of the .zip files of a folder: file, member, value."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return rows.lateralJoin(ZipMembers(F.col("content").outer())).select("file", "member", "value")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Columns in fixed order; missing ones are blank."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields]).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
