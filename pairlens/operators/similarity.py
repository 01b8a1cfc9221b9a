"""Similarity of texts and vectors as joins: TF-IDF cosine, top-k, label vectors, near-duplicates, group means."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairlens.operators.shared import components, cut as lineage_cut, null_safe_join


#: Rows up to which a table is broadcast, labels that all meet every vector, rows of a block of which pairs are made, cosines at a time,
# vectors at a time that are sent to up to as many homes as there are pivots, members of sets that are given at a time.
FEW, LABELS, BLOCK, CELLS, VISITORS, MEMBERS = 500_000, 10_000, 10_000, 1 << 20, 64, 65_536


# Function words of English that say nothing of a text's subject; a list of this library's own.
ENGLISH_STOP = (
    "a an the this that these those i me my mine we us our ours you your yours he him his she her hers it its they them their theirs who whom whose which what "
    "and or but nor so if then than because while although though as until unless whether of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further once here there when where why how all any both each few more most other some such no not only own same too very just also even still yet "
    "is am are was were be been being have has had having do does did doing will would shall should can could may might must ought"
).split()


def words(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_grams(text: Column, most: int = 2, stop: list[str] | None = None) -> Column:
    """Words and runs of up to ``most`` words, without the words of ``stop``."""
    found = words(text) if not stop else F.filter(words(text), lambda x: ~x.isin(*stop))

    def runs(w: Column) -> Column:
        out, run = w, w
        for n in range(2, most + 1):  # each run and the word after it: the words are not read again for each place
            count = F.greatest(F.size(w) - (n - 1), F.lit(0))
            run = F.zip_with(F.slice(run, 1, count), F.slice(w, n, count), lambda x, y: F.concat_ws(" ", x, y))
            out = F.concat(out, run)
        return out

    return F.flatten(F.transform(F.array(found), runs))  # bound once: as an expression the words would be found for each use


def gram_hashes(text: Column, most: int = 2) -> Column:
    """Words and runs of up to ``most`` words as hashes: a run's is one of its words' hashes."""

    def runs(w: Column) -> Column:
        out, run = w, w
        for n in range(2, most + 1):
            count = F.greatest(F.size(w) - (n - 1), F.lit(0))
            run = F.zip_with(F.slice(run, 1, count), F.slice(w, n, count), lambda x, y: F.hash(x, y))
            out = F.concat(out, run)
        return out

    return F.flatten(F.transform(F.array(F.transform(words(text), lambda w: F.hash(w))), runs))


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside words that are padded with a blank on each side."""
    padded = F.transform(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def cut(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[cut(w, n) for n in range(least, most + 1)])))


def term_weights(docs: DataFrame, ident: str, grams: Column, block: list[str], vocabulary: DataFrame | None = None, min_df: int = 2, max_share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF weights (block, ident, term, w) of documents, and the vocabulary (block, term, idf) they are fitted on.

    With ``vocabulary`` the documents are queries against it, and only its terms are shuffled: once, by document.
    """
    terms = docs.select(*block, ident, F.explode(grams).alias("term"))
    if vocabulary is None:
        counts = terms.groupBy(*block, ident, "term").agg(F.count(F.lit(1)).alias("tf"))
        n = docs.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
        df = counts.groupBy(*block, "term").agg(F.count(F.lit(1)).alias("df"))
        df = df.join(n, block) if block else df.crossJoin(n)
        df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
        vocabulary = df.select(*block, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
        vocabulary = lineage_cut(vocabulary)
    few = F.broadcast(vocabulary) if vocabulary.count() <= FEW else vocabulary
    known = terms.join(few, [*block, "term"]).repartition(*block, ident)
    raw = known.groupBy(*block, ident, "term", "idf").agg(F.count(F.lit(1)).alias("tf")).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*block, ident)))
    return raw.withColumn("w", F.col("raw") / norm).select(*block, ident, "term", "w"), vocabulary


def _postings(fitted: DataFrame, vocabulary: DataFrame, doc_id: str, block: list[str]) -> dict:
    """By block: its terms, their idf, and term by term the documents that hold them with their weights (starts, documents, weights, ids)."""
    table = fitted.join(vocabulary, [*block, "term"]).toArrow()
    keys = list(zip(*[table[c].to_pylist() for c in block], strict=True)) if block else [()] * len(table)
    of: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        of.setdefault(key, []).append(i)
    out = {}
    for key, rows in of.items():
        part = table.take(rows).combine_chunks()
        term, doc = (part[c].combine_chunks().dictionary_encode("encode") for c in ("term", doc_id))
        code = term.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        idf = np.zeros(len(term.dictionary))
        idf[code] = part["idf"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(idf)))])
        out[key] = (term.dictionary, idf, starts, doc.indices.to_numpy()[order], part["w"].to_numpy()[order], doc.dictionary)
    return out


def _cosines(code: np.ndarray, row: np.ndarray, rows: int, index: tuple, k: int | None):
    """Triples (row, document, cosine) of rows whose known terms are ``code``, some rows at a time."""
    _, idf, starts, doc, weight, ids = index
    pair, tf = np.unique(row * len(idf) + code, return_counts=True)
    row, code = np.divmod(pair, len(idf))
    raw = tf * idf[code]
    raw /= np.sqrt(np.bincount(row, raw * raw, rows))[row]
    many = starts[code + 1] - starts[code]
    each = max(1, CELLS // len(ids))
    upto = np.concatenate([[0], np.cumsum(np.bincount(row, many, rows))])
    low = 0
    while low < rows:
        high = max(low + 1, min(low + each, int(np.searchsorted(upto, upto[low] + CELLS, "right")) - 1, rows))
        span = slice(*np.searchsorted(row, [low, high]))
        n = many[span]
        at = np.repeat(starts[code[span]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cells = np.repeat(row[span] - low, n) * len(ids) + doc[at]
        c = np.bincount(cells, np.repeat(raw[span], n) * weight[at], (high - low) * len(ids)).astype(float).reshape(high - low, len(ids))  # of no cells it counts in integers
        keep = c > 0
        if k is not None and k < len(ids):
            keep &= c >= np.partition(c, len(ids) - k, axis=1)[:, [len(ids) - k]] - 1e-6
        i, j = np.nonzero(keep)
        yield i + low, j, c[i, j]
        low = high


def _scored(shared, block: list[str], query_id: str, doc_id: str, k: int | None):
    """Batches of queries with their grams, scored against the postings of their block."""

    def score(batches):
        for batch in batches:
            keys = list(zip(*[batch[c].to_pylist() for c in block], strict=True)) if block else [()] * batch.num_rows
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                of.setdefault(key, []).append(i)
            for key, rows in of.items():
                if (index := shared.value.get(key)) is None or None in key:  # a null block equals none
                    continue
                mine = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
                code = pc.index_in(pc.list_flatten(mine["_grams"]), value_set=index[0])
                row = pc.list_parent_indices(mine["_grams"]).filter(code.is_valid()).to_numpy()
                for i, j, c in _cosines(code.drop_null().to_numpy(), row, mine.num_rows, index, k):
                    yield pa.RecordBatch.from_arrays([*[mine[x].take(pa.array(i)) for x in (*block, query_id)], index[5].take(pa.array(j)), pa.array(c)], [*block, query_id, doc_id, "score"])

    return score


def tfidf_cosine(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, grams, text: str, block: list[str], k: int | None = None, **limits) -> DataFrame:
    """Cosines above 0 of queries with the documents of their block: block, query_id, doc_id, score.

    Weights of up to ``FEW`` terms of documents are broadcast as postings, and each query is scored in its row, without a
    shuffle; with ``k`` only scores within 1e-6 of a query's k best or above are then given. Queries of an id that several
    rows have are one query, and so are scored by a join on terms, as all are where there are more weights.
    """
    fitted, vocabulary = term_weights(docs, doc_id, grams(F.col(text)), block, **limits)
    fitted = lineage_cut(fitted)

    def joined(part: DataFrame) -> DataFrame:
        asked, _ = term_weights(part, query_id, grams(F.col(text)), block, vocabulary)
        pairs = asked.withColumnRenamed("w", "wq").join(fitted, [*block, "term"])
        return pairs.groupBy(*block, query_id, doc_id).agg(F.sum(F.col("wq") * F.col("w")).alias("score"))

    if fitted.count() > FEW:
        return joined(queries)
    shared = queries.sparkSession.sparkContext.broadcast(_postings(fitted, vocabulary, doc_id, block))
    keys = [*block, query_id]
    again = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    repeated = again.limit(1).count() > 0
    single = null_safe_join(queries, again, keys, "left_anti") if repeated else queries
    fields = [StructField(x, single.schema[x].dataType) for x in keys]
    kinds = StructType([*fields, StructField(doc_id, docs.schema[doc_id].dataType), StructField("score", DoubleType())])
    scores = single.select(*keys, grams(F.col(text)).alias("_grams")).mapInArrow(_scored(shared, block, query_id, doc_id, k), kinds)
    return scores.unionByName(joined(null_safe_join(queries, again, keys, "left_semi"))) if repeated else scores


def best_label(queries: DataFrame, scores: DataFrame, query_id: str, label: str, labels: DataFrame, threshold: float) -> DataFrame:
    """The best label of each query (ties: the first in order), 0 and the first label without a score; and a flag."""
    top = scores.withColumn("_place", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), label))).where("_place = 1").drop("_place")
    first = labels.agg(F.min(label).alias("_first"))
    out = queries.select(query_id).join(top.select(query_id, label, "score"), query_id, "left").crossJoin(F.broadcast(first))
    score = F.coalesce("score", F.lit(0.0))
    return out.select(query_id, F.coalesce(label, "_first").alias(label), score.alias("score"), (score >= threshold).alias("mapped"))


def top_k(scores: DataFrame, query_id: str, doc_id: str, k: int, score: str = "score") -> DataFrame:
    """The k best documents of each query (ties by id), with their place from 0."""
    place = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc(score), doc_id)) - 1
    return scores.withColumn("place", place).where(F.col("place") < k)


def clean_vector(v: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))


def unit(v: Column) -> Column:
    """A vector at length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def label_vectors(df: DataFrame, label: str, vector: str, width: int) -> DataFrame:
    """The mean vector of each label, at length 1."""
    means = df.groupBy(label).agg(F.array(*[F.avg(F.col(vector)[i]) for i in range(width)]).alias("_mean"))
    return means.select(label, unit(F.col("_mean")).alias("label_vector"))


def nearest_labels(df: DataFrame, ident: str, vector: str, labels: DataFrame, label: str, k: int, threshold: float) -> DataFrame:
    """Each vector's k nearest label vectors, the best, and whether it reaches ``threshold``.

    Labels are a dimension: they are collected into one array that is broadcast, and no row multiplies. More than ``LABELS``
    are refused.
    """
    if (many := labels.count()) > LABELS:
        raise ValueError(f"{many} labels: more than {LABELS}")
    table = labels.agg(F.array_sort(F.collect_list(F.struct(label, "label_vector"))).alias("_labels"))
    near = F.transform("_labels", lambda r: F.struct((-F.round(dot(F.col("_v"), r["label_vector"]), 9)).alias("minus"), r[label].alias("label")))
    out = df.select(ident, unit(F.col(vector)).alias("_v")).crossJoin(F.broadcast(table)).withColumn("_top", F.slice(F.array_sort(near), 1, k))
    best = -F.col("_top")[0]["minus"]
    return out.select(ident, F.col("_top")[0]["label"].alias("best"), best.alias("score"), (best >= threshold).alias("mapped"), F.transform("_top", lambda r: r["label"]).alias("top"))


def mean_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine of the pairs of each group, from the length of the sum of its unit vectors: one pass, no pairs."""
    parts = df.select(group, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = parts.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return out.where("n > 1").select(group, "n", ((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def _refuse_large(df: DataFrame, block: str) -> None:
    most = df.groupBy(block).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > BLOCK:
        raise ValueError(f"a block of {block} has {most} rows: more than {BLOCK}, of which all pairs would be made")


def similar_pairs(df: DataFrame, block: str, ident: str, vector: str, least: float) -> DataFrame:
    """Pairs a < b of a block whose cosine is above ``least``: an equi-join on the block, checked before it is written.

    Blocks have to be small sets (a bias's pairs): one of over ``BLOCK`` rows is refused, see ``similar_pairs_tiled``.
    """
    _refuse_large(df, block)
    u = df.select(block, F.col(ident).alias("a"), unit(F.col(vector)).alias("va"))
    v = df.select(F.col(block).alias("_block"), F.col(ident).alias("b"), unit(F.col(vector)).alias("vb"))
    return u.join(v, (F.col(block) == F.col("_block")) & (F.col("a") < F.col("b"))).select(block, "a", "b", dot(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") > least)


def _product(block: str, least: float):
    """The similar pairs of two tiles, or of one with itself, by a matrix product."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        one = pdf[pdf["_tile"] == low]
        two = pdf[pdf["_tile"] == high]
        if not len(one) or not len(two):
            return pd.DataFrame({block: pdf[block][:0], "a": pdf["id"][:0], "b": pdf["id"][:0], "cosine": np.zeros(0)})
        c = np.stack(one["v"].to_list()) @ np.stack(two["v"].to_list()).T
        i, j = np.nonzero(c > least)
        x, y = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
        keep = x < y if low == high else x != y
        x, y, c = x[keep], y[keep], c[i, j][keep]
        return pd.DataFrame({block: pdf[block].iloc[0], "a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": c})

    return product


def similar_pairs_tiled(df: DataFrame, block: str, ident: str, vector: str, least: float, rows: int = 1024) -> DataFrame:
    """Like ``similar_pairs`` for blocks of any size: a block is dealt to tiles of about ``rows``, and each pair of tiles
    is a task's matrix product. Vectors have one width; ids are longs, one for each row."""
    parts = df.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    v = df.select(block, F.col(ident).cast("long").alias("id"), unit(F.col(vector)).alias("v")).join(parts, block)
    v = v.withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    v = v.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    v = v.select(block, F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"), "_tile", "id", "v")

    return v.groupBy(block, "_low", "_high").applyInPandas(_product(block, least), f"{block} {df.schema[block].dataType.simpleString()}, a long, b long, cosine double")


def similar_pairs_pruned(df: DataFrame, block: str, ident: str, vector: str, least: float, pivots: int = 64, rows: int = 1024) -> DataFrame:
    """Like ``similar_pairs_tiled``, exactly, but only vectors that can be similar meet: for high ``least`` and large blocks.

    A vector is at home with its nearest of ``pivots`` vectors (drawn by a hash of the id). Of two that are similar, at home
    with c and d, the leads of x for c over d and of y for d over c add up to no more than the length of x - y times that of
    c - d; so one of them is at most half of that, and the vector that has it visits the other's home. There they are
    compared in tiles of about ``rows``. Zero vectors are similar to none.
    """
    half = float(np.sqrt(max(0.0, 2 - 2 * least)) / 2)
    v = df.select(block, F.col(ident).cast("long").alias("id"), unit(F.col(vector)).alias("v")).where(F.exists("v", lambda x: x != 0))
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()["v"].to_pylist()
    kind = df.schema[block].dataType.simpleString()
    if not drawn:
        return df.sparkSession.createDataFrame([], f"{block} {kind}, a long, b long, cosine double")
    c = np.array(drawn)

    def housed(parts):
        for pdf in parts:
            for low in range(0, len(pdf), VISITORS):
                part = pdf.iloc[low : low + VISITORS]
                near = np.stack(part["v"].to_list()) @ c.T
                own = near.argmax(axis=1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * c[own] @ c.T))
                row, cell = np.nonzero(near.max(axis=1)[:, None] - near <= half * gap + 1e-9)
                out = part.iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell, home=own[row] == cell)

    met = v.mapInPandas(housed, f"{block} {kind}, id long, v array<double>, cell int, home boolean")
    share = lambda home: F.ceil(F.count_if(home) / rows).cast("int")
    sizes = met.groupBy(block, "cell").agg(share(F.col("home")).alias("_homes"), share(~F.col("home")).alias("_guests")).where("_homes > 0")
    met = met.join(sizes, [block, "cell"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("_homes")).otherwise(F.col("_guests"))).cast("int")
    each = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda i: i < F.col(n))
    among = F.transform(each("_homes"), lambda i: F.struct(F.least(own, i).alias("low"), F.greatest(own, i).alias("high")))
    hosts = F.transform(each("_guests"), lambda i: F.struct(own.alias("low"), (F.col("_homes") + i).alias("high")))
    guests = F.transform(each("_homes"), lambda i: F.struct(i.alias("low"), (F.col("_homes") + own).alias("high")))
    tile = F.when(F.col("home"), own).otherwise(F.col("_homes") + own)
    met = met.withColumn("_to", F.explode(F.when(F.col("home"), F.concat(among, hosts)).otherwise(guests)))
    met = met.select(block, "cell", F.col("_to.low").alias("_low"), F.col("_to.high").alias("_high"), tile.alias("_tile"), "id", "v")
    found = met.groupBy(block, "cell", "_low", "_high").applyInPandas(_product(block, least), f"{block} {kind}, a long, b long, cosine double")
    return found.groupBy(block, "a", "b").agg(F.max("cosine").alias("cosine"))  # two may meet in both homes


def similarity_to(df: DataFrame, ident: str, vector: str, one: DataFrame, name: str = "similarity") -> DataFrame:
    """Cosine of every vector with the one vector of ``one`` (its first row): ident, ``name``."""
    asked = one.select(unit(F.col(vector)).alias("_one")).limit(1)
    return df.crossJoin(F.broadcast(asked)).select(ident, dot(unit(F.col(vector)), F.col("_one")).alias(name))  # one row


def greedy_sets(pairs: DataFrame) -> DataFrame:
    """Sets of similar rows grown in the order of ``pairs`` (a < b, by a, then b): a row (label, set_id, id) for each member.

    A pair adds the end that a set lacks to every set that has the other end; if none has either, it opens a set. So a
    row can be in several sets, and sets that come to touch stay apart. What a pair does depends on the pairs of its
    component alone, so each component is grown by itself; ``label`` names it. Its pairs pass in order, and only its sets are held.
    """
    found = components(pairs)
    known = pairs.select("a", "b").join(found, F.col("a") == F.col("id")).select("label", "a", "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def grow(parts):
        label, last, sets, of = None, None, [], {}

        def members():
            rows = ((k, x) for k, found in enumerate(sets) for x in found)
            while some := list(islice(rows, MEMBERS)):
                yield pd.DataFrame({"label": label, "set_id": [k for k, _ in some], "id": [x for _, x in some]})

        for pdf in parts:
            for now, a, b in zip(pdf["label"], pdf["a"], pdf["b"], strict=True):
                if now != label:
                    yield from members()
                    label, last, sets, of = now, None, [], {}
                if (a, b) == last:
                    continue
                last = (a, b)
                one, two = list(of.get(a, ())), list(of.get(b, ()))
                for k in one:
                    if b not in sets[k]:
                        sets[k].add(b)
                        of.setdefault(b, []).append(k)
                for k in set(two) - set(one):
                    sets[k].add(a)
                    of.setdefault(a, []).append(k)
                if not one and not two:
                    for x in (a, b):
                        of.setdefault(x, []).append(len(sets))
                    sets.append({a, b})
        yield from members()

    return known.repartition("label").sortWithinPartitions("label", "a", "b").mapInPandas(grow, f"label {kind}, set_id long, id {kind}")


def keep_first_of_similar(df: DataFrame, ident: str, pairs: DataFrame, mode: str = "components") -> DataFrame:
    """Rows but those that similar ones make superfluous under ``pairs`` (a < b).

    "components": the smallest id of each component stays. "greedy": of each of ``greedy_sets`` all but the smallest go, so
    what stays depends on the order of the pairs: never more than of "components" go.
    """
    if mode == "greedy":
        sets = greedy_sets(pairs)
        first = sets.groupBy("label", "set_id").agg(F.min("id").alias("_first"))
        gone = sets.join(first, ["label", "set_id"]).where("id <> _first").select(F.col("id").alias(ident)).distinct()
    else:
        gone = components(pairs).where("id <> label").select(F.col("id").alias(ident))
    return df.join(gone, ident, "left_anti")


def mean_levenshtein(df: DataFrame, group: str, ident: str, text: str, rows: int = 256) -> DataFrame:
    """Mean edit similarity of the pairs of each group, by tiles of about ``rows`` rows: each two tiles of a group are joined by
    themselves, so a group's pairs are dealt to many tasks and summed where they are made."""
    from pairlens.functions.text import levenshtein_similarity

    parts = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    d = df.select(group, F.col(ident).alias("_id"), F.col(text).alias("_text")).join(parts, group)
    d = d.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    one = d.withColumn("_other", F.explode(F.sequence(F.col("_tile"), F.col("_parts") - 1))).select(group, F.col("_tile").alias("_low"), F.col("_other").alias("_high"), F.col("_id").alias("_a"), F.col("_text").alias("_ta"))
    two = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tile")))).select(group, F.col("_other").alias("_low"), F.col("_tile").alias("_high"), F.col("_id").alias("_b"), F.col("_text").alias("_tb"))
    pairs = one.join(two, [group, "_low", "_high"]).where((F.col("_low") < F.col("_high")) | (F.col("_a") < F.col("_b")))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.avg(levenshtein_similarity(F.col("_ta"), F.col("_tb"))).alias("mean_similarity"))


def correlations(cells: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Correlation of every two columns of a matrix over its rows; 0 where it is undefined. A row of over ``BLOCK`` cells is refused."""
    _refuse_large(cells, key)
    a = cells.select(key, F.col(column).alias("a"), F.col(value).alias("va"))
    b = cells.select(key, F.col(column).alias("b"), F.col(value).alias("vb"))
    r = F.corr("va", "vb")
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("r"))
