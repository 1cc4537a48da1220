"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

(1) The index: every occurrence of a benchmark term in the corpus as (document, position, term), written once; a
last posting per document holds its word count. (2) Each benchmark window names its two rarest terms by corpus
frequency. Their lists, shifted by the term's place in the item, are intersected: the aggregation keeps the
(document, item, shift) that both lists have. (3) Each survivor is compared word by word, whole windows are kept.

A window is searched by its two rarest terms, so frequent terms are joined only for items that have no others; a
passage that many documents share makes one row per document. The benchmark's vocabulary, its items and the
candidate ids are broadcast only if their measured bytes are few; beyond that they are shuffled, where the
frequent words of a corpus are left to adaptive skew joins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import read_table, written

WINDOW = 13
#: Words after A-Z has been folded: anything but ASCII other than digits and a-z.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before folding.
UNFOLDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Not a word; its posting's position is the document's word count.
END_MARK, END_TERM = "\x00", -1
#: Bytes (of texts, and 64 for each row) up to which a table is broadcast.
BROADCAST_BYTES = 8 << 20


def fold(word: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNFOLDED), F.lit(0))


def bounded(df: DataFrame, *texts: Column) -> DataFrame:
    """Marked for broadcast if its rows and the bytes of ``texts``, measured here, are few enough."""
    sizes = [F.coalesce(F.sum(F.octet_length(x)), F.lit(0)) for x in texts]
    row = df.agg(F.count("*").alias("n"), *[x.alias(f"s{k}") for k, x in enumerate(sizes)]).first()
    return F.broadcast(df) if 64 * row["n"] + sum(row[1:]) <= BROADCAST_BYTES else df


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, th, pos, t) of each occurrence of a term of ``vocabulary`` (term, t), positions from 0."""
    marked = F.concat(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(END_MARK)))
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(marked).alias("pos", "word"))
    return each.withColumn("term", fold(F.col("word"))).join(bounded(vocabulary, F.col("term")), "term").select("doc_id", "th", "pos", "t")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(row, item_id, words) of the items that have a word; row numbers them."""
    words = F.transform(tokens(F.col("text")), fold)
    return benchmark.select("item_id", words.alias("words")).where("size(words) > 0").distinct().withColumn("row", F.monotonically_increasing_id())


def rarest_pairs(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(row, off, t, pair, need): for each distinct choice of a window's two rarest places, one row per place.

    A window with a term that the corpus lacks is left out. ``need`` is the number of places: 1 for one word.
    """
    placed = items.select("row", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    known = placed.join(frequency, "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - window + 1), F.least(F.col("off"), F.greatest(F.lit(0), F.col("n") - window)))
    by_window = known.withColumn("start", F.explode(starts)).groupBy("row", "start").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "off", "t"))).alias("terms")
    )
    usable = by_window.where(F.col("terms")[0]["f"] > 0)
    chosen = usable.select("row", F.slice(F.transform("terms", lambda x: F.struct(x["off"].alias("off"), x["t"].alias("t"))), 1, 2).alias("terms")).distinct()
    return chosen.select("row", F.xxhash64("terms").alias("pair"), F.size("terms").alias("need"), F.explode("terms").alias("x")).select("row", "pair", "need", "x.off", "x.t")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Exact phrase matches, and the documents with their word counts.

    The first has (doc_id, th, item_id, starts, width): the places in the document where windows of the item's
    words begin, once for rows of one doc_id and text. The second has (doc_id, th, n_words) of every row. th is the
    text's xxhash64.
    """
    items = written(benchmark_items(benchmark), "decontaminate-items")
    terms = items.select(F.explode("words").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
    mark = docs.sparkSession.createDataFrame([(END_MARK, END_TERM)], "term string, t long")
    vocabulary = written(terms.union(mark), "decontaminate-terms")
    index = written(postings(docs, vocabulary), "decontaminate-postings")
    counted = index.where(F.col("t") == END_TERM).select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))

    frequency = index.where(F.col("t") != END_TERM).groupBy("t").agg(F.count("*").alias("f")).join(vocabulary, "t")
    pairs = written(rarest_pairs(items, frequency, window), "decontaminate-pairs")
    probes = bounded(pairs)
    shifted = index.join(probes, "t").select("doc_id", "th", "row", "pair", "need", (F.col("pos") - F.col("off")).alias("shift"), "off")
    both = shifted.groupBy("doc_id", "th", "row", "pair", "need", "shift").agg(F.count_distinct("off").alias("found"))
    survivors = written(both.where("found = need").select("doc_id", "th", "row", "shift").distinct(), "decontaminate-survivors")

    ids = written(survivors.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).distinct(), "decontaminate-ids")
    held = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(bounded(ids), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left_semi")
    texts = held.distinct().select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), F.transform(tokens(F.col("text")), fold).alias("text_words"))
    lined = (
        survivors.join(bounded(items, F.concat_ws(" ", "words")), "row")
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("item_id", "words", "shift")).alias("lines"))
        .join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")))
    )
    width = lambda words: F.least(F.size(words), F.lit(window))
    agree = lambda line: F.transform(line["words"], lambda w, i: F.coalesce(F.get(F.col("text_words"), (line["shift"] + i).cast("int")) == w, F.lit(False)))
    whole = lambda same, w: F.filter(F.sequence(F.lit(0), F.size(same) - w), lambda i: F.forall(F.slice(same, i + 1, w), lambda x: x))
    compared = F.transform("lines", lambda line: F.struct(line["item_id"].alias("item_id"), line["shift"].alias("shift"), agree(line).alias("same"), width(line["words"]).alias("width")))
    found = lined.select("doc_id", "th", compared.alias("lines")).select(
        "doc_id",
        "th",
        F.transform(
            "lines",
            lambda line: F.struct(line["item_id"].alias("item_id"), F.transform(whole(line["same"], line["width"]), lambda i: (line["shift"] + i).cast("long")).alias("starts"), line["width"].cast("long").alias("width")),
        ).alias("lines"),
    )
    return found.select("doc_id", "th", F.filter("lines", lambda line: F.size(line["starts"]) > 0).alias("lines")).where("size(lines) > 0"), counted


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean. Items without a word match nothing; an item with a null id
    marks words but is not counted or named. Items that share an id count once. Repeated rows of documents are
    judged each. Empty tables give no rows, or no hits. Other columns are ignored. A text's words must fit in a row.
    """
    lines, counted = matches(docs, benchmark, window)
    spans = F.array_sort(F.flatten(F.transform("lines", lambda line: F.transform(line["starts"], lambda s: F.struct(s.alias("s"), (s + line["width"]).alias("e"))))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).cast("long").alias("n"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda line: line["item_id"].cast("string")), lambda x: x.isNotNull())))
    found = lines.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), F.aggregate(spans, zero, add)["n"].alias("n_hit"), names.alias("names"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("names", F.array().cast(T.ArrayType(T.StringType())))
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left").select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, place): where all words of a phrase stand within ``slop`` words of their places in it.

    Starts from the phrase's rarest word in the corpus; each further word adds one intersection of shifted lists,
    whose keys are the shift's cell of ``slop`` + 1 and its neighbours. phrases: (item_id, text) of few words each.
    """
    items = written(benchmark_items(phrases), "proximity-items")
    placed = written(items.select("row", "item_id", F.posexplode("words").alias("off", "term")), "proximity-terms")
    vocabulary = placed.select("term").distinct().withColumn("t", F.xxhash64("term"))
    index = written(postings(docs, vocabulary), "proximity-postings")
    frequency = index.groupBy("t").agg(F.count("*").alias("f"))
    ranked = placed.withColumn("t", F.xxhash64("term")).join(frequency, "t", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("f", "off", "t")))
    terms = ranked.groupBy("row", "item_id").agg(order.alias("terms")).select("row", "item_id", F.size("terms").alias("need"), F.posexplode("terms").alias("rank", "x")).select("row", "item_id", "need", "rank", "x.off", "x.t")
    shifted = index.join(terms, "t").withColumn("shift", F.col("pos") - F.col("off"))
    cell = F.floor(F.col("shift") / (slop + 1))
    anchors = shifted.where("rank = 0").select("doc_id", "th", "row", "item_id", "need", F.col("shift").alias("place"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    others = shifted.where("rank > 0").select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), F.col("row").alias("o_row"), "rank", "shift", cell.alias("o_cell"))
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th")) & (F.col("row") == F.col("o_row")) & (F.col("cell") == F.col("o_cell"))
    near = anchors.join(others, same & (F.abs(F.col("place") - F.col("shift")) <= slop), "left")
    return near.groupBy("doc_id", "th", "row", "item_id", "need", "place").agg(F.count_distinct("rank").alias("found")).where("found = need - 1").select("doc_id", "item_id", F.col("place").cast("long").alias("place"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("th")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts stay. Repeated rows stay or go together; an empty table, or an
    empty benchmark, takes nothing out; other columns stay."""
    bad = hits(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"]) == F.col("__bad_th")), "left_anti")


OP6_SQL = r"""
with d as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), items as (select item_id, w, least(13, len(w)) k from b where len(w) > 0
), windows as (
  select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) i from items)
), places as (select r, w, unnest(range(1, len(w) + 1)) p from d
), grams as (
  select r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') g
  from places, (select distinct k from windows) where p + k - 1 <= len(w)
), found as (select distinct r, p, k, item_id from grams join windows using (k, g)
), words as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + k)) q from found) group by r
), named as (
  select r, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256
  from (select distinct r, cast(item_id as varchar) item from found where item_id is not null) group by r
)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (r) left join named using (r)
"""
