"""Ranked lexical search: three-phase threshold search (TPUT) over term-partitioned postings.

The index is a table of postings: a row for each term that is asked for and each document that holds it, dealt out by
term, long lists in pieces, each piece in order of impact. All items are ranked together:

1. the heads of the lists give documents partial scores; an item's k-th best partial score bounds its k-th score;
2. that bound, shared out equally among the item's terms, is the threshold down to which every list is read. What a
   list has not shown of a document is less than the threshold, so a document whose partial score and these rests
   cannot reach the k-th best partial score is out;
3. the exact scores of the others are looked up in the lists.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize, partitions_for

#: Bytes of a text to those of its terms: ASCII letters lower-cased, other ASCII but digits to spaces, the rest as it is.
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: Postings of a piece of a list, about.
PIECE = 1 << 16
#: Bytes of postings a partition of the index, about.
INDEX_BYTES = 32 << 20


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: maximal runs of letters and digits of ASCII and of all other code points; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_key, term): the distinct terms of each distinct row; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t.decode("utf-8", "surrogatepass") for t in set(terms(x))] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["item", "item_key", "found"])

    rows = items.select(F.col(key).cast("long").alias("item_key"), F.col(text).cast("string").alias("text")).distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_key", "text")
    return rows.mapInArrow(run, "item long, item_key long, found array<string>").select("item", "item_key", F.explode("found").alias("name"))


def forward(docs: DataFrame, key: str, text: str, names: dict[str, int] | None) -> DataFrame:
    """(row, doc, n, found): the number of terms of each document, and its asked terms with their occurrences.

    With ``names``, the numbers of the asked terms, ``found`` has these; without, all terms by name.
    """
    known = docs.sparkSession.sparkContext.broadcast(None if names is None else {k.encode("utf-8", "surrogatepass"): v for k, v in names.items()})
    kind = pa.string() if names is None else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ends, which, times = [], [0], [], []
                for x in part.column(1).to_pylist():
                    ts = terms(x)
                    counts = Counter(ts)
                    n.append(len(ts))
                    own = counts if asked is None else counts.keys() & asked.keys()
                    which += [t.decode("utf-8", "surrogatepass") for t in own] if asked is None else map(asked.__getitem__, own)
                    times += map(counts.__getitem__, own)
                    ends.append(len(which))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((which, kind), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "which", "times"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, f"doc long, n long, which array<{'string' if names is None else 'long'}>, times array<long>")
    return counted.withColumn("row", F.monotonically_increasing_id())


def index(docs: DataFrame, vocabulary: DataFrame, key: str, text: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings of the terms of ``vocabulary`` (term, name), those terms with weight and greatest impact, and the documents.

    Postings: term, piece, place (in its piece, from 1 by impact), row, impact. Up to ``most`` terms go to all tasks,
    and only their occurrences leave them; more are joined.
    """
    few = vocabulary.count() <= most
    names = {r.name: r.term for r in vocabulary.collect()} if few else None
    counted = materialize(forward(docs, key, text, names), "terms")
    total = counted.filter("n > 0").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = total.n_docs, max(1, total.n_terms)
    pairs = counted.select("row", "n", F.explode(F.arrays_zip("which", "times")).alias("p"))
    found = pairs.select("row", "n", F.col("p.which").alias("term" if few else "name"), F.col("p.times").alias("tf"))
    if not few:
        found = found.join(vocabulary, "name").drop("name")
    used = materialize(found.groupBy("term").agg(F.count("*").alias("df")), "used")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    used = used.select("term", weight.alias("w"), F.floor(F.col("df") / PIECE).cast("int").alias("last")).filter("w > 0")
    m = f"(50 + (50 * n * {n_docs}L) div {n_terms}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000 * tf + 20 * {m})")
    posted = found.join(broadcast_if_small(used), "term").withColumn("impact", impact)
    posted = posted.select("term", F.pmod(F.xxhash64("row"), F.col("last") + 1).cast("int").alias("piece"), "row", "impact")
    dealt = posted.repartition(partitions_for(counted, INDEX_BYTES), "term", "piece")
    place = Window.partitionBy("term", "piece").orderBy(F.desc("impact"), "row")
    postings = materialize(dealt.withColumn("place", F.row_number().over(place)), "postings")
    peak = postings.filter("place = 1").groupBy("term").agg(F.max("impact").alias("peak"))
    return postings, used.select("term", "w").join(peak, "term"), counted.select("row", "doc")


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """(item, name): the k-th highest of each item's scores; items with fewer have none."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return scores.select("item", "score", F.row_number().over(order).alias("i")).filter(F.col("i") <= k).filter(F.col("i") == k).select("item", F.col("score").alias(name))


def rank(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score (columns named as the keys).

    The score is an integer form of BM25; equal scores come by ascending key, null keys last. Null, empty and
    termless texts have no terms: such documents are found by nothing, such items find nothing. Rows of ``items`` that
    are equal in key and text are one item; every row of ``docs`` is a document of its own, repeated ones too. Only
    documents with a score above 0 are returned, so there may be fewer than k. Empty frames give an empty frame; other
    columns are ignored.
    """
    asked = materialize(item_terms(items, item_key, text), "items")
    vocabulary = materialize(asked.select("name").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    postings, used, keys = index(docs, vocabulary, key, text, most)
    wanted = materialize(asked.join(vocabulary, "name").join(used, "term").select("item", "term", "w", "peak"), "wanted")
    wanted_small = wanted.count() <= BROADCAST_ROWS
    to_all = F.broadcast if wanted_small else (lambda df: df)

    # 1: heads
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    heads = postings.filter(F.col("place") <= k).withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k).select("term", "row", "impact")
    partial = heads.join(to_all(wanted), "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    first = _kth(partial, k, "bound")
    # 2: every list down to an equal share of the bound
    sizes = wanted.groupBy("item").agg(F.count("*").alias("n_terms"))
    limits = wanted.join(sizes, "item").join(first, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    limits = limits.withColumn("down_to", F.greatest(F.lit(0), F.expr("(bound + n_terms * w - 1) div (n_terms * w)")))
    limits = limits.withColumn("rest", F.col("w") * F.least("peak", F.greatest(F.lit(0), F.col("down_to") - 1)))
    limits = materialize(limits.select("item", "term", "w", "down_to", "rest", "bound"), "limits")
    lowest = limits.groupBy("term").agg(F.min("down_to").alias("lowest"))
    shown = postings.join(to_all(lowest), "term").filter(F.col("impact") >= F.col("lowest")).select("term", "row", "impact")
    # postings go to their document once, whatever the items that ask for them; sums by document and item need no more shuffle
    shown = shown.repartition(partitions_for(postings, INDEX_BYTES // 4), "row")
    shown = shown.join(to_all(limits), "term").filter(F.col("impact") >= F.col("down_to"))
    seen = shown.groupBy("row", "item").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.sum("rest").alias("known"))
    rests = limits.groupBy("item").agg(F.sum("rest").alias("rests"), F.max("bound").alias("bound"))
    able = seen.join(broadcast_if_small(materialize(rests, "rests")), "item").select("item", "row", "score", (F.col("score") + F.col("rests") - F.col("known")).alias("most"), "bound")
    able = materialize(able.filter(F.col("most") >= F.col("bound")).drop("bound"), "able")
    level = materialize(_kth(able, k, "level"), "level")
    hopeful = able.join(broadcast_if_small(level), "item", "left").filter(F.col("most") >= F.coalesce("level", F.lit(0))).select("item", "row")
    hopeful = materialize(hopeful, "hopeful")
    # 3: exact scores of what is left
    looked = postings.select("term", "row", "impact").join(broadcast_if_small(hopeful), "row")
    exact = looked.join(to_all(wanted.select("item", "term", "w")), ["item", "term"])
    exact = exact.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).filter("score > 0")
    # a document behind k higher scores is out before keys are fetched; those level with the k-th stay
    behind = Window.partitionBy("item").orderBy(F.desc("score"))
    exact = exact.withColumn("i", F.rank().over(behind)).filter(F.col("i") <= k)
    named = keys.join(broadcast_if_small(materialize(exact, "exact")), "row")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ranked = ranked.join(asked.select("item", "item_key").distinct(), "item")
    return ranked.select(F.col("item_key").alias(item_key), "rank", F.col("doc").alias(key), "score")
