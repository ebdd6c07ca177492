"""Benchmark decontamination by a positional inverted index (operator 2). DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item, or all words of a
shorter one. The index holds the postings of every term that windows have: a
row for each document row, term and position, written once to the shared folder
in one pass over the documents, without a shuffle. All that follows reads the
index: counts of terms, lists of postings, and the words of each document row,
which has one header.

A window's terms are ranked by how rare they are in the documents; windows with
a term that no document has cannot occur and go first. A posting of the rarest
term, moved back by the term's offset, says where the window would start. The
list of these places is intersected with the list of the next rarest term, then
with those of all others, each moved back by its own offset. Two places meet if
they lie at most ``SLOP`` positions apart. ``apart`` is the largest of the least
distances: 0 means that the exact phrase stands there, more that all its terms
stand near. Lists are met in cells of positions, so all joins are on equality.

The windows are the stated query set; each distinct one is looked up once, and
its items are joined once for each document that has it. Windows that have the same two rarest
terms at the same distance are looked for together until these two have met, so
headings that many items share don't multiply postings. A side of windows is broadcast up to
BROADCAST_ROWS rows and shuffled beyond. Postings are joined by document row and
term, so frequent terms and passages that many documents share don't meet in one
task. A document's own matches are gathered in one row, which its length bounds.

Null and empty texts have no words: zero counts, not contaminated. Items
without words match nothing; a null item_id is written "null". Repeated
documents give repeated rows, repeated items count once. Without items, or in
an empty table, nothing is contaminated. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, row_key, shuffled, table, written
from .words import WORDS_SQL, words

WINDOW = 10
#: How far a term may stand from where the phrase has it, to be near.
SLOP = 3
#: Rows up to which terms, windows or candidate documents are broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Stands for a document in the index.
HEADER = -1
_CELL = 2 * SLOP + 1


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id string, terms array<string>): the distinct windows of every item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, F.lit(size)))
    return w.select("item_id", F.explode(parts).alias("terms")).distinct()


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


def vocabulary(asked: DataFrame) -> DataFrame:
    """(term, tid): the terms of windows (win, terms), numbered."""
    return checkpointed(asked.select(F.explode("terms").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")))


def index(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, tid, pos, doc_id, text_key): postings of the terms of a vocabulary. Of a document's header tid is HEADER and pos its number of words."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), *row_key(F.col("doc_id"), F.col("text").cast("string")), words(F.col("text")).alias("w"))
    header = F.array(F.struct(F.lit("").alias("term"), F.size("w").alias("pos")))  # no word is empty
    placed = F.transform("w", lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    # the array is a column of its own, so that cutting it up and the join are one piece of generated code; it is never
    # empty, and "outer" keeps the planner from working it out once more to see that
    each = own.select("row", "doc_id", "text_key", F.concat(header, placed).alias("all"))
    each = each.select("row", "doc_id", "text_key", F.explode_outer("all").alias("p")).select("row", "p.term", "p.pos", "doc_id", "text_key")
    sides = known.select("term", "tid").unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(HEADER).cast("long").alias("tid")))
    met = each.join(F.broadcast(sides) if known.count() <= BROADCAST_ROWS else shuffled(sides), "term")
    return written(met.select("row", "tid", "pos", *[F.when(F.col("tid") == HEADER, F.col(c)).alias(c) for c in ("doc_id", "text_key")]))


def ranked(asked: DataFrame, known: DataFrame, postings: DataFrame) -> DataFrame:
    """(win, size, rank, at, tid): the terms of windows (win, terms) that may occur, each at every place it has, rarest first."""
    counts = checkpointed(known.join(small(checkpointed(postings.groupBy("tid").agg(F.count("*").alias("n")))), "tid"))
    each = asked.select("win", "terms", F.posexplode("terms").alias("at", "term")).join(small(counts), "term", "left")
    lists = each.groupBy("win", "terms").agg(
        F.count("n").alias("known"),
        F.array_sort(F.collect_list(F.struct("n", "at", "tid"))).alias("lists"),
    ).where(F.size("terms") == F.col("known"))
    return lists.select("win", F.size("terms").alias("size"), F.posexplode("lists").alias("rank", "x")).select("win", "size", "rank", "x.at", "x.tid")


def _cells(start: Column) -> Column:
    """The cells in which whatever is at most SLOP positions away lies."""
    return F.array_distinct(F.array(F.floor((start - SLOP) / _CELL), F.floor((start + SLOP) / _CELL)))


def _intersected(places: DataFrame, lists: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Those of places (row, key, start, apart) that postings of all lists (key, at, tid, lists) of their key meet."""
    due = places.join(small(lists.select(key, "at", "tid", "lists")), key).withColumn("due", F.col("start") + F.col("at"))
    due = due.withColumn("cell", F.explode(_cells(F.col("due"))))
    there = postings.select("row", "tid", F.floor(F.col("pos") / _CELL).alias("cell"), "pos")
    gap = F.abs(F.col("pos") - F.col("due"))
    met = due.join(there, ["row", "tid", "cell"]).where(gap <= SLOP)
    each = met.groupBy("row", key, "start", "at", "lists", "apart").agg(F.min(gap).alias("gap"))
    whole = each.groupBy("row", key, "start", "lists", "apart").agg(F.count("*").alias("n"), F.max("gap").alias("gap"))
    return whole.where("n = lists").select("row", key, "start", F.greatest("gap", "apart").alias("apart"))


def matches(asked: DataFrame, known: DataFrame, postings: DataFrame) -> DataFrame:
    """(row, win, size, start, apart): where windows (win, terms) stand exactly (apart = 0) or near, from the rarest term on.

    Windows whose two rarest terms are the same and as far apart are one pair, of which places are looked for once.
    """
    lists = checkpointed(ranked(asked, known, postings))
    first, second, rest = lists.where("rank = 0"), lists.where("rank = 1"), lists.where("rank > 1")
    next_one = second.select("win", F.col("tid").alias("next"), F.col("at").alias("next_at"))
    by_pair = checkpointed(first.where("size > 1").join(next_one, "win").withColumn("leap", F.col("next_at") - F.col("at")))
    both = checkpointed(by_pair.select("tid", "next", "leap").distinct().withColumn("pair", F.monotonically_increasing_id()))
    starts = postings.join(small(both.select("tid", "pair")), "tid").select("row", "pair", F.col("pos").alias("start"), F.lit(0).alias("apart"))
    of_second = postings.join(small(both.select(F.col("next").alias("tid")).distinct()), "tid", "left_semi")
    lists_of_pair = both.select("pair", F.col("leap").alias("at"), F.col("next").alias("tid"), F.lit(1).alias("lists"))
    pairs = checkpointed(_intersected(starts, lists_of_pair, of_second, "pair"))
    windows_of = checkpointed(by_pair.join(both, ["tid", "next", "leap"]).select("pair", "win", "size", "at"))
    begin = (F.col("start") - F.col("at")).cast("int")
    met = pairs.join(small(windows_of), "pair").select("row", "win", "size", begin.alias("start"), "apart")
    # what is left asks for few documents: the postings of others go before they travel
    few = postings.join(small(checkpointed(pairs.select("row").distinct())), "row", "left_semi")
    size = lists.where("rank = 0").select("win", "size")
    whole = _intersected(met.where("size > 2").drop("size"), rest.withColumn("lists", F.col("size") - 2), few, "win").join(small(size), "win")
    alone = postings.join(small(first.where("size = 1")), "tid").select("row", "win", "size", (F.col("pos") - F.col("at")).cast("int").alias("start"), F.lit(0).alias("apart"))
    return whole.select(*alone.columns).unionAll(met.where("size = 2")).unionAll(alone)


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, found array<struct<start, end>> of exact matches, sorted, the items that they are of, and n_near, how many windows stand near elsewhere."""
    by_item = checkpointed(windows(items, size))
    asked = checkpointed(by_item.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()))
    owners = checkpointed(by_item.join(asked, "terms").select("win", "item_id"))
    known = vocabulary(asked)
    postings = index(docs, known)
    met = checkpointed(matches(asked, known, postings))
    exact, span = F.col("apart") == 0, F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    header = postings.where(F.col("tid") == HEADER)
    of_items = met.where(exact).select("row", "win").distinct().join(small(owners), "win").select("row", F.col("item_id").alias("item")).distinct()
    # a document's header, its matches and their items come together in one shuffle
    rows = header.select("row", F.struct("doc_id", "text_key", F.col("pos").cast("long").alias("n_words")).alias("document"))
    for part in (met.select("row", F.when(exact, span).alias("span"), (~exact).alias("near")), of_items):
        rows = rows.unionByName(part, allowMissingColumns=True)
    per = rows.groupBy("row").agg(
        F.max("document").alias("d"),
        F.array_sort(F.collect_set("span")).alias("found"),
        F.array_sort(F.collect_set("item")).alias("items"),
        F.count_if("near").alias("n_near"),
    )
    return per.select("d.doc_id", "d.text_key", "d.n_words", "found", "items", "n_near")


def covered(found: Column) -> Column:
    """How many words sorted matches cover together."""

    def step(acc: Column, m: Column) -> Column:
        return F.struct(F.greatest(acc["to"], m["end"]).alias("to"), (acc["n"] + F.greatest(m["end"] - F.greatest(m["start"], acc["to"]), F.lit(0))).alias("n"))

    return F.aggregate(found, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    hit = phrase_matches(docs, items, size).where(F.size("found") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    boxed = docs.select(F.struct(*columns).alias("row"), *row_key(F.col("doc_id"), F.col("text").cast("string")))
    clean = boxed.join(hit, boxed["doc_id"].eqNullSafe(hit["hit_id"]) & (boxed["text_key"] == hit["hit_key"]), "left_anti")
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the benchmark in all documents."""
    per = phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    per = per.select("doc_id", "n_words", covered(F.col("found")).alias("n_hit"), "items", "n_near")
    return per.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) k, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, item_id, i, n FROM pos JOIN win USING (n, s)),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, i - 1 AS pos, w[i] AS term FROM d, unnest(range(1, len(w) + 1)) t(i)),
term_n AS (SELECT term, count(*) AS c FROM tok GROUP BY term),
one AS (SELECT DISTINCT n AS size, s FROM win),
lst AS (SELECT s, size, i - 1 AS at_, string_split(s, ' ')[i] AS term FROM one, unnest(range(1, size + 1)) t(i)),
rare AS (SELECT s, size, at_, term FROM lst JOIN term_n USING (term) QUALIFY row_number() OVER (PARTITION BY s ORDER BY c, at_) = 1 AND count(*) OVER (PARTITION BY s) = size),
cand AS (SELECT doc_id, s, size, pos - at_ AS start FROM tok JOIN rare USING (term)),
gap AS (SELECT cand.doc_id, cand.s, cand.start, cand.size, lst.at_, min(abs(tok.pos - lst.at_ - cand.start)) AS g
  FROM cand JOIN lst USING (s) JOIN tok ON tok.doc_id = cand.doc_id AND tok.term = lst.term AND abs(tok.pos - lst.at_ - cand.start) <= {SLOP} GROUP BY ALL),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, s, start FROM gap GROUP BY doc_id, s, start, size HAVING count(*) = size AND max(g) > 0) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""
