"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The texts are read once. Every word that any test item has becomes a posting (document, word id, position) in a
written table; a document has one more row there with its number of words. All that follows reads postings, so
texts are neither tokenised again nor shuffled. The index is dealt by documents: every part has the postings of its
own documents, so a frequent word is spread over all parts and lists of one document meet without a hot key.

For every window of an item, the ``points`` rarest of its words are looked up. The list of the
rarest is read first; each further list, offset-adjusted, only keeps candidates that it continues.
What is left (document, item, shift) is compared word by word with the postings; unbroken runs of at least a window
are the phrase matches, all windows along the same shift at once. Rarity is the number of occurrences in all documents.

- A NULL or empty text, or an item without words, has no words and no hits.
- A NULL item id is an id like any other; ``hit_items`` writes it as an empty string.
- Rows alike in id and text are judged alike; items of one id and different texts count as one item.
- Repeated words, overlapping occurrences and items within items are all found. Texts of any length are read whole.
- An empty table on either side gives no hits; other columns pass through ``find_hits``, but for those it adds and for
  names that begin with two underscores, which are reserved.

``find_hits`` and ``judge_documents`` run their jobs when they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from markscale.llm.common import lower_ascii, words
from markscale.session import configure, materialise

WINDOW, POINTS = 13, 3
#: Tables of words or documents whose bytes stay below this are sent to every task; larger ones are joined by a shuffle.
TERM_BYTES = 32 << 20
#: What stands between words, before A to Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def by_size(table: DataFrame, size: Column) -> DataFrame:
    """A written table, marked for broadcast if its counted bytes allow it."""
    held = table.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(table) if held <= TERM_BYTES else table


def with_pieces(df: DataFrame, text: Column) -> DataFrame:
    """Add ``__words``: the words of a text in order, their case as it stands.

    The split stands behind a generator, so nothing that uses it evaluates it again.
    """
    rows = df.withColumn("__split", F.explode(F.array(F.split(F.coalesce(text, F.lit("")), SEPARATORS))))
    split, size = F.col("__split"), F.size("__split")
    first = (split[0] == "").cast("int")
    last = ((size > 1) & (F.element_at(split, -1) == "")).cast("int")
    return rows.withColumn("__words", F.slice("__split", first + 1, size - first - last)).drop("__split")


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text_key``, ``pos``, ``term``: a row per word."""
    rows = with_pieces(df.select(F.col(key).alias("key"), text_hash(F.col(text)).alias("text_key"), F.col(text).alias("__text")), F.col("__text"))
    placed = rows.select("key", "text_key", F.posexplode("__words").alias("pos", "__word"))
    return placed.select("key", "text_key", "pos", lower_ascii(F.col("__word")).alias("term"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``term``, ``key``, ``text_key``, ``pos``; of all terms, or of those given (distinct, written)."""
    rows = tokens(docs, key, text)
    if terms is not None:
        rows = rows.join(by_size(terms, F.octet_length("term")), "term", "left_semi")
    return rows.select("term", "key", "text_key", "pos")


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct items as ``item``, ``item_key``, ``item_words`` (one word at least)."""
    rows = items.select(F.col(key).alias("item"), text_hash(F.col(text)).alias("item_key"), words(F.col(text)).alias("item_words"))
    return rows.where(F.size("item_words") > 0).dropDuplicates(["item", "item_key"])


def vocabulary(items: DataFrame) -> DataFrame:
    """``word``, ``term``: the distinct words of :func:`item_words` with ids from 1; the empty word has the id 0."""
    distinct = items.select(F.explode("item_words").alias("word")).distinct()
    numbered = distinct.withColumn("term", F.monotonically_increasing_id() + 1)
    none = items.sparkSession.createDataFrame([("", 0)], "word string, term long")
    return materialise(numbered.unionByName(none), "vocabulary")


def item_places(items: DataFrame, terms: DataFrame) -> DataFrame:
    """``item``, ``item_key``, ``size``, ``offset``, ``term``: a row per word of an item."""
    placed = items.select("item", "item_key", F.size("item_words").alias("size"), F.posexplode("item_words").alias("offset", "word"))
    return placed.join(terms, "word").drop("word")


def postings(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """The written postings ``doc``, ``term``, ``pos`` of the words in ``terms``, the one pass over the texts.

    ``doc`` numbers the rows of ``docs``. Rows of ``head`` have ``key``, ``text_key`` and, as ``pos``, the number of words.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).withColumn("doc", F.monotonically_increasing_id())
    rows = with_pieces(rows.withColumn("text_key", text_hash(F.col("__text"))), F.col("__text")).drop("__text")
    placed = rows.select("doc", "key", "text_key", F.size("__words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "__words")).alias("at", "__word"))
    head = F.col("at") == 0
    found = placed.withColumn("word", lower_ascii(F.col("__word"))).join(by_size(terms, F.octet_length("word")), "word")
    table = found.select(
        "doc", "term", F.when(head, F.col("n")).otherwise(F.col("at") - 1).alias("pos"),
        F.when(head, F.col("key")).alias("key"), F.when(head, F.col("text_key")).alias("text_key"), head.alias("head"),
    )
    return materialise(table, "postings", partition_by=("head",))


def lookup_plans(places: DataFrame, counts: DataFrame, window: int = WINDOW, points: int = POINTS) -> DataFrame:
    """Per item the distinct ``points``: (count, term, offset) of the rarest words of its windows, rarest first.

    Windows with a word that no document has cannot occur and are left out.
    """
    length = F.least(F.lit(window), F.col("size"))
    first = F.greatest(F.col("offset") - length + 1, F.lit(0))
    last = F.least(F.col("offset"), F.col("size") - length)
    in_windows = places.join(counts, "term").withColumn("at", F.explode(F.sequence(first, last)))
    ranked = Window.partitionBy("item", "item_key", "at").orderBy("n", "term", "offset")
    chosen = in_windows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= points)
    plans = chosen.groupBy("item", "item_key", "at").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("points"))
    return plans.where(F.col("points")[0]["n"] > 0).select("item", "item_key", "points").distinct()


def intersect_lists(index: DataFrame, plans: DataFrame, points: int = POINTS) -> DataFrame:
    """Distinct ``doc``, ``item``, ``item_key``, ``shift`` that all lists of a plan share."""
    rarest = plans.withColumns({"term": F.col("points")[0]["term"], "offset": F.col("points")[0]["offset"]})
    found = index.join(rarest, "term").withColumn("shift", F.col("pos") - F.col("offset")).drop("term", "pos", "offset")
    for k in range(1, points):
        point = F.get("points", F.lit(k))
        # Only plans of that many points are narrowed further.
        narrowed = found.where(F.size("points") > k).withColumns({"term": point["term"], "pos": F.col("shift") + point["offset"]})
        narrowed = narrowed.join(index, ["doc", "term", "pos"], "left_semi").drop("term", "pos")
        found = narrowed.unionByName(found.where(F.size("points") <= k))
    return found.select("doc", "item", "item_key", "shift").distinct()


def exact_runs(candidates: DataFrame, places: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Distinct ``doc``, ``item``, ``start``, ``length``: every occurrence of an item's window along the candidates' shifts."""
    size = places.select(F.col("item").alias("__item"), F.col("item_key").alias("__item_key"), "size", "offset", "term")
    same = F.col("item").eqNullSafe(F.col("__item")) & (F.col("item_key") == F.col("__item_key"))
    wanted = candidates.join(size, same).drop("__item", "__item_key").withColumn("pos", F.col("shift") + F.col("offset"))
    met = wanted.join(index, ["doc", "term", "pos"], "left_semi")
    # Offsets that follow each other keep their distance from their rank.
    along = ["doc", "item", "item_key", "shift"]
    ranked = met.withColumn("run", F.col("offset") - F.row_number().over(Window.partitionBy(*along).orderBy("offset")))
    runs = ranked.groupBy(*along, "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("n"), F.first("size").alias("size"))
    length = F.least(F.lit(window), F.col("size"))
    whole = runs.withColumn("length", length).where(F.col("n") >= F.col("length"))
    starts = F.sequence(F.col("first"), F.col("first") + F.col("n") - F.col("length"))
    # Windows of the same words are met along several shifts.
    return whole.select("doc", "item", F.explode(starts).alias("start"), "length").distinct()


def judge_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    window: int = WINDOW, points: int = POINTS,
) -> DataFrame:
    """A row per row of ``docs``: ``key``, ``text_key``, ``n_words`` and ``hits``, every occurrence (item, first word, length) of an item's window."""
    configure(docs.sparkSession)
    known = materialise(item_words(items, item), "items")
    terms = vocabulary(known)
    places = materialise(item_places(known, terms), "item-places")
    table = postings(docs, terms, key, text)
    index = table.where(~F.col("head")).select("doc", "term", "pos")
    occurring = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(terms.where("term > 0").select("term").join(occurring, "term", "left").fillna(0, "n"), "term-counts")
    plans = materialise(lookup_plans(places, counts, window, points), "plans")
    looked_up = materialise(plans.select(F.explode("points.term").alias("term")).distinct(), "looked-up")
    lists = materialise(index.join(by_size(looked_up, F.lit(8)), "term", "left_semi"), "looked-up-lists")
    candidates = materialise(intersect_lists(lists, plans, points), "candidates")
    in_question = materialise(candidates.select("doc").distinct(), "documents-in-question")
    near = index.join(by_size(in_question, F.lit(8)), "doc", "left_semi")
    hits = exact_runs(candidates, places, near, window).groupBy("doc").agg(F.collect_list(F.struct("item", "start", "length")).alias("hits"))
    none = F.array().cast(f"array<struct<item:{items.schema[item].dataType.simpleString()},start:int,length:int>>")
    heads = table.where("head").select("doc", "key", "text_key", F.col("pos").cast("long").alias("n_words"))
    return heads.join(hits, "doc", "left").select("key", "text_key", "n_words", F.coalesce("hits", none).alias("hits"))


def find_hits(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    window: int = WINDOW, points: int = POINTS, words_out: str = "n_words", hits_out: str = "hits",
) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits`` (or so named) of :func:`judge_documents`."""
    judged = judge_documents(docs, items, key, text, item, window, points).dropDuplicates(["key", "text_key"])
    judged = judged.select(F.col("key").alias("__key"), F.col("text_key").alias("__found"), F.col("n_words").alias("__n"), F.col("hits").alias("__hits"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_key") == F.col("__found"))
    joined = docs.withColumn("__text_key", text_hash(F.col(text))).join(judged, same)
    return joined.withColumns({words_out: F.col("__n"), hits_out: F.col("__hits")}).drop("__text_key", "__key", "__found", "__n", "__hits")


def drop_documents(docs: DataFrame, bad: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose ``key`` and ``text_key`` stand in ``bad``. Few of those are sent to every task."""
    bad = materialise(bad.select(F.col("key").alias("__key"), F.col("text_key").alias("__bad")).distinct(), "dropped")
    same = F.col(key).eqNullSafe(F.col("__key")) & (text_hash(F.col(text)) == F.col("__bad"))
    return docs.join(by_size(bad, F.lit(48)), same, "left_anti")


def hit_words(hits: Column) -> Column:
    """How many words lie inside any hit."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))).cast("long")


def hit_items(hits: Column) -> Column:
    """The ids of the items that occur, as sorted strings."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.coalesce(h["item"].cast("string"), F.lit("")))))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: any hit, and at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """Places where all words of a query stand near each other, in any order.

    ``queries``: ``query``, ``terms`` (array). A match is an occurrence of the query's rarest word with
    every other distinct word of the query at most ``slop`` words away: ``query``, ``key``, ``text_key``,
    ``pos``. Begins with the rarest list and keeps what each further list continues.
    """
    wanted = queries.select("query", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    counts = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(counts, "term", "left").fillna(0, "n")
    by_rarity = Window.partitionBy("query").orderBy("n", "term")
    ranked = ranked.withColumns({"rank": F.row_number().over(by_rarity), "terms": F.count(F.lit(1)).over(Window.partitionBy("query"))})
    anchors = index.join(ranked.where("rank = 1").select("query", "term", "terms"), "term").drop("term")
    others = index.join(ranked.where("rank > 1").select("query", "term"), "term").select(
        F.col("query").alias("__query"), F.col("key").alias("__key"), F.col("text_key").alias("__text_key"), "term", F.col("pos").alias("__pos")
    )
    near = (
        F.col("query").eqNullSafe(F.col("__query")) & F.col("key").eqNullSafe(F.col("__key"))
        & (F.col("text_key") == F.col("__text_key")) & (F.abs(F.col("pos") - F.col("__pos")) <= slop)
    )
    met = anchors.join(others, near, "left").groupBy("query", "key", "text_key", "pos", "terms")
    full = met.agg(F.count_distinct("term").alias("met")).where(F.col("met") == F.col("terms") - 1)
    return full.select("query", "key", "text_key", "pos")
