"""Benchmark decontamination with a positional inverted index.

The index holds one posting per word of the training texts: term, document,
position.  Each task writes the postings of the documents it reads, sorted by term,
so the index is sharded by document and building it shuffles nothing.

A phrase is looked up from its rarest term: the postings of that term, shifted by
the term's offset, are where the phrase may start.  The postings of the second rarest
term, shifted alike, are intersected with these starts, and those of all terms with
what is left; a start that all terms agree on is an occurrence.  A proximity search does the same with a window in place of
the exact offset.  Only DataFrame operations are used.

Terms are held as 64-bit hashes.  Two terms of the test set never share one (that
is checked); a training word that shares one with a test word would have to stand
within an otherwise equal phrase to matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, numbered_rows, passing_tables, unused_name

# All that is not a word character: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are the words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Up to so many row numbers are sent to all executors (16 MB at most).
ASKING_ROWS = 1 << 20


def _pieces(text: Column) -> Column:
    """Words of ``text`` after an empty first piece; the last may be empty too."""
    lower = ascii_lower(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit(""))))
    return F.split(lower, _BETWEEN)


def build_index(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Write the postings of ``docs``: ``term, row, pos``.

    ``row`` numbers the rows of ``docs`` as they were read, so repeated and null keys
    are documents of their own.  Words are counted from 1.  Every row also has an entry
    that is no posting: ``pos`` 0 with its key in place of the term, or -1 for a null key.
    """
    # Rows are numbered before they are taken apart.
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{key}`"].cast("long").alias("key"),
        _pieces(docs["text"]).alias("words"),
    )
    words = numbered.select("row", "key", F.posexplode("words").alias("pos", "word")).where(
        "pos = 0 or word <> ''"
    )
    postings = words.select(
        F.expr("case when pos > 0 then xxhash64(word) else coalesce(key, 0) end").alias("term"),
        "row",
        F.expr("case when pos = 0 and key is null then -1 else pos end").alias("pos"),
    )
    return keep(postings.sortWithinPartitions("term"), "postings", path)


def item_words(items: DataFrame, key: str = "item_id") -> DataFrame:
    """``item, words`` of the items that have words; ``item`` may be null."""
    return items.select(
        items[f"`{key}`"].cast("string").alias("item"),
        F.filter(_pieces(items["text"]), lambda w: w != "").alias("words"),
    ).where("size(words) > 0")


def _sequence_id() -> Column:
    """A sequence of words as a number, so that its text is not sent with every match."""
    return F.xxhash64(F.array_join("words", " "))


def _terms(sequences: DataFrame) -> DataFrame:
    """``seq, length, offset, word, term`` of each distinct sequence of words."""
    return (
        sequences.select("words").distinct()
        .select(_sequence_id().alias("seq"), F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
        .withColumn("term", F.xxhash64("word"))
    )


def _check_hashes(terms: DataFrame) -> None:
    """Two words of one hash, or two sequences of one number, would be taken for one."""
    words = terms.groupBy("term").agg(F.countDistinct("word").alias("n"))
    places = terms.groupBy("seq", "offset").agg(F.count("*").alias("n"))
    if not words.select("n").union(places.select("n")).where("n > 1").isEmpty():
        raise ValueError("two test words or sequences share a hash")


def exact_matches(index: DataFrame, sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """``seq, row, start, length`` of every longest run of a sequence in the index.

    A run has ``window`` words at least, or all words of a shorter sequence; ``seq`` is
    the number of the sequence.  Overlapping windows on one diagonal are one run.
    """
    terms = keep(_terms(sequences), "phrase-terms")
    _check_hashes(terms)
    postings = index.where("pos > 0")
    wanted = terms.select("term").distinct()
    counts = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # A term that does not occur has no entry here and rules out its windows.
    counted = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("seq").orderBy("offset").rowsBetween(0, window - 1)
    rare = (
        counted.withColumn("r", F.array_sort(F.collect_list(F.struct("df", "offset", "term")).over(ahead)))
        .where(F.col("offset") <= F.greatest(F.lit(0), F.col("length") - window))
        .where("r[0].df > 0")
        .select("seq", "offset", F.col("r")[0].alias("r1"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("r2"))
        # The windows of two rarest places follow one another without a gap.
        .groupBy(
            "seq", F.col("r1.offset").alias("at"), F.col("r1.term").alias("term"),
            F.col("r2.offset").alias("next"), F.col("r2.term").alias("next_term"),
        )
        .agg(F.min("offset").alias("low"), (F.max("offset") + window - 1).alias("high"))
    )
    rare = keep(rare, "rarest-terms")
    # The shifted postings of the rarest terms: where the sequence may lie.  These and the
    # tables below are stored, so that Spark knows their size when it plans the joins.
    starts = keep(
        postings.join(rare, "term").select(
            "seq", "row", (F.col("pos") - F.col("at")).alias("diagonal"), "low", "high",
            F.col("next_term").alias("term"), (F.col("pos") - F.col("at") + F.col("next")).alias("pos"),
        ),
        "phrase-starts",
    )
    # Intersect with the second rarest terms, whose postings are few as well.
    second = rare.select(F.col("next_term").alias("term")).distinct()
    left = starts.join(postings.join(second, "term", "left_semi"), ["row", "pos", "term"])
    # What is left asks for all terms of its windows at their places.
    asked = keep(
        left.join(terms.select("seq", "length", "offset", F.col("term").alias("own")), "seq")
        .where("offset between low and high")
        .select("seq", "length", "row", "diagonal", "offset", F.col("own").alias("term")).distinct(),
        "phrase-requests",
    ).withColumn("pos", F.col("diagonal") + F.col("offset"))
    answers = postings.join(wanted, "term", "left_semi")
    # Where few documents ask, the postings of the others need not be sent.
    asking = keep(asked.select("row").distinct(), "phrase-rows")
    if asking.count() <= ASKING_ROWS:
        answers = answers.join(F.broadcast(asking), "row", "left_semi")
    agreed = asked.join(answers, ["row", "pos", "term"])
    # Offsets in a row differ from their rank by the same number.
    order = Window.partitionBy("row", "seq", "diagonal").orderBy("offset")
    runs = agreed.withColumn("island", F.col("offset") - F.dense_rank().over(order))
    return (
        runs.groupBy("row", "seq", "diagonal", "island")
        .agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.first("length").alias("whole"))
        .withColumn("length", F.col("last") - F.col("first") + 1)
        .where(F.col("length") >= F.least(F.lit(window), F.col("whole")))
        .select("seq", "row", (F.col("diagonal") + F.col("first")).alias("start"), "length")
    )


def proximity_matches(index: DataFrame, phrases_of: DataFrame, within: int) -> DataFrame:
    """``phrase, row, at``: places of the rarest term with all other terms within ``within`` words."""
    terms = keep(phrases_of.select("phrase", F.explode("words").alias("word")).distinct(), "proximity-terms")
    terms = terms.withColumn("term", F.xxhash64("word"))
    counts = index.where("pos > 0").groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(counts, "term", "left")
    size = ranked.groupBy("phrase").agg(
        F.count("*").alias("size"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")
    )
    anchors = size.where("r.df > 0").select("phrase", "size", F.col("r.term").alias("term"))
    found = keep(
        index.where("pos > 0").join(anchors, "term").select("phrase", "size", "row", F.col("pos").alias("at")),
        "proximity-anchors",
    )
    # One row per place that counts as near, so that the join is on equal keys.
    places = found.join(terms.select("phrase", "term"), "phrase").select(
        "phrase", "size", "row", "at", "term",
        F.explode(F.expr(f"sequence(greatest(1, at - {within}), at + {within})")).alias("pos"),
    )
    near = index.where("pos > 0").select("term", "row", "pos").join(places, ["row", "pos", "term"])
    agreed = near.groupBy("phrase", "row", "at").agg(
        F.countDistinct("term").alias("n"), F.first("size").alias("size")
    )
    return agreed.where("n = size").select("phrase", "row", "at")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id"
) -> DataFrame:
    """One row per document: ``key, row, n_words, n_hit, items, n_items, contaminated``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A word within
    an occurrence of a phrase is hit.  Null texts have no words.  ``items`` are the
    ids of the items with an occurring phrase, as sorted strings; repeated items
    count once, and an item without id is not listed.
    """
    index = build_index(docs, key=key)
    sequences = keep(item_words(benchmark), "benchmark-words")
    matches = keep(exact_matches(index, sequences, window), "phrase-matches")
    # Spans of one row in order; a word counts where it is past all earlier spans.
    upto = F.max(F.col("start") + F.col("length") - 1).over(
        Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = matches.select("row", "start", "length").distinct().withColumn("upto", F.coalesce(upto, F.lit(0)))
    hit = spans.groupBy("row").agg(
        F.sum(F.expr("greatest(0, start + length - 1 - greatest(upto, start - 1))")).alias("n_hit")
    )
    named = sequences.where("item is not null").select(_sequence_id().alias("seq"), "item").distinct()
    items = (
        matches.select("row", "seq").distinct()
        .join(named, "seq")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    sizes = index.groupBy("row").agg(
        F.max(F.expr("case when pos = 0 then term end")).alias("key"), (F.count("*") - 1).alias("n_words")
    )
    return (
        sizes.join(hit, "row", "left")
        .join(items, "row", "left")
        .select(
            F.col("key").alias(key),
            "row",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, most: float = 0.0, stored: bool = False
) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most`` are hit.

    A ``stored`` table of Parquet files is read again and not copied (see :func:`numbered_rows`).
    """
    key = unused_name(docs, "source_row")
    numbered = numbered_rows(docs, key, "decontaminate", stored)
    with passing_tables(docs.sparkSession):
        found = contamination(numbered, benchmark, key=key)
        bad = found.where(F.col("n_hit") > F.lit(most) * F.col("n_words")).select(key)
        bad = keep(bad, "contaminated", lasting=True)
    return numbered.join(bad, key, "left_anti").drop(key)
