"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, per-source permutations.

DataFrame functions only.  A source's words, in a fixed order of its documents, are packed into
blocks of ``block_words``.  A source fills as many slots as its target asks for.  Every slot draws
one of the output shards, so that a source's counts over the shards are a multinomial draw given
its total, and the total itself does not stray from the target.  A slot's index is mapped through
a permutation of the source's blocks (one for each pass over the source), and blocks are joined to
slots by that index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codemem.llm.common import cut

# Words and the white space around them: the matches of a text, joined, are the text.
PIECE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
WORD = r"[^\x20\x09-\x0D]+"

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
ROUNDS = 24
# Documents whose places are counted together, and slots made from one row.
GROUP_DOCS = 512
SLOT_RUN = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` -> with ``target``: words to take from each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words.  No target is above ``most`` times its source; what is cut off is shared again by
    weight.  A source below the level is capped, so with sources sorted by cap over weight the
    level is the largest of (total - caps before) / (weights from here on).  One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy(F.lit(1))))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - before) / rest)
    rows = rows.withColumn("level", F.max("level").over(Window.partitionBy(F.lit(1))))
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def place_documents(docs: DataFrame) -> DataFrame:
    """Gives every row of ``doc_id, source, size, tie`` its first word's place in the source's stream.

    Rows of a source are dealt to groups of about ``GROUP_DOCS``; places are counted inside a
    group, and groups are placed by their sums, so that no task sees a whole source.  Rows are
    ordered by id and ``tie``; ``copy`` numbers rows that are equal in both.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    named = docs.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    named = named.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(groups)))
    sums = named.groupBy("src", "grp").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("src").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "grp", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "grp").orderBy(F.col("doc_id").isNull(), "doc_id", "tie")
    within = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = named.withColumns({"nth": F.row_number().over(inside), "within": within})
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("src", "grp", "doc_id", "tie").orderBy("nth")))
    return rows.join(sums, ["src", "grp"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def permuted(i: Column, n: Column, key: list[Column], rounds: int = ROUNDS) -> Column:
    """Place of ``i`` under a pseudorandom permutation of 0..n-1: a swap-or-not shuffle.

    Every round pairs ``x`` with ``k - x`` modulo ``n`` and swaps or keeps the pair by a bit that
    both members share, so each round, and the whole, is a bijection for any ``n``.
    """
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def draw_slots(sources: DataFrame, block_words: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``src, source_size, target`` -> one row per slot: ``src, slot, pass, block, shard``.

    A source has as many slots as blocks of its target, at most two for each block.
    """
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    # A short last block counts for its part: slots per word of the source, not per full block.
    wanted = F.round(F.col("target") / F.col("source_size") * n).cast("long")
    rows = sources.where("source_size > 0").select("src", n.alias("n"), F.least(wanted, 2 * n).alias("slots"))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(1))) / shard_slots)).cast("long")
    rows = rows.withColumn("shards", shards).where("slots > 0")
    # A source of any size: first its runs of slots, spread over all tasks, then the slots of a run.
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_RUN))))
    # A set number of tasks, since a run is a small row that becomes many.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, F.col("src"), F.col("run"))
    first = F.col("run") * SLOT_RUN
    slots = runs.withColumn("slot", F.explode(F.sequence(first, F.least(first + SLOT_RUN, F.col("slots")) - 1)))
    one = F.floor(F.col("slot") / F.col("n")).cast("long")
    key = [F.lit(seed), F.col("src"), F.col("pass")]
    slots = slots.withColumn("pass", one).withColumn("at", F.col("slot") - F.col("pass") * F.col("n"))
    return slots.select("src", "slot", "pass", permuted(F.col("at"), F.col("n"), key).alias("block"),
                        F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "src", "slot"), F.col("shards")).alias("shard"))


def block_pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document touches: the words ``from_word`` to ``to_word`` of it."""
    rows = placed.where("size > 0")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    rows = rows.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0).cast("long"))
    high = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return rows.select("src", "grp", "nth", "block", low.alias("from_word"), high.alias("to_word"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, tie`` of every row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))


def plan_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17, **weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, sources with targets, and the taken pieces: block pieces joined to slots by index.

    The texts are read once; what follows starts from the written, narrow table of places.  Slots are
    as many as blocks, so that join is never left to a broadcast.
    """
    placed = cut(place_documents(sized(docs)))
    sizes = placed.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.drop("src"), **weights)
    targets = targets.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    slots = draw_slots(targets, block_words, seed)
    return placed, targets, block_pieces(placed, block_words).join(slots.hint("merge"), ["src", "block"])


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``.

    Every row of ``docs`` gives one row, repeated ids included; a null text has size 0 and takes
    nothing; a null source is a source of its own; no rows give no rows.  Further columns are
    not read.  Reruns agree, because every draw is a hash of the seed and the rows.
    """
    placed, targets, taken = plan_mix(docs, **how)
    sums = taken.groupBy("src", "grp", "nth").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = placed.join(sums, ["src", "grp", "nth"], "left").join(targets.drop("source"), "src")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _with_texts(docs: DataFrame, placed: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``parts`` (by src, grp, nth) with the row of ``docs`` that they belong to, in ``doc``.

    The texts move once.  Rows that share id, source and text are told apart by their number.
    """
    known = parts.join(placed.select("src", "grp", "nth", "doc_id", "tie", "copy"), ["src", "grp", "nth"])
    same = ["src", "_id", "tie", "copy"]
    known = known.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).drop("doc_id", "grp", "nth")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src"),
                       F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("src", "_id", "tie").orderBy(F.lit(1))))
    return rows.join(known, same)


def _cut_words(text: Column, parts: Column) -> Column:
    """The given ranges of words, with the white space after each, as one text; words are split once."""
    piece = lambda words: lambda p: F.array_join(F.slice(words, p["from_word"].cast("int") + 1, (p["to_word"] - p["from_word"]).cast("int")), "")
    # The words are the one element of an array, so that they are a value inside, not an expression.
    of_words = lambda words: F.array_join(F.transform(parts, piece(words)), "")
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), of_words), 1)


def mixed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in pieces: ``shard, slot, source, block, pass, doc_id, text`` in no order."""
    placed, _, taken = plan_mix(docs, **how)
    rows = _with_texts(docs.select("doc_id", "source", "text"), placed, taken.withColumn("parts", F.array(F.struct("from_word", "to_word"))))
    return rows.select("shard", "slot", "doc.source", "block", "pass", "doc.doc_id", _cut_words(F.col("doc.text"), F.col("parts")).alias("text"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix in the columns of ``docs``: for each pass over a source, what it takes of a document.

    A document that a pass takes whole keeps its text as it is; one that is taken in part keeps the
    pieces of the taken blocks, in order.  ``n_chars`` follows the text.  Rows without words leave,
    since the mix takes none of them.
    """
    placed, _, taken = plan_mix(docs, **how)
    parts = taken.groupBy("src", "grp", "nth", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("parts"))
    rows = _with_texts(docs, placed, parts).withColumn("mixed", _cut_words(F.col("doc.text"), F.col("parts")))

    def column(c: str) -> Column:
        value = {"text": F.col("mixed"), "n_chars": F.length("mixed")}.get(c, F.col(f"doc.`{c}`"))
        return value.cast(docs.schema[c].dataType).alias(c)

    return rows.select(*[column(c) for c in docs.columns])
