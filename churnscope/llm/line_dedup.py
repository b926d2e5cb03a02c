"""Line dedup with a suffix array over line ids, by distributed prefix doubling.

Only lines that occur at two places or more can be part of a repeated run, so
the suffixes of their unbroken sequences are sorted, by built-in functions
alone:

1. line ids (two 64-bit hashes) are ranked; a rank is the number of suffixes
   that come before, so equal prefixes have equal ranks and order is kept;
2. each round sorts the suffixes by twice as many lines: pairs (own rank, rank
   2^k lines on) are ranked among those that share the first; suffixes that
   are unique already, or sorted as deep as a run needs, are left out;
3. asked are the shortest run of ``min_words`` from each line and the shortest
   one up to each line: every line of a longer repeated run is in one of those
   that lie inside it.  A run of L lines belongs to the longest-common-prefix
   interval of depth L at its first line: suffixes share it if two overlapping
   power-of-two prefixes that cover L lines have equal ranks;
4. in every interval the first place, by (doc_id, text, line), is the first
   copy; the L lines at all other places go.  Adjoining ones merge into
   maximal runs.

Running counts go through cells of bounded width, so one very common line, or
one followed by very many different lines, is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import materialize

MIN_WORDS = 50
CELL = 2000
MAX_CELLS = 4096
BROADCAST_RUNS = 500_000  # runs (some 30 bytes each) up to this many go to every task; more are joined by shuffle
_PLACE = ("doc_id", "key", "pos")


def _count_before(rows: DataFrame, group: list[str], cell: Column, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the group that come earlier by ``order``.

    ``cell`` must not fall as ``order`` rises: cells are summed first, then
    rows inside a cell.
    """
    celled = rows.withColumn("_cell", cell)
    by_cell = Window.partitionBy(*group).orderBy("_cell") if group else Window.partitionBy(F.lit(0)).orderBy("_cell")
    starts = (celled.groupBy(*group, "_cell").agg(F.sum(value).alias("_sum"))
              .withColumn("_start", F.sum("_sum").over(by_cell) - F.col("_sum")).drop("_sum"))
    inside = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (celled.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
            .join(starts, [*group, "_cell"]).withColumn("before", F.col("_start") + F.col("_inside"))
            .drop("_cell", "_inside", "_start"))


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
                       F.split(text, "\n").alias("lines"))


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    """Places of repeated lines: ``doc_id, key, pos``, unbroken sequence ``seg``, line rank ``r``, its places ``n``,
    ``upto``, ``since`` and ``want``.

    ``upto`` is the last line of the shortest run from here that has
    ``min_words`` words, null if the sequence ends before; ``since`` the first
    line of the shortest such run that ends here, null if there is none or it
    is the shortest from its first line too; ``want`` the lines of the longest
    of these runs in the sequence, 0 if there is none.
    """
    line = F.col("line")
    words = F.size(F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), ""))
    lines = materialize(_base(docs).select("doc_id", "key", F.posexplode("lines").alias("pos", "line")).select(
        *_PLACE, F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), words.alias("words")))
    place = F.struct(*_PLACE)
    ids = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
                      .filter("a <> b").select("h1", "h2", "n"))
    cells = max(1, min(MAX_CELLS, ids.count() // CELL))
    share = F.col("h1").cast("double") / 2.0 ** 64 + 0.5
    ranked = _count_before(ids, [], F.floor(share * cells), ["h1", "h2"], "n").withColumnRenamed("before", "r")
    # one exchange by document serves all windows below
    own = lines.join(ranked, ["h1", "h2"]).select(*_PLACE, "words", "r", "n").repartition("doc_id", "key")
    once = own.withColumn("nth", F.row_number().over(Window.partitionBy(*_PLACE).orderBy("r"))).filter("nth = 1").drop("nth")
    by_doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    segments = once.withColumn("seg", F.col("pos") - F.row_number().over(by_doc))
    in_seg = Window.partitionBy("doc_id", "key", "seg")
    summed = segments.withColumn("total", F.sum("words").over(in_seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    # a line's end stands at its total, its start at the total that a run from there has to reach: scanned from the top,
    # the least end so far answers a start; scanned from the bottom, the last start so far answers an end
    edges = summed.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_end")).withColumn(
        "at", F.when(F.col("is_end"), F.col("total")).otherwise(F.col("total") - F.col("words") + min_words))
    down = in_seg.orderBy(F.col("at").desc(), F.col("is_end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = in_seg.orderBy("at", "is_end").rowsBetween(Window.unboundedPreceding, 0)
    start = F.max(F.when(~F.col("is_end"), F.struct("pos", "at"))).over(up)
    # "at" of a start is min_words above the words before it: without its last line, the run still reaches min_words
    longer = F.col("total") - F.col("words") >= F.col("start.at")
    answered = (edges.withColumn("upto", F.when(~F.col("is_end"), F.min(F.when(F.col("is_end"), F.col("pos"))).over(down)))
                .withColumn("start", start).withColumn("since", F.when(F.col("is_end") & longer, F.col("start.pos")))
                .groupBy(*_PLACE, "seg", "r", "n").agg(F.max("upto").alias("upto"), F.max("since").alias("since")))
    lines_asked = F.greatest(F.col("upto") - F.col("pos") + 1, F.col("pos") - F.col("since") + 1)
    return answered.withColumn("want", F.coalesce(F.max(lines_asked).over(in_seg), F.lit(0)))


def _refined(open_: DataFrame, biggest: int, width: int) -> DataFrame:
    """Rows ranked anew by (r, r2): ``r`` grows by the rows of its class that come before, ``n`` is the size of the new class.

    A class of up to ``CELL`` rows is ranked by one window; larger ones by their
    distinct pairs, counted map-side, in cells.
    """
    by_pair = Window.partitionBy("r", "r2")
    small = (open_.filter(F.col("n") <= CELL)
             .withColumn("before", F.rank().over(Window.partitionBy("r").orderBy("r2")).cast("long") - 1)
             .withColumn("n", F.count("*").over(by_pair)))
    if biggest <= CELL:
        return small.withColumn("r", F.col("r") + F.col("before")).drop("before", "r2")
    large = open_.filter(F.col("n") > CELL).drop("n")
    pairs = large.groupBy("r", "r2").agg(F.count("*").alias("n"))
    ranked = materialize(_count_before(pairs, ["r"], F.floor(F.col("r2") / width), ["r2"], "n"))
    both = small.unionByName(large.join(ranked, ["r", "r2"]).select(*small.columns))
    return both.withColumn("r", F.col("r") + F.col("before")).drop("before", "r2")


def suffix_array(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Ranks of the suffixes that start at repeated lines, sorted as deep as a run of ``min_words`` needs.

    ``doc_id, key, pos, seg, upto, since, want, r, n, levels``: ``levels[k]`` is the
    rank by the first 2^k lines, ``r`` the last of them, ``n`` the suffixes that
    share it.  Sequences whose runs are sorted to their depth leave the rounds.
    """
    now = materialize(_places(docs, min_words).withColumn("levels", F.array("r")))
    width = max(CELL, -(-now.count() // MAX_CELLS))
    columns, done, k = now.columns, [], 0
    while True:
        done.append(now.filter(F.col("want") <= 2 ** k))
        now = now.filter(F.col("want") > 2 ** k)
        biggest = now.agg(F.max("n")).first()[0]
        if biggest is None:
            return reduce(DataFrame.unionByName, done)
        along = Window.partitionBy("doc_id", "key", "seg").orderBy("pos")
        paired = now.withColumn("r2", F.coalesce(F.lead("r", 2 ** k).over(along), F.lit(-1).cast("long")))
        if biggest > CELL:
            paired = materialize(paired)  # read along three ways
        fixed = paired.filter("n = 1").select(*columns)
        ranked = fixed.unionByName(_refined(paired.filter("n > 1"), biggest, width).select(*columns))
        now = materialize(ranked.withColumn("levels", F.array_append("levels", F.col("r"))))
        k += 1


def _looked_up(runs: DataFrame, array: DataFrame, at: str, name: str) -> DataFrame:
    """``runs`` with ``name``: the rank by 2^k lines of the suffix at line ``at`` of the run's document."""
    ranks = array.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("pos").alias("_pos"), "levels")
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & (F.col(at) == F.col("_pos"))
    return runs.join(ranks, here).withColumn(name, F.element_at("levels", F.col("k") + 1)).drop("_doc", "_key", "_pos", "levels")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, start, end, first_doc``: lines start to end are a later copy; ``first_doc`` holds the first."""
    array = suffix_array(docs, min_words)

    def asked(start: str, end: str, *more: str) -> DataFrame:
        runs = array.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
            "doc_id", "key", F.col(start).alias("pos"), F.col(end).alias("upto"), *more)
        return (runs.withColumn("depth", F.col("upto") - F.col("pos") + 1)
                .withColumn("k", F.floor(F.log2(F.col("depth").cast("double"))).cast("int"))
                .withColumn("tail_pos", F.col("upto") + 1 - F.pow(F.lit(2), F.col("k")).cast("int")))

    own = asked("pos", "upto", "levels").withColumn("head", F.element_at("levels", F.col("k") + 1)).drop("levels")
    heads = own.unionByName(_looked_up(asked("since", "pos"), array, "pos", "head"))
    headed = materialize(_looked_up(heads, array, "tail_pos", "tail").select(*_PLACE, "upto", "depth", "head", "tail"))
    # depth and both ranks name the longest-common-prefix interval
    interval = ["depth", "head", "tail"]
    firsts = headed.groupBy(*interval).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("places")).filter("places > 1")
    copies = (headed.join(firsts.drop("places"), interval).filter(~F.struct(*_PLACE).eqNullSafe(F.col("first")))
              .groupBy(*_PLACE).agg(F.max("upto").alias("upto"), F.max_by("first.doc_id", "upto").alias("first_doc")))
    by_doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    reached = F.max("upto").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("pos") <= reached + 1, 0).otherwise(1)
    runs = copies.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "key", "run").agg(F.min("pos").alias("start"), F.max("upto").alias("end"),
                                                    F.min_by("first_doc", "pos").alias("first_doc")).drop("run")


def _marked(docs: DataFrame, min_words: int, kept: list[str]) -> DataFrame:
    """``row`` (the columns ``kept`` of ``docs``), ``text``, ``_runs`` to delete (null: none), ``_lines`` in all and ``_deleted``."""
    copies = materialize(later_copies(docs, min_words))
    runs = (copies.groupBy("doc_id", "key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc"))).alias("_runs"))
            .select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_runs"))
    if copies.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text", F.col("doc_id").cast("long").alias("_id"),
                        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text_key"))
    joined = keyed.join(runs, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    count = F.aggregate("_runs", F.lit(0), lambda a, run: a + run["end"] - run["start"] + 1)
    return (joined.withColumn("_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
            .withColumn("_deleted", F.coalesce(count, F.lit(0))).drop("_id", "_doc", "_key", "_text_key"))


def _kept_text() -> Column:
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.exists("_runs", lambda run: (run["start"] <= i) & (i <= run["end"])))
    return F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, runs, text`` of every row of ``docs`` (doc_id, text; others are ignored).

    ``text`` is left without later copies of repeated line runs; ``runs`` tells
    them as (start, end, first_doc), lines from 0.  A run is one or more whole
    lines (cut at line feeds) that hold at least ``min_words`` words and stand
    at two places or more, within a document or across; the first place by
    (doc_id, nulls first, text hash, line) keeps it.  Where copies overlap
    their first, the overlapping lines go too.  A null text stays null and has
    no lines; rows equal in doc_id and text are one document and fare alike.
    """
    runs = F.coalesce(F.col("_runs"), F.array().cast("array<struct<start: int, end: int, first_doc: long>>"))
    return _marked(docs, min_words, ["doc_id"]).select("row.doc_id", F.col("_lines").cast("long").alias("n_lines"),
                                           F.col("_deleted").cast("long").alias("n_deleted"), runs.alias("runs"),
                                           _kept_text().alias("text"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text of :func:`dedup_lines`, all columns kept.

    A document whose lines have all been deleted goes (other documents hold
    them); ``n_chars``, if there, tells the new length of a changed text.
    Columns may have any names.
    """
    others = [c for c in docs.columns if c != "text"]
    changed = F.col("_deleted") > 0
    rows = _marked(docs, min_words, others).filter(~changed | (F.col("_deleted") < F.col("_lines"))).withColumn("text", _kept_text())
    own = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in own:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(changed, length).otherwise(own["n_chars"])
    return rows.select(*(own[c].alias(c) for c in docs.columns))


def oracle_sql(min_words: int = MIN_WORDS, table: str = "documents") -> str:
    """The same in DuckDB SQL, by comparing every line with its equal earlier ones: doc_id, n_lines, n_deleted, text.

    Neighbouring pairs of equal lines make up the longest common runs of two
    places; the later lines of those with ``min_words`` words go.
    """
    steps = [
        f"d as (select doc_id, coalesce(text, '') as text from {table})",
        "l as (select doc_id, i as pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from "
        "(select doc_id, unnest(string_split(text, chr(10))) as line, "
        "unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d))",
        "p as (select b.doc_id, b.pos, b.words, a.doc_id as first_doc, b.pos - a.pos as apart from l a join l b on a.line = b.line "
        "and (a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.pos < b.pos))",
        "r as (select *, pos - row_number() over (partition by doc_id, first_doc, apart order by pos) as run from p)",
        "s as (select *, sum(words) over (partition by doc_id, first_doc, apart, run) as total from r)",
        f"x as (select distinct doc_id, pos from s where total >= {min_words})",
    ]
    return "with " + reduce(lambda a, b: f"{a},\n{b}", steps) + """
select l.doc_id, count(*) as n_lines, count(x.pos) as n_deleted,
       coalesce(string_agg(line, chr(10) order by l.pos) filter (where x.pos is null), '') as text
from l left join x on l.doc_id = x.doc_id and l.pos = x.pos group by 1"""
