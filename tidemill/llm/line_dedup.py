"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

The lines of a document that hold a word form a sequence of line ids (a line's id is the MD5 of its text). No
repeated run crosses a line that occurs only once, so sequences are cut at these lines into islands, and only
suffixes of islands are sorted.

*Prefix doubling.* A suffix has a path of ranks: of its first line, of its first 2, 4, 8, ... lines. The next
rank numbers the sorted distinct pairs (last rank here, path of the suffix that many lines on). Paths order
suffixes as a suffix array does. A suffix goes on to the next round while its rank repeats and its island is
longer than what the rank covers; the rounds end when no suffix goes on, or when ranks cover as many lines as
the longest common prefix that is asked for.

*Longest common prefixes.* Neighbours of the suffix array share the lines of the last rank that they have in
common, and what the suffixes behind these lines share; those are looked up in the same way, so a length is
the sum of a few powers of two.

*Intervals.* A run of n lines is an interval of the suffix array: neighbours with n lines or more in common.
Its earliest member is the first copy, all others are later copies. A line is deleted if it belongs to a later
copy of a run with ``min_words`` words, but not to the first copy, which may overlap the later one. All such
lines lie in least runs, which have ``min_words`` words but not without their first or not without their last
line. So intervals are looked up for the least runs that begin at a suffix, of ``min_words`` lines at most;
together they cover the later copies of all maximal runs, however long.

All steps are Spark SQL expressions, joins, aggregates and windows. Windows run over one document's lines or
over one range of the suffix array; ranges are joined by one row a range. Crowded lines are counted first and
joined by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_name, join_counted

MIN_WORDS = 10
_WORD = "[^ \\t-\\r]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _held(text: Column) -> Column:
    """Lines of a text that hold a word: number, id and words of each."""

    def one(x: Column, i: Column) -> Column:
        return F.when(x.rlike(_WORD), F.struct(i.alias("line"), F.unhex(F.md5(x)).alias("h"), F.regexp_count(x, F.lit(_WORD + "+")).alias("words")))

    return F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull())


def _numbered(groups: DataFrame, *keys: str) -> DataFrame:
    """Adds ``r``, which numbers the rows in the order of ``keys``, and writes the table."""
    return durable(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()), "ranks")


def _least_runs(ahead: Column, min_words: int) -> Column:
    """Lengths of the runs from a line on that have ``min_words`` words, but not without their last or first line."""
    total = lambda n: F.aggregate(F.slice(ahead, 1, n), F.lit(0), lambda x, w: x + w)
    first = F.get(ahead, F.lit(0))
    fits = lambda n: (total(n) >= min_words) & ((total(n - 1) < min_words) | (total(n) - first < min_words))
    some = F.filter(F.sequence(F.lit(1), F.size(ahead)), fits)
    # quick for what most lines are: long, and before a long one or the last
    return F.when((first >= min_words) & (F.coalesce(F.get(ahead, F.lit(1)), F.lit(min_words)) >= min_words), F.array(F.lit(1))).otherwise(some)


def _islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines as suffixes of islands: ``d``, ``at``, ``line``, ``left`` (lines to the island's end), ``least``, ``path``, ``n``."""
    ranks = _numbered(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")
    # a document that repeats in id and text is one: its lines count once
    rows = join_counted(lines, ranks, ["h"], lines.count()).select("d", "at", "line", "words", "r", "n").distinct()
    place = Window.partitionBy("d").orderBy("at")
    rows = rows.withColumn("island", F.col("at") - F.row_number().over(place))
    whole = Window.partitionBy("d", "island")
    inside = whole.orderBy("at")
    ahead = F.collect_list(F.least("words", F.lit(min_words))).over(inside.rowsBetween(0, max(min_words, 1) - 1))
    rows = rows.withColumn("left", (F.max("at").over(whole) - F.col("at") + 1).cast("int")).withColumn("ahead", ahead)
    return durable(rows.select("d", "at", "line", "left", _least_runs(F.col("ahead"), min_words).alias("least"), F.array("r").alias("path"), "n"), "suffixes")


def _at(suffixes: DataFrame, path: str, d: str, at: str) -> DataFrame:
    return suffixes.select(F.col("d").alias(d), F.col("at").alias(at), F.col("path").alias(path))


def suffix_paths(suffixes: DataFrame, most: int | None = None) -> DataFrame:
    """Prefix doubling: ``suffixes`` with paths that go on until no rank repeats or the island ends.

    With ``most``, ranks that cover so many lines are the last: the order of suffixes that share more is left open.
    """
    done, state, length = [], suffixes, 1
    while True:
        goes_on = (F.col("n") > 1) & (F.col("left") > length)
        if most is not None and length >= most:
            goes_on = F.lit(False)
        done.append(state.where(~goes_on).drop("n"))
        going = state.where(goes_on).drop("n")
        total = going.count()
        if not total:
            return reduce(DataFrame.unionByName, done)
        others = _at(reduce(DataFrame.unionByName, [*done, going]), "b", "d2", "at2")
        here = F.col("d").eqNullSafe(F.col("d2")) & (F.col("at") + length == F.col("at2"))
        pairs = durable(going.join(others, here).select(*going.columns, F.element_at("path", -1).alias("a"), "b"), "pairs")
        ranks = _numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b")
        joined = join_counted(pairs, ranks, ["a", "b"], total)
        state = durable(joined.select("d", "at", "line", "left", "least", F.concat("path", F.array("r")).alias("path"), "n"), "suffixes")
        length *= 2


def _shared(left: str, right: str) -> Column:
    """Lines that the last rank common to two paths covers; 0 if the first lines differ. Ranks name their level's classes."""
    common = F.size(F.filter(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), lambda same: same))
    return F.when(common > 0, F.pow(F.lit(2.0), common - 1).cast("int")).otherwise(0)


def suffix_array(suffixes: DataFrame, most: int) -> DataFrame:
    """Suffixes in order: ``part``, ``seq`` (ascending), d, at, least, and ``lcp``, the lines shared with the one before, ``most`` at most."""
    key = ["path", "d", "at"]
    ordered = suffixes.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered = durable(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "order")
    one = F.struct("d", "at", "left", "path")
    # a range begins behind the last suffix of the range before: one row a range
    last = ordered.groupBy("part").agg(F.max_by(one, "seq").alias("last")).select("part", F.lag("last").over(Window.orderBy("part")).alias("border"))
    rows = ordered.join(F.broadcast(last), "part").withColumn("before", F.coalesce(F.lag(one).over(Window.partitionBy("part").orderBy("seq")), "border"))
    fits = F.coalesce(F.least(F.lit(most), "left", "before.left"), F.lit(0))
    keep = ["part", "seq", "d", "at", "least"]
    more = F.coalesce(_shared("path", "before.path"), F.lit(0))
    # behind a single common line, or none, the next lines are known to differ
    rows = rows.select(*keep, F.col("before.d").alias("d3"), F.col("before.at").alias("at3"), fits.alias("fits"), F.least(more, fits).alias("lcp"), (more > 1).alias("open"))
    found = []
    while True:
        rows = durable(rows, "lcp")
        going = F.col("open") & (F.col("lcp") < F.col("fits"))
        found.append(rows.where(~going).select(*keep, "lcp"))
        rows = rows.where(going)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)
        ours = _at(suffixes, "p", "d4", "at4")
        theirs = _at(suffixes, "q", "d5", "at5")
        rows = rows.join(ours, F.col("d").eqNullSafe(F.col("d4")) & (F.col("at") + F.col("lcp") == F.col("at4")))
        rows = rows.join(theirs, F.col("d3").eqNullSafe(F.col("d5")) & (F.col("at3") + F.col("lcp") == F.col("at5")))
        more = _shared("p", "q")
        rows = rows.select(*keep, "d3", "at3", "fits", F.least(F.col("lcp") + more, F.col("fits")).alias("lcp"), (more > 1).alias("open"))


def later_copies(order: DataFrame, most: int) -> DataFrame:
    """Lines ``d``, ``at`` in later copies of the least runs, but not in the first copy, each once."""
    starts = lambda f: [f(F.when(F.col("lcp") < n, F.col("seq"))) for n in range(1, most + 1)]
    # an interval is named by its first suffix, which may lie in an earlier range
    borders = order.groupBy("part").agg(*[x.alias(f"s{i}") for i, x in enumerate(starts(F.max))])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("part", F.array(*[F.max(f"s{i}").over(earlier) for i in range(most)]).alias("carried"))
    upto = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = order.join(F.broadcast(borders), "part").select("d", "at", "least", F.array(*starts(lambda x: F.max(x).over(upto))).alias("own"), "carried")
    runs = named.select("d", "at", "own", "carried", F.explode("least").alias("lines"))
    runs = durable(runs.select("d", "at", "lines", F.coalesce(F.get("own", F.col("lines") - 1), F.get("carried", F.col("lines") - 1)).alias("start")), "runs")
    groups = runs.groupBy("lines", "start").agg(F.count("*").alias("n"), F.min(F.struct("d", "at")).alias("first")).where("n > 1")
    later = join_counted(runs, groups, ["lines", "start"], runs.count()).where(~F.struct("d", "at").eqNullSafe(F.col("first")))
    begin = F.when(F.col("d").eqNullSafe(F.col("first.d")), F.greatest("at", F.col("first.at") + F.col("lines"))).otherwise(F.col("at"))
    return later.select("d", F.explode(F.sequence(begin, F.col("at") + F.col("lines") - 1)).alias("at")).distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of lines to delete: ``id``, ``tie`` (hash of the text) and ``line`` (from 0), each once."""
    text = F.col(text_col)
    d = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"))
    lines = docs.where(text.isNotNull()).select(d.alias("d"), F.posexplode(_held(text)).alias("at", "x"))
    lines = durable(lines.select("d", "at", "x.line", "x.h", "x.words"), "lines")
    # least runs have at most min_words lines, so no longer common prefix is asked for
    most = max(min_words, 1)
    suffixes = durable(suffix_paths(_islands(lines, min_words), most), "paths")
    gone = later_copies(suffix_array(suffixes, most), most).toDF("d2", "at2")
    here = F.col("d").eqNullSafe(F.col("d2")) & (F.col("at") == F.col("at2"))
    return suffixes.join(gone, here, "left_semi").select("d.id", "d.tie", "line")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text_col``; all rows and columns stay.

    Adds ``lines`` (lines with a word), ``deleted`` (of these) and ``runs`` (stretches of deleted lines), with an
    underscore appended where ``docs`` has such a column. A line is deleted if a run of lines, of any length,
    that holds it has ``min_words`` words and occurs at an earlier place (in the order of id, null first, text
    hash and line), and the first of these places does not hold the line: of copies that overlap, the first
    stays whole. Lines without a word are passed over and stay. Rows that repeat in id and text are one
    document and get the same result; null texts stay null; an empty table stays empty.
    """
    own = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(own))])
    inner_id, inner_text = (f"c{own.index(c)}" for c in (id_col, text_col))
    gone = repeated_lines(inner, min_words, inner_id, inner_text).groupBy(F.col("id").alias("gone_id"), F.col("tie").alias("gone_tie")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    joined = inner.withColumn("tie", F.xxhash64(inner_text)).join(gone, F.col(inner_id).eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left")
    lines = _lines(F.col(inner_text))
    held = F.filter(lines, lambda x: x.rlike(_WORD))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(inner_text)).otherwise(kept)
    # a stretch begins where the line before is not deleted
    runs = F.size(F.filter("gone", lambda g, i: (i == 0) | ~F.get("gone", i - 1).eqNullSafe(g - 1)))
    added = {"lines": F.size(held), "deleted": F.size("gone"), "runs": runs}
    return joined.select(
        *[(text if c == inner_text else F.col(c)).alias(name) for c, name in zip(inner.columns, own, strict=True)],
        *[F.coalesce(F.when(x >= 0, x), F.lit(0)).cast("long").alias(free_name(name, own)) for name, x in added.items()],
    )
