"""Review state as tables: marks (doc_id, paragraph, start, end, level, rule, word, fix, status), decisions, lists, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ACCEPTED, REJECTED = "open", "accepted", "rejected"


def counts(marks: DataFrame, by: list[str]) -> DataFrame:
    """Marks by status and level."""
    open_marks = F.col("status") == OPEN
    return marks.groupBy(*by).agg(F.count_if(open_marks & (F.col("level") == "error")).alias("errors"), F.count_if(open_marks & (F.col("level") == "check")).alias("checks"), F.count_if(F.col("status") == ACCEPTED).alias("accepted"), F.count_if(F.col("status") == REJECTED).alias("rejected"))


def accept_errors(marks: DataFrame) -> DataFrame:
    """Open errors with a suggestion become accepted."""
    sure = (F.col("status") == OPEN) & (F.col("level") == "error") & F.col("fix").isNotNull()
    return marks.withColumn("status", F.when(sure, ACCEPTED).otherwise(F.col("status")))


def dismiss_words(marks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Open marks of a word in the user's dictionary, whatever its case, become rejected."""
    own = dictionary.select(F.lower("word").alias("_w")).distinct().withColumn("_known", F.lit(True))
    out = marks.join(own, F.lower(marks["word"]) == F.col("_w"), "left")
    return out.withColumn("status", F.when((F.col("status") == OPEN) & F.col("_known"), REJECTED).otherwise(F.col("status"))).drop("_w", "_known")


def neighbours(marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``next_open`` and ``previous_open`` of each mark, wrapping around within ``keys``; the order columns identify a mark."""
    w = Window.partitionBy(*keys)
    place = F.when(F.col("status") == OPEN, F.struct(*order))
    ahead = F.first(place, ignorenulls=True).over(w.orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    behind = F.last(place, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return marks.withColumns({"next_open": F.coalesce(ahead, F.min(place).over(w)), "previous_open": F.coalesce(behind, F.max(place).over(w))})


def invalidate(marks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Marks without those of replaced paragraphs."""
    return marks.join(paragraphs.select("doc_id", "paragraph").distinct(), ["doc_id", "paragraph"], "left_anti")


def undone(log: DataFrame, keys: list[str], order: str, is_undo: Column) -> DataFrame:
    """Entries of an undo log that stand: each undo takes back the newest entry not taken back yet, if there is one.

    An entry stands unless the number of open entries falls below its own later on; all by running sums and minima."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    rows = log.withColumn("_u", is_undo).withColumn("_run", F.sum(F.when(F.col("_u"), -1).otherwise(1)).over(upto))
    rows = rows.withColumn("_open", F.col("_run") - F.least(F.lit(0), F.min("_run").over(upto)))
    rows = rows.withColumn("_low", F.min("_open").over(after))
    return rows.where(~F.col("_u") & (F.coalesce("_low", "_open") >= F.col("_open"))).select(*log.columns)


def merged_dictionary(mine: DataFrame, imported: DataFrame) -> DataFrame:
    """Words of both lists, one a word ignoring case; mine are spelt as I have them."""
    both = mine.select("word", F.lit(0).alias("_p")).union(imported.select("word", F.lit(1)))
    tidy = both.withColumn("word", F.trim("word")).where("word <> ''")
    return tidy.groupBy(F.lower("word").alias("_k")).agg(F.min_by("word", F.struct("_p", "word")).alias("word")).select("word")


def recent(files: DataFrame, most: int = 20) -> DataFrame:
    """The newest opening of each path, newest first, at most ``most``; impossible times are left out."""
    good = files.where("opened_at >= 0 and opened_at < 4000000000")
    return good.groupBy("path").agg(F.max("opened_at").alias("opened_at")).orderBy(F.desc("opened_at"), "path").limit(most)


def with_defaults(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """(name, value): every default, overridden where set; unknown names are left out."""
    own = settings.select("name", F.col("value").alias("_v"))
    return defaults.join(own, "name", "left").select("name", F.coalesce("_v", "value").alias("value"))


def progress(stages: DataFrame, order: str) -> DataFrame:
    """Stages (stage, total, done, cost, seconds) with ``fraction`` of the weighted work that is done up to and in the
    stage, and ``left``: seconds for the rest at the measured rate; null before two steps are done."""
    work, done = F.col("total") * F.col("cost"), F.col("done") * F.col("cost")
    w = Window.partitionBy()
    return stages.withColumn("fraction", F.sum(done).over(w.orderBy(order)) / F.sum(work).over(w)).withColumn(
        "left", F.when(F.sum("done").over(w) >= 2, F.sum("seconds").over(w) / F.sum(done).over(w) * (F.sum(work).over(w) - F.sum(done).over(w))))


def current_place(replacements: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """``positions`` (keys, pos) moved from original to current coordinates by the replacements before them."""
    r = replacements.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), (F.length("fix") - (F.col("end") - F.col("start"))).alias("_d"))
    moved = positions.join(r, keys, "left").groupBy(*keys, "pos").agg(F.coalesce(F.sum(F.when(F.col("_e") <= F.col("pos"), F.col("_d"))), F.lit(0)).alias("_m"))
    return moved.select(*keys, "pos", (F.col("pos") + F.col("_m")).alias("current"))


def corrected_name(path: Column, taken: Column) -> Column:
    """A name for the corrected copy that is not among the taken ones: ``name (corrected).ext``, then with numbers."""
    stem, ending = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    names = F.concat(F.array(F.concat(stem, F.lit(" (corrected)"), ending)), F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: F.concat(stem, F.lit(" (corrected "), k.cast("string"), F.lit(")"), ending)))
    return F.element_at(F.filter(names, lambda n: ~F.array_contains(taken, n)), 1)
