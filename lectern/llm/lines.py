"""Lines of articles and the sites they stand on, as the line-based operators need them.

Rows with a null id are left out; repeated rows of an id count once; null and empty contents have no lines
but their articles still count for their site. Lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import staged

#: What surrounds a line without being part of it (the characters Unicode calls white space, without the line feed).
BLANKS = " \t\r\f\x0b\x85\xa0                　"
#: Marks that end a sentence in the scripts of the corpus, and what may close after them.
CLOSED = r"""[.!?…。！？।؟｡][*_"”»’')」』\])）]*$"""
LIST_ITEM = r"^([-*•·–]|[0-9]+[.)])[\s ]"
#: A mark that points elsewhere, unless it opens a quotation.
POINTER = r"^(?:[»›→←▸►⟶]|«(?![^»]*»)|‹(?![^›]*›))\s"


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def alike(line: Column) -> Column:
    """The form in which two stripped lines count as the same: collapsed white space, lower case, one mark for every run of digits."""

    def collapsed(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x)

    return once(F.translate(line, BLANKS[1:], " " * (len(BLANKS) - 1)), lambda x: F.lower(F.regexp_replace(collapsed(x), r"\p{Nd}+", "0")))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bare_domain(domain: Column) -> Column:
    """A site's name without case, surrounding blanks and a leading ``www.``."""
    return F.regexp_replace(F.lower(F.trim(domain, F.lit(BLANKS + "\n"))), r"^www\.", "")


def with_site(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``site``: the source's id, else the id of the source with the article's domain, else that domain, else ``none``.

    ``sources`` has one row a site; the optimizer broadcasts it where it is small enough and joins by key where not.
    """
    names = sources.where(F.col("domain").isNotNull()).groupBy(bare_domain(F.col("domain")).alias("_name")).agg(F.min("id").alias("_by_name"))
    named = articles.withColumn("_name", F.when(F.col("source_id").isNull(), bare_domain(F.col("source_domain"))))
    site = F.coalesce(F.col("source_id").cast("string"), F.col("_by_name").cast("string"), F.col("_name"), F.lit("none"))
    return named.join(names, "_name", "left").withColumn("site", site).drop("_name", "_by_name")


#: Repeated ids that are sent to every executor at most (8 bytes each); more are joined by key.
FEW_IDS = 2_000_000


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each ``key`` without moving the others: only rows whose key repeats are shuffled. Null keys are left out."""
    again = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(key), "repeated-ids")
    again = F.broadcast(again) if again.count() <= FEW_IDS else again
    return rows.where(F.col(key).isNotNull()).join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))


def line_array(content: Column) -> Column:
    """The non-blank lines of a content as an array of (no, text), text without surrounding blanks."""
    lines = F.transform(F.split(content, "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), stripped(x).alias("text")))
    return F.coalesce(F.filter(lines, lambda l: l["text"] != ""), F.array().cast("array<struct<no:int,text:string>>"))
