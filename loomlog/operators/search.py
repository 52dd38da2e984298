"""Search over the texts of transcripts, with an index of trigrams that narrows it down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import contains, search

GRAM = 3
PLACE = ["project_id", "session_id", "line_no", "pos"]


def texts(records: DataFrame) -> DataFrame:
    """(project_id, session_id, line_no, pos, text): the texts and thoughts of sessions' own lines, each of a block; a block's text comes first."""
    own = records.filter("agent_id IS NULL").select("project_id", "session_id", "line_no", F.explode("blocks").alias("b"))
    parts = F.array(F.struct((F.col("b.pos") * 2).alias("pos"), F.col("b.text").alias("text")), F.struct((F.col("b.pos") * 2 + 1).alias("pos"), F.col("b.thinking").alias("text")))
    return own.select("project_id", "session_id", "line_no", F.explode(parts).alias("p")).select("project_id", "session_id", "line_no", "p.*").filter("text <> ''")


def titles(records: DataFrame) -> DataFrame:
    """(project_id, session_id, title): a session's first slug, else its id."""
    own = records.filter("agent_id IS NULL").groupBy("project_id", "session_id").agg(F.min_by("slug", F.when(F.col("slug") != "", F.col("line_no"))).alias("slug"))
    return own.select("project_id", "session_id", F.coalesce("slug", "session_id").alias("title"))


def postings(texts: DataFrame) -> DataFrame:
    """(gram, place): where each run of three characters, in lower case, occurs; sorted by gram, so that files can be skipped by it.

    Rows carry their project and session, so :func:`loomlog.sources.incremental.refresh` keeps them like sessions.
    """
    chars = F.split(F.lower("text"), "")
    at = lambda i: F.element_at("__c", i)
    grams = F.transform(F.sequence(F.lit(1), F.size("__c") - (GRAM - 1)), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    long_enough = texts.select(*PLACE, chars.alias("__c")).filter(F.size("__c") >= GRAM)
    rows = long_enough.select(*PLACE, F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.repartitionByRange("gram", "session_id", "line_no").sortWithinPartitions("gram")


def candidates(index: DataFrame, query: str) -> DataFrame:
    """The places that hold every trigram of ``query``."""
    low = query.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    held = index.filter(F.col("gram").isin(grams)).groupBy(*PLACE).agg(F.count("*").alias("n"))  # a place has a gram once
    return held.filter(F.col("n") == len(grams)).drop("n")


def search_sessions(texts: DataFrame, titles: DataFrame, query: str, index: DataFrame | None = None, snippets: int = 3) -> DataFrame:
    """(project_id, session_id, title, matches, snippets): a match for each text that holds ``query``, whatever the case; most matches first.

    With an ``index`` (:func:`postings` of the same texts) only texts that hold all trigrams are looked at; queries of under three characters, or whose
    length changes with the case, scan. A blank query finds nothing.
    """
    usable = index is not None and len(query.strip()) > 0 and len(query.lower()) == len(query) >= GRAM
    chosen = texts.join(candidates(index, query), PLACE, "left_semi") if usable else texts
    keyed = chosen.filter(contains(F.col("text"), query)).withColumn("key", F.struct("project_id", "session_id")).withColumn("at", F.struct("line_no", "pos"))
    found = search(keyed, query, "key", "at", snippets=snippets).select("key.*", "matches", "snippets")
    return found.join(titles, ["project_id", "session_id"], "left").select("project_id", "session_id", F.coalesce("title", "session_id").alias("title"), "matches", "snippets").orderBy(F.desc("matches"), "session_id")
