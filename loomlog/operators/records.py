"""Filters, joins and searches over records and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import snippet
from ..sources.files import kept


def display(records: DataFrame) -> DataFrame:
    """Boundaries and messages of the three roles."""
    return records.filter((F.col("kind") == "boundary") | F.col("role").isin("user", "assistant", "system"))


def contains(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower())


def search(lines: DataFrame, query: str, key: str = "session_id", order: str = "line_no", text: str = "text", snippets: int = 3) -> DataFrame:
    """Per session: matches and the first snippets; a blank query finds nothing.

    The first lines are chosen by rank before they are gathered, so a session with very many hits stays small.
    """
    hits = lines.filter(contains(F.col(text), query)) if query.strip() else lines.limit(0)
    ranked = hits.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= snippets, F.struct(F.col("__n").alias("n"), snippet(F.col(text), query).alias("s"))))), lambda x: x["s"])
    return ranked.groupBy(key).agg(F.count("*").alias("matches"), first.alias("snippets")).orderBy(F.desc("matches"), key)


def sidebar(sessions: DataFrame, projects: DataFrame, query: str) -> DataFrame:
    """A project whose name matches keeps all its sessions, else those whose title matches."""
    joined = sessions.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    return joined.filter(contains(F.col("name"), query) | contains(F.col("title"), query))


def last_results(blocks: DataFrame) -> DataFrame:
    """(session_id, tool_use_id, content, is_error): of several results of one call the last."""
    r = blocks.filter("type = 'tool_result' AND tool_use_id IS NOT NULL").groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("content", "is_error"), F.struct("line_no", "pos")).alias("r"))
    return r.select("session_id", "tool_use_id", "r.*")


def with_results(blocks: DataFrame) -> DataFrame:
    """Tool calls with their results."""
    r = last_results(blocks).select(F.col("session_id").alias("__s"), F.col("tool_use_id").alias("__t"), F.col("content").alias("result"), F.col("is_error").alias("result_error"))
    return blocks.join(r, (F.col("session_id") == F.col("__s")) & (F.col("id") == F.col("__t")) & (F.col("type") == "tool_use"), "left").drop("__s", "__t")


def tool_calls(blocks: DataFrame) -> DataFrame:
    """(session_id, line_no, tool, category, failed, file) of each tool call among content blocks and their results."""
    from ..functions.scalars import tool_category

    file = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"), F.get_json_object("input", "$.notebook_path"))
    calls = with_results(blocks).filter("kind = 'assistant' AND type = 'tool_use'")
    return calls.select("session_id", "line_no", F.col("name").alias("tool"), tool_category(F.col("name")).alias("category"), F.coalesce("result_error", F.lit(False)).alias("failed"), file.alias("file"))


def tool_report(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, failures, failure rate and distinct files of :func:`tool_calls`, by tool or category."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.countDistinct("file").alias("files")).withColumn("error_rate", F.col("errors") / F.col("calls"))


def allow_deny_conflicts(allow: DataFrame, deny: DataFrame) -> DataFrame:
    """The first deny entry of each allow entry of which one is the other or a folder above it.

    Entries are compared with a closing slash. Equal prefixes meet by an equi-join on every folder of the longer entry, so nothing is
    compared pairwise.
    """
    closed = lambda c: F.when(c.endswith("/"), c).otherwise(F.concat(c, F.lit("/")))
    parts = lambda c: F.split(c, "/")
    folders = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c)) - 1), lambda n: F.concat(F.array_join(F.slice(parts(c), 1, n), "/"), F.lit("/")))
    a = allow.select(F.col("entry").alias("a"), F.col("pos").alias("ap"), closed(F.col("entry")).alias("ac"))
    d = deny.select(F.col("entry").alias("d"), F.col("pos").alias("dp"), closed(F.col("entry")).alias("dc"))
    longer_allow = a.withColumn("p", F.explode(folders(F.col("ac")))).join(d, F.col("p") == F.col("dc")).select("a", "ap", "d", "dp")
    longer_deny = d.withColumn("p", F.explode(folders(F.col("dc")))).join(a, F.col("p") == F.col("ac")).select("a", "ap", "d", "dp")
    return longer_allow.unionByName(longer_deny).groupBy("a", "ap").agg(F.min_by("d", "dp").alias("d"))


def import_lines(docs: DataFrame) -> DataFrame:
    """(src, pos, dst): the files that the lines ``@import <path>`` of ``docs`` (path, content) name, in order.

    A relative path starts at the importing file's folder and loses its ``.`` and ``..``; an absolute one is taken as it is.
    """
    said = F.regexp_extract_all("content", F.lit(r"(?m)^@import[\s\x{a0}\x{feff}]+(.+)$"), F.lit(1))
    named = docs.select(F.col("path").alias("src"), F.posexplode(said).alias("pos", "said")).withColumn("said", F.regexp_replace("said", r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", ""))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    folder = F.regexp_replace("src", "[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, "said"), "/"), lambda x: ~x.isin("", "."))
    normal = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    resolved = F.concat(F.when(F.col("src").startswith("/"), "/").otherwise(""), F.array_join(normal, "/"))
    return named.select("src", "pos", F.when(F.col("said").startswith("/"), F.col("said")).otherwise(resolved).alias("dst"))


def import_chains(docs: DataFrame, roots: DataFrame, stop: int = 10) -> DataFrame:
    """(root, depth): how deep the imports of each of ``roots`` (path) go among ``docs`` (path, content), depth first.

    A file counts at the depth at which the first chain, in the order of the lines, meets it: a target that is missing or was met before ends
    its chain there, and no chain is followed beyond ``stop`` + 1. What is within ``stop`` steps of a root is gathered by joins, one for each step; the
    order of the walk is then a root's own affair.
    """
    edges = kept(import_lines(docs), "imports")
    front = kept(roots.select(F.col("path").alias("root"), F.col("path").alias("node")).distinct(), "imports")
    seen, held = front, None
    for _ in range(stop + 1):
        step = kept(front.join(edges, front.node == edges.src).select("root", "src", "pos", "dst"), "imports")
        held = step if held is None else held.unionByName(step)
        front = kept(step.select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"), "imports")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)

    def depth_of(root: str, targets: dict[str, list[str]]) -> int:
        met, most, todo = set(), 0, [(root, 0)]
        while todo:
            node, depth = todo.pop()
            most = max(most, depth)
            if depth <= stop and node not in met:
                met.add(node)
                todo.extend((dst, depth + 1) for dst in reversed(targets.get(node, [])))
        return most

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come by root, file and place; a root's are held until the next root."""
        root, targets = None, {}
        for batch in batches:
            out = []
            for r, src, dst in zip(batch["root"], batch["src"], batch["dst"], strict=True):
                if r != root:
                    if targets:
                        out.append((root, depth_of(root, targets)))
                    root, targets = r, {}
                targets.setdefault(src, []).append(dst)
            yield pd.DataFrame(out, columns=["root", "depth"])
        if targets:
            yield pd.DataFrame({"root": [root], "depth": [depth_of(root, targets)]})

    deep = held.repartition("root").sortWithinPartitions("root", "src", "pos").select("root", "src", "dst").mapInPandas(walk, "root string, depth long")
    return roots.select(F.col("path").alias("root")).distinct().join(deep, "root", "left").select("root", F.coalesce("depth", F.lit(0)).alias("depth"))


def import_depths(edges: DataFrame, roots: DataFrame, cap: int = 10) -> DataFrame:
    """(root, node, depth) of everything reached over (src, dst) within ``cap`` steps; a node counts at its first depth."""
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, cap + 1):
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def novel(findings: DataFrame, alerted: DataFrame) -> DataFrame:
    """Findings whose fingerprint (check id and masked value) has not been alerted."""
    print_ = F.concat_ws(":", "check_id", "masked")
    return findings.withColumn("fingerprint", print_).join(alerted.select("fingerprint"), "fingerprint", "left_anti")


def turn_at(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` with turn_line, the last turn of their session that has their timestamp."""
    keys = ["project_id", "session_id", "ts"]
    return rows.join(turns.groupBy(*keys).agg(F.max("line_no").alias("turn_line")), keys, "left")


def with_tags(sessions: DataFrame, stored: DataFrame) -> DataFrame:
    """Automatic and stored tags together, each once."""
    t = stored.select(F.col("session_id").alias("__s"), F.col("tags").alias("__t"))
    return sessions.join(t, F.col("session_id") == F.col("__s"), "left").withColumn("tags", F.array_distinct(F.concat("tags", F.coalesce("__t", F.array().cast("array<string>"))))).drop("__s", "__t")
