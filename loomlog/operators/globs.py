"""Which globs match a file: globs are compiled to segments and met by files on the literal segments they hold.

A glob is anchored at its root. ``*`` and ``?`` match inside a segment, ``**`` as a whole segment any number of segments, ``[a-z]`` and ``[!a]`` a
character, ``{a,b}`` alternatives, ``\\`` escapes. A wildcard at the start of a segment matches no leading dot. Folders count as files.

Every compiled glob has an anchor, the most telling thing that each file it matches must have at a fixed place: a literal segment counted from the
start or, behind ``**``, from the end; else how its last segment ends; else nothing. Files and folders have the same keys, and only equal
keys meet, so a glob is compared with the files of its anchor and not with all.

Defined cases: null and blank globs match nothing; a glob with unbalanced brackets is taken as it can be read; repeated globs and paths count once;
a glob of wildcards alone meets every path of its root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "punct": r"\p{P}"}
TAIL = 8  #: characters of a last segment's literal end that make a key


def split_top(body: str, at: str) -> list[str]:
    """``body`` cut at ``at`` outside braces."""
    depth, parts, i = 0, [""], 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            parts[-1] += body[i : i + 2]
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        if c == at and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
        i += 1
    return parts


def brace(glob: str) -> tuple[int, int] | None:
    """The first outermost group of alternatives."""
    depth, first, i = 0, 0, 0
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == "{":
            first = i if depth == 0 else first
            depth += 1
        elif glob[i] == "}" and depth:
            depth -= 1
            if depth == 0 and (len(split_top(glob[first + 1 : i], ",")) > 1 or span(glob[first + 1 : i])):
                return first, i
        i += 1
    return None


def span(body: str) -> list[str]:
    """``1..3`` and ``a..c``."""
    found = re.fullmatch(r"(-?\d+)\.\.(-?\d+)|([A-Za-z])\.\.([A-Za-z])", body)
    if not found:
        return []
    ends = [int(x) for x in found.groups()[:2]] if found[1] else [ord(x) for x in found.groups()[2:]]
    step = 1 if ends[0] <= ends[1] else -1
    return [str(n) if found[1] else chr(n) for n in range(ends[0], ends[1] + step, step)]


def alternatives(glob: str) -> Iterator[str]:
    """Globs without braces that together match what ``glob`` does."""
    at = brace(glob)
    if at is None:
        yield glob
        return
    first, last = at
    body = glob[first + 1 : last]
    for choice in span(body) or split_top(body, ","):
        yield from alternatives(glob[:first] + choice + glob[last + 1 :])


def segment(text: str) -> tuple[str | None, str, str]:
    """Of a segment: the literal it is or None, a Java pattern, and the literal it ends in."""
    literal, pattern, tail, wild, i = "", "", "", False, 0
    while i < len(text):
        c = text[i]
        if c == "[" and (close := text.find("]", i + 2)) > 0:
            body = text[i + 1 : close]
            if body.startswith("[:") and text[close + 1 : close + 2] == "]":
                close += 1
                body = CLASSES.get(body[2:-1], "")
            else:
                body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if body[0] in "!^" else body)
                body = ("^/" if text[i + 1] in "!^" else "") + body
            pattern += f"[{body}]" if body else "(?!)"
            wild, tail, i = True, "", close
        elif c in "*?":
            pattern += "[^/]*" if c == "*" else "[^/]"
            wild, tail = True, ""
        else:
            if c == "\\" and i + 1 < len(text):
                i += 1
            pattern += re.sub(r"([^\w])", r"\\\1", text[i]) if text[i].isascii() else text[i]
            literal, tail = literal + text[i], tail + text[i]
        i += 1
    if not wild:
        return literal, pattern, literal
    if text[0] in "*?[":
        pattern = r"(?!\.)" + ("(?=.)" if set(text) == {"*"} else "") + pattern
    return None, pattern, tail


def compiled(glob: str) -> list[tuple[str, str]]:
    """(key, Java pattern) for each alternative of ``glob``."""
    out = []
    for one in alternatives(glob):
        parts = [p for p in re.sub(r"^(\./)+", "", one).split("/") if p]
        parts = [p for i, p in enumerate(parts) if p != "**" or parts[i - 1 : i] != ["**"]]
        if not parts:
            continue
        pattern, keys, deep = "^", [], "**" in parts
        start = parts.index("**") if deep else len(parts)
        end = len(parts) - 1 - parts[::-1].index("**") if deep else -1
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            if p == "**":
                below = r"(?:/(?!\.)[^/]+)*"  # a deep last segment also matches the folder it stands in
                pattern += r"(?:(?!\.)[^/]+/)*" if not last else below if i else r"(?!\.)[^/]+" + below
                continue
            literal, own, tail = segment(p)
            pattern += own + ("" if last or parts[i + 1 :] == ["**"] else "/")
            if literal is not None and i < start:
                keys.append((i + 1, f"s{i}:{literal}"))
            if literal is not None and i > end >= 0:
                keys.append((i + 1, f"e{len(parts) - 1 - i}:{literal}"))
            if last and literal is None and tail:
                keys.append((0, f"t:{tail[-TAIL:]}"))
        out.append((max(keys)[1] if keys else "", pattern + "$"))
    return out


def compiled_globs(globs: DataFrame) -> DataFrame:
    """(root, glob, key, pattern) of the different ``globs`` (root, glob)."""

    def compile_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(r, g, k, p) for r, g in zip(batch["root"], batch["glob"], strict=True) for k, p in compiled(g)], columns=["root", "glob", "key", "pattern"])

    return globs.select("root", "glob").filter("trim(glob) <> ''").distinct().mapInPandas(compile_all, "root string, glob string, key string, pattern string")


def file_keys(files: DataFrame) -> DataFrame:
    """(root, path, key) of the paths and folders of ``files`` (root, path relative to it)."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = files.filter("path <> ''").select("root", F.explode(folders).alias("path")).distinct()
    n, last = F.size(parts), F.element_at(parts, -1)
    from_start = F.transform(parts, lambda x, i: F.concat(F.lit("s"), i.cast("string"), F.lit(":"), x))
    from_end = F.transform(parts, lambda x, i: F.concat(F.lit("e"), (n - 1 - i).cast("string"), F.lit(":"), x))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(TAIL), F.char_length(last))), lambda k: F.concat(F.lit("t:"), F.right(last, k)))
    return paths.select("root", "path", F.explode(F.concat(F.array(F.lit("")), from_start, from_end, tails)).alias("key"))


def matched(globs: DataFrame, files: DataFrame) -> DataFrame:
    """The (root, glob) of ``globs`` that match a path or folder of ``files`` (root, path) of the same root.

    Pairs of equal keys are tested as they are joined and reduced to globs before they are shuffled.
    """
    keyed = compiled_globs(globs)
    used = file_keys(files).join(keyed.select("root", "key").distinct(), ["root", "key"], "left_semi")
    return used.join(keyed, ["root", "key"]).filter("path RLIKE pattern").select("root", "glob").distinct()
