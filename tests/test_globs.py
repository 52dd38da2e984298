"""Globs against a matcher of its own that walks path and glob segment by segment, without keys or compiled patterns."""

from __future__ import annotations

import random
from functools import cache

import pytest

from loomlog.operators import lint
from loomlog.operators.globs import alternatives, matched


def within(glob: str, name: str) -> bool:
    """One segment: ``*``, ``?``, classes and escapes, character by character."""

    @cache
    def at(i: int, j: int) -> bool:
        if i == len(glob):
            return j == len(name)
        c = glob[i]
        if c == "*":
            return at(i + 1, j) or (j < len(name) and at(i, j + 1))
        if j == len(name):
            return False
        if c == "?":
            return at(i + 1, j + 1)
        if c == "[" and (close := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : close]
            no, body = body[0] in "!^", body.lstrip("!^")
            held = any(body[k] == name[j] or (body[k + 1 : k + 2] == "-" and k + 2 < len(body) and body[k] <= name[j] <= body[k + 2]) for k in range(len(body)))
            return held != no and at(close + 1, j + 1)
        if c == "\\":
            return glob[i + 1] == name[j] and at(i + 2, j + 1)
        return c == name[j] and at(i + 1, j + 1)

    if name.startswith(".") and glob[0] in "*?[":
        return False
    return bool(name) and at(0, 0)


def walks(glob: list[str], path: list[str]) -> bool:
    if not glob:
        return not path
    if glob[0] == "**":
        return walks(glob[1:], path) or bool(path and not path[0].startswith(".") and walks(glob, path[1:]))
    return bool(path) and within(glob[0], path[0]) and walks(glob[1:], path[1:])


def expected(glob: str, paths: list[str]) -> bool:
    every = {"/".join(p.split("/")[:n]) for p in paths for n in range(1, p.count("/") + 2)}
    return any(walks([s for s in one.split("/") if s], p.split("/")) for one in alternatives(glob) for p in every)


def test_alternatives():
    assert list(alternatives("a{b,c{d,e}}f")) == ["abf", "acdf", "acef"]
    assert list(alternatives("{1..3}.{x}")) == ["1.{x}", "2.{x}", "3.{x}"]
    assert list(alternatives(r"\{a,b}")) == [r"\{a,b}"]


@pytest.mark.parametrize("seed", range(3))
def test_matched(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "src", "ab.py", "a.py", "x.ts", ".git", "a b", "é.py", "a+b", "[x]"]
    bits = ["*", "?", "**", "a", "b", "src", "*.py", "*.{py,ts}", "[ab]*", "[!a]?", "a?", "{a,src/b}", "{a,b}", ".git", "*.p?", r"\*", "é*", "a+b", "???", "[a-c].py", "*b*"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randrange(1, 5))) for _ in range(60)})
    globs = sorted({"/".join(r.choice(bits) for _ in range(r.randrange(1, 4))) for _ in range(250)})
    roots = {"p": paths[::2], "q": paths[1::2]}
    files = spark.createDataFrame([(k, p) for k, ps in roots.items() for p in ps], "root string, path string")
    asked = spark.createDataFrame([(k, g) for k in (*roots, "none") for g in [*globs, "", " "]], "root string, glob string")
    got = {tuple(x) for x in matched(asked, files).collect()}
    assert got == {(k, g) for k, ps in roots.items() for g in globs if expected(g, ps)}


def test_rule_files(spark):
    docs = [
        ("a", "---\nx: y\n---\nsee `src/a?.py` and `lib/* .x`\n`[}` `src/*`"),
        ("b", "---x\n---x\n"),
        ("c", "---\nopen"),
        ("d", "x\n" * 100),
        ("e", "```\nplain `a{` text"),
    ]
    found = lint.rules(spark.createDataFrame(docs, "path string, content string"), spark.createDataFrame([("src/ab/m.py",)], "path string"))
    got = sorted((x.path, x.check_id, x.severity, x.line) for x in found.collect())
    assert got == [("a", "RUL002", "error", 5), ("a", "RUL003", "info", 4), ("a", "RUL003", "info", 4), ("b", "RUL001", "error", None), ("c", "RUL001", "error", None), ("d", "RUL005", "warning", None), ("e", "RUL002", "error", 2)]
