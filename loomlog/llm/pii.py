"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Four patterns find personal data (email, ip, card, phone). A finding protects three entities: its value, the group that it belongs
to (an address's domain, an ip's first two numbers, a card's issuer, a phone's country and area) and its kind, as values seldom recur. All
words of a document with a finding are candidate terms, wherever they stand outside findings. Corpus co-occurrence says how much a term
reveals: with document counts c, taken over whole documents with their findings left out, and N documents,

    PMI(t, e) = log2(c(t, e) N / (c(t) c(e)))        IC(e) = log2(N / c(e))

and a term discloses the entity when PMI / IC is at least ``disclosure`` (1: the term occurs with the entity only) and they meet in at
least ``support`` different contexts (one for each document: the REACH characters on either side of its first finding of the entity), so
that copies of one text are no evidence. Such terms are generalised wherever they occur in a document that holds the entity, and removed
from ``removal`` on.

Positions come from splitting the text by a pattern: a match starts behind all pieces and matches before it. The
patterns are the base ones with possessive quantifiers and a start condition, which find the same matches without
backtracking, so that long runs of digits or letters cost linear time and no stack.

Defined cases: a null text is empty; positions count code points, end exclusive; ids may be null or repeat: rows are told apart by a
number of their own; rows that repeat a text are sanitised alike; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 12 more digits are looked for ahead: shorter numbers are no card anyway.
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"(?:\G(?<![\p{L}'-])|(?<![\p{L}'-]))\p{L}[\p{L}'-]{2,}+"
REACH = 60  #: code points on either side of a finding that tell copies of one text from independent ones; terms come from whole texts
NONE = "array<struct<s:int,e:int,v:string,left:string,right:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(lengths: Column, block: int = 512) -> Column:
    """Sums of all earlier elements; in blocks, as growing an array by one copies it."""

    def sums(values: Column, start: Column) -> Column:
        return F.slice(F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(1), F.size(values))

    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: F.slice(n, b * block + 1, F.lit(block)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y)
    whole = lambda parts: let(sums(F.transform(parts, total), F.lit(0)), lambda at: F.flatten(F.transform(parts, lambda x, b: sums(x, F.get(at, b)))))
    return let(lengths, lambda n: let(blocks(n), whole))


def matches(text: Column, pattern: str) -> Column:
    """Start, end, value and the context on both sides of all matches, leftmost and non-overlapping."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(x: Column) -> Column:
        p, h = x["p"], x["h"]
        starts = running_sum(F.transform(h, lambda v, i: F.char_length(F.get(p, i)) + F.char_length(v)))
        at = lambda v, i, s: F.get(s, i) + F.char_length(F.get(p, i))
        row = lambda v, i, s: F.struct(at(v, i, s).alias("s"), (at(v, i, s) + F.char_length(v)).alias("e"), v.alias("v"), F.substring(F.get(p, i), -REACH, REACH).alias("left"), F.substring(F.get(p, i + 1), 1, REACH).alias("right"))
        return let(starts, lambda s: F.transform(h, lambda v, i: row(v, i, s)))

    return let(F.struct(pieces.alias("p"), hits.alias("h")), lambda x: F.when(F.size(x["h"]) > 0, located(x)).otherwise(F.array().cast(NONE)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, less nine if that is over nine."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _labelled(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("s", "e", "v", "left", "right")]))


def findings(text: Column) -> Column:
    """All base findings by kind, then start: struct(kind, s, e, v, left, right)."""
    maybe = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")),
    }
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m["v"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda m: let(digits_of(m["v"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)),
        "phone": lambda m: F.length(digits_of(m["v"])).between(9, 15),
    }
    parts = []
    for kind in KINDS:
        found = F.when(maybe[kind], F.filter(matches(text, PATTERNS[kind]), valid[kind])).otherwise(F.array().cast(NONE))
        parts.append(_labelled(found, kind))
    return F.concat(*parts)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def group_of(kind: Column, value: Column) -> Column:
    """The recurring part of a finding: domain, network, issuer, country and area."""
    return (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits_of(value), 1, 6))
        .otherwise(F.substring(digits_of(value), 1, 4))
    )


def entities_of(found: DataFrame) -> DataFrame:
    """(rid, entity, context) of each document and entity in it; context is that of the first finding of the entity."""
    value = F.lower("m.v")
    levels = F.array(F.concat_ws(":", F.lit("value"), F.col("m.kind"), value), F.concat_ws(":", F.lit("group"), F.col("m.kind"), group_of(F.col("m.kind"), value)), F.concat_ws(":", F.lit("kind"), F.col("m.kind")))
    each = found.select("rid", F.explode("found").alias("m")).select("rid", F.explode(levels).alias("entity"), F.struct("m.s", F.xxhash64("m.left", "m.right").alias("context")).alias("first"))
    return each.groupBy("rid", "entity").agg(F.min("first").alias("first")).select("rid", "entity", F.col("first.context").alias("context"))


def words_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def bare(text: Column, found: Column) -> Column:
    """The text with each finding replaced by a mark: words inside findings are no evidence, they are the entity itself."""
    spans = F.transform(found, lambda m: F.struct(F.lit("").alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    return sanitised_text(text, spans, F.array().cast("array<struct<kind:string,s:int,e:int,action:string>>"))


def disclosing(docs: DataFrame, found: DataFrame, text: str, disclosure: float, support: int) -> DataFrame:
    """(rid, term, ratio) of the terms in a document that disclose one of its entities; counts run over all documents, each with map-side combine."""
    n = float(max(1, docs.count()))
    held = entities_of(found)
    # Pairs have no more contexts than their entity has.
    entities = held.groupBy("entity", "context").agg(F.count("*").alias("docs")).groupBy("entity").agg(F.count("*").alias("contexts"), F.sum("docs").alias("c_e"))
    entities = entities.filter(F.col("contexts") >= support).select("entity", "c_e")
    # Counted before the join: a frequent word is one row there, not one for each document. Words that a document has in findings only are taken off again.
    own = found.filter(F.size("found") > 0).select("rid", words_in(F.col("text")).alias("all"), words_in(bare(F.col("text"), F.col("found"))).alias("outside"))
    counted = docs.select(F.explode(words_in(F.col(text))).alias("term"), F.lit(1).alias("one")).unionByName(own.select(F.explode(F.array_except("all", "outside")).alias("term"), F.lit(-1).alias("one")))
    seen = counted.groupBy("term").agg(F.sum("one").alias("c_t")).filter(F.col("c_t") >= support)
    # c_te is at most c_e, so the ratio reaches ``disclosure`` only where c_t is at most N^(1 - disclosure) c_e^disclosure.
    most = F.greatest(F.col("c_e"), F.pow(F.lit(n), F.lit(1 - disclosure)) * F.pow(F.col("c_e"), F.lit(disclosure))) * (1 + 1e-9)
    likely = materialise(held.join(entities, "entity").withColumn("most", most), "pii-entities")
    highest = likely.agg(F.max("most")).first()[0] or 0.0
    beside = own.join(likely.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode("outside").alias("term"))
    beside = beside.join(seen.filter(F.col("c_t") <= highest), "term")
    # A row for each entity and rare term that a document holds; neither an entity's nor a term's documents are paired.
    met = materialise(likely.join(beside, "rid").filter(F.col("c_t") <= F.col("most")), "pii-met")
    pairs = met.groupBy("entity", "term", "context").agg(F.count("*").alias("docs"), F.max("c_e").alias("c_e"), F.max("c_t").alias("c_t"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("c_te"), F.max("c_e").alias("c_e"), F.max("c_t").alias("c_t")).filter(F.col("contexts") >= support)
    pmi = F.log2(F.col("c_te") * n / (F.col("c_t") * F.col("c_e")))
    info = F.log2(F.lit(n) / F.col("c_e"))
    telling = pairs.withColumn("ratio", F.when(info > 0, pmi / info).otherwise(0.0)).filter(F.col("ratio") >= disclosure - 1e-9).select("entity", "term", "ratio")
    return met.select("rid", "entity", "term").join(telling, ["entity", "term"]).groupBy("rid", "term").agg(F.max("ratio").alias("ratio"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", disclosure: float = 0.8, support: int = 2, removal: float = 0.95) -> DataFrame:
    """Per row: rid (its number), id, found (base findings), terms (spans of disclosing terms with their ratio and action)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias(id_col), findings(F.coalesce(F.col(text), F.lit(""))).alias("found"), F.col(text).alias("text"))
    found = materialise(rows.withColumn("text", F.when(F.size("found") > 0, F.col("text"))), "pii-found")
    best = materialise(disclosing(docs, found, text, disclosure, support), "pii-terms")
    # Every occurrence of the terms in the documents that hold their entity.
    places = found.join(best.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(matches(F.col("text"), TERM)).alias("m")).select("rid", F.lower("m.v").alias("term"), "m.s", "m.e")
    spans = places.join(best, ["rid", "term"])
    each = F.struct(F.lit("term").alias("kind"), "s", "e", F.when(F.col("ratio") >= removal, "remove").otherwise("generalise").alias("action"), "ratio")
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_list(each)).alias("terms")).withColumnRenamed("rid", "trid")
    joined = found.join(spans, F.col("rid") == F.col("trid"), "left")
    none = F.array().cast("array<struct<kind:string,s:int,e:int,action:string,ratio:double>>")
    # A term inside a base finding of any kind is covered already.
    free = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("found", lambda m: (m["s"] < t["e"]) & (t["s"] < m["e"])))
    return joined.select("rid", F.col(id_col), "found", free.alias("terms"))


def sanitised_text(text: Column, found: Column, terms: Column) -> Column:
    """The text with findings replaced by their kind, terms generalised to ``[TERM]`` or removed; of overlapping spans the first counts."""
    spans = F.array_sort(F.concat(F.transform(found, lambda m: F.struct(m["s"], m["e"], F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("to"))), F.transform(terms, lambda t: F.struct(t["s"], t["e"], F.when(t["action"] == "remove", "").otherwise("[TERM]").alias("to")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, m: F.when(m["s"] >= acc["at"], F.struct(m["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), m["to"])).alias("out"))).otherwise(acc)
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))


def op2_pii_sanitisation(spark, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("found", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, terms = shown(F.col("found")), shown(F.col("terms"))
    return sanitise(documents(spark, sf_dir)).select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"))
