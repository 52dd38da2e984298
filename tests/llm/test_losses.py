"""Cases in which rows were once lost without a word: gzip members of several records, damaged archives, languages learned without ids."""

from __future__ import annotations

import gzip
from collections import Counter

import numpy as np
import pytest

from loomlog.llm import langid, warc

DATE = "1970-01-01T00:00:00Z"


def record(n: int, payload: bytes) -> bytes:
    return warc.encode_record("response", f"urn:page:{n}", f"http://a/{n}", DATE, None, warc.base32_sha1(payload), len(payload), payload)


PAYLOADS = [b"abc", b"", b"x" * 3_000_000, b"\r\n\r\nWARC/1.1\r\n", b"last"]


def read(spark, folder, *columns):
    df = spark.read.format("warc").option("verify", "true").load(str(folder))
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("members", [[5], [1, 4], [2, 2, 1], [1] * 5])
@pytest.mark.parametrize("blank", [b"", b"\r\n\r\n"])
def test_members_of_several_records(spark, tmp_path, members, blank):
    warc.register(spark)
    all_records = [record(i, p) + blank for i, p in enumerate(PAYLOADS)]
    data, at = b"", 0
    for m in members:
        data += gzip.compress(b"".join(all_records[at : at + m]))
        at += m
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert read(spark, tmp_path, "target_uri", "payload") == [(f"http://a/{i}", p) for i, p in enumerate(PAYLOADS)]
    load = lambda: spark.read.format("warc").load(str(tmp_path))
    assert load().filter("target_uri = 'http://a/4'").count() == 1 and load().select("target_uri").count() == 5


def test_blank_lines_in_plain_files(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc").write_bytes(b"\r\n" + b"\r\n".join(record(i, p) for i, p in enumerate(PAYLOADS)) + b"\r\n\r\n")
    assert read(spark, tmp_path, "payload_bytes") == sorted((len(p),) for p in PAYLOADS)


@pytest.mark.parametrize("damage", [lambda b: b.replace(b"WARC/", b"WRAC/"), lambda b: b[: b.index(b"\r\n\r\n")], lambda b: b[:-200]])
@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_damage_fails(spark, tmp_path, damage, pack):
    warc.register(spark)
    (tmp_path / ("a.warc.gz" if pack is gzip.compress else "a.warc")).write_bytes(pack(record(0, b"good") + damage(record(1, b"y" * 1000))))
    with pytest.raises(Exception, match="WARC record|no end|cut off"):
        read(spark, tmp_path, "payload")


SENTENCES = {"en": "the quick brown fox jumps over the lazy dog", "de": "zwölf boxkämpfer jagen viktor quer über den sylter deich", "es": "el veloz murciélago hindú comía feliz cardillo y kiwi"}


def test_languages_are_learned_without_ids(spark):
    rows = [(i, f"{text} {n}", lang) for lang, text in SENTENCES.items() for n in range(200) for i in (None,)]
    for repeated in (rows, [(7, t, lang) for _, t, lang in rows], [(None, t, lang) for lang, t in SENTENCES.items() for _ in range(200)]):
        docs = spark.createDataFrame(repeated, "doc_id long, text string, lang string")
        found = langid.learn(docs, train_docs=50)
        assert found.words.any()
        assert {lang: found.decide(text)[0] for lang, text in SENTENCES.items()} == {lang: lang for lang in SENTENCES}


def test_filters_hold_the_typical_ngrams(spark):
    """Every n-gram that exact counts call typical is in its language's filter, others as often as the fill says, and shares are corrected for those."""
    rows = [(n, f"{text} {text[n % 7 :]}", lang) for lang, text in SENTENCES.items() for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.learn(docs, train_docs=1000, slots=1 << 12, min_count=3, ratio=0.25)
    grams = {lang: Counter() for lang in SENTENCES}
    for _, text, lang in rows:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            grams[lang].update(f" {word} "[i : i + 3] for i in range(len(word)))
    rate = {lang: {g: c / sum(counts.values()) for g, c in counts.items()} for lang, counts in grams.items()}
    peak = Counter()
    for rates in rate.values():
        for g, x in rates.items():
            peak[g] = max(peak[g], x)
    typical = {lang: {g for g, c in grams[lang].items() if c >= 3 and rate[lang][g] >= peak[g] * 0.25} for lang in SENTENCES}

    def held(gram: str, lang: str) -> bool:
        key = np.array([sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(gram))], np.uint64)
        bit = np.uint64(1 << found.langs.index(lang))
        return all(bool(found.words[0][p[0]] & bit) for p in langid.positions(key, found.words.shape[1], found.hashes))

    every = set(peak)
    for i, lang in enumerate(found.langs):
        assert all(held(g, lang) for g in typical[lang])
        others = every - typical[lang]
        wrong = sum(held(g, lang) for g in others)
        assert wrong <= max(3, 5 * found.false[i] * len(others))
        for text in SENTENCES.values():
            own = [f" {w} "[k : k + 3] for w in text.split() for k in range(len(w))]
            exact = sum(g in typical[lang] for g in own) / len(own)
            assert abs(found.shares(text)[i] - exact) <= 0.05 + 3 * found.false[i]
