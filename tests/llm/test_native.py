"""Sharding, URL rules, quality rules and licence scans against brute force."""

import math
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cinderlog.llm import licenses, quality, sharding, urlfilter

DOCS = "doc_id long, text string, source string, n_words int, words string"
TEXTS = [None, "", "  \n ", "one", "é ü\u00a0x\n\nline two\nline two", "a b c " * 40, "\U0001f600 smile # * $ % & | < >", "word " * 60 + "\n" + "other words here " * 3]


def rows():
    out = [(i, t, f"s{i % 3}" if i else None, -1, "clash") for i, t in enumerate(TEXTS)]
    return out + [out[5], out[5], (None, "no id at all", "s1", 0, ""), (None, None, None, 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


# -- sharding ------------------------------------------------------------------------------------------------
def hash_long(x, seed):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", x), seed & (2**64 - 1))))[0]


def brute_place(x, n):
    a = max(1, -int(-(n**0.5) // 1))
    b = max(1, -(-n // a))

    def once(v):
        left, right = divmod(v, b)
        for i, k in enumerate(sharding.ROUND_KEYS):
            if i % 2 == 0:
                left = (left + hash_long(k, hash_long(right, 42)) % a) % a
            else:
                right = (right + hash_long(k, hash_long(left, 42)) % b) % b
        return left * b + right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 101, 997])
def test_feistel(spark, n):
    a, b = sharding.sides(F.col("n"))
    got = (
        spark.range(n).withColumns({"n": F.lit(n).cast("long")}).withColumns({"a": a, "b": b})
        .select("id", sharding.shuffled_place(F.col("id"), F.col("n"), F.col("a"), F.col("b")).alias("p")).collect()
    )
    assert sorted(r.p for r in got) == list(range(n))
    assert all(r.p == brute_place(r.id, n) for r in got)


def test_shards(spark, docs):
    keyed = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    for parts in (1, 5):  # the same whatever the partitions
        got = sharding.assign_shards(keyed.repartition(parts), ["doc_id", "size"], 5).collect()
        assert sorted(r.row_number for r in got) == list(range(len(rows())))
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
        assert all(sorted(r.slot for r in got if r["shard"] == s) == list(range(k)) for s, k in sizes.items())
        assert all((r["shard"], r.slot) == (r.place % 5, r.place // 5) for r in got)
        again = Counter(map(tuple, got)) if parts == 1 else again  # noqa: F821
        assert Counter(map(tuple, got)) == again
    assert sharding.assign_shards(keyed.limit(0), ["doc_id", "size"], 5).count() == 0


def test_shard_query(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op2_feistel_shards(spark, str(tmp_path)).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {r.law for r in got} == {"rows"}
    n = len(rows())
    assert all((r["shard"], r.slot) == (lambda p: (p % 40, p // 40))(brute_place(r.row_number, n)) for r in got) and all(r.grown_shard is None for r in got)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(min(40, n))) and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter((r["shard"], r.slot) for r in got) == Counter((s, k) for s, m in sizes.items() for k in range(m))


# -- URL rules -----------------------------------------------------------------------------------------------
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/q",
    "http://badexample.com/en/", "http://x.net/es/1", "http://x.net/fr/1", "http://x.net/fr", "http://net/fr/", "http://casino-win.example.org/", "http://www.casinos.org/a",
    "http://x.org/free-bets/now", "http://x.org/CASINO/now", "http://x.org?casino", "a://b://c.com/", "http://x.net/ES/", "http://h.com:80/", "http://x.org/wp-login.php?x", "http://é.net/es/\n/",
    "http://" + "a." * 3000 + "net/es/",
]


def glob_match(pattern, target):
    """The pattern language by hand, character by character, without regular expressions."""
    separator = lambda c: not (c.isascii() and c.isalnum()) and c not in "_%"
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    pattern, target = low(pattern), low(target)

    def here(p, t):  # pattern from p at place t
        if p == len(pattern):
            return True
        if pattern[p] == "*":
            return any(here(p + 1, u) for u in range(t, len(target) + 1))
        if pattern[p] == "^":
            return (t == len(target) and here(p + 1, t)) or (t < len(target) and separator(target[t]) and here(p + 1, t + 1))
        return t < len(target) and target[t] == pattern[p] and here(p + 1, t + 1)

    if pattern.startswith("||"):
        host = target.split("/")[0]
        return any(here(2, t) for t in range(len(host) + 1) if t == 0 or target[t - 1] == ".")
    if pattern.startswith("|"):
        return here(1, 0)
    return any(here(0, t) for t in range(len(target) + 1)) or (pattern.startswith("^") and here(1, 0))


def brute_url(url, rules=urlfilter.PATTERN_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host):])[0] if rest is not None else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in urlfilter.BASE_RULES:
        h, p = r.pattern[2:].split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    hit = [(len(r.pattern.lstrip("|")), r.pattern.lstrip("|"), r.verdict) for r in rules if glob_match(r.pattern, host + path)]
    return host, path, best and best.pattern[2:], best.verdict if best else max(hit)[2] if hit else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS + URLS[:4])}
    assert got[17][3] == "block" and "CASINO" in URLS[17]
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_many_rules_from_a_table(spark):
    """Ten thousand rules from a table give what trying every rule gives."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    shapes = [lambda: f"||{word()}.{word()}^", lambda: f"^{word()}^", lambda: f"/{word()}/*{word()}", lambda: f"|{word()}.", lambda: f"{word()}-{word()}^", lambda: f"^{word()}.*^{word()}/"]
    rules = {(rng.choice(shapes)(), rng.choice(["allow", "block"])) for _ in range(10_000)}
    table = spark.createDataFrame([*rules, *list(rules)[:5]], "pattern string, verdict string")
    some = [urlfilter.UrlRule(*r) for r in rules]
    urls = [f"http://{word()}.{word()}.org/{word()}/{rng.choice(['', word().upper()])}{rng.choice('-./_')}{word()}" for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlfilter.judge(pages, [*urlfilter.BASE_RULES, *urlfilter.rules_of(table)]).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute_url(u, some) for i, u in enumerate(urls)}
    assert max(r.n_candidates for r in rows) < 2000 and len({r.verdict for r in rows}) == 2
    with pytest.raises(ValueError):
        urlfilter.rules_of(spark.range(urlfilter.MOST_RULES + 5).selectExpr("cast(id as string) pattern", "'block' verdict"))


def test_url_index_fetches_every_match():
    rules = list(urlfilter.BASE_RULES + urlfilter.PATTERN_RULES) + [urlfilter.UrlRule("||a.b/c*d^", "block"), urlfilter.UrlRule("*x*", "block")]
    slots, rest = urlfilter.build_index(rules, 4)
    filed = sorted(i for s in slots for ids in s.values() for i in ids)
    assert sorted(filed + rest) == list(range(len(rules))) and rest == [len(rules) - 1]
    for s in slots:
        for token, ids in s.items():
            assert all(token in urlfilter.compiled(rules[i])[1] for i in ids)


# -- quality -------------------------------------------------------------------------------------------------
def brute_measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(ws) < 50 or 100 * len(hit) > 50 * len(ws)


def test_measures(spark, docs):
    got = Counter((r.doc_id, r.text, *(r[c] for c in quality.MEASURES)) for r in quality.add_measures(docs.drop("n_words")).collect())
    assert got == Counter((d, t, *brute_measures(t)) for d, t, *_ in rows())


def test_lines(spark):
    own = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    data = [(i, f"Shared  Boiler {' '.join('b%d' % j for j in range(300))}\n{own(i)}", "hot") for i in range(8)]
    data += [(100 + i, f"{own(100 + i)}\nfew share this", "hot") for i in range(3)] + [(200, data[0][1], "cold"), (300, None, None), data[0], data[0]]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in quality.judge(docs, max_docs=5).collect()}
    assert all(got[i] == (302, False) for i in range(8)) and all(got[100 + i] == (0, True) for i in range(3))
    assert got[200] == (0, True) and got[300] == (0, False)
    assert quality.judge(docs, max_docs=5).count() == len(data)
    assert all(r.n_boilerplate_words == 0 for r in quality.judge(docs, max_docs=8).collect())  # repeated rows are one document
    assert quality.judge(docs.limit(0)).count() == 0


def test_boilerplate_is_removed(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    data = [(i, f"Top  Line\n\n  {own(i)}  \ntop line \nlast {i}\n", "hot", 0, "c") for i in range(8)]
    data += [(50, "top line\n" + own(50), "cold", 0, "c"), (51, "Top line\n" * 400 + own(51), "hot", 0, "c"), (52, None, "hot", 0, "c"), data[0], (None, data[0][1], "hot", 0, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, _cut string")
    got = quality.without_boilerplate(docs, max_docs=5).collect()
    assert Counter((r.doc_id, r.text, r.n_chars, r.source, r["_cut"]) for r in got) == Counter(
        (d, t, len(t), s, "c") for d, t, s in [*((i, f"\n  {own(i)}  \nlast {i}\n", "hot") for i in (*range(8), 0)), (50, data[8][1], "cold"), (None, f"\n  {own(0)}  \nlast 0\n", "hot")]
    )
    words = Counter({(r.doc_id, r.n_words - r.n_boilerplate_words) for r in quality.judge(docs, max_docs=5).collect() if r.kept})
    assert words == Counter({(r.doc_id, len(r.text.split())) for r in got})


# -- licences ------------------------------------------------------------------------------------------------
def brute_licences(text):
    """Every line and every run of lines without a blank one scored in full, without the bound; templates by hand."""
    _, rows, bias, temperature, least, column, _ = licenses.model()
    lines, judged = [licenses.terms_of(x) for x in (text or "").split("\n")], []
    for i in range(len(lines)):
        for n in range(1, licenses.WRAP + 1):
            part = lines[i : i + n]
            if len(part) < n or not all(part):
                break
            words = [w for ws in part for w in ws]
            s = list(bias)
            for g in licenses.grams(words):
                if g in column:
                    s = [a + b / math.sqrt(len(words)) for a, b in zip(s, rows[column[g]][2])]
            e = [math.exp((v - max(s)) / temperature) for v in s]
            k = e.index(max(e))
            if k == len(licenses.FAMILIES) or max(e) / sum(e) < least:
                continue
            held = []
            for t in licenses.templates():
                like = len(set(t["words"]) & set(words)) / len(set(t["words"]))
                if t["phrase"]:
                    like = float(any(words[a : a + len(t["words"])] == t["words"] for a in range(len(words))))
                if like >= licenses.CONFIRM and set(t["numbers"]) <= set(words):
                    held.append((round(len(t["words"]) * like), like, -t["k"]))
            best = max(held, default=(0, 0, 0))
            judged.append((-best[0], -best[1], n, i, k) if best[2] == -k - 1 else (0, 0.0, n, i, k))
    chosen = []
    meets = lambda a, b: a[3] < b[3] + b[2] and b[3] < a[3] + a[2]
    for x in sorted(x for x in judged if x[1] < 0):
        if not any(meets(x, y) for y in chosen):
            chosen.append(x)
    rest = [x for x in judged if x[2] == 1 and x[1] == 0 and not any(meets(x, y) for y in chosen)]
    return sorted((i, licenses.FAMILIES[k], unlike < 0) for _, unlike, _, i, k in chosen + rest)


def found_licences(spark, texts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, findings string")
    rows = licenses.scan(docs.repartition(4), ["doc_id"]).collect()
    return [x for _, x in sorted((r.doc_id, [(f.paragraph, f.family, f.confirmed) for f in r.findings]) for r in rows)]


#: Notices that are neither among the templates nor among the texts of the fit.
UNSEEN = ("We publish everything here under the {} unless noted otherwise.", "Source files are covered by the {}", "{} applies to all of it", "(c) 2019 somebody, {}")


def test_licences(spark):
    texts = [None, "", "x\n\nReleased under the MIT License.\nMIT\nschool", *licenses.OTHERS, *(t for ts in licenses.NOTICES.values() for t in ts), "Licensed under CC BY-NC 4.0. " * 200,
             "words " * 3000 + "\nLicensed under the Apache License, Version 2.0.\n\n# All rights reserved.", "word\n" * 300 + "GPLv3"]
    texts += [lead.format(n) for lead in licenses.LEADS[:3] for n in licenses.NEAR]
    got = found_licences(spark, texts + texts[:3])
    assert got == [brute_licences(t) for t in texts + texts[:3]]
    assert [x for x in got[2] if x[2]] == [(2, "MIT", True)] and not any(got[3 + i] for i in range(len(licenses.OTHERS)))
    assert got[len(texts)] == [] and licenses.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_unseen_notices_and_near_misses(spark):
    wanted = [(family, lead.format(name)) for family, names in licenses.NAMES.items() for name in names for lead in UNSEEN]
    got = found_licences(spark, [t for _, t in wanted])
    assert sum(x == [(0, family, True)] for (family, _), x in zip(wanted, got)) >= 0.9 * len(wanted)
    other = [lead.format(name) for name in licenses.NEAR for lead in (*licenses.LEADS, *UNSEEN)]
    assert not [x for x in zip(other, found_licences(spark, other)) if any(f[2] for f in x[1])]
    exact = {
        "This library is under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU General Public License, version 2": "GPL-2.0", "under the BSD 2-Clause License": "BSD-2-Clause",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        "licensed under CC BY 4.0": "CC-BY-4.0", "GNU Affero General Public License version 3.0": "AGPL-3.0", "code is Apache-2.0": "Apache-2.0",
    }
    assert [{f[1] for f in x if f[2]} for x in found_licences(spark, list(exact))] == [{f} for f in exact.values()]


def test_wrapped_notices(spark):
    whole = [(f, t) for f, ts in licenses.NOTICES.items() for t in ts] + [(f, f"This work is licensed under the {n}.") for f, ns in licenses.NAMES.items() for n in ns[:2]]
    texts = []
    for _, t in whole:
        for width, prefix in ((34, ""), (60, "# "), (72, " * ")):
            lines = [prefix + x for x in textwrap.wrap(t, width)]
            texts.append("\n".join(["some prose stands here", "", *lines, prefix, "and other prose here"]))
    got = found_licences(spark, texts)
    assert [[x[1] for x in g if x[2]] for g in got] == [[f] for f, _ in whole for _ in range(3)]
    notices = 3 * sum(map(len, licenses.NOTICES.values()))
    assert all(x[0] == 2 for g in got[:notices] for x in g if x[2])  # of a name that is put on the next line only that line counts
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    got = found_licences(spark, [bsd, bsd.replace("\n", "\n\n"), "Released under the MIT License.\n" + bsd + "\nLicensed under CC BY 4.0."])
    assert [[x[:2] for x in g if x[2]] for g in got] == [[(0, "BSD")], [], [(0, "MIT"), (1, "BSD"), (3, "CC-BY-4.0")]]


def test_long_runs_of_lines_are_scanned_fast(spark):
    """Paragraphs of many lines are scored by the sums of their lines, and templates are tried only where a whole text may hold them."""
    rng = random.Random(4)
    stock = ["the", "of", "and", "to", "in", "is", "by", "or", "a", "for", "this", "that"] + ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(24)]
    prose = lambda n: [" ".join(rng.choices(stock, k=40)) for _ in range(n)]
    texts = ["\n".join([*prose(n), "", "Released under the MIT License.", "", *prose(n)]) for n in [3] + [30] * 1000]
    assert brute_licences(texts[0]) == found_licences(spark, texts[:1])[0]
    began = time.perf_counter()
    got = found_licences(spark, texts[1:])
    assert time.perf_counter() - began < 20
    assert all((31, "MIT", True) in x for x in got)
