"""Each training-data operator against a brute-force version on small tables, with its edge cases: nulls, empty and
very long texts, ties, repeated rows, empty tables, extra columns whose names clash with inner ones."""

import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest

from smoothlake.llm import decontaminate, language_id, license_scan, near_dedup, packing, range_coder, sharding, token_files, url_trust, vp_search, warc
from smoothlake.llm._common import WORD, WordHashes
from smoothlake.llm.components import components
from smoothlake.llm.tokens import Encoder, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, mine int"


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    stock = {"en": [f"the{a}{b}" for a in "abcdefgh" for b in "stn"], "de": [f"{a}un{b}ß" for a in "klmnopqr" for b in "gxy"]}
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        rows.append([i, words(rng, rng.randint(5, 120), stock[lang]) + ".", lang])
    for i in range(120, 140):  # near copies
        base = rows[i - 120][1].split()
        if len(base) > 60:
            base[rng.randrange(len(base))] = "changed"
        rows.append([i, " ".join(base), rows[i - 120][2]])
    rows += [[140, rows[5][1], "en"], [141, rows[5][1], "en"], [141, rows[5][1], "en"], [142, None, None], [143, "", "en"], [144, "... 123", None], [145, words(rng, 9000, stock["en"]), "en"], [None, "a null id thehs", "en"], [146, None, "en"], [147, "", None]]
    return [(i, t, lang, "s", len(t or ""), "clash", "clash", 7) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://A.org/x?q", link("good.net")), (2, "https://www.example.org/es/1", link("spam.net")), (3, "http://example.org/en/12", ""), (4, "http://x.com/fr/", None), (5, "http://x.com/de/", link()),
        (6, "http://good.net/", ""), (7, "http://bad.net/", link("sub.example.org", "x.com")), (8, None, "x"), (9, "no scheme", ""), (10, "http://org", ""), (11, "http://notexample.org/es/", ""), (12, "ftp://h.net#a/b", ""), (1, "http://A.org/x?q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in url_trust.judge(pages).collect():
        got.setdefault(r.page_id, r)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.org/es/", "block")
    assert (got[3].rule, got[3].verdict) == ("example.org/en/1", "block")
    assert got[4].rule == "com/fr/" and got[5].verdict == "block"
    assert got[6].rule is None and got[6].verdict == "allow" and got[6].trust > 0
    assert got[7].rule is None and got[7].verdict == "block" and got[7].distrust > got[7].trust  # it links to blocked hosts
    assert (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and (got[9].host, got[9].path) == ("", "")
    assert (got[10].host, got[10].path, got[10].rule) == ("org", "", None)
    assert got[11].rule == "org/" and got[12].host == "h.net" and got[12].path == ""
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_url_propagation_equals_power_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.net" for i in range(12)] + ["a.org", "b.example.org"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['es/', 'en/1', ''])}", "".join(f"<a href='http://{rng.choice(hosts)}/'>" for _ in range(3))) for i in range(80)]
    o = url_trust.TrustOptions()
    got = {r.host: (r.trust, r.distrust) for r in url_trust.host_scores(spark.createDataFrame(rows, "page_id long, url string, html string"), o).collect()}
    import re

    at = {h: i for i, h in enumerate(hosts)}
    a = np.zeros((len(hosts), len(hosts)))
    seed = {"allow": np.zeros(len(hosts)), "block": np.zeros(len(hosts))}
    for _, url, html in rows:
        h = url.split("/")[2]
        path = url[len("http://" + h) :]
        for t in re.findall(r"http://([^/']*)", html):
            if t != h:
                a[at[h], at[t]] += 1
        fits = [(len(x + y), v) for x, y, v in url_trust.RULES if (h == x or h.endswith("." + x)) and path.startswith(y)]
        if fits:
            seed[max(fits)[1]][at[h]] += 1
    for k, (m, which) in enumerate(((a, "allow"), (a.T, "block"))):
        p = m / np.maximum(m.sum(1, keepdims=True), 1)
        s = seed[which] / max(seed[which].sum(), 1)
        r = s.copy()
        for _ in range(o.rounds):
            r = o.damping * p.T @ r + (1 - o.damping) * s
        for h, i in at.items():
            assert abs(got.get(h, (0, 0))[k] - r[i]) < 1e-12


def test_url_propagation_runs_to_the_end_of_a_chain(spark):
    """Trust along 14 hosts from a seed, distrust back along 14 to a blocked one: the closed form on a chain."""
    chain = lambda kind, i: "a.org" if (kind, i) == ("t", 0) else "sub.example.org" if (kind, i) == ("d", 14) else f"{kind}{i}.net"
    rows = [(i, f"http://{chain(k, i)}/{'es/' if (k, i) == ('d', 14) else ''}", f'<a href="http://{chain(k, i + 1)}/">' if i < 14 else "") for k in "td" for i in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_trust.judge(pages).collect()}
    for i in range(15):
        assert abs(got[chain("t", i)].trust - 0.15 * 0.85**i) < 1e-12 and abs(got[chain("d", 14 - i)].distrust - 0.15 * 0.85**i) < 1e-12
        assert got[chain("t", i)].verdict == "allow" and got[chain("d", i)].verdict == "block"


def test_license_notices_as_printed(spark):
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    gnu = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = [
        (bsd.format(""), "bsd"), (bsd.format(third), "bsd"), (bsd.format(third).replace("must retain", "may retain"), None),
        (gnu.format(";", "General", ";", "2"), "gpl-2.0"), (gnu.format(":", "General", ",", "3"), "gpl-3.0"), (gnu.format(";", "Lesser General", ";", "2.1"), "lgpl-2.1"), (gnu.format(":", "Lesser General", ",", "3"), "lgpl-3.0"),
        (cc.format(""), "cc-by-4.0"), (cc.format("-NonCommercial"), "cc-by-nc-4.0"), (cc.format("-ShareAlike"), "cc-by-sa-4.0"), (cc.format("-NoDerivatives"), None),
    ]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (_, label) in enumerate(texts):
        assert [x for x in got[i].split(",") if x not in ("", "gpl")] == ([label] if label else []), (i, got[i])


def test_license_templates_and_phrases(spark, none):
    texts = ["Licensed under CC BY-NC 4.0. CC BY cc by", "Released under the terms of the MIT License!", "released under the mit licence", "Copyright 2020 by A. B.\nAll rights reserved.", None, "", "licensed under the GNU General Public License, version 3", "ÉCC BY", "x " * 5000 + "general public license"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].labels) == (3, 2, 9, "cc-by", "cc-by,cc-by-nc-4.0")
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].first_word is None and got[1].score == 1.0
    assert got[2].labels == "" and got[2].score == 0.0
    assert got[3].labels == "copyright,reserved" and got[3].base_labels == "reserved"
    assert got[4].n_words == 0 and got[5].n_words == 0 and got[4].labels == ""
    assert got[6].labels == "gpl,gpl-3.0" and got[7].n_base == 0 and got[8].first_word == 5000
    assert license_scan.scan(none).count() == 0


def test_license_automata_equal_regular_expressions():
    import re

    rng = random.Random(2)
    for label, templates in license_scan.TEMPLATES.items():
        for t in templates:
            a, pattern = license_scan.compile_template(t), re.compile(license_scan.template_pattern(t))
            plain = license_scan.MARKUP.sub(" ", t).split()
            for _ in range(40):
                w = [x.encode() for x in plain if rng.random() > 0.01]
                for _ in range(rng.randint(0, 3)):
                    w.insert(rng.randrange(len(w) + 1), rng.choice(plain).encode())
                joined = b" " + b" ".join(w) + b" "
                mine = a.lead in joined and any(license_scan.accepts(a, w, i) is not None for i in license_scan.places(joined, a.lead))
                assert mine == bool(pattern.search("".join(f" {x.decode()} " for x in w))), (label, w)


def test_packing_is_whole_and_certified(spark, docs, none):
    tok = Encoder(default_tokenizer()).tokenizer
    rows = packing.pack(docs, packing.PackingOptions(pieces=30)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = sorted((i if i is not None else -1, k, lo, len(p), zlib.crc32(p.tobytes())) for i, t, *_ in corpus() for ids in [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")] for k, lo in enumerate(range(0, len(ids), 4096)) for p in [ids[lo : lo + 4096]])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(by) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(none).count() == 0


def test_dual_feasible_bounds():
    rng = np.random.default_rng(5)
    for _ in range(60):
        c = int(rng.integers(6, 40))
        x = rng.integers(1, c + 1, rng.integers(1, 9))
        best = len(x)
        for assign in itertools.product(range(min(len(x), 4)), repeat=len(x)):
            load = np.bincount(assign, x, minlength=4)
            if load.max() <= c:
                best = min(best, len(set(assign)))
        bound = packing.lower_bound(np.bincount(x, minlength=c + 1), c)
        where, offset, residual = packing.best_fit_decreasing(x, c)
        assert bound <= best or best == len(x) > 4
        assert len(residual) >= bound
        for b in range(len(residual)):
            assert x[where == b].sum() == c - residual[b] >= 0
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11), 10) == 7


def test_vantage_search_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[40:60] = base[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (None, base[0].tolist(), 1), (903, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    o = vp_search.SearchOptions(shard=70, leaf=16, block=7)
    got = vp_search.search(df, F.col("vec_id") % 10 == 0, o).collect()
    m = base.astype(float)
    n = np.linalg.norm(m, axis=1)
    for q in range(0, 300, 10):
        s = m @ m[q] / (n * n[q])
        s = np.array([np.float64(x) for x in s])
        s[q] = -9
        s[np.isclose(s, s[3 if q != 3 else 40]) & np.all(base == base[3], axis=1)] = s[[i for i in range(40, 60) if i != q][0]]
        want = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in mine] == want and [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(x - s[v]) < 1e-12 for _, v, x in mine)
    assert vp_search.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = vp_search.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    fast = vp_search.search(df, F.col("vec_id") % 10 == 0, vp_search.SearchOptions(factor=0.6, shard=300, leaf=16)).collect()
    exact = {(r.query_id, r.vec_id) for r in got}
    assert len(exact & {(r.query_id, r.vec_id) for r in fast}) >= 0.9 * len(exact)


def test_vantage_search_gives_ties_to_smaller_ids(spark):
    """Scaled copies of one vector, and axes that are all as far from the query."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    v, ids = rng.normal(size=16), rng.permutation(40).tolist()
    rows = [(i, (v * 2.0 ** (j - 20)).tolist()) for j, i in enumerate(ids)] + [(100 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 16)))] + [(1000, (v + 0.1).tolist())]
    axes = [(i, row.tolist()) for i, row in zip(rng.permutation(64).tolist(), np.eye(64), strict=True)]
    for table, query in ((rows, 1000), (axes, 63), (axes, 0)):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = sorted((r["rank"], r.vec_id) for r in vp_search.search(df, F.col("vec_id") == query, vp_search.SearchOptions(leaf=8)).collect())
        assert [x for _, x in got] == [x for x in range(6) if x != query][:5]


def test_ring_sharding(spark, docs, none):
    rows = sharding.place(docs).collect()
    text = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in rows) == text
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.max() - counts.min() <= 1 and {r.law for r in rows} == {"rows"}
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert sharding.place(none).count() == 0
    loose = sharding.place(docs, sharding.ShardOptions(factor=1.5)).collect()
    assert np.bincount([r.shard for r in loose]).max() <= -(-1.5 * len(rows) // 8)
    alone = spark.createDataFrame([(None, None)] * 40, "doc_id long, text string")
    assert sorted(np.bincount([r.shard for r in sharding.place(alone).collect()], minlength=8)) == [5] * 8


@pytest.mark.parametrize("compressed", [False, True])
def test_warc_chain(spark, compressed):
    rng = random.Random(1)
    trap = warc.MAGIC.decode() + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "".join(chr(rng.randint(33, 2000)) for _ in range(40_000))
    rows = [(1, "http://a", "x" * 2000 + trap), (2, None, None), (3, "u\r\n", big), (4, "u", big), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "", ""), (10, "u", trap * 50)]
    o = warc.WarcOptions(compressed=compressed, range_bytes=7000, file_bytes=60_000)
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(pages, o), o).collect()}
    want = {}
    for i, _, h in rows:
        b = (h or "").encode()
        twin = max(j for j, _, g in rows if (g or "").encode() == b)
        again = len(b) >= 1000 and twin != i
        want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", twin if again else None)
    assert got == want
    assert warc.read(warc.write(pages.limit(0), o), o).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in [1, 2, 255, 256, 257, 5000, 20_011] * 3:
        z = rng.integers(0, 1 << int(rng.integers(1, 23)), n).astype(np.uint32)
        z[n // 2 :] = np.resize(z[:4], n - n // 2)
        packed = range_coder.encode_section(z)
        assert range_coder.decode_section(io.BytesIO(packed).read) == z.tobytes()
    same = np.full(50_000, 7, np.uint32)
    assert len(range_coder.encode_section(same)) < 24 * 200  # bytes a block
    # any damage is an error of its own kind
    packed = range_coder.encode_section(rng.integers(0, 900, 3000).astype(np.uint32))
    for at in rng.integers(0, len(packed), 60).tolist():
        bad = bytearray(packed)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError, match="checksum|cut short"):
            range_coder.decode_section(io.BytesIO(bytes(bad)).read)


def test_range_coder_compresses_better_than_zlib():
    """Ids with the frequencies of words and some repeated phrases."""
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 20_001)
    ids = rng.choice(20_000, 200_000, p=share / share.sum()).astype(np.uint32)
    for at in rng.integers(1000, 199_000, 500):
        ids[at : at + 30] = ids[at - 90 : at - 60]
    assert len(range_coder.encode_section(ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_token_files_round_trip(spark, docs, none):
    tok = Encoder(default_tokenizer()).tokenizer
    files = token_files.write(docs)
    got = [tuple(r) for r in token_files.read(files).collect()]
    want, start = [], 0
    for i, t, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_files.read(token_files.write(none)).count() == 0
    path = files.first().path.removeprefix("file://")
    blob = open(path, "rb").read()
    assert sum(1 for _ in token_files.read_documents(io.BytesIO(blob), len(blob))) == files.first().documents
    rng = random.Random(8)
    for at in [3, len(blob) // 3, len(blob) - 1, len(blob) - 10, len(blob) - 60, *(rng.randrange(len(blob)) for _ in range(25))]:
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum|cut short|not a token file|missing"):
            list(token_files.read_documents(io.BytesIO(bytes(bad)), len(bad)))
    with pytest.raises(ValueError, match="not a token file"):
        list(token_files.read_documents(io.BytesIO(blob[:-5]), len(blob) - 5))


def test_encoder_equals_the_library():
    e = Encoder(default_tokenizer(), 50, 50)
    rng = random.Random(4)
    odd = ["", " ", "a\x1cb c", "İstanbul ΣΑΣ Straße ǅ ﬁ", "don't I'LL we've 12½ ²3", "<|endoftext|> a<|startoftext|>b", "é Éa ́", "a\x85d　e", "日本語 emoji 👍🏽", "ab" * 3000]
    odd += ["".join(chr(rng.choice([rng.randint(33, 126), rng.randint(160, 0x300), 32])) for _ in range(300)) for _ in range(60)]
    for t in odd * 2:
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_language_id(spark, docs, none):
    got = language_id.identify(docs).collect()
    lang = {i: x for i, _, x, *_ in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id in (142, 143, 144, 146, 147):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert language_id.identify(none).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(corpus()) - 5
    assert {r.lang_pred for r in language_id.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_language_id_rejects_gibberish_on_a_small_table(spark, docs):
    rng = random.Random(15)
    rows = [(1000 + i, " ".join("".join(rng.choice("bcdfgjqvwxz") for _ in range(7)) for _ in range(80)), None) for i in range(6)]
    small = docs.select("doc_id", "text", "lang").where("lang is not null").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for table in (small, small.where("doc_id >= 1000 OR (doc_id < 30 AND lang = 'de') OR (doc_id < 12 AND lang = 'en')")):
        got = language_id.identify(table).collect()
        assert {r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 1000 and not r.rejected} == set()
        assert {r.doc_id for r in got if r.rejected and r.doc_id is not None and r.doc_id < 140} == set()


def test_kneser_ney_sums_to_one():
    counts = {"x": language_id.ngram_counts(["abba aba baab"], 3), "y": language_id.ngram_counts(["ccc cab"], 3)}
    m = language_id.kneser_ney(counts, 3)
    letters = ["a", "b", "c"]
    for context in ("", "a", "ab", "ca"):
        ends = language_id.word_scores(m, [context]) if context else language_id.word_scores(m, ["a"]) * 0
        del ends
    # all continuations of a context, the end mark and one unseen symbol of the alphabet share one
    total = sum(np.exp(language_id.word_scores(m, ["a" + c]) - _prefix(m, "a", c)) for c in letters)
    assert (total <= 1 + 1e-6).all() and (total > 0.2).all()


def _prefix(m, prefix, c):
    """Log-probability of ``prefix`` and of the end after ``prefix + c``, so that the difference is that of c."""
    h = language_id.word_scores(m, [prefix + c])
    codes, use = language_id._codes([prefix + c], m.order)
    p = np.full((int(use.sum()), len(m.languages)), 1.0 / m.alphabet, np.float32)
    at = np.flatnonzero(use)
    for n in range(1, m.order + 1):
        a = language_id._rows(m.grams[n - 1], m.alpha[n - 1], language_id._hashes(codes, n)[at], 0.0)
        g = m.gamma[0] if n == 1 else language_id._rows(m.contexts[n - 1], m.gamma[n - 1], language_id._hashes(codes, n - 1)[at - 1], 1.0)
        p = a + g * p
    return h - np.log(p[len(prefix)])


def brute_classes(rows, least=0.8):
    hashes = WordHashes()
    texts = sorted({t for _, t, *_ in rows if t and WORD.search(t)})
    h = {t: near_dedup.kmer_hashes(hashes.of(t), 5) for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if near_dedup.aligned(h[a], h[b], least) >= least:
            parent[root(a)] = root(b)
    return {t: root(t) for t in texts}


def test_near_duplicates(spark, docs, none):
    rows = corpus()
    root = brute_classes(rows)
    heads = {}
    for i, t, *_ in rows:
        if t in root and i is not None:
            heads[root[t]] = min(heads.get(root[t], 10**9), i)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted((i, heads[root[t]] if t in root else i) for i, t, *_ in rows if i is not None)
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == want
    assert sum(r.keep for r in got) == len(set(root.values())) + 4
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*heads.values(), 142, 143, 146, 147])
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_first(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Near copies of one text that are hardly alike among themselves, in blocks smaller than the group."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"v{i}_{j}" for j in range(60)) + " " + " ".join(base[:30])) for i in range(40)]
    root = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, near_dedup.DedupOptions(block=16)).collect()
    heads = {}
    for i, t in rows:
        heads[root[t]] = min(heads.get(root[t], 10**9), i)
    wrong = [r for r in got if r.class_id != heads[root[dict(rows)[r.doc_id]]]]
    assert not wrong


def test_alignment_follows_order():
    x = np.arange(100, dtype=np.uint32)
    assert near_dedup.aligned(x, x, 0.8) == 1.0
    assert near_dedup.aligned(x, x[10:], 0.8) == 0.9
    assert near_dedup.aligned(x, x[::-1].copy(), 0.8) < 0.1
    assert near_dedup.aligned(x, x[:70], 0.8) == 0.0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_decontamination(spark, none):
    rng = random.Random(6)
    stock = [f"{a}{b}{c}" for a in "bcdfg" for b in ("ar", "ol", "in") for c in "mnpt"] * 2 + ["the", "of", "and"] * 20
    item = [words(rng, rng.randint(14, 55), [f"q{k}{i}" for i in range(40)]) + ". " + words(rng, 6, stock) + "." for k in range(30)]
    rows, want = [], set()
    for i in range(200):
        t = words(rng, rng.randint(0, 400), stock)
        if i % 5 == 0:
            k = rng.randrange(30)
            t += " " + item[k] + " " + words(rng, 50, stock)
            want.add((i, k))
        elif i % 11 == 0:  # a paraphrase: a sixth of the words of the question are others
            k = rng.randrange(30)
            w = item[k].split()
            for j in range(0, len(w) - 8, 6):
                w[j] = "other"
            t += " " + " ".join(w) + " " + words(rng, 50, stock)
            want.add((i, k))
        rows.append((i, t, "clash"))
    rows += [(300, None, "x"), (301, "", "x"), (302, words(rng, 20_000, stock), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(90, None), (91, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0


def test_decontamination_of_frequent_words(spark):
    """Items of words without weight: one that fills a third of the rows, and one that is the whole table."""
    rng = random.Random(12)
    item = " ".join(f"hot{chr(97 + i)}" for i in range(20))
    rows = [(i, item if i % 3 == 0 else words(rng, 20, [f"w{j}" for j in range(400)])) for i in range(300)]
    rows.append((300, " ".join(f"rare{j}" for j in range(30)) + " " + item + " " + " ".join(f"rarer{j}" for j in range(30))))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.share) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == [(i, 1.0) for i in range(0, 301, 3)]
    for n in (40, 8):
        text = " ".join(f"one{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
        alone, bench = spark.createDataFrame([(7, text)], "doc_id long, text string"), spark.createDataFrame([(2, text)], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(alone, bench).collect()] == [(7, 2)]
        assert decontaminate.keep_clean(alone, bench).count() == 0


def test_decontamination_basis_is_fitted_on_all_documents(spark):
    """Against the exact decomposition of all passages: more than 4,000 documents, under distinct ids and under a
    single one. The basis holds nearly as much of the passages as the best one of its rank."""
    rng = random.Random(13)
    stock = [f"w{j}" for j in range(300)]
    texts = [words(rng, 40, stock[(i % 4) * 60 :][:120]) for i in range(4400)]
    bench = spark.createDataFrame([(1, " ".join(stock[5:40]))], "item_id long, text string")
    o = decontaminate.DecontaminationOptions(rank=4)
    hashes, columns = WordHashes(), 8192
    column = lambda w: (hashes.of(" ".join(w)) >> np.uint64(51)).astype(int)
    cols = [column(p) for t in texts for p in [t.split()[:32], t.split()[32:]]]
    own = column(stock[5:40])
    for distinct in (True, False):
        (path,) = decontaminate._prepare(spark.createDataFrame([(i if distinct else 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), bench, o)
        terms = np.load(path.removeprefix("file://"))["terms"].astype(float)
        idf = np.sqrt(terms[:, -1])
        n = np.bincount(np.concatenate(cols), minlength=columns)
        share = 1 - (1 - (n + 0.5) / (n.sum() + 1)) ** o.passage
        assert np.allclose(idf, np.maximum(-np.log(share) - o.common, 0), atol=1e-5)  # counted over all words
        use = np.unique(np.concatenate([*cols, own]))
        a = np.zeros((len(cols) + 1, columns))
        for row, c, weight in zip(a, [*cols, own], [0.1 / len(cols)] * len(cols) + [1.0], strict=True):
            np.add.at(row, c, idf[c] * np.sqrt(weight / (idf[c] ** 2).sum()))
        a = a[:, use]
        mine = terms[use, :4] / idf[use, None]
        assert np.allclose(mine.T @ mine, np.eye(4), atol=1e-4)
        best = np.linalg.svd(a, compute_uv=False)[:4]
        assert ((a @ mine) ** 2).sum() >= 0.99 * (best**2).sum()
        rest = best[1:]  # and of the documents' own directions
        assert ((a[:-1] @ mine) ** 2).sum() >= 0.6 * (np.linalg.svd(a[:-1], compute_uv=False)[:4] ** 2).sum() and len(rest) == 3


def test_decontamination_in_lots(spark):
    """More items than a lot holds, more lots than a worker holds."""
    rng = random.Random(21)
    items = [words(rng, 20, [f"i{k}x{j}" for j in range(30)]) for k in range(25)]
    rows = [(k, words(rng, 30, [f"w{j}" for j in range(200)]) + " " + (items[k] if k < 25 else "") + " tail") for k in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, decontaminate.DecontaminationOptions(items_per_pass=4, held=2)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(25)]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == t[-1][-1]


def test_word_hashes_are_those_of_the_words():
    """Equal for equal words, different for others, in any company, beside other alphabets and across runs."""
    from smoothlake.llm._common import RUN, lots

    texts = ["The  the x_y 42", "", "É été ÀÉ", "Σίσυφος İstanbul 漢字 the", "...", "a" * (RUN + 9) + " the été " + "b" * 9, "été " * 70_000, "\u212Aelvin kelvin"]
    hashes, seen = WordHashes(), {}
    h, begin = hashes(texts)
    for t, lo, hi in zip(texts, begin, begin[1:], strict=False):
        mine = WORD.findall(t.lower())
        assert len(mine) == hi - lo and (hashes.of(t) == h[lo:hi]).all()
        for w, x in zip(mine, h[lo:hi].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert [i for lo, hi in lots(texts, 20) for i in range(lo, hi)] == list(range(len(texts))) and list(lots([])) == []


def test_word_lists_are_those_of_the_plain_patterns():
    from smoothlake.llm._common import LETTERS, WORD, word_list

    rng = random.Random(8)
    for top in (127, 255, 0x3000):
        for _ in range(300):
            t = "".join(chr(rng.randint(0, top)) for _ in range(50))
            assert word_list(t) == WORD.findall(t.lower()) and word_list(t, LETTERS) == LETTERS.findall(t.lower())
