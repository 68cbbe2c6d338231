"""Each operator against brute force, a library or a round trip, on small tables with nulls, ties and odd texts."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, common, jaccard_join, licenses, order_minhash, packing, quality_rules, sentencepiece_codec, token_store, toxicity, warc

ODD = [None, "", " ", "\n", "a", "Ünï  códe\t\n x", "中文 テスト", "the " * 300, "<|im_end|> <s> </s>", "a\x00b", "x" * 5000, "one two three four five six seven eight nine ten eleven", "word-word's 12 ²3 ſt ﬁ İ"]


def frame(spark, texts, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)] + ([(len(texts) - 1, texts[-1])] if extra else [])
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("row", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(["a", "th", "e ", " ", "  ", "▁", "é", "²", "²."]) for _ in range(60)) for _ in range(200)]
    got = {r.doc_id: r for r in sentencepiece_codec.encode_digests(frame(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 100_000), (None, "u", "same"), (6, "u", "é" * 3)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    whole = sorted(map(tuple, warc.read_archive(spark, path).collect()), key=str)
    assert sorted(map(tuple, warc.read_archive(spark, path, 50).collect()), key=str) == whole
    by = {r[0]: r for r in whole}
    assert by[1][3:] == ("revisit", 2) and by[2][3:] == ("response", None) and by[None][3:] == ("revisit", 2)
    assert by[3][3:] == ("revisit", 4) and by[3][1] == 0 and by[6][2] == warc.digest32("ééé".encode())
    assert warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    warc.verify(spark, path, 50)
    url = "http://" + "".join(random.Random(7).choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(900_000))
    long = warc.write_archive(spark.createDataFrame([(1, url, "x", "clash"), (2, url, "y", "clash")], "page_id long, url string, html string, digest string").coalesce(1))
    assert warc.read_archive(spark, long, 1000).count() == 2


def test_warc_of_others(spark, tmp_path):
    """No manifest, ids that are no pages, other types, no digests, two records in a member, a wrong digest, splits inside records."""
    import gzip

    def one(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *more]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http, uid = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n", "WARC-Record-ID: <urn:uuid:0b3b4f3c-0000-4000-8000-00000000000%d>"
    page = "Content-Type: application/http; msgtype=response"
    members = [
        one("warcinfo", b"software: x", uid % 1), one("request", b"GET / HTTP/1.1\r\n\r\n", uid % 2) + one("response", http + b"body" * 999, uid % 3, page),
        one("response", http + b"z", uid % 4, page, "WARC-Payload-Digest: sha1:" + "A" * 32), one("revisit", http, uid % 5, page, "WARC-Refers-To: <urn:uuid:x>"), one("metadata", b"\x1f\x8b\x08 no member", uid % 6),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    for where, split in (("in", 32 << 20), ("in", 40), ("in/a.warc.gz", 100)):
        rows = warc.read_records(spark, f"file://{tmp_path}/{where}", split).orderBy("record_id").collect()
        assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "revisit", "metadata"]
        assert [r.differs for r in rows] == [False, False, False, True, False, False] and rows[2].payload_bytes == 3996 and rows[4].payload_bytes is None
    pages = warc.read_archive(spark, f"file://{tmp_path}/in").collect()
    assert len(pages) == 3 and {r.page_id for r in pages} == {None}


def test_toxicity(spark):
    rnd = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "amet", "sed", "elit", "magna"]
    docs = [" ".join(rnd.choices(words, k=40)) + (" scumbag" if i % 4 == 0 else "") for i in range(400)]
    table = frame(spark, docs, False)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    rows = toxicity.score_documents(table, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(frame(spark, ODD), labels).collect())


def test_toxicity_without_labels(spark):
    schema = "doc_id long, toxic int"
    docs, none = frame(spark, ["a b c", None, "x y z"], False), spark.createDataFrame([], schema)
    assert toxicity.score_documents(empty(spark), none).count() == 0
    assert toxicity.score_documents(empty(spark), spark.createDataFrame([(1, 1)], schema)).count() == 0
    for labels in ([], [(99, 1)], [(None, 1)], [(1, None)]):
        assert [r.score for r in toxicity.score_documents(docs, spark.createDataFrame(labels, schema)).collect()] == [0, 0, 0]
    one = toxicity.score_documents(docs, spark.createDataFrame([(0, 0), (1, 0), (2, 0)], schema)).collect()
    assert all(r.predicted == 0 for r in one)
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.held_out for r in toxicity.score_documents(nulls, none).collect()] == [False, False]


def test_toxicity_ratios():
    """The fit against ratios counted by hand: with one informative n-gram its weight has the sign of its ratio, and scores order texts by it."""
    texts = ["good day"] * 20 + ["bad day"] * 20
    labels = np.array([0] * 20 + [1] * 20)
    weights, b = toxicity._fit(labels, [np.unique(toxicity.ngrams(t)) for t in texts])
    only = {w: np.setdiff1d(toxicity.ngrams(f"{w} day"), toxicity.ngrams(f"{o} day")) for w, o in (("good", "bad"), ("bad", "good"))}
    assert (weights[only["bad"]] > 0).all() and (weights[only["good"]] < 0).all()
    assert (weights[np.intersect1d(toxicity.ngrams("good day"), toxicity.ngrams("bad day"))] == 0).all()  # ratio 0
    assert toxicity._score("bad day", weights, b) > 0.9 and toxicity._score("good day", weights, b) < 0.1


def test_toxicity_memory(monkeypatch):
    """The fit takes a few bytes a feature beside its rows, and blocks of any size give the same weights."""
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 400)
    rows = [np.unique(rng.integers(0, 1 << 16, 12_000) + (y << 16)).astype(np.uint32) for y in labels] + [np.zeros(0, np.uint32)]
    labels = np.append(labels, 0)
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    tracemalloc.start()
    weights, b = toxicity._fit(labels, [r.copy() for r in rows])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, rows)) + (60 << 20) and (weights != 0).any()
    for block in (1, 50_000, 1 << 30):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        again, c = toxicity._fit(labels[:30], [r[:500] for r in rows[:30]]), toxicity._fit(labels[:30], [r[:0] for r in rows[:30]])
        want = want if block > 1 else (again, c)
        assert np.allclose(again[0], want[0][0]) and np.allclose((again[1], c[1]), (want[0][1], want[1][1])) and not c[0].any()
    assert want[1][1] != np.log((labels[:30].sum() + 1) / (30 - labels[:30].sum() + 1))  # the intercept is learnt without features


def order_minhash_by_hand(text, bins=64):
    """Python version of the definition in the docstring, with Spark's own hash replaced: only equalities are compared."""
    words = [c for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w for c in (w if len(w) > order_minhash.LONG else [w])]
    grams = [tuple(words[i : i + 2]) for i in range(len(words) - 1)] or ([tuple(words)] if words else [])
    seen, numbered = Counter(), []
    for i, g in enumerate(grams):
        numbered.append((g, seen[g], i))
        seen[g] += 1
    h = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big")
    out = []
    for b in range(bins if grams else 0):
        least = sorted(numbered, key=lambda x: (h("bin", x[0], x[1]) % bins != b, h(b, x[0], x[1])))[:2]
        out.append(tuple(g for g, _, _ in sorted(least, key=lambda x: x[2])))
    return out


def test_order_minhash_by_hand(spark):
    """Likeness estimates what an independent Python version estimates, on texts short, long, shuffled in blocks, and without blanks."""
    rnd = random.Random(11)
    pairs = []
    for n in (6, 30, 120, 500):
        for _ in range(8):
            w = [f"w{rnd.randrange(300)}" for _ in range(n)]
            blocks = [w[i : i + 6] for i in range(0, n, 6)]
            pairs += [(w, sum(rnd.sample(blocks, len(blocks)), [])), (w, w[: n // 2] + [f"v{k}" for k in range(n // 2)])]
    texts = [" ".join(t) for p in pairs for t in p] + ["一二三四五六七八九十" * 30, "一二三四五六七八九十" * 29 + "甲乙丙丁戊己庚辛壬癸"]
    rows = order_minhash.fingerprint(frame(spark, texts, False), "text", "fp").orderBy("doc_id").collect()
    by_hand = [order_minhash_by_hand(t) for t in texts]
    got = np.array([len({*rows[i].fp} & {*rows[i + 1].fp}) / 64 for i in range(0, len(rows), 2)])
    want = np.array([np.mean([x == y for x, y in zip(by_hand[i], by_hand[i + 1], strict=True)]) for i in range(0, len(rows), 2)])
    assert abs(got - want).max() < 0.35 and abs((got - want).mean()) < 0.03 and 0 < got[-1] < 1
    hot = spark.createDataFrame([(None, f"t{k} a b") for k in range(300)] + [(k, f"u{k} a") for k in range(20)], "doc_id long, text string")
    keyed = hot.selectExpr("coalesce(doc_id, -9223372036854775808L) AS k", "xxhash64(text) AS tie")
    numbers = [r.bucket for r in keyed.withColumn("bucket", order_minhash.buckets(keyed, "k", "tie", 4)).orderBy("k", "tie").collect()]
    assert numbers == sorted(numbers) and max(Counter(numbers).values()) < 30  # null ids are cut too
    report = order_minhash.edit_report(hot, 4)
    assert report.count() == 320
    ordered = hot.selectExpr("text", "coalesce(doc_id, -9223372036854775808L) AS k", "xxhash64(text) AS tie").orderBy("k", "tie").collect()
    edits = Counter(hashlib.sha256((t.text[: len(t.text) - len(t.text) // 4] + n.text[: len(t.text) // 4]).encode()).hexdigest() for t, n in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert Counter(r.edited_sha256 for r in report.collect()) == edits


def test_order_minhash(spark):
    base = [f"alpha{i} beta{i % 7} gamma delta{i % 3}" for i in range(200)]
    texts = [" ".join(base), " ".join(base), " ".join(reversed(base)), *[t for t in ODD if t != "x" * 5000]]
    rows = order_minhash.edit_report(frame(spark, texts, False), 4).orderBy("doc_id").collect()
    for i, r in enumerate(rows):
        t, n = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1 and rows[1].near_next < 0.5  # the same k-mers in another order
    assert order_minhash.edit_report(empty(spark)).count() == 0


def test_order_of_short_texts(spark):
    """Halves swapped: the share of equal tuples is that of pairs of k-mers, of all in either text, that keep their order."""
    rnd = random.Random(8)
    for n in (12, 20, 40, 64, 100, 250):
        texts = []
        for _ in range(40):
            w = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])]
        rows = order_minhash.fingerprint(frame(spark, texts, False), "text", "fp").orderBy("doc_id").collect()
        assert all(len(r.fp) == 64 for r in rows)
        alike = [len({*rows[i].fp} & {*rows[i + 1].fp}) / 64 for i in range(0, len(rows), 2)]
        a, b = n // 2 - 1, n - n // 2 - 1  # k-mers within the halves; with the one across the border of each text there are n
        kept = (a * (a - 1) + b * (b - 1)) / (n * (n - 1))
        assert abs(np.mean(alike) - kept) < 0.05, (n, np.mean(alike), kept)


def test_licenses(spark):
    filler = [f"w{i}" for i in range(300)]
    texts = [" ".join(filler[:k] + [text] + filler[k:]) for k in (0, 1, 7, 150, 300) for _, text in licenses.TEMPLATES]
    rows = licenses.scan(frame(spark, texts + ODD + ["released under no license"], False)).orderBy("doc_id").collect()
    for i in range(len(texts)):
        assert licenses.TEMPLATES[i % len(licenses.TEMPLATES)][0] in rows[i].licenses
    assert all(r.n_licenses == 0 for r in rows[len(texts) :])


def test_full_licenses(spark):
    text = {name: t for name, t in sorted(licenses.TEMPLATES, key=lambda x: len(x[1]))}
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    want = [([n], text[n]) for n in ("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "BSL-1.0", "CC0-1.0", "MPL-2.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")]
    want += [(["GPL-2.0-or-later"], gpl), (["AGPL-3.0-or-later"], gpl.replace("General", "Affero General").replace("version 2", "version 3")), (["LGPL-2.1-or-later"], gpl.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1"))]
    want += [(["ISC", "MIT"], f"{text['MIT']} lorem ipsum {text['ISC']}"), (["EPL-2.0"], "// SPDX-License-Identifier: EPL-2.0"), (["BSD-2-Clause"], text["BSD-2-Clause"].replace("COPYRIGHT HOLDERS", "AUTHOR").replace("1.", "*"))]
    rows = licenses.scan(frame(spark, ["lorem ipsum dolor " * 50 + t + " sit amet" * 70 for _, t in want], False)).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [names for names, _ in want]


def test_licenses_by_containment(spark):
    """Containment counted over whole texts without windows or bands: copies, altered copies, near misses, halves."""
    rnd = random.Random(6)
    words = lambda t: licenses.WORD.findall(t.lower())
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    texts = []
    for _, text in licenses.TEMPLATES:
        w = words(text)
        for edits in (0, len(w) // 60, len(w) // 32, len(w) // 25 + 1):
            copy = list(w)
            for at in rnd.sample(range(len(w)), min(edits, len(w))):
                copy[at] = f"zz{at}"
            texts.append(" ".join([f"f{k}" for k in range(rnd.randrange(90))] + copy + [f"g{k}" for k in range(rnd.randrange(90))]))
        texts.append(" ".join(w[: len(w) // 2]))
    scanner, need = licenses.Scanner(licenses.TEMPLATES), [(name, grams(words(t))) for name, t in licenses.TEMPLATES]
    for text in texts:
        held = grams(words(text))
        could = {name for name, t in need if len(t & held) >= 0.9 * len(t)}
        found = {m[0] for m in scanner.matches(text)}
        assert found <= could and bool(found) == bool(could)  # of overlapping ones the largest is named
    assert licenses.scan(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "Released under the MIT License."), (None, None)], "doc_id long, text string")
    assert sorted(r.n_licenses for r in licenses.scan(nulls).collect()) == [0, 1]


def test_packing_solver():
    """Least squares against the best of all sets of active columns; rounding, cuts and padding of whole plans."""
    from itertools import combinations

    rnd = np.random.default_rng(9)
    for _ in range(20):
        lengths = np.sort(rnd.choice(np.arange(1, 16), 6, replace=False))
        columns = packing.combinations(lengths, 16)
        if not 0 < len(columns) <= 8:
            continue
        histogram = np.zeros(17, int)
        histogram[lengths] = rnd.integers(1, 30, len(lengths))
        matrix = np.zeros((17, len(columns)))
        for k, column in enumerate(columns):
            for n in column[column > 0]:
                matrix[n, k] += 1
        best = float((histogram**2).sum())
        for size in range(1, len(columns) + 1):
            for active in combinations(range(len(columns)), size):
                x, *_ = np.linalg.lstsq(matrix[:, active], histogram, rcond=None)
                if (x >= -1e-9).all():
                    best = min(best, float(((matrix[:, active] @ x - histogram) ** 2).sum()))
        x = packing.solve(columns, histogram, 2000, 1e-6)
        assert (x >= 0).all() and abs(float(((matrix @ x - histogram) ** 2).sum()) - best) < 1e-3 * max(1, best)
    for lengths in (np.full(501, 512), np.full(7, 300), rnd.integers(1, 1024, 900), np.array([], int), np.array([1])):
        made = list(packing.plan(lengths, 1024))
        sizes = [sum(n for _, _, n in s) for s in made]
        assert sum(sizes) == lengths.sum() and all(x == 1024 or x & (x - 1) == 0 for x in sizes) and sum(x < 1024 for x in sizes) <= 10
        got = Counter((i, at + k) for s in made for i, at, n in s for k in range(n))
        assert got == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))
    assert sum(len(s) for s in packing.plan(np.full(500, 512), 1024)) == 500  # whole pairs, none cut


def test_packing_of_nothing(spark):
    path = P.path("byte_bpe_50k.json")
    assert packing.pack_documents(empty(spark), path).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string").coalesce(1)
    assert [(r.length, r.doc_tokens) for r in packing.pack_documents(nulls, path).collect()] == [(1, 1), (1, 1)]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    texts = ODD + [" ".join(rnd.choices(["alpha", "be", "c", "delta,"], k=rnd.randint(1, 3000))) for _ in range(60)]
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    pieces = packing.pack_documents(frame(spark, texts, False), P.path("byte_bpe_50k.json")).collect()
    covered, sequences = Counter(), {}
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        covered.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert covered == Counter((i, k) for i, x in enumerate(ids) for k in range(len(x)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_quality_rules(spark):
    import re

    texts = ODD + ["a b c d e " * 9, "l1 x\nl1 x\n\n\nl2", "#a $b | c"]
    policy = quality_rules.POLICIES["2"]
    entries = quality_rules.apply_policy(quality_rules.ledger(frame(spark, texts, False)), policy)
    for r in entries.collect():
        t = texts[r.doc_id] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        repeat = len({i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)})
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len({*lines}), repeat)
        assert r.n_symbols == len(re.findall("[#*$%&|<>]", t))
    report = {r.rule: r for r in quality_rules.ablations(entries, policy).collect()}
    kept = entries.where("kept").count()
    for k, (name, _) in enumerate(quality_rules.RULES):
        assert report[name].n_kept == kept and report[name].n_failed == entries.where(F.expr(f"failed & {1 << k} != 0")).count()
    docs = frame(spark, texts)
    assert sorted(r.doc_id for r in quality_rules.filtered(docs, policy).collect()) == sorted(r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs), policy).where("kept").collect())


def test_token_store(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, "a <|endoftext|> b <|STARTOFTEXT|>"]
    store = token_store.write_tokens(frame(spark, texts, False).orderBy(F.rand(1)), P.path("word_bpe_49k.json"), 1, parts=3)
    rows = token_store.read_tokens(spark, store).orderBy("doc_id").collect()
    at, own = 0, {}
    for _, name, _, _ in store.files:
        file = token_store.TokenFile(store.path, name, store.dictionary)
        for k, ids in enumerate(file.scan()):
            assert (ids == file.ids(k)).all()
            own[int(file.index["doc_id"][k])] = ids.tolist()
    for r, t in zip(rows, texts, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and own[r.doc_id] == ids
        at += len(ids)
    none = token_store.write_tokens(empty(spark), P.path("word_bpe_49k.json"), 1)
    assert token_store.read_tokens(spark, none).count() == 0


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens(file, spaced):
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(P.path(file)), common.TokenCache(P.path(file), spaced)
    for t in [*ODD, "a <|endoftext|> b <|startoftext|> c", "<|ENDofTEXT|>x", "x<|endoftext|>", "<|endoftext |> <|endoftext", "\u00e9 <|startoftext|><|endoftext|>\n it's"]:
        assert np.frombuffer(cache(t), "<u2").tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_nulls_and_nothing(spark):
    """Null ids twice, empty tables and clashing columns, for operators whose own tests have none."""
    rows = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2), (3, None, 3)], "doc_id long, text string, bits int")
    model = P.path("piece_bpe_32k.model")
    assert sorted(r.n_tokens for r in sentencepiece_codec.encode_digests(rows, model).collect())[0] == 2
    found = jaccard_join.linked(rows, jaccard_join.Near(3, 90, 100)).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id is None) for r in found) == [(False, 0, False), (True, 2, True), (True, 2, True)]
    assert jaccard_join.linked(empty(spark), jaccard_join.Near(3, 90, 100)).count() == 0
    assert quality_rules.ledger(empty(spark)).count() == 0 and quality_rules.filtered(empty(spark), quality_rules.POLICIES["2"]).count() == 0
    (one,) = quality_rules.ablations(quality_rules.stored_ledger(empty(spark)), quality_rules.Policy("x", ("few_words",))).collect()
    assert (one.n_documents, one.n_kept, one.n_failed) == (0, 0, 0)
    assert quality_rules.ledger(rows).count() == 3 and order_minhash.fingerprints(rows).count() == 3
    store = token_store.write_tokens(rows, P.path("word_bpe_49k.json"), 1)
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_store.read_tokens(spark, store).collect())[0] == (False, 1)
    chats = spark.createDataFrame([(1, 0, "user", "x", "clash")], "conv_id long, turn long, role string, text string, span string")
    assert chat.format_report(chats).count() == 2 and chat.format_report(chats.where("false")).count() == 1


def test_large_tiles(spark, monkeypatch):
    """A tile in several blocks gives the same components."""
    rnd = random.Random(12)
    texts = [" ".join(["p q r s t u v w x y z"] + [f"w{rnd.randrange(6)}" for _ in range(3)]) for _ in range(120)]
    near = jaccard_join.Near(3, 60, 100)
    whole = sorted(map(tuple, jaccard_join.linked(frame(spark, texts, False), near).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    assert sorted(map(tuple, jaccard_join.linked(frame(spark, texts, False), near).collect())) == whole


@pytest.mark.parametrize("near", [jaccard_join.Near(3, 90, 100), jaccard_join.Near(5, 80, 100)])
def test_jaccard_join(spark, near):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = list(ODD)
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 200))
        for edits in (0, 0, 1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + near.words]) for i in range(max(1, len(w) - near.words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and near.den * both >= near.num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r for r in jaccard_join.linked(frame(spark, texts), near).collect()}
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_wide_bitmaps():
    rnd = np.random.default_rng(5)
    for n, m in ((10, 900), (3000, 3100), (20000, 5)):
        x, y = (np.unique(rnd.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (n, m))
        y = np.unique(np.concatenate([x[: min(n, m) // 2], y]))
        assert jaccard_join.differing(jaccard_join.wide_bitmap(x), jaccard_join.wide_bitmap(y)) <= len(np.setxor1d(x, y))


class Whole:
    """A template that looks at all turns: the last one is marked."""

    def __call__(self, turns):
        return "|".join(t for _, t in turns) + "!"


def test_chat(spark):
    rows = [(1, 0, "user", "hi\\ <|im_end|>\n"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, None, "assistant", "é<"), (2, 1, "assistant", chat.PROBE_TEXT), (2, 1, "assistant", chat.PROBE_TEXT), (None, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_report(table).collect()}
    assert {*got} == {1, 2, None, -1} and got[2].n_turns == 3
    text = "é<" + chat.PROBE_TEXT * 2
    assert (got[2].loss_chars, got[2].loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    whole = "user\nhi\\ <|im_end|>\n\nassistant\n\n\nx\n"
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    turns = [("a", "x"), ("b", "<|y")]
    full = chat.Incremental(lambda t: chat.MarkedTemplate()(t))
    local = chat.Incremental(chat.MarkedTemplate())
    assert [full.add(*t) for t in turns] == [local.add(*t) for t in turns]
    odd = chat.Incremental(Whole())
    assert odd.add("a", "x") and odd.add("a", "y") is None and odd.rewrites


def test_chat_prefixes(spark):
    """Successive prefixes are rendered with their context, and a wrong statement of the context is found out."""
    seen = []

    class Spy(chat.MarkedTemplate):
        def __call__(self, turns):
            seen.append(len(turns))
            return super().__call__(turns)

    state = chat.Incremental(Spy())
    for k in range(9):
        state.add("user", f"t{k}")
    assert max(seen) == 8 and seen.count(2) > 8 and not state.rewrites

    class Numbered(chat.MarkedTemplate):  # numbers turns from the first one: needs all of them
        def __call__(self, turns):
            return super().__call__([(f"{role}{k}", text) for k, (role, text) in enumerate(turns)])

    state = chat.Incremental(Numbered())
    assert [state.add("user", "x") is None for _ in range(4)] == [False, False, False, True] and state.rewrites
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>a</think>b"), (1, 2, "user", "r"), (2, 0, "user", "q"), (2, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    template = chat.TEMPLATES["forgetful"]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table, template), template.parse).collect()}
    assert (got[1].n_turns, got[1].n_unlocated, got[1].rewrites) == (3, 1, True) and (got[2].n_unlocated, got[2].rewrites, got[2].loss_chars) == (0, False, 1)
    sizes = lambda turns: "".join(f"{len(t)};" for _, t in turns)  # noqa: E731  texts can't be found
    assert [(r.located, r.span) for r in chat.format_conversations(table.where("conv_id = 2"), sizes).collect()] == [(False, "1;"), (False, "1;")]
    assert chat.format_conversations(table.where("false"), template).count() == 0


def test_chat_sizes(spark):
    """What a conversation gives depends on no number of turns or code points."""

    class Numbered(chat.MarkedTemplate):  # states a context of one turn and needs all
        def __call__(self, turns):
            return super().__call__([(f"{role}{k}", text) for k, (role, text) in enumerate(turns)])

    class Replying(chat.LocalTemplate):
        def turn(self, before, turn):
            return f"{before and before[0]}>{turn[0]}:{turn[1]};"

    for first in ("x", "x" * (1 << 20)):
        state = chat.Incremental(Numbered())
        assert [state.add("user", first) is None, *(state.add("user", "x") is None for _ in range(3))] == [False, False, False, True] and state.rewrites
    turns = {n: [("user", f"t{k}" if k else "x" * (1 << 20 if n == 6 else 1)) for k in range(n)] for n in range(1, 10)}
    table = spark.createDataFrame([(n, k, *t) for n, ts in turns.items() for k, t in enumerate(ts)], "conv_id long, turn long, role string, text string")
    for template in (Numbered(), Replying(), chat.MarkedTemplate()):
        spans = {n: ["" for _ in ts] for n, ts in turns.items()}
        for r in chat.format_conversations(table, template).collect():
            spans[r.conv_id][r.seq] = r.span
            assert r.located and not r.rewrites
        assert all("".join(spans[n]) == template(ts) for n, ts in turns.items())
    state = chat.Incremental(chat.MarkedTemplate())
    for k in range(100):
        state.add("user", f"t{k}")
    assert len(state.turns) == 1 and not state.all and not state.spans
