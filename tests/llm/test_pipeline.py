"""The pipeline's stages one after another against plain Python, over nulls, repeated rows, groups of copies and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def written(spark, path, docs, labels):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(13)
    words = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    docs = [(k, text(rnd.randint(20, 120)) + (" scumbag filth" * 3 if k % 5 == 0 else "")) for k in range(120)]
    for k in range(0, 60, 2):  # copies with up to 12 words changed
        w = docs[k + 1][1].split()
        for at in rnd.sample(range(len(w)), min(len(w), rnd.choice([0, 1, 2, 4, 12]))):
            w[at] = rnd.choice(words)
        docs.append((200 + k if k % 4 else None, " ".join(w)))
    docs += [(300, None), (301, ""), (302, "one two three"), (303, "# $ % & " * 20), (304, "a b c d e " * 30), docs[7], docs[7], (None, docs[9][1]), (None, docs[9][1]), (None, text(50))]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(120)] + [(None, 1, 1)]
    sf = written(spark, tmp_path, docs, labels)
    read = spark.read.parquet(f"{sf}/documents.parquet")
    (_, quality), (_, toxic), (_, near), (_, pack) = corpus_pipeline.STAGES

    kept = [(r.doc_id, r.text) for r in quality(spark, read, sf).collect()]
    assert Counter(kept) == Counter((i, t) for i, t in docs if t and i not in (302, 303, 304))

    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in kept], SCHEMA)
    clean = [(r.doc_id, r.text) for r in toxic(spark, frame, sf).collect()]
    assert Counter(clean) == Counter((i, t) for i, t in kept if "scumbag" not in t)

    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean], SCHEMA)
    left = [(r.doc_id, r.text) for r in near(spark, frame, sf).collect()]
    different = sorted({*clean}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    sets, root = [shingles(t, 5) for _, t in different], list(range(len(different)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(different)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for k, row in enumerate(different):
        groups.setdefault(find(k), []).append(row)
    assert len(left) == len(groups) < len(different)
    for members in groups.values():  # one of each group, with the least id where there is one
        stays = [row for row in left if row in members]
        assert len(stays) == 1 and (stays[0][0] is None) == all(i is None for i, _ in members)
        assert stays[0][0] is None or stays[0][0] == min(i for i, _ in members if i is not None)

    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], SCHEMA)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [tok.encode(t, add_special_tokens=False).ids + [0] for _, t in left]
    pieces = pack(spark, frame, sf).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    by = {i: x for (i, _), x in zip(left, ids, strict=True) if i is not None}
    for p in pieces:
        if p.doc_id is not None:
            assert zlib.crc32(np.array(by[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert sum(p.length for p in corpus_pipeline.run(spark, sf).collect()) == sum(map(len, ids))


def test_nothing(spark, tmp_path):
    for name, docs, labels in (("none", [], []), ("rejected", [(1, "x"), (2, None)], [(1, 1, 1)]), ("unlabelled", [(1, "one two three four five six seven eight nine ten eleven")], [])):
        sf = written(spark, tmp_path / name, docs, labels)
        assert corpus_pipeline.run(spark, sf).isEmpty() == (name != "unlabelled")
