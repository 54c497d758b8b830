import math
import random
import re
from itertools import combinations

import numpy as np
import pytest

from tupelo.llm import decontaminate as d


def test_masks_hit_every_overlap():
    for size in range(8, 21):
        for lost in combinations(range(size), size - math.ceil(0.8 * size)):
            assert any(not {s + k for k in m} & set(lost) for m in d.MASKS for s in range(size - m[-1]))


def slow_tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    out = {}
    for i, text in docs:
        own = slow_tokens(text)
        for j, item in set(items):
            it = slow_tokens(item)
            if len(it) < 8:
                continue
            n = min(20, len(it))
            best = max((sum(a == b for a, b in zip(own[p : p + n], it[q : q + n])) for p in range(len(own) - n + 1) for q in range(len(it) - n + 1)), default=0)
            if best >= math.ceil(0.8 * n):
                out[(i, j)] = (best, n)
    return out


def cases():
    r = random.Random(5)
    word = lambda: r.choice("the of and to ünd Da it".split()) if r.random() < 0.4 else "w%d" % r.randrange(400)
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([8, 9, 13, 14, 20, 21, 40, 59, 3, 7])]
    items += [(20, None), (21, ""), (22, "the the the the the the the the the"), (None, " ".join(word() for _ in range(12))), (0, items[0][1])]
    docs = []
    for i in range(160):
        own = [word() for _ in range(r.randrange(0, 60))]
        if i % 2:
            j = r.choice([x for x in items if x[1]])
            part = slow_tokens(j[1])
            for _ in range(r.randrange(0, 2 + len(part) // 4)):
                part[r.randrange(len(part))] = "sub"
            own[5:5] = part
        docs.append((i, r.choice([" ", ", ", "\n"]).join(own)))
    docs += [(900, None), (901, ""), (902, "THE! " * 5000), (None, items[5][1]), (1, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_overlaps_match_brute_force(spark, block):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as matched", "2 as item_id").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in d.overlaps(left, right, block_bytes=block).collect()}
    want = slow(docs, items)
    assert got == want
    assert len(want) > 40
    kept = d.clean(left, right, block_bytes=block)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the documents are read once
    assert kept.columns == left.columns
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.overlaps(left.limit(0), right).count() == 0
    assert d.overlaps(left, right.limit(0)).count() == 0
    assert d.clean(left, right.limit(0)).count() == len(docs)


def test_common_seeds_stay_bounded():
    import pyarrow as pa

    from tupelo.llm.textvec import pieces

    items = pa.table({"item_id": list(range(50)), "text": ["the same words again and again " * 20] * 50})
    found = d.index(items, 20, 0.8, 8)
    t = next(pieces(pa.array(["the same words again and again " * 30])))[2]
    text, item, matched, *_ = found.leaks(*d.tokens(t))
    assert len(np.unique(item)) == 50 and (matched == 20).all()


def test_case_and_marks_beyond_ascii(spark):
    words = "canción übel niño été straße ÀÉÎ λόγος мир naïve cœur œuvre señor größe þing ǆep fin año mañana où déjà".split()
    items = [(1, " ".join(words)), (2, " ".join(reversed(words)).upper()), (3, "«" + "»\u00a0“".join(w + "…" for w in words[5:17]) + "”")]
    docs = [(1, "Before " + items[0][1].upper() + " after"), (2, items[1][1].lower()), (3, "x " + " ".join(words[5:17]) + " y"), (4, "¿" + "”\u2003«".join(words) + "?"), (5, " ".join(sorted(words)))]

    def cut(text):
        return re.findall(r"[^\W_]+", text.casefold())

    def best(a, b, n):
        return max((sum(x == y for x, y in zip(a[p : p + n], b[q : q + n])) for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)), default=0)

    want = {(i, j): best(cut(a), cut(b), min(20, len(cut(b)))) for i, a in docs for j, b in items}
    want = {k: v for k, v in want.items() if v >= math.ceil(0.8 * min(20, len(cut(dict(items)[k[1]]))))}
    assert {(1, 1), (2, 2), (3, 3), (4, 1)} <= set(want)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.matched for r in d.overlaps(left, right).collect()} == want


def test_characters_of_any_length_and_broken_bytes():
    import pyarrow as pa

    from tupelo.llm.textvec import pieces

    raw = [b"\xc3", b"\xa9a b", "ÉＡ\u00adb 😀 𐐀 z".encode(), b"", b"\xff\xff"]
    t = next(pieces(pa.array(raw, pa.binary())))[2]
    hashes, before = d.tokens(t)
    one = lambda x: d.tokens(next(pieces(pa.array([x])))[2])[0].tolist()
    assert len(before) == 6 and before[-1] == len(hashes)
    assert hashes[before[2] : before[3]].tolist() == one("é\uff41b 𐐨 Z")


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Forty-two is it"), (2, "yes"), (3, "日本語の文章には単語の間に空白がありません。これは例です"), (4, "東京都"), (5, "one two three four five six seven"), (6, "!?"), (7, "Yes.")]
    docs = [(1, "so FORTY two, is it. No"), (2, "forty two is that it"), (3, "前置き" + items[2][1].replace("例", "文") + "後書き"), (4, "私は東京都に住む yesterday"), (5, "one two three four five six seven"), (6, "one two three four six seven five"), (7, "yes " * 40000), (8, "forty two"), (9, "is it")]
    want = {(1, 1): (4, 4), (3, 3): (20, 20), (4, 4): (3, 3), (5, 5): (7, 7), (7, 2): (1, 1), (7, 7): (1, 1)}
    left, right = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in d.overlaps(left, right, short=True).collect()}
    assert got == want
    assert sorted(r.doc_id for r in d.clean(left, right, short=True).collect()) == [2, 6, 8, 9]
    assert {(r.doc_id, r.item_id) for r in d.overlaps(left, right).collect()} == {(3, 3)}
