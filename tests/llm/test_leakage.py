import random

import numpy as np

from tessera.llm import leakage as L

ITEM = "the keen gable repairs some coarse toll beyond its humid sluice while the narrow orchard balances a jagged pulley behind the woven trellis"
ZH = "吊架鮮明照亮的堤道涵洞磨坊絞車與渦輪格柵熔爐拓寬遮篷石礦熱心的贖回的測量遮篷渡輪"


def run(spark, docs, exact=True, items=((1, "en", ITEM), (2, "zh", ZH), (2, "zh", ZH), (3, "en", "too short"), (4, "en", None))):
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", L.F.lit("clash"))
    return sorted(map(tuple, L.leaks(documents, spark.createDataFrame(list(items), "item_id long, lang string, text string"), exact).collect()))


def test_found(spark):
    words = ITEM.split()
    docs = [
        (1, "before " + " ".join(words[3:15]) + " after"), (2, " ".join(words[3:14])), (3, "X " + ", ".join(w.upper() for w in words[:12]).replace(" ", " \n> ")), (4, None), (5, ""),
        (6, "其他，" + "。".join(ZH[4:28]) + "文"), (7, ZH[4:27]), (8, "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in " ".join(words[2:16]))), (9, " ".join(words).replace("e", "е")),
        (10, "filler " * 70000 + " ".join(words[:12])), (11, " ".join(words[:6] + ["x"] + words[6:12])), (1, "before " + " ".join(words[3:15])),
    ]
    assert run(spark, docs) == [(1, 1), (1, 1), (3, 1), (6, 2), (8, 1), (9, 1), (10, 1)]


def test_equal_to_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, "en", " ".join(rng.choices(vocabulary, k=30))) for i in range(8)]
    docs = []
    for d in range(150):
        text = rng.choices(vocabulary, k=20)
        source = items[rng.randrange(8)][2].split()
        a, n = rng.randrange(0, 20), rng.randrange(8, 16)
        docs.append((d, " ".join(text + source[a : a + n] + rng.choices(vocabulary, k=5))))
    runs = {i: {tuple(t.split()[k : k + 12]) for k in range(19)} for i, _, t in items}
    want = sorted({(d, i) for d, t in docs for i in runs for k in range(len(t.split()) - 11) if tuple(t.split()[k : k + 12]) in runs[i]})
    assert run(spark, docs, items=items) == want


def test_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(8)
    items = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)], 40))) for i in range(5)]
    index = L.Index(items, L.WORDS, L.words_of)
    prints = np.concatenate([index.prints ^ (np.uint64(1) << rng.integers(0, 64, len(index.prints)).astype(np.uint64)), rng.integers(0, 2**63, 200).astype(np.uint64)])
    who, window = index.near(prints)
    want = {(i, j) for i in range(len(prints)) for j in range(len(index.prints)) if int(prints[i] ^ index.prints[j]).bit_count() <= L.RADIUS}
    assert set(zip(who.tolist(), window.tolist(), strict=True)) == want


def test_near_windows_by_shingles(spark):
    words = ITEM.split()
    docs = [(1, " ".join(words[:11]) + " other"), (2, " ".join(words[:12])), (3, " ".join(reversed(words)))]
    found = run(spark, docs, exact=False)
    assert (2, 1) in found and (3, 1) not in found


def test_similar_equal_to_brute_force(spark):
    """Every window against every window by shingle similarity; the radius of the fingerprints finds few of those that differ."""
    rng = random.Random(4)
    vocabulary = ["a", "of", "the", "in", "it"] + [f"long{i}word" for i in range(60)]
    signs = [chr(0x4E00 + i) for i in range(200)]
    items = [(i, "en", " ".join(rng.choices(vocabulary, k=20))) for i in range(6)] + [(10 + i, "zh", "".join(rng.choices(signs, k=30)) + ("abc" if i == 0 else "")) for i in range(4)]
    docs = []
    for d in range(120):
        _, lang, text = items[rng.randrange(10)]
        tokens, size = (text.split(), 12) if lang == "en" else (list(text), 24)
        a = rng.randrange(len(tokens) - size + 1)
        part = tokens[a : a + size]
        for _ in range(rng.choice([1, 1, 2])):
            part[rng.choice([0, 0, 1, -1, -2, rng.randrange(size)])] = rng.choice(vocabulary[:8] if lang == "en" else [*signs[:5], "x"])
        docs.append((d, (" " if lang == "en" else "").join(part)))
    want, near = set(), set()
    for size, tokens_of, lang in ((L.WORDS, L.words_of, "en"), (L.CHARACTERS, L.characters_of, "zh")):
        index, vectors = L.Index([(i, L.folded(t)) for i, g, t in items if g == lang], size, tokens_of), L.Vectors()
        for d, text in docs:
            at = vectors.of(tokens_of(L.folded(text)))
            for p, fp in enumerate(L.fingerprints(vectors.signs[at], size)):
                for w in range(len(index.prints)):
                    if index.similarity(vectors.hashes[at[p : p + size]], w) >= L.SIMILARITY:
                        want.add((d, int(index.owners[w])))
                        if int(fp ^ index.prints[w]).bit_count() <= L.RADIUS:
                            near.add((d, int(index.owners[w])))
    assert len(want) > 30 and len(near) < len(want)
    assert set(run(spark, docs, exact=False, items=items)) == want


def test_near_window_with_one_ideograph_less(spark):
    changed = "x" + ZH[1:24]
    assert run(spark, [(1, changed), (2, "xyz" + ZH[3:24])], exact=False) == [(1, 2)]
    assert run(spark, [(1, changed)]) == []


def test_empty_tables(spark):
    assert run(spark, [(1, ITEM)], items=[(4, "en", None)]) == []
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert L.leaks(documents, spark.createDataFrame([(1, "en", ITEM)], "item_id long, lang string, text string")).count() == 0
