import random

import numpy as np

from tessera.llm import stuffing as P

PROSE = ["The board must keep the records of each client for seven years.", "Any firm that acts for a client shall review the limits at least once in every year.", "If the trustee has not replied, the bank may close the account of the client."]
HAN = ["認可機構須在批准前保存紀錄，並於三十日內向監管當局匯報。", "董事局應當覆核有關的政策，以確保內部監控行之有效。"]


def prose(rng, n):
    return "\n".join(" ".join(rng.choices(PROSE, k=3)) if rng.random() < 0.7 else "".join(rng.choices(HAN, k=3)) for _ in range(n))


def stuffed(rng, n):
    words = rng.sample(["margin", "quota", "ledger", "charge", "tranche", "repo", "buffer", "curve"], 4)
    kind = rng.randrange(6)
    if kind == 0:
        return " ".join(rng.choices([*words, "cheap", "now"], k=n))
    if kind == 1:
        return "\n".join(f"{rng.choice(words)} » m{rng.randrange(99)}.example" for _ in range(n // 3))
    if kind == 2:
        return " ".join("#" + a + b for a, b in zip(rng.choices(words, k=n), rng.choices(words, k=n), strict=True))
    if kind == 3:
        return "\n".join(f"{rng.choice(words)} {rng.choice(['near', 'in', 'at'])} Norvale" for _ in range(n // 3))
    if kind == 4:
        return " | ".join(f"{a}-{b}-20{rng.randrange(20, 40)} SKU{rng.randrange(1000, 9999)} new" for a, b in zip(rng.choices(words, k=n // 3), rng.choices(words, k=n // 3), strict=True))
    return "。".join("".join(rng.choices(["基準抵押", "名義結算", "細分資本", "加權外判"], k=2)) for _ in range(n // 2))


OTHER = [
    "Contents\n" + "\n".join(f"{i}.1 Client Assets .......... {i * 7}" for i in range(1, 20)), "Schedule of fees\n" + "\n".join(f"{i}. custody ledger\tUSD {i}.5bn" for i in range(1, 20)),
    "References\n" + "\n".join(f"[{i}] Quisk, A. (2030). Notes on the duty to review the limits of a client. m{i}.example" for i in range(1, 12)), "\n".join(PROSE * 20), "\n".join(f"The text of the rule is kept at https://m{i}.example/r/{i}." for i in range(20)),
    "\n".join(f"({chr(97 + i)}) the review of the client limits;" for i in range(20)),
]


def corpus():
    rng = random.Random(9)
    rows, truth = [], set()
    for i in range(700):
        if i % 7 == 0:
            rows.append((i, "s1", stuffed(rng, 80)))
            truth.add(i)
        else:
            rows.append((i, None if i % 11 == 0 else f"s{i % 5}", prose(rng, 8)))
    for k, text in enumerate(OTHER):
        rows.append((1000 + k, "s2", text))
    for k in range(20):
        rows.append((2000 + k, "s3", prose(rng, 3) + "\n" + stuffed(rng, 240)))
        truth.add(2000 + k)
        rows.append((3000 + k, "s3", prose(rng, 12) + "\n" + stuffed(rng, 12)))
    rows += [(4000, "s1", None), (4001, "s1", ""), (4002, None, " \n "), (4003, "s1", rows[0][2])]
    truth.add(4003)
    return rows, truth


def test_pages(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("score", P.F.lit("clash"))
    got = {r.doc_id for r in P.scores(df).where("score > 0.5").collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 3
    assert not got & {1000 + k for k in range(len(OTHER))} and not got & {4000, 4001, 4002}


UNSEEN = ["rebate", "voucher", "outlet", "stake", "jackpot", "casino", "loans", "visa"]


def unseen(rng, kind, n):
    """Pages in forms that no page of the corpus above has: other tags, domains, markup and scripts."""
    w = lambda: rng.choice(UNSEEN)
    if kind == 0:
        return " ".join(f"tag:{w()}_{w()}" for _ in range(n))
    if kind == 1:
        return "\n".join(f'<a href="http://{w()}{rng.randrange(99)}.shop/{w()}">{w()} {w()}</a>' for _ in range(n // 3))
    if kind == 2:
        return "\n".join(f"* [{w()}](https://{w()}-{w()}.xyz/{rng.randrange(9999)})" for _ in range(n // 3))
    if kind == 3:
        return " / ".join(f"{w()}{rng.randrange(100)} {w()}" for _ in range(n))
    if kind == 4:
        return "｜".join(rng.choice(["優惠券", "娛樂城", "貸款", "折扣", "禮券"]) + rng.choice(["免費", "線上", "特價"]) for _ in range(n))
    return " ".join(rng.choice(["ऋण", "छूट", "वीज़ा", "कैसीनो", "सस्ता"]) for _ in range(2 * n))


def test_unseen_forms(spark):
    """Forms that nothing in the operator states are found, since the trees learn them from the corpus itself; no single feature parts the pages."""
    rng = random.Random(3)
    rows = [(k, "new", unseen(rng, k % 6, 120)) for k in range(120)] + [(1000 + k, "new", prose(rng, 9) + "\n" + (unseen(rng, k % 6, 6) if k % 2 else "")) for k in range(600)]
    rows += [(5000 + k, "old", text) for k, text in enumerate(OTHER)]
    pages = P.cut_lineage(P.page_blocks(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    learnt = P.fit(pages)
    assert learnt.out_of_bag > 0.97
    found = {r[0] for r in P.predicted(pages, learnt).where("page_score > 0.5").collect()}
    right = {k for k in found if k < 1000}
    assert len(right) >= 0.95 * 120 and len(right) >= 0.95 * len(found)
    held = pages.orderBy("doc_id").select("doc_id", "x").collect()
    x, y = np.array([r[1][: len(P.FEATURES)] for r in held]), np.array([r[0] < 1000 for r in held])
    for j in range(x.shape[1]):
        best = max(max(((x[:, j] > v) == y).mean(), ((x[:, j] <= v) == y).mean()) for v in np.unique(x[:, j]))
        assert best < 1.0, P.FEATURES[j]


def test_source_rate_decides(spark):
    rows = [(i, "spam", 0.95) for i in range(300)] + [(1000 + i, "good", 0.03) for i in range(5000)] + [(9000, "spam", 0.4), (9001, "good", 0.4), (9002, None, 0.4), (9003, "good", 0.55)]
    got = {r.doc_id: r.score for r in P.smoothed(spark.createDataFrame(rows, "doc_id long, source string, page_score double")).collect()}
    assert len(got) == len(rows) and got[9000] > 0.5 > got[9001] and got[9001] < 0.4 and abs(got[9002] - 0.4) < 0.01 and 0.5 < got[0]
    assert got[9003] < 0.55


def test_no_labels_of_one_kind(spark):
    df = spark.createDataFrame([(1, "a", PROSE[0]), (2, None, PROSE[1]), (3, "a", None)], "doc_id long, source string, text string")
    assert P.scores(df).where("score > 0.5").count() == 0
    assert P.scores(df.limit(0)).count() == 0


def test_only_pages_without_text(spark):
    """With weak labels of one kind there is nothing to learn from, and no page is found."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "a", stuffed(rng, 90)) for i in range(6)], "doc_id long, source string, text string")
    assert P.scores(df).where("score > 0.5").count() == 0 and P.scores(df).count() == 6


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(int)
    held = rng.random((300, 4))
    assert ((P.Trees(x, y).predict(held) > 0.5) == ((held[:, 0] > 0.5) ^ (held[:, 2] > 0.7))).mean() > 0.9


def test_very_long_text():
    for text in ("word " * 200000, "x" * 500000, "a\n" * 100000):
        blocks = P.blocks_of(text)
        assert sum(len(b.replace("\n", "")) for b in blocks) == len(text.replace("\n", "")) and max(map(len, blocks)) < 2000
        assert np.isfinite(P.features(blocks)).all() and P.features(blocks).shape == (len(blocks), len(P.FEATURES))
