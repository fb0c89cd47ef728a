from itertools import combinations

from tessera.llm import canonical as C
from tessera.llm.lookalike import skeleton

SAME = [
    ("review unit", "ｒｅｖｉｅｗ ｕｎｉｔ"), ("review unit", "rеvіеw unіt"), ("review unit", "re​view u­nit"), ("review unit", "review unit"), ("office", "oﬃce"), ("co-op", "co‑op"),
    ("café", "café"), ("十人", "⼗⼈"), ("資本", "資︀本"), ("理", "理"), ("Über", "Über"), ("12%", "１２％"),
]
OTHER = [("review", "Review"), ("cafe", "café"), ("l0an", "loan"), ("1oan", "loan"), ("a b", "ab"), ("a\nb", "a b"), ("naïve", "naive")]


def table(spark, rows):
    return spark.createDataFrame(rows, "kind string, scope string, id string, text string")


def test_pairs(spark):
    rows = [("chunk", "", f"{i}{s}", t) for i, pair in enumerate(SAME + OTHER) for s, t in zip("ab", (f"case {i} {x}" for x in pair), strict=True)]
    got = {tuple(r) for r in C.pairs_of(C.same_looking(table(spark, rows))).collect()}
    assert got == {(f"{i}a", f"{i}b") for i in range(len(SAME))}


def test_equal_to_brute_force(spark):
    import random

    rng = random.Random(2)
    forms = {"e": ["e", "е", "ｅ"], "o": ["o", "ο", "о"], "a": ["a", "а"], " ": [" ", "　", " "], "é": ["é", "é", "е́"], "-": ["-", "‐"]}
    rows = []
    for i in range(400):
        base = rng.choice(["one eta", "one-eta", "oné eta", "One eta", "oo ee", "é", "e"])
        rows.append(("term", rng.choice(["x", "y"]), f"t{i:03d}", "".join(rng.choice(forms.get(c, [c])) for c in base)))
    want = {tuple(sorted((a[2], b[2]))) for a, b in combinations(rows, 2) if a[1] == b[1] and a[3] != b[3] and skeleton(a[3]) == skeleton(b[3])}
    members = C.same_looking(table(spark, rows))
    got = {tuple(r) for r in C.pairs_of(members).collect()}
    assert got <= want  # copies stand for each other: every id is paired with the first of each other text
    classes = {}
    for k, s, i, t in rows:
        classes.setdefault((s, skeleton(t)), {}).setdefault(t, []).append(i)
    links = {tuple(sorted((i, min(other)))) for v in classes.values() for t, ids in v.items() for u, other in v.items() if t != u for i in ids}
    assert got == links
    canonical = {(r.scope, r.text): r.canonical for r in members.collect()}
    assert all(canonical[s, t] == canonical[s, u] for (s, _), v in classes.items() for t in v for u in v if len(v) > 1)


def test_blank_null_repeated(spark):
    rows = [("chunk", "", "a", None), ("chunk", "", "b", ""), ("chunk", "", "c", "　"), ("chunk", "", "d", " \n"), ("chunk", None, "n", "x y"), ("chunk", "", "e", "x y"), ("chunk", "", "e", "x y"), ("chunk", "", "f", "x y"), ("chunk", "", None, "x y"), ("chunk", "", "g", "z" * 100000 + "​"), ("chunk", "", "h", "z" * 100000)]
    got = {tuple(r) for r in C.pairs_of(C.same_looking(table(spark, rows))).collect()}
    assert got == {("e", "f"), ("g", "h")}
    assert C.same_looking(table(spark, rows).limit(0)).count() == 0
