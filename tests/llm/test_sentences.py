import random
from collections import Counter

import pytest

from tessera.llm import sentences as S

LATIN = [
    "The board must keep records.", "The trustee shall review them.", "Dr. A.B. Quisk told the board that the fee rose (approx. 4.2 times).", "It fell later.", "The bank opens at 9 a.m. Hong Kong time on each day.",
    "Any firm may act as set out in Art. 3.4 of Circular No. 5.", "The board may decline.", "The board must keep ledgers, keys, etc.", "Dr. Wexlome told the board that it must act.", "The bank closes at 4 p.m.",
]
HAN = ["認可機構必須保存紀錄。", "董事局須覆核。", "通告指出：「機構須保存紀錄。機構須覆核。」", "「機構須保存紀錄。」是董事局的回覆。"]
HINDI = ["न्यासी को रु. 2.5 लाख जांचना चाहिए।", "बैंक को रखना होगा।"]
THAI = ["ธนาคารต้องจัดเก็บรายงาน", "ธนาคารควรทบทวนนโยบาย"]
GERMAN = ["Das Institut muss es bis zum 3. März prüfen.", "Der Prüfer soll melden.", "Das Institut muss es nach Ablauf von ca. 14 Tagen prüfen."]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(("" if group is HAN else " ").join(rng.choices(group, k=rng.randrange(1, 4))),) for group in (LATIN, LATIN, LATIN, HAN, HINDI, THAI, GERMAN) for _ in range(150)]
    rows += [(None,), ("",), (" \n ",)]
    return S.fit(spark.createDataFrame(rows, "text string").repartition(3))


def cut(model, text):
    return [text[a:b] for a, b in model.units(text, {})]


def test_units(model):
    assert cut(model, "Dr. Quisk told the board that the fee rose (approx. 4.2 times). The trustee shall review them.") == ["Dr. Quisk told the board that the fee rose (approx. 4.2 times).", "The trustee shall review them."]
    assert cut(model, "2.1 Scope\n  The board must keep records.The trustee shall review them. \n\n• a list item;") == ["2.1 Scope", "The board must keep records.", "The trustee shall review them.", "• a list item;"]
    assert cut(model, "通告指出：「機構須保存紀錄。機構須覆核。」董事局須覆核。") == ["通告指出：「機構須保存紀錄。機構須覆核。」", "董事局須覆核。"]
    assert cut(model, "「機構須保存紀錄。」是董事局的回覆。認可機構須覆核") == ["「機構須保存紀錄。」是董事局的回覆。", "認可機構須覆核"]
    assert cut(model, "ธนาคารต้องจัดเก็บรายงาน ธนาคารควรทบทวนนโยบาย") == ["ธนาคารต้องจัดเก็บรายงาน", "ธนาคารควรทบทวนนโยบาย"]
    assert cut(model, "Das Institut muss es bis zum 3. März prüfen. Der Prüfer soll melden.") == ["Das Institut muss es bis zum 3. März prüfen.", "Der Prüfer soll melden."]
    assert cut(model, "बैंक को रु. 2.5 लाख रखना होगा। न्यासी को जांचना चाहिए।") == ["बैंक को रु. 2.5 लाख रखना होगा।", "न्यासी को जांचना चाहिए।"]


def test_positions_count_stored_characters(model):
    text = "The board​ must keep re­cords.　The trustee shall ｒeview them."
    assert cut(model, text) == ["The board​ must keep re­cords.", "The trustee shall ｒeview them."]


def test_nothing_to_cut(model):
    for text in (None, "", " \n\t ", "　"):
        assert model.units(text, {}) == []
    assert cut(model, "no end at all") == ["no end at all"]


def test_long_line_and_unmatched_quotes(model):
    text = '"The board must keep records. ' * 500
    units = cut(model, text)
    assert "".join(units).replace(" ", "") == text.replace(" ", "")
    assert cut(model, ")」 .")  # closes without an opening


def test_table(spark, model):
    rows = [("a", "The board must act. The trustee shall act.", None, 1, "x"), ("a", "The board must act. The trustee shall act.", None, 2, "x"), ("b", None, "", 1, None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, retrieval_text string, updated_at int, field string")
    got = S.segment(S.latest(df, "chunk_id", "text", "retrieval_text"), model, "chunk_id", "text", "retrieval_text")
    assert sorted(map(tuple, got.collect())) == [("a", "text", 0, 19), ("a", "text", 20, 42)]
    assert S.segment(df.limit(0), model, "chunk_id", "text").count() == 0
    assert S.fit(df.select("text").limit(0)).units("One line", {}) == [(0, 8)]


def test_rare_words_keep_their_counts(spark, monkeypatch):
    """With tables far too small for all words, the counts of the rare ones stand with their classes and none is lost."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(LATIN, k=2)), None) for _ in range(200)] + [(f"Word{i} ends with term{i}. Then more{i}.", None) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, retrieval_text string")
    whole = S.fit(df)
    monkeypatch.setattr(S, "MOST_ROWS", 40)
    small = S.fit(df)
    assert len(small.of_left) < len(whole.of_left) and small.prior == whole.prior and sum(small.shape_s.values()) == pytest.approx(sum(whole.shape_s.values()), rel=0.05)
    for text in ("Dr. Quisk told the board that the fee rose (approx. 4.2 times). The trustee shall review them.", "It ends with term7. Then more."):
        assert cut(small, text) == cut(whole, text)


def test_units_are_the_same_where_tables_outgrow_the_driver(spark, monkeypatch):
    """No word is put together with others, however many there are: the same odds and the same units."""
    rng = random.Random(4)
    rows = [(f"r{i}", " ".join(rng.choices(group, k=3)), None) for i in range(120) for group in (LATIN, HINDI, GERMAN)]
    # rare short words of which some never end a line, with a capital after them, and some always do
    rows += [(f"a{i}", f"The board saw ab{i}. Quor{i} and left.\nIt kept zz{i}.\nThen it kept zz{i}.", f"N. It saw {i}. N there. The board must keep endword{i}. Then") for i in range(60) for _ in range(4)]
    df = spark.createDataFrame([(f"{k}-{n}", *r) for n, (k, *r) in enumerate(rows)], "id string, text string, retrieval_text string")
    found = {}
    for most in (S.MOST_ROWS, 40):
        monkeypatch.setattr(S, "MOST_ROWS", most)
        monkeypatch.setattr(S, "BLOCK_ROWS", 50, raising=False)
        found[most] = S.fit(df.select("text", "retrieval_text"))
        found[most, "units"] = sorted(map(tuple, S.segment(df, found[most], "id", "text", "retrieval_text").collect()))
    assert found[S.MOST_ROWS, "units"] == found[200_000, "units"]
    contexts = sorted(set().union(*(S.contexts_of(r[1:]) for r in rows)))
    given = spark.createDataFrame([*contexts, ("unseen", "S", "Unseen", "U")], "l string, lc string, r string, rc string")
    odds = {tuple(r)[:4]: r.odds for r in found[S.MOST_ROWS].scored(given).collect()}
    assert len(odds) == len(contexts) + 1
    for (l, lc, r, rc), at in odds.items():
        assert at == pytest.approx(found[200_000].log_odds((l, lc), (r, rc)), rel=1e-9, abs=1e-9)


def test_priors_of_a_class_have_no_step():
    """The share seen outweighs the one set by hand little by little, not from some number of places on."""
    prior = [S.Model([], [], [], [("S", S.END, 10), ("S", "U", n - 10)]).prior["S"] for n in (199, 200, 201, 202, 20000)]
    assert max(abs(b - a) for a, b in zip(prior[:4], prior[1:4], strict=False)) < 0.01 and prior[4] < 0.02


def test_lines_of_both_fields_count_once():
    one, two = Counter(), Counter()
    S.count_contexts(("The board must act. It may wait.",), one)
    S.count_contexts(("The board must act. It may wait.", "Heading\nThe board must act. It may wait."), two)
    assert one == two and sum(one.values())


#: Units made by hand, script by script; "|" stands between units.
BY_HAND = {
    "Latin": ["Dr. Wexlome told the board that it must act.|The trustee shall review them.", "The fee rose (approx. 4.2 times).|It fell later.", "The bank closes at 4 p.m.|The board may decline.", "Any firm may act as set out in Art. 3.4 of Circular No. 5.|It fell later.", "Das Institut muss es bis zum 3. März prüfen.|Der Prüfer soll melden."],
    "Han": ["認可機構必須保存紀錄。|董事局須覆核。", "通告指出：「機構須保存紀錄。機構須覆核。」|董事局須覆核。", "「機構須保存紀錄。」是董事局的回覆。|認可機構必須保存紀錄。", "董事局須覆核。|董事局須覆核。|認可機構必須保存紀錄。"],
    "Devanagari": ["न्यासी को रु. 2.5 लाख जांचना चाहिए।|बैंक को रखना होगा।", "बैंक को रखना होगा।|बैंक को रखना होगा।|न्यासी को जांचना चाहिए।"],
    "Thai": ["ธนาคารต้องจัดเก็บรายงาน|ธนาคารควรทบทวนนโยบาย", "ธนาคารควรทบทวนนโยบาย|ธนาคารต้องจัดเก็บรายงาน|ธนาคารต้องจัดเก็บรายงาน"],
}


@pytest.mark.parametrize("script", BY_HAND)
def test_precision_and_recall_by_script(model, script):
    right = got = want = 0
    for made in BY_HAND[script]:
        units = made.split("|")
        glue = "" if script == "Han" else " "
        found = cut(model, glue.join(units))
        right += (Counter(found) & Counter(units)).total()
        got += len(found)
        want += len(units)
    assert right / got >= 0.9 and right / want >= 0.9
