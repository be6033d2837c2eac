import re

import pytest

from conftest import SF
from shoptrail.llm import decontam

ITEM = "A farmer named Miller sold 12 apples for 3 dollars each to Jones and bought 40 kg of corn for his horse in the spring"
FILL = "zap zip zop zup zep " * 30


def pairs(spark, docs, items):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, matched int")
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, i).collect()}


def exchanged(**by):
    return re.sub(r"Miller|Jones|\b12\b|\b3\b|\b40\b|kg", lambda m: by.get(m[0], by.get("n" + m[0], m[0])), ITEM)


DOCS = [(1, FILL + "\n" + ITEM + ". " + FILL), (2, FILL), (3, FILL + ". " + exchanged(Miller="Smith", Jones="Brown", n12="17", n3="5", n40="90") + "."),
        (4, ITEM.replace("Miller", "Jones", 1).replace("12", "3").replace(" 40", " 41")), (5, None), (6, ""), (7, ITEM.upper()), (None, ITEM), (1, "another text"),
        (8, exchanged(kg="lb") + "."), (9, " ".join(ITEM.split()[:11]) + " " + FILL)]


@pytest.mark.parametrize("limit", (decontam.FILTER, 3))
def test_templates(spark, monkeypatch, limit):
    """The result does not depend on whether the benchmark fits the filter."""
    monkeypatch.setattr(decontam, "FILTER", limit)
    got = pairs(spark, DOCS, [(10, ITEM), (11, "unrelated words that no document holds at all here"), (12, None), (13, "")])
    assert set(got) == {(1, 10), (3, 10), (None, 10), (7, 10), (8, 10)}
    assert got[1, 10].literal and not got[3, 10].literal and not got[8, 10].literal
    assert got[None, 10].coverage == 1.0 and got[1, 10].n_windows == got[3, 10].n_windows


def test_inconsistent_slots_are_no_copy(spark):
    item = "if 5 cats eat 7 fish in 5 days then how many fish do 5 cats and 7 dogs eat in 9 days"
    ok = item.replace("5", "50").replace("7", "8").replace("9", "10")
    wrong = "if 1 cats eat 2 fish in 3 days then how many fish do 4 cats and 5 dogs eat in 6 days"
    merged = item.replace("7", "5")
    assert set(pairs(spark, [(1, ok), (2, wrong), (3, merged), (4, item)], [(1, item)])) == {(1, 1), (4, 1)}


def test_short_items_and_repeats(spark):
    got = pairs(spark, [(1, "what is the capital of it"), (1, "what is the capital of it"), (2, "the capital"), (3, "1 2 3 4 5 6 7 8 9 10")],
                [(5, "what is the capital"), (5, "what is the capital"), (6, "1 2 3 4 5 6 7 8 9 10"), (7, "Capital")])
    assert set(got) == {(1, 5), (1, 7), (2, 7), (3, 6)}  # items of one word are their own window; figures match as they stand
    assert got[1, 5].n_windows == 1


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, ITEM)]) == {} and pairs(spark, [(1, ITEM)], []) == {}


def plain_tokens(text):
    """Words only: the given tables hold no figures in their benchmark."""
    out, begins = [], True
    for t in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]", text):
        if t in ".!?\n":
            begins = True
            continue
        title = t[0].isupper() and (len(t) == 1 or t[1:].islower())
        out.append(("#", t) if t[0].isdigit() else ("@", t) if title and not begins else (t.lower() if t.islower() or t.isupper() or title else t, None))
        begins = False
    return out


def test_query_equals_brute_force(spark, rows):
    def windows(text):
        t = plain_tokens(text or "")
        n = min(8, len(t))
        return {i: (tuple(x[0] for x in t[i:i + n]), tuple(x for x in t[i:i + n] if x[1])) for i in range(len(t) - n + 1) if n}
    items = {i: windows(t) for i, t in rows("SELECT item_id, text FROM '@benchmark.parquet'")}
    of = {}
    for i, own in items.items():
        for p, (key, slots) in own.items():
            of.setdefault(key, []).append((i, p, slots))
    want = {}
    for d, t in rows("SELECT doc_id, text FROM '@documents.parquet'"):
        diagonals = {}
        for p, (key, slots) in windows(t).items():
            if 2 * len(slots) <= len(key):
                for i, q, its in of.get(key, []):
                    diagonals.setdefault((i, p - q), []).append((q, list(zip(slots, its))))
        covered, longest = {}, {}
        for (i, _), hits in diagonals.items():
            both = {pair for _, ps in hits for pair in ps}
            if len({a for a, _ in both}) == len({b for _, b in both}) == len(both):
                covered.setdefault(i, set()).update(q for q, _ in hits)
                longest[i] = max(longest.get(i, 0), len(hits))
        for i, qs in covered.items():
            if len(qs) / len(items[i]) >= 0.5 or longest[i] >= 6:
                want[d, i] = len(qs)
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.op1(spark, SF).collect()}
    assert got == want and len(want) > 0


def test_planted_passages_are_found(spark, rows):
    docs = rows("SELECT doc_id, text FROM '@documents.parquet'")
    held = {(d, i) for i, b in rows("SELECT item_id, text FROM '@benchmark.parquet'") for d, t in docs if b in (t or "")}
    got = {(r.doc_id, r.item_id) for r in decontam.op1(spark, SF).collect()}
    assert held and held <= got


def test_a_sentence_may_begin_elsewhere(spark):
    """A copy is found where its first word does not begin a sentence any more, and names that begin one are exchanged too."""
    items = [(1, "What is the capital of France?"), (2, "Tom has 5 apples. Ann has 7 apples. How many apples do they have in total?")]
    docs = [(1, "Question: What is the capital of France?"), (2, "Sam has 5 apples. Eve has 7 apples. How many apples do they have in total?"),
            (3, "Paris is the capital of France."), (4, "Q: Tom has 9 apples. Ann has 3 apples. How many apples do they have in total?")]
    got = pairs(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (4, 2)} and got[1, 1].literal and not got[2, 2].literal


def test_items_of_figures_and_names_are_found_as_literal_copies(spark):
    items = [(1, "Compute 12 + 34 * 56 - 78"), (2, "From Lima to Oslo via Rome 12 km and 15 kg")]
    docs = [(1, "It says: Compute 12 + 34 * 56 - 78 and no more"), (2, "Compute 1 + 2 * 3 - 4"), (3, "x. From Lima to Oslo via Rome 12 km and 15 kg"),
            (4, "From Bonn to Kiel via Hamm 11 km and 16 kg")]
    got = pairs(spark, docs, items)
    assert {(1, 1), (3, 2)} <= set(got) and (2, 1) not in got and got[1, 1].literal


def test_texts_of_one_item_do_not_disturb_each_other(spark):
    text = "if {} cats eat all of the fish then how many fish do {} dogs eat in the end"
    got = pairs(spark, [(1, text.format(3, 5)), (2, text.format(4, 9)), (3, text.format(6, 6))], [(1, text.format(3, 5)), (1, text.format(4, 9))])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].literal and got[1, 1].coverage == 1.0
