import random

from quotelens.llm import decontam

ITEM = "The train from Paris travels 300 km in 5 hours and Mary wants to know how fast the train from Paris goes."


def leaks(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as key", "2 as windows")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as at")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(d, b, **how).collect()}


def test_reparameterised_and_inconsistent_questions(spark):
    same = ITEM.replace("Paris", "Berlin").replace("300", "450").replace("Mary", "Anna").replace(" 5 ", " 9 ")
    odd = same.replace("train from Berlin goes", "train from Rome goes")
    docs = [(1, "Question: " + ITEM), (2, "So here. " + same + " Thanks."), (3, odd), (4, "The train was late again and Mary was not amused at all."),
            (5, "yes: 12 + 30 = 42"), (6, None), (7, ""), (None, ITEM), (1, "Question: " + ITEM)]
    got = leaks(spark, docs, [(1, ITEM), (2, "12 + 30 = 42"), (3, None), (4, ""), (5, "it")])
    assert set(got) == {(1, 1), (2, 1), (5, 2), (None, 1)}
    assert not got[1, 1]["changed"] and got[2, 1]["changed"] and got[1, 1]["coverage"] > 0.9


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more apples. Tom then eats 2 apples. How many apples does Tom have left?"
    same = item.replace("Tom", "Ann").replace("5", "9").replace("3", "4").replace(" 2 ", " 6 ")
    got = leaks(spark, [(1, same), (2, "Thanks. " + item), (3, "Ann then eats her apples. How many are left?")], [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1]["changed"] and not got[2, 1]["changed"]


def test_equals_plain_windows_on_random_text(spark):
    r = random.Random(10)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(15, 60)))) for i in range(40)]
    docs, want = [], set()
    for i in range(300):
        w = r.choices(vocabulary, k=r.randint(30, 200))
        if i % 5 == 0:
            item = r.choice(items)
            p = item[1].split()
            if i % 10 == 0:
                p[r.randrange(len(p))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = p
            want.add((i, item[0]))
        elif i % 5 == 1:
            w[3:3] = r.choice(items)[1].split()[:6]  # less than half of an item
        docs.append((i, " ".join(w)))
    assert set(leaks(spark, docs, items)) == want


def test_rows_are_dropped_whole(spark, small, empty):
    items = spark.createDataFrame([(1, "Hello there, this is a plain text of some words")], "item_id long, text string")
    kept = decontam.decontaminate(small, items)
    assert kept.columns == small.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert decontam.decontaminate(small, items.limit(0)).count() == 9
    assert decontam.find_leaks(empty, items).count() == 0
