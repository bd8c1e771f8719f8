from __future__ import annotations

from orbitree.llm.decontaminate import contaminated


def _leaks(spark, docs, items):
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.kind for r in rows}


def test_short_runs_are_found_wherever_they_lie(spark):
    words = "alpha bravo carbon delta echo foxtrot golf hotel india juliet kilo lima mango november oscar papa quebec romeo sierra tango".split()
    docs = [(i, " ".join([f"f{'x' * j}" for j in range(1, 20 + i)] + words[:7] + ["other", "things"] + words[12:18] + ["end"])) for i in range(7)]
    assert _leaks(spark, docs, [(1, " ".join(words))]) == {(i, 1): "verbatim" for i in range(7)}


def test_names_at_the_start_of_sentences(spark):
    def told(name, n):
        return f"{name} buys {n} pens today. {name} pays with one note. {name} gets little money back. {name} walks home very fast."

    docs = [(1, "some words before. " + told("Maria", 7)), (2, "some words before: " + told("Anna", 3).lower()), (3, "Nothing of the kind. Maria reads a book and Peter sleeps.")]
    assert _leaks(spark, docs, [(1, told("Anna", 3))]) == {(1, 1): "reparameterised", (2, 1): "verbatim"}


def test_numbers_part_from_units(spark):
    from orbitree.llm.decontaminate import contaminated

    item = "A train travels 120 km in 2 hours at a steady pace so what is the average speed of the train over the whole way"
    docs = [(1, f"before {item} after"), (2, item.replace("120 km in 2 hours", "300km in 4h")), (3, item.replace("120 km", "120Km")), (4, "a text about one train and 200km of other words that have nothing to do with any of the items at all")]
    found = {r.doc_id: r.kind for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert found == {1: "verbatim", 2: "reparameterised", 3: "verbatim"}
