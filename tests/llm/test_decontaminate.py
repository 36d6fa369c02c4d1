from itertools import combinations

from feedback_signals.llm import decontaminate

from . import fixtures


def _survives(masks, size, changed):
    return any(
        all(bit == "0" or at + i not in changed for i, bit in enumerate(mask))
        for mask in masks for at in range(size - len(mask) + 1)
    )


def test_every_permitted_substitution_leaves_a_seed():
    for window, ratio in ((13, 0.8), (13, 0.9), (8, 0.8), (20, 0.8), (13, 0.5)):
        plan = decontaminate._plan(window, list(range(1, window)), ratio)
        assert sorted(plan) == list(range(1, window + 1))
        for size, masks in plan.items():
            permitted = decontaminate.permitted_changes(size, ratio)
            assert len({len(mask) for mask in masks}) == 1
            assert all(_survives(masks, size, set(c)) for c in combinations(range(size), permitted)), (window, size)


def test_short_items_and_lone_windows_are_found_with_any_permitted_substitution(spark):
    items = {n: fixtures.words(n, 600 + n).split() for n in (5, 8, 10, 12)}
    items[30] = fixtures.words(30, 640).split()
    texts, wanted = [None, "", fixtures.words(30, 700), "x"], set()
    for n, item in items.items():
        part = item[9:22] if n == 30 else item
        permitted = 1 if n < 10 else 2
        for changed in list(combinations(range(len(part)), permitted)) + list(combinations(range(len(part)), permitted + 1))[::9]:
            if len(changed) == permitted:
                wanted.add((len(texts), n))
            words = [f"other{i}" if i in changed else w for i, w in enumerate(part)]
            texts.append(" ".join(["before", "it", *words, "after", "it"]))
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    found = decontaminate.contaminated(fixtures.table(spark, texts), benchmark)
    assert {(r[0], r[1]) for r in found.select("doc_id", "item_id").collect()} == wanted
