import random
import zlib

from pyspark.sql import functions as F

from feedback_signals.llm import toxicity

from . import fixtures


def _best(scores):
    """All maximal segments, by their definition: recursively the best segment first."""
    def best(low, high):
        top = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-12):
                    top = (i, j, total)
        if not top:
            return []
        return best(low, top[0]) + [top] + best(top[1] + 1, high)

    return best(0, len(scores))


def test_segments_equal_the_definition():
    draw = random.Random(1)
    for _ in range(300):
        dense = [draw.choice([0, 0, 0, draw.uniform(0.3, 4), draw.uniform(-3, 0)]) for _ in range(draw.randrange(1, 25))]
        found = toxicity.segments([(i, s) for i, s in enumerate(dense) if s], 0.25)
        wanted = _best([s - 0.25 for s in dense])
        assert sorted(round(s, 6) for _, _, s in found) == sorted(round(s, 6) for _, _, s in wanted)


def _labelled(spark):
    texts, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        body = fixtures.words(40, i, 300).split()
        if toxic:
            body[5] = f"grumbl{'abcdefgh'[i % 8]}"
            body[20] = "vexing"
        texts.append(" ".join(body))
        labels.append((i, int(toxic)))
    return fixtures.table(spark, [*texts, None, "", "plain " * 20_000]), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")


def test_held_out_documents_are_found(spark):
    docs, labels = _labelled(spark)
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    assert all(r["predicted"] == int(r["doc_id"] % 9 == 0) for r in held)
    assert all(r["passages"] for r in held if r["predicted"])
    odd = {r["doc_id"]: r for r in found if r["doc_id"] >= 900}
    assert odd[900]["score"] == odd[901]["score"] < 0.1 and odd[902]["predicted"] == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels = _labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (fixtures.collected(toxicity.toxicity(docs, x), "doc_id", "score") for x in (labels, turned))
    assert one == two


def test_no_labels_and_no_documents(spark):
    docs, labels = _labelled(spark)
    scores = {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert len(scores) == 1
    assert toxicity.toxicity(fixtures.empty(spark), labels).count() == 0
