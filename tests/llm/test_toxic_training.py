"""Training texts that begin alike are not copies."""

import random

from quarry.llm import toxicity


def test_texts_with_one_header_all_train(spark, monkeypatch):
    r = random.Random(12)
    letters = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    rows = []
    for i in range(300):
        w = r.choices(letters, k=60)
        for _ in range(4 if i % 4 == 0 else 0):
            w.insert(r.randrange(60), r.choice(["nastia", "nastio", "vilebo"]))
        rows.append((i, "the same long header line opens every document of this hot source " + " ".join(w)))
    rows += [(400 + i, rows[1][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i == 404)) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda train, s: seen.extend((x.text, x.y) for x in train.collect()))
    toxicity.learned(docs, labels, toxicity.Settings(), 1, 7, "doc_id", "text")
    assert len(seen) == len(set(seen)) == len({(t, int(i % 4 == 0 or i == 404)) for i, t in rows})
