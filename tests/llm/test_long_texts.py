"""Texts of megabytes: operators read them whole, and what they give is that of their whole text."""

import hashlib
import re

import pytest

from quarry.llm import chat, personal, quality, secrets, simhash, toxicity

WORDS = 300_000
TEXT = " ".join(f"word{k % 9973}" for k in range(WORDS))
KEY = "AKIA" + "Q7" * 8


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def labels(spark, n):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_secrets_at_the_end_of_a_long_text(spark):
    (x,) = secrets.scan_secrets(documents(spark, f"{TEXT} {KEY}")).collect()
    assert x.n_access == 1 and x.spans == f"access:{len(TEXT) + 1}:{len(TEXT) + 1 + len(KEY)}"
    (x,) = secrets.redact_secrets(documents(spark, f"{TEXT} {KEY} end")).collect()
    assert x.text == f"{TEXT} [access] end"


def test_private_data_at_the_end_of_a_long_text(spark):
    (x,) = personal.private_digests(personal.find_private(documents(spark, f"{TEXT} a.b@mail.example"))).collect()
    assert x.spans == f"email:{len(TEXT) + 1}:{len(TEXT) + 17}"


def test_long_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", TEXT), (1, 1, "assistant", f"{TEXT} </s>")], "conv_id long, turn long, role string, text string")
    (x,) = chat.digests(chat.format_trees(chat.linear(rows))).collect()
    assert x.n_turns == 2 and x.loss_chars == len(TEXT) + 5 and x.loss_sha256 == hashlib.sha256(f"{TEXT} </s>".encode()).hexdigest()


@pytest.mark.parametrize("module, score, label", [(toxicity, "score_toxicity", "toxic"), (quality, "score_quality", "quality")])
def test_scores_of_long_texts(spark, module, score, label):
    texts = [f"good calm words {i} here" if i % 3 else f"awful nasty words {i} here" for i in range(200)]
    d = documents(spark, *texts, TEXT, f"{TEXT} {'awful nasty ' * 5000}")
    got = {x.doc_id: x.score for x in getattr(module, score)(d, labels(spark, 200)).collect()}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values())
    if label == "toxic":
        assert got[201] > 0.5 > got[200]


def test_fingerprints_of_long_texts(spark):
    import xxhash

    x, y = simhash.near_groups(documents(spark, TEXT, f"{TEXT}  \n"), words=3, radius=3).orderBy("doc_id").collect()
    w = re.findall(r"[^\x20\x09-\x0D]+", TEXT)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    assert x.fingerprint == y.fingerprint == f"{want:016x}" and x.component_id == y.component_id == 0
