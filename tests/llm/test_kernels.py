"""The operators' inner parts against their definitions."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarry.llm import chat, decontaminate, embeddings, quality, simhash, suffix, tokens, toxicity
from quarry.llm.common import union_roots


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(vocabulary):
    library, ours = Tokenizer.from_file(vocabulary), tokens.counter(vocabulary)
    r = random.Random(1)
    letters = [*map(chr, range(0x300)), *map(chr, [0x1680, 0x2003, 0x200B, 0x2028, 0x202F, 0x3000, 0x1C, 0x85, 0xA0, 0x4E00, 0x1F600, 0x661, 0x2160, 0xFEFF]), *[" "] * 60, *"'sabc\n\t" * 5]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) + r.choice(["", "<|endoftext|>", " <|endoftext|> a"]) for _ in range(3000)]
    texts += ["", "a" * 20_000, "ab" * 5000 + " " * 3000, "it's they'll WE'RE"]
    assert [ours.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ours.count(None) == 0


def test_long_texts_are_counted_piece_by_piece(vocabulary, monkeypatch):
    t = "word by word, " * 500
    whole = tokens.counter(vocabulary).count(t)
    monkeypatch.setattr(tokens, "AT_ONCE", 10)
    assert tokens.counter(vocabulary).count(t) == whole


def test_suffix_array():
    r = random.Random(2)
    for _ in range(1500):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 60))] + [0]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchors_depend_on_the_string_only(monkeypatch):
    monkeypatch.setattr(suffix, "AT_ONCE", 97)
    r = random.Random(3)
    for alphabet in ("ab", "abcdefgh"):
        data = "".join(r.choices(alphabet, k=700)).encode()
        seen, held = {}, []
        for _, place, first, last in suffix.anchors(data, 64):
            for p, a, e in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                held += [*range(a, e + 1)]
                for k in range(a, e + 1):
                    assert k <= p <= k + 64 - suffix.ANCHOR
                    assert seen.setdefault(data[k : k + 64], p - k) == p - k
        assert held == list(range(len(data) - 64 + 1))


def test_edit_distance():
    r = random.Random(4)
    for _ in range(500):
        a, t = "".join(r.choices("abc", k=r.randint(1, 12))), "".join(r.choices("abc", k=r.randint(0, 20)))
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(a, 1):
            cur = [i]
            for j, k in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != k)))
            prev = cur
        assert decontaminate.nearest(a, decontaminate.places(a), t) == (min(prev), prev.index(min(prev)))


def test_pieces_cover_and_one_survives():
    for item, e in (("abcdefghij", 2), ("ab", 3), ("abc", 0)):
        p = decontaminate.pieces(item, e)
        assert "".join(x for _, x in p) == item and all(item.startswith(x, o) for o, x in p)


def test_matcher_finds_every_item_within_its_budget():
    r = random.Random(5)
    items = [(i, "".join(r.choices("abcdefghijklmnop ", k=60)).strip()) for i in range(20)]
    m = decontaminate.Matcher(items, 0.1)
    for _ in range(200):
        i, t = r.choice(items)
        x = list(t)
        for _ in range(int(len(t) * 0.1)):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice([[], ["z"], [x[k], "z"]])
        text = "q" * r.randint(0, 9) + "".join(x) + "q" * r.randint(0, 9)
        found = {f[0]: f for f in m.find(text)}
        assert i in found and found[i][1] <= int(len(t) * 0.1)


def test_fingerprint():
    def slow(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    r = random.Random(6)
    for t in ["", " \n", "a", "a B", "A b C", "Ä É x y", *("".join(r.choices("abAB é\t\n\x0b\x1c\x85", k=r.randint(0, 60))) for _ in range(300))]:
        assert simhash.fingerprint(t) == slow(t), t
    assert simhash.fingerprint(None) == 0


def parts(root):
    return {frozenset(np.flatnonzero(root == x).tolist()) for x in set(root.tolist())}


def test_gray_index():
    r = np.random.default_rng(7)
    for _ in range(25):
        n = int(r.integers(1, 500))
        fp = r.integers(0, 1 << 63, 5).astype(np.uint64)[r.integers(0, 5, n)]
        for _ in range(int(r.integers(0, 8))):
            fp = fp ^ np.where(r.random(n) < 0.5, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        g = np.sort(r.integers(0, int(r.integers(1, 40)), n))
        i, j = np.nonzero((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3) & (g[:, None] == g[None, :]))
        assert parts(simhash.connect(g, fp, 3)) == parts(union_roots(n, i, j))
    x = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_segments():
    def best(x, lo, hi):
        top = max(((sum(x[i:j]), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        i = -top[1]
        j = min(j for j in range(i + 1, hi + 1) if sum(x[i:j]) == top[0])
        return best(x, lo, i) + [(i, j, top[0])] + best(x, j, hi)

    r = np.random.default_rng(8)
    for _ in range(200):
        x = r.normal(-0.2, 1, int(r.integers(0, 20)))
        got = toxicity.segments(x)
        want = best(list(x), 0, len(x))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_lowered_keeps_offsets():
    assert len(toxicity.lowered("İstanbul X")) == 10 and toxicity.lowered(None) == ""


def test_chat_round_trip():
    r = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "/", "s", ">", "[", "]", "INST", " ", "\n", "<\\s>", "[\\INST]", "é"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and not re.search(r"</?s>|\[/?(?:INST|ROLE)\]", chat.escape(t))
        turns = [(r.choice(["user", "assistant", "system", "", "x</s>"]), "".join(r.choices(bits, k=r.randint(0, 9)))) for _ in range(r.randint(0, 6))]
        line, loss = chat.render(turns)
        assert chat.parse(line) == turns
        assert [chat.unescape(line[a:b]) for a, b in loss] == [t for who, t in turns if who == "assistant"]


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(10).normal(size=(800, 16))
    made = embeddings.Codes(x, x.mean(axis=0))
    p = made.projection(24)
    assert p.shape == (16, 24) and np.allclose(p[:, :16].T @ p[:, :16], np.eye(16)) and np.allclose(p[:, 16:].T @ p[:, 16:], np.eye(8))
    assert (abs(((x - made.centre) @ p >= 0).mean(axis=0) - 0.5) < 0.1).all()


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(11)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.fit(x[:2000], y[:2000], quality.Settings(rounds=20))
    assert {0, 1} in [{i, j} for i, j, _ in t.pairs]
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert quality.fit(x[:5], np.ones(5), quality.Settings()).score(x[:3]).min() > 0.9
    assert quality.fit(x[:0], y[:0], quality.Settings()).score(x[:1])[0] == 0.5
    assert quality.features(None) == quality.features("  \n") == [0.0] * len(quality.FEATURES)
