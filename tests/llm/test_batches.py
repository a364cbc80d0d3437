"""Pure parts of the operators: coders, planners, encoders, hashes."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilgrain.llm import fingerprints, minhash, packing, quality, rangecoder, tokens


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 1 << 16, n).astype(np.uint32) for n in (0, 1, 2, 100, 2048)]
    blocks += [np.zeros(2048, np.uint32), np.full(7, 65535, np.uint32), np.tile(np.arange(9, dtype=np.uint32), 50)]
    blocks += [rng.zipf(1.3, 300).clip(0, 50256).astype(np.uint32) for _ in range(5)]
    coded = rangecoder.encode(blocks)
    back = rangecoder.decode(coded, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    # alone, in another order and company, a block reads the same
    assert np.array_equal(rangecoder.decode([coded[4]], [2048])[0], blocks[4])
    assert len(coded[7]) < 200 and len(coded[5]) < 400


def test_crcs_join():
    data = bytes(range(256)) * 9
    parts = [data[:5], data[5:1000], data[1000:1001], data[1001:]]
    assert rangecoder.join_crcs([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_encoder_gives_the_library_ids():
    e = tokens.Encoder(tokens.default_path())
    random.seed(2)
    alphabet = list("ab \n\t.,'1é\u00a0\u200b\x1c\u3000") + ["'s", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", " ", "  a", "a  b", "it's <|endoftext|> so", "word " * 3000]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in e.encode(part)] == want


def test_encoder_within_bounds(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    e = tokens.Encoder(tokens.default_path())
    for i in range(40):
        t = " ".join(f"w{i}x{j % 7} the of" for j in range(20))
        assert e.encode([t])[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.at) < 200


@pytest.mark.parametrize("kind", ["even", "small", "large", "one", "tight"])
def test_plan_holds_every_length_and_wastes_little(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 1024, 20000),
        "small": rng.integers(1, 60, 5000),
        "large": rng.integers(513, 1024, 3000),
        "one": np.array([7]),
        "tight": np.repeat([700, 324, 512], 1000),
    }[kind]
    counts = Counter(lengths.tolist())
    runs = packing.plan(dict(counts), 1024)
    held = Counter()
    for lens, n in runs:
        assert sum(lens) <= 1024 and n > 0
        for x in lens:
            held[x] += n
    assert held == counts
    need = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert sum(n for _, n in runs) <= 1.01 * need + 2
    for length, begin, end, sequence, copies, offset in packing.places(runs):
        assert (end - begin) % copies == 0 and 0 <= offset and sequence >= 0 and offset + copies * length <= 1024


def test_shingles():
    def s(text, n=3):
        return set(minhash.shingles(text, n).tolist())

    assert s(None) == s("") == s(" \t\n") == set()
    assert s("A b c") == s("a  B\nC") and len(s("a b c d")) == 2
    assert len(s("a b")) == len(s("a")) == 1 and s("a b") != s("a")
    assert s("a b c a b c a b c") == s("a b c a b c a b c a b c")
    assert s("É x y") != s("é x y")  # only A-Z have another case
    assert s("a\u00a0b c d") != s("a b c d")  # other white space is part of a word


def test_least_shared_is_exact_for_small_sets():
    assert minhash.least_shared(100, 128, 85) == 85
    assert minhash.least_shared(5000, 128, 85) < 0.85 * 128


def test_fingerprints():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(900))
    other = " ".join("".join(rng.choices("ijklmnop", k=rng.randint(2, 9))) for _ in range(900))
    f = fingerprints.fingerprint
    assert f(None) == f("") and f(text) == f(str(text))
    assert fingerprints.likeness(f(text), f(text)) == 1
    assert fingerprints.likeness(f(text), f(fingerprints.edited(text, other))) > 0.4
    assert fingerprints.likeness(f(text), f(other)) < 0.1
    assert fingerprints.likeness(f(text), f(text[:3000] + "xyz" + text[3000:])) > 0.85
    assert fingerprints.likeness(f("a" * 5000), f("")) == 0
    # chunk hashes don't depend on where a chunk lies
    assert fingerprints.common_subsequence("ACGTAC", "GTTAC") == 4


def test_quality_parts():
    clean = "The quick brown fox jumps over the lazy dog, and then it sleeps. " * 4
    junk = "the*** quick%%% brown$$$ fox&&& jumps### over*** " * 5
    assert quality.pattern(quality.look(clean)[0]) != quality.pattern(quality.look(junk)[0])
    assert quality.look(None)[0] == quality.look("")[0] == {}
    patterns = np.array([quality.pattern(quality.look(t)[0]) for t in (clean, junk, "")])
    model = quality.fit_labellers(patterns, np.array([900, 100, 5]))
    assert model["posterior_bad"][0] < 0.1 and model["posterior_bad"][1] > 0.9 and model["posterior_bad"][2] < 0.5
    weights = quality.fit_scorer([quality.look(t)[1].tolist() for t in (clean, junk)] * 5, np.array([0.0, 1.0] * 5))
    assert quality.score_of(quality.look(clean)[1], weights) < 0.5 < quality.score_of(quality.look(junk)[1], weights)


def test_labeller_estimates_like_a_plain_repetition():
    # EM over single documents, written out, against the estimate from pattern counts
    rng = np.random.default_rng(3)
    many = rng.integers(0, 3, (400, len(quality.LABELLERS)))
    many[rng.random((400, len(quality.LABELLERS))) < 0.6] = quality.NONE
    codes = [int("".join(map(str, row)), 3) for row in many.tolist()]
    p = [0.9 if quality.BAD in row else 0.02 for row in many.tolist()]
    for _ in range(100):
        weight = [[1 - b for b in p], p]
        prior = [(sum(w) + 1) / (len(p) + 2) for w in weight]
        chance = []
        for w in weight:
            rows = []
            for j in range(many.shape[1]):
                seen = [1 + sum(x for x, row in zip(w, many.tolist()) if row[j] == v) for v in (quality.NONE, quality.BAD, quality.GOOD)]
                rows.append([x / sum(seen) for x in seen])
            chance.append(rows)
        for j in range(many.shape[1]):
            chance[1][j][1] = max(chance[1][j][1], chance[0][j][1])
            chance[0][j][2] = max(chance[0][j][2], chance[1][j][2])
        new = []
        for row in many.tolist():
            score = [np.log(prior[c]) for c in (0, 1)]
            for j, v in enumerate(row):
                for c in (0, 1):
                    score[c] += np.log(chance[c][j][v == quality.GOOD and 2 or 1]) if v != quality.NONE else 0.0
            new.append(1 / (1 + np.exp(min(50, max(-50, score[0] - score[1])))))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        p = new
        if done:
            break
    kinds, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    model = quality.fit_labellers(kinds, counts)
    assert np.allclose(model["posterior_bad"][which], p, atol=1e-4)


def test_without_a_bad_vote_nothing_is_bad():
    kinds = np.array([0, quality.GOOD])
    model = quality.fit_labellers(kinds, np.array([6, 3]))
    assert (model["posterior_bad"] < 0.05).all()
