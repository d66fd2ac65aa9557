"""Near copies of whole texts against all pairs: kinds of edits, hot families, and families around one text."""

import random

import pytest

from chunkloom.llm import simhash_dedup

from .test_pairs import brute_simhash, frame, shingle_set

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randint(3, 9))) for _ in range(5000)]
WEIGHTS = [1 / (k + 10) for k in range(len(WORDS))]


def prose(rng, n):
    return rng.choices(WORDS, WEIGHTS, k=n)


def edited(rng, words, edits):
    w = list(words)
    for at in rng.sample(range(len(w)), edits):
        w[at] = rng.choice(WORDS)
    return w


def similarity(a, b):
    a, b = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    return len(a & b) / len(a | b)


def brute_groups(texts, least=0.8):
    sets, root = [shingle_set(" ".join(t)) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def found_groups(spark, texts):
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(frame(spark, [" ".join(t) for t in texts])).collect()}
    return [group[i] for i in range(len(texts))]


def partition(groups):
    members = {}
    for i, g in enumerate(groups):
        members.setdefault(g, set()).add(i)
    return sorted(map(sorted, members.values()))


def test_appended_cut_and_edited_copies(spark):
    """Pairs alone in their families, at 0.8 to 0.95."""
    rng, texts, pairs = random.Random(5), [], []
    for least in (0.81, 0.85, 0.9, 0.95):
        for k in range(24):
            n = rng.choice([100, 200, 400, 1000])
            base, kind = prose(rng, n), k % 3
            new = [base + prose(rng, int(n * (1 / least - 1))), base[: int(n * least) + 1], edited(rng, base, max(1, int(n * (1 - least) / 10)))][kind]
            if similarity(base, new) >= 0.8:
                pairs.append((len(texts), len(texts) + 1))
                texts += [base, new]
    assert len(pairs) > 85
    got = found_groups(spark, texts)
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert partition(got) == partition(brute_groups(texts))


def test_family_of_a_third_of_the_rows(spark):
    """How often a family occurs doesn't change how it is found."""
    rng = random.Random(6)
    base = prose(rng, 300)
    family = [base, *[edited(rng, base, 4) for _ in range(60)]]
    texts = [*family, *[prose(rng, rng.randint(50, 400)) for _ in range(2 * len(family))]]
    got = found_groups(spark, texts)
    assert partition(got) == partition(brute_groups(texts)) and len(set(got[: len(family)])) == 1


@pytest.mark.parametrize("rounds", [2, 1, 0])
def test_families_around_texts_that_do_not_lead(spark, monkeypatch, rounds):
    """Members are like a hidden base or like one member of a chain alone; others share bands and are no links."""
    monkeypatch.setattr(simhash_dedup, "LEAD", rounds, raising=False)
    rng = random.Random(7)
    base = prose(rng, 400)
    star = [base, *[edited(rng, base, 6) for _ in range(100)]]
    chain = [prose(rng, 300)]
    for _ in range(40):
        chain.append(edited(rng, chain[-1], 5))
    crowd = prose(rng, 400)  # around a text that is missing, with few links and many pairs that come close
    crowd = [edited(rng, crowd, 5) for _ in range(60)]
    texts = [*star, *chain, *crowd, *[edited(rng, t, 1) for t in crowd[:30]]]
    texts = [texts[i] for i in rng.sample(range(len(texts)), len(texts))]
    assert partition(found_groups(spark, texts)) == partition(brute_groups(texts))


def test_fingerprints_within_two_bits_link_texts(spark, monkeypatch):
    """Without any sketch, texts are grouped by their SimHash and the exact check alone."""
    bands = simhash_dedup.shared_bands
    monkeypatch.setattr(simhash_dedup, "shared_bands", lambda texts: bands(texts.limit(0)))
    rng, texts = random.Random(8), []
    for n in (300, 600, 1200):
        for _ in range(8):
            base = prose(rng, n)
            texts += [base, [w.upper() for w in base], edited(rng, base, 1), [*base, "end"], edited(rng, base, n // 40)]
    refrain = prose(rng, 21)  # fingerprints agree, sets of shingles don't
    texts += [refrain * 30 + prose(rng, 40) for _ in range(2)]
    texts += [[], [" "], ["..."]]  # texts without words: two have fingerprint zero
    texts = [" ".join(t) for t in texts]
    fps, sets = [brute_simhash(t) for t in texts], [shingle_set(t) for t in texts]
    bits = lambda i, j: bin(fps[i] ^ fps[j]).count("1")
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bits(i, j) <= 2]
    pairs = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 30 and set(near) - set(pairs) == {(121, 120)} and (123, 122) in pairs
    assert any(bits(k, k + 4) > 2 for k in range(0, 120, 5))  # for the sketches
    root = list(range(len(texts)))
    for i, j in pairs:
        root = [root[j] if r == root[i] else r for r in root]
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(frame(spark, texts)).collect()}
    assert partition([group[i] for i in range(len(texts))]) == partition(root)
    assert simhash_dedup.one_of_each(frame(spark, texts)).count() == len(set(root))
