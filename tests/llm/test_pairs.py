"""SimHash groups, repeated substrings, edit fingerprints and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkloom.llm import decontaminate, edit_fingerprint, simhash_dedup, substring_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(fps, ids, radius=2):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_simhash_groups_match_brute_force(spark, texts):
    rows = [*texts, (500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (505, "x"), (505, "x"), (None, texts[0][1])]
    found = simhash_dedup.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    fps = [brute_simhash(t) for _, t in rows]
    want = brute_components(fps, [i for i, _ in rows])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found)
    assert got == sorted((-1 if i is None else i, f, c) for (i, _), f, c in zip(rows, fps, want, strict=True))


@pytest.mark.parametrize("most", [256, 3])
def test_links_connect_all_within_two_bits(spark, most):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from chunkloom.llm.components import components

    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash_dedup.links(df, most)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()
    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(fps, signed)
    assert [root.get(f, f) for f in signed] == want


def shingle_set(text, words=5):
    w = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", (text or "").lower()).split()
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_near_copies_are_grouped(spark, texts):
    rng = random.Random(4)
    own = [t for _, t in texts if 400 < len(t) < 4000][:60]
    copies, base = [], []
    for k, t in enumerate(own[:30]):
        for _ in range(3):
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(["other", "words", "here"])
            copies.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
            base.append(k)
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(frame(spark, [*own, *copies])).collect()}
    sets = [shingle_set(t) for t in [*own, *copies]]
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = [(len(own) + i, k) for i, k in enumerate(base) if close(sets[len(own) + i], sets[k])]
    assert len(want) > 60 and np.mean([group[a] == group[b] for a, b in want]) > 0.97
    # whatever shares a group is chained by similar texts
    for g in set(group.values()):
        members = [i for i in group if group[i] == g]
        reached, todo = {members[0]}, [members[0]]
        while todo:
            a = todo.pop()
            new = [b for b in members if b not in reached and close(sets[a], sets[b])]
            reached.update(new)
            todo += new
        assert reached == set(members)


def test_one_of_each_keeps_one_row_of_a_group(spark):
    df = frame(spark, ["a b c d", "a b c d", "A b, c d", "other words are here", None, "", "other words are here", "..."], [4, 3, 3, 9, 1, 2, 9, 5])
    kept = simhash_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 9]
    assert simhash_dedup.one_of_each(df.limit(0)).count() == 0


def brute_removed(bodies, length):
    where = {}
    for d, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    return gone


def brute_passages(bodies, words):
    found, where = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in bodies], {}
    for d, w in enumerate(found):
        for i in range(len(w) - words + 1):
            where.setdefault(tuple(x[2] for x in w[i : i + words]), []).append((d, i))
    spans = [[] for _ in bodies]
    for d, i in sorted(p for places in where.values() if len(places) > 1 for p in places):
        a, b = found[d][i][0], found[d][i + words - 1][1]
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1][1] = b
        else:
            spans[d].append([a, b])
    return spans


@pytest.mark.parametrize(("heavy", "words"), [(5000, 51), (1, 51), (3, 9), (5000, 7)])
def test_repeated_substrings_match_brute_force(spark, texts, heavy, words):
    rng = random.Random(3)
    base = [t for _, t in texts[:60] if len(t) < 6000]
    passage = base[0][:700]
    made = [base[i % len(base)][: rng.randint(0, 300)] + passage[rng.randint(0, 200) :] + base[(i * 7) % len(base)][:200] for i in range(12)]
    bodies = [*base, *made, "ab" * 900, "x" * 1300, "x" * 399, None, "", base[3], passage + passage, "\n".join(passage.split()[:60]), "Head " + "  ".join(passage.split()[5:56]), "so it is " * 40]
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, bodies), 400, words, heavy).collect()}
    raw = [(b or "").encode() for b in bodies]
    assert len(found) == len(raw)
    for i, (b, gone) in enumerate(zip(raw, brute_removed(raw, 400), strict=True)):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        assert (found[i]["n_bytes"], bytes(found[i]["kept"]), len(found[i]["spans"])) == (len(b), kept, runs), i
    assert [[list(s) for s in found[i]["passages"]] for i in range(len(raw))] == brute_passages(raw, words)


def test_repeats_of_rows_that_share_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(120))
    rows = [(1, passage), (1, passage), (1, "Other " + passage[:300]), (None, passage[20:]), (None, "alone"), (2, None)]
    found = substring_dedup.remove_repeats(frame(spark, [t for _, t in rows], [i for i, _ in rows]), 400, 51).collect()
    gone = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"] - len(r["kept"]), len(r["passages"])) for r in found)
    n = len(passage)
    assert gone == [(-1, 0, 0), (-1, n - 20, 1), (1, 0, 1), (1, n, 1), (1, n, 1), (2, 0, 0)]
    assert substring_dedup.remove_repeats(frame(spark, []), 400, 51).count() == 0


def test_words_of_long_texts():
    piece = substring_dedup.PIECE
    for text in (b"ab  c\td " * (piece // 4), b"x" * (2 * piece + 5) + b" y", b" " * (piece + 3) + b"z", b"a " + b"q" * piece, b""):
        starts, ends, hashes = substring_dedup.words_of(text)
        want = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want
        assert len(set(hashes.tolist())) == len({text[a:b] for a, b in want})


def test_repeats_in_a_text_of_several_pieces(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(substring_dedup.PIECE + 5000))
    at = substring_dedup.PIECE - 300
    bodies = [long, "Before#" + long[at : at + 900] + "#after"]
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, bodies), 400, 51).collect()}
    assert [tuple(s) for s in found[0]["spans"]] == [(at, at + 900)] and [tuple(s) for s in found[1]["spans"]] == [(7, 907)]
    assert len(found[0]["passages"]) == len(found[1]["passages"]) == 1


def test_transform_rounds_match_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        length, group, items, off = 40, [], [], []
        for g in range(rng.randint(1, 5)):
            core = bytes(rng.choice(b"abc") for _ in range(70))
            for _ in range(rng.randint(1, 7)):
                a, b = rng.randint(0, 15), rng.randint(60, 70)
                t = bytearray(core[a:b])
                for _ in range(rng.randint(0, 2)):
                    t[rng.randrange(len(t))] = rng.choice(b"abc")
                t[20 - a : 28 - a] = core[20:28]  # the anchor
                group.append(g), items.append(bytes(t)), off.append(20 - a)
        got = substring_dedup.repeated_windows(np.array(group), items, np.array(off), length)
        for i, t in enumerate(items):
            want = []
            for s in range(len(t) - length + 1):
                at = s - off[i]
                if not (at <= 0 and at + length >= 8):
                    continue
                want += [s] if any(j != i and group[j] == group[i] and at + off[j] >= 0 and items[j][at + off[j] : at + off[j] + length] == t[s : s + length] for j in range(len(items))) else []
            assert [s for s in got[i].tolist() if s - off[i] <= 0 and s - off[i] + length >= 8] == want


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def test_edit_fingerprints_of_next_and_edited(spark, texts):
    rows = [*texts, (900, None), (901, ""), (902, "é" * 5000), (None, "last")]
    found = edit_fingerprint.edited_fingerprints(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = {i: (t, n) for i, t, n in brute_next(rows)}
    assert len(found) == len(rows)
    for r in found:
        text, after = want[r["doc_id"]]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, nxt = edit_fingerprint.embed([text])[0], edit_fingerprint.embed([edited])[0], edit_fingerprint.embed([after])[0]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.tobytes().hex(), new.tobytes().hex())
        assert r["near_edited"] == float((own == new).mean()) and r["near_next"] == float((own == nxt).mean())
    far = [r for r in found if r["n_chars"] > 200 and want[r["doc_id"]][0] != want[r["doc_id"]][1]]
    assert np.mean([r["near_edited"] > r["near_next"] for r in far]) > 0.95
    one = edit_fingerprint.edited_fingerprints(frame(spark, ["abcdef"])).collect()
    assert one[0]["near_next"] == 1.0 and edit_fingerprint.edited_fingerprints(frame(spark, [])).count() == 0


def brute_walk(text):
    """The sampled symbols, one character at a time."""
    s, walks = edit_fingerprint.symbols(text).tolist(), []
    for bits in edit_fingerprint.walk_bits():
        read, p = [], 0
        for j in range(max(1, 2 * len(s))):
            read.append(s[p] if p < len(s) else 0)
            p += int(bits[j % edit_fingerprint.PERIOD][read[-1]])
        walks.append(read)
    return [walks[k % edit_fingerprint.WALKS][max(x for x in steps.tolist() if x < len(walks[0]))] for k, steps in enumerate(edit_fingerprint.slot_steps())]


def test_embedding_matches_a_walk_by_hand(texts):
    some = ["", "a", "abc" * 50, texts[3][1][:900], texts[0][1], "x" * 30000, max((t for _, t in texts), key=len)]
    assert edit_fingerprint.embed(some).tolist() == [brute_walk(t) for t in some]


def test_early_edits_of_long_texts_are_paid_for_once():
    rng = random.Random(6)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(60000))
    for n in (1, 10, 30):
        new = text[:500] + "".join(rng.choice("etaoin shrdlu") for _ in range(n)) + text[500:]
        a, b, c = edit_fingerprint.embed([text, new, "".join(rng.sample(text, len(text)))])
        assert edit_fingerprint.likeness(a, b) > 0.85 and edit_fingerprint.likeness(a, c) < 0.4


def test_search_finds_edited_texts(spark, texts):
    own = [t for _, t in texts[:40] if len(t) > 300]
    edits = [t[:50] + "X" + t[51:200] + t[202:] for t in own]
    fp = edit_fingerprint.fingerprints(frame(spark, [*own, *edits]))
    found = edit_fingerprint.search(fp.where(F.col("doc_id") >= len(own)), fp, 0.5)
    member = {bytes(r["edit_fp"]): r["doc_id"] for r in fp.where(F.col("doc_id") < len(own)).collect()}
    pairs = {(bytes(r["query_fp"]), bytes(r["doc_fp"])) for r in found.collect()}
    hits = sum(any((bytes(r["edit_fp"]), f) in pairs for f, d in member.items() if d == r["doc_id"] - len(own)) for r in fp.where(F.col("doc_id") >= len(own)).collect())
    assert hits >= 0.9 * len(own)


def brute_links(docs, items):
    words = lambda t: re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            s = min(5, len(v))
            bag = lambda x: {g: [tuple(x[k : k + s]) for k in range(len(x) - s + 1)].count(g) for g in {tuple(x[k : k + s]) for k in range(len(x) - s + 1)}}  # noqa: E731, B023
            b, best = bag(v), 0
            for start in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[start : start + len(v)])
                if a.keys() & b.keys():
                    low = sum(min(a.get(g, 0), b.get(g, 0)) for g in a.keys() | b.keys())
                    best = max(best, low / (sum(a.values()) + sum(b.values()) - low))
            if best >= 0.8:
                found[d, i] = best
    return found


def test_decontamination_matches_brute_force(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()][:12]
    rng = random.Random(2)
    docs = [(i, t) for i, t in texts if len(t) < 1500][:25]
    for k, (_, t) in enumerate(items):
        w = t.split()
        near = list(w)
        near[rng.choice([0, 1, len(w) - 1])] = "changed"
        docs += [(1000 + k, docs[k][1][:300] + " " + t + " tail words follow"), (2000 + k, "Head " + " ".join(near).upper()), (3000 + k, " ".join(w[: len(w) // 2]))]
    docs += [(4000, None), (4001, ""), (4002, "one two three")]
    items += [(90, "one two three"), (91, None), (92, " "), (0, items[0][1])]
    found = decontaminate.links(frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id long, text string"), slice_bytes=1500)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()}
    assert got == {k: round(v, 9) for k, v in brute_links(docs, items).items()}
    kept = decontaminate.clean(frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in got}
