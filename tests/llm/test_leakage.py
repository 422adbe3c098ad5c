import numpy as np
import random

from skein.llm import leakage


def runs(words):
    return leakage._runs_of(words)


def holds(item, text):
    return leakage.holds(item, runs(item), text, runs(text), 12, 8)


def brute(item, text, words=12, rate=8):
    """Longest passages by dynamic programming over all places and edits."""
    low, most = -(10**6), len(item) // rate
    rows = [[low] * (len(text) + 1) for _ in range(most + 1)]
    rows[0] = [0] * (len(text) + 1)
    for w in item:
        new = [[low] * (len(text) + 1) for _ in range(most + 1)]
        new[0][0] = 0
        for e in range(most + 1):
            for j in range(1, len(text) + 1):
                best = rows[e][j - 1] + 1 if text[j - 1] == w else 0 if e == 0 else low
                if e:
                    for before, more in ((rows[e - 1][j - 1], 1), (rows[e - 1][j], 1), (new[e - 1][j - 1], 0)):
                        best = max(best, before + more if before >= 1 else low)
                new[e][j] = best
                if text[j - 1] == w and rows[e][j - 1] + 1 == best >= max(words, rate * e):
                    return True
        rows = new
    return False


def test_against_brute_force():
    """Items of different words: with repeated ones a left-out word may equal its neighbour, which the operator does not count."""
    rng = random.Random(2)
    seen = [0, 0]
    for _ in range(400):
        item = [f"w{k}" for k in rng.sample(range(300), rng.randrange(12, 45))]
        at, out = rng.randrange(0, len(item) - 10), []
        for w in item[at : at + rng.randrange(9, 30)]:
            x = rng.random()
            out += [] if x < 0.03 else ["x", w] if x < 0.06 else ["y"] if x < 0.1 else [w]
        text = [f"t{k}" for k in range(15)] + out + [f"u{k}" for k in range(15)]
        want = brute(item, text)
        seen[want] += 1
        assert holds(item, text) == want
    assert min(seen) > 50


ITEM = "Between Yarrowgate and Quenby the archivist swaps 3824 woven conveyors for 6254 sealed tickets and the librarian signs for nine thousand"


def test_operator(spark):
    words = ITEM.split()
    texts = {
        1: "Intro. " + ITEM + " Outro.", 2: ITEM.upper().replace(" ", "\n"), 3: "> " + "\n> ".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4)), 4: " ".join(words[:11]), 5: " ".join(words[:12]),
        6: " ".join(["changed" if k == 6 else w for k, w in enumerate(words)]), 7: " ".join(["changed" if k % 4 == 2 else w for k, w in enumerate(words)]), 8: None, 9: "", 10: "nothing of the kind " * 5000, 11: "filler " * 30_000 + ITEM,
        12: ITEM.replace("conveyors", "conve-\nyors"), 13: "1. " + " ".join(words[:8]) + "\n2. " + " ".join(words[8:]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs.union(docs.where("doc_id = 1")), items).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 5, 6, 11, 12, 13)}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(k, ITEM) for k in range(3)], "item_id long, text string")
    assert leakage.find_leaks(docs, items).count() == 3


def test_scripts_without_blanks(spark):
    """Recall over passages cut out of Japanese, Chinese and Thai items, with a character changed, in longer texts."""
    rng = np.random.default_rng(8)
    alphabets = {"ja": [*map(chr, range(0x3042, 0x3090)), *map(chr, range(0x4E00, 0x4F00))], "zh": [*map(chr, range(0x5000, 0x5400))], "th": [*map(chr, range(0x0E01, 0x0E2F))]}
    items, docs, want, k = [], [], set(), 0
    for n, letters in enumerate(alphabets.values()):
        for j in range(6):
            item = "".join(rng.choice(letters, 60))
            items.append((n * 10 + j, item))
            noise = lambda m: "".join(rng.choice(letters, m))  # noqa: E731, B023
            passage = list(item[10 : 10 + 26])
            docs += [(k, noise(80) + "".join(passage) + "。" + noise(50)), (k + 2, noise(40) + item[:14] + noise(40))]
            passage[int(rng.integers(8, 18))] = letters[0] if passage[12] != letters[0] else letters[1]
            docs.append((k + 1, noise(30) + "".join(passage) + noise(30)))
            want |= {(k, n * 10 + j), (k + 1, n * 10 + j)}
            k += 3
    got = {tuple(r) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got & want) >= 0.97 * len(want), (sorted(want - got), sorted(got - want))


def test_blocks_of_items_are_searched_in_few_scans(spark, monkeypatch):
    words = [f"w{k}x" for k in range(400)]
    items = spark.createDataFrame([(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before it " + " ".join(words[k * 20 + 3 : k * 20 + 17]) + " after") for k in range(20)] + [(99, None), (98, "")], "doc_id long, text string")
    whole = {tuple(r) for r in leakage.find_leaks(docs, items).collect()}
    assert whole == {(k, k) for k in range(20)}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 150)
    assert {tuple(r) for r in leakage.find_leaks(docs, items).collect()} == whole
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_an_added_word_longer_than_half_a_band(spark):
    item = [f"word{k}" for k in range(26)]
    one = lambda added: spark.createDataFrame([(1, " ".join([*item[:8], *added, *item[8:16]]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert leakage.find_leaks(one(["short"]), items).count() == 1
    assert leakage.find_leaks(one(["x" * (leakage.BAND // 2 - 2)]), items).count() == 1
