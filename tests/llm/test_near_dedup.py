"""The pipeline's near-duplicate stage held to its threshold by brute force."""

import random

import pytest

from foliospark.llm import op2_simhash

DOCS = "doc_id long, text string"


def similar(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def kept(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    return {r["doc_id"]: r["keep"] for r in op2_simhash.near_duplicates(df, **more).collect()}


def test_pairs_at_the_threshold(spark):
    """Of 5-word shingles, n - x of n shared each way: (n - x) / (n + x) is 0.8 at x = n / 9, less one step above."""
    rng, texts, want = random.Random(1), [], {}
    for k in range(300):
        n = 9 * rng.choice([7, 20, 30, 60])
        x = n // 9 + (k % 3 == 2)
        a = words(rng, n + 4)
        texts += [" ".join(a), " ".join(a[: n + 4 - x] + words(rng, x))]
        assert (similar(*texts[-2:]) >= 0.8) == (k % 3 < 2)
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (k % 3 == 2)}
    got = kept(spark, texts)
    missed = sum(want[i] < got[i] for i in want)
    assert (missed, sum(want[i] > got[i] for i in want)) == (0, 0), f"{missed} of 200 pairs missed"


def test_pairs_among_texts_of_one_template(spark):
    """300 texts share a passage at about 0.6, so cells hold many that are not similar; 100 of them have a near copy."""
    rng = random.Random(2)
    passage = words(rng, 150)
    texts = [" ".join(passage + words(rng, 50)) for _ in range(300)]
    for i in range(100):
        w = texts[i].split()
        texts.append(" ".join(w[:-15] + words(rng, 15)))
    assert similar(texts[0], texts[1]) < 0.7 and similar(texts[0], texts[300]) >= 0.8
    got = kept(spark, texts)
    want = {i: i if i < 300 else i - 300 for i in range(400)}
    wrong = sum(got[i] != want[i] for i in want)
    assert not wrong, f"{wrong} of 400 documents wrong"


@pytest.mark.parametrize("times", [10, 20])
def test_repeats_inside_a_text_count_once(spark, times):
    rng, texts, want = random.Random(3), [], {}
    for k in range(40):
        loop = words(rng, 40)
        texts += [" ".join(loop * times + words(rng, 200)) for _ in range(2)]
        assert similar(*texts[-2:]) < 0.2
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + 1}
    for k in range(40, 60):  # 5 passes of a loop add no shingle that 2 passes do not have
        rest, loop = words(rng, 400), words(rng, 40)
        texts += [" ".join(loop * 2 + rest), " ".join(loop * 5 + rest)]
        assert similar(*texts[-2:]) == 1
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    got = kept(spark, texts)
    wrong = sum(got[i] != want[i] for i in want)
    assert not wrong, f"{wrong} of 120 documents wrong"


def test_texts_that_share_an_id_are_texts_of_their_own(spark):
    """Ids repeat with different texts: each text has the group that its words give it, named by the least id there."""
    rng, rows = random.Random(4), []
    for k in range(60):
        a = words(rng, 80)
        rows += [(k, " ".join(a)), (rng.randrange(60), " ".join(a[:77] + words(rng, 3))), (1000 + k % 7, " ".join(words(rng, 3) + a[3:]))]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (3, None), (900, ""), (None, rows[0][1])]
    rng.shuffle(rows)
    texts = sorted({t or "" for i, t in rows if i is not None})
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for x in range(len(texts)):
        for y in range(x):
            if (not texts[x].split()) == (not texts[y].split()) and similar(texts[x], texts[y]) >= 0.8:
                root[top(texts[x])] = top(texts[y])
    least = {}
    for i, t in rows:
        if i is not None:
            least[top(t or "")] = min(i, least.get(top(t or ""), i))
    want = sorted((i, least[top(t or "")]) for i, t in rows if i is not None)
    got = op2_simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted((r["doc_id"], r["keep"]) for r in got) == want


def test_candidates_of_the_covering_masks(spark):
    """Without any minima what the masks bring together is found, and only if the sets are similar."""
    rng, texts = random.Random(5), []
    for _ in range(20):
        a = words(rng, 1500)
        texts += [" ".join(a), " ".join(a[:-1] + words(rng, 1))]
    marks = [op2_simhash.fingerprint(op2_simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    near = {2 * k + 1 for k in range(20) if ((marks[2 * k] ^ marks[2 * k + 1]) & (1 << 64) - 1).bit_count() <= 3}
    assert len(near) > 10
    got = kept(spark, [*texts, "one two", "three four", ""], bands=0)
    assert got == {i: i - (i in near) for i in range(43)}
