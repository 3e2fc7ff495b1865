"""Line dedup of documents whose lines lead to other documents than the one they copy."""

import random

import pytest

from panewise.llm import lines


def dropped(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return {r.row.doc_id: (r.text, r.n_removed) for r in lines.drop_lines(df).collect()}


def test_copies_of_reordered_or_repeated_lines(spark):
    texts = [(1, "y\nx"), (2, "x\ny"), (3, "x\ny"), (4, "p"), (5, "p\nq\np"), (6, "p\n \nq\np\n")]
    got = dropped(spark, texts)
    assert got[1] == ("y\nx", 0) and got[2][1] == 1 and got[3] == ("", 2)
    assert got[4] == ("p", 0) and got[5][1] == 1 and got[6] == ("", 5)


def test_near_copy_of_reordered_lines(spark):
    """Only the document that shares the most lines has them in the same order."""
    own = [f"line {i}" for i in range(20)]
    joined = "\n".join
    texts = [(1, joined(own[::-1])), (2, joined(own)), (3, joined([*own, "new"])), (4, joined(["old", *own[:9], "x", *own[9:]]))]
    got = dropped(spark, texts)
    assert got[2][1] == 1
    assert got[3] == ("new", 20) and got[4] == ("old\nx", 20)
    texts = [(1, joined(own[:10][::-1])), (2, joined(own)), (3, joined([*own, "new"]))]
    assert dropped(spark, texts)[3] == ("new", 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_copies_go(spark, seed):
    """A copy of an earlier text keeps no line, and the first document of a line keeps it."""
    rng = random.Random(seed)
    texts = []
    for i in range(80):
        if texts and rng.random() < 0.4:
            texts.append((i, rng.choice(texts)[1]))
        else:
            texts.append((i, "\n".join(rng.choice("abcdefghijkl") * 3 for _ in range(rng.randint(1, 9)))))
    got, seen, first = dropped(spark, texts), set(), {}
    for i, t in texts:
        if t in seen:
            assert got[i][0] == ""
        seen.add(t)
        for x in t.split("\n"):
            first.setdefault(x, i)
        assert all(x in got[i][0].split("\n") for x in t.split("\n") if first[x] == i)


def filled(text):
    return [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]


def brute(texts):
    """Every document aligned with every earlier one of different content, pair by pair."""
    seen, originals, out = {}, [], {}
    for i, t in sorted(texts):
        body = tuple(filled(t))
        if body and body in seen:
            out[i] = set(range(len(t.split("\n"))))
            continue
        seen[body] = i
        own, gone = t.split("\n"), set()
        for other in originals:
            shared = set(filled(t)) & set(other)
            places = [k for k, x in enumerate(own) if x in shared]
            gone.update(places[k] for k in lines.patience([own[k] for k in places], [x for x in other if x in shared]))
        originals.append(filled(t))
        out[i] = gone
    return out


def lengths(seed, n=70):
    """Documents with shared runs, shuffled runs, repeated and blank lines, and whole copies."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        body = [rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randint(0, 12))]
        if texts and rng.random() < 0.5:
            other = rng.choice(texts)[1].split("\n")
            a = rng.randrange(len(other))
            run = other[a : a + rng.randint(1, 6)]
            body[2:2] = rng.sample(run, len(run)) if rng.random() < 0.3 else run
        if rng.random() < 0.2:
            body.insert(0, " ")
        texts.append((i, rng.choice(texts)[1] if texts and rng.random() < 0.15 else "\n".join(body)))
    return texts


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_all_pairs_are_aligned(spark, monkeypatch, seed):
    """With every line rare, what goes is what any earlier document is aligned with."""
    monkeypatch.setattr(lines, "HOLDERS", 10**6)
    texts = lengths(seed)
    got, want = dropped(spark, texts), brute(texts)
    for i, t in texts:
        own = t.split("\n")
        kept = [x for k, x in enumerate(own) if k not in want[i]]
        if want[i] and not any(x.strip() for x in kept):
            kept = []
        assert got[i][0].split("\n") == (kept or [""]), i


@pytest.mark.parametrize("reversed_ones", [1, 3, 6])
def test_all_holders_of_rare_lines_are_partners(spark, reversed_ones):
    own = [f"line {i}" for i in range(20)]
    texts = [(i, "\n".join([f"first {i}", *own[::-1]])) for i in range(reversed_ones)]
    texts += [(100, "\n".join(own)), (101, "\n".join([*own, "new"]))]
    assert dropped(spark, texts)[101] == ("new", 20)


def test_frequent_lines_follow_their_first_holders(spark):
    """A line of very many documents goes from all but the first."""
    texts = [(i, f"own {i}\ncommon\nlast {i}") for i in range(60)]
    got = dropped(spark, texts)
    assert got[0][1] == 0 and all(got[i] == (f"own {i}\nlast {i}", 1) for i in range(1, 60))


def common(seed, n=70):
    """Documents in which a few lines are frequent, in many orders and numbers, and some are rare."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        body = [rng.choice("aaaabbcdef") * 3 for _ in range(rng.randint(1, 6))]
        body += [f"rare {rng.randrange(n)}" for _ in range(rng.randrange(3))]
        if rng.random() < 0.6:
            rng.shuffle(body)
        if texts and rng.random() < 0.3:
            body = rng.choice(texts)[1].split("\n") + body[:1]
        texts.append((i, "\n".join(body)))
    return texts


@pytest.mark.parametrize("holders", [1, 8])
@pytest.mark.parametrize("make,seed", [(lengths, 3), (common, 6)])
def test_holders_do_not_change_the_result(spark, monkeypatch, make, seed, holders):
    """Frequent lines lose no partner: what goes is what any earlier document is aligned with."""
    monkeypatch.setattr(lines, "HOLDERS", holders)
    monkeypatch.setattr(lines, "FURTHER", 4)
    monkeypatch.setattr(lines, "MATCHES_AT_ONCE", 20)
    texts = make(seed)
    got, want = dropped(spark, texts), brute(texts)
    for i, t in texts:
        kept = [x for k, x in enumerate(t.split("\n")) if k not in want[i]]
        if want[i] and not any(x.strip() for x in kept):
            kept = []
        assert got[i][0].split("\n") == (kept or [""]), i


def test_frequent_lines_are_aligned_with_late_holders(spark):
    """Only the last of many holders has the lines in the same order."""
    own = [f"line {i}" for i in range(6)]
    texts = [(i, "\n".join([f"first {i}", *own[::-1]])) for i in range(30)]
    texts += [(100, "\n".join(own)), (101, "\n".join([*own, "new"]))]
    assert dropped(spark, texts)[101] == ("new", 6)
