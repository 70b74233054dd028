"""Recall and precision of the search against the plain edit distance."""

import random

import pyarrow as pa
import pytest

from marketspark.llm import decontaminate


def distance(wanted, body):
    """Least word edits between ``wanted`` and any run of ``body``."""
    row = [0] * (len(body) + 1)
    for i, w in enumerate(wanted):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(body):
            last, row[j + 1] = row[j + 1], min(last + (w != b), row[j] + 1, row[j + 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        assert decontaminate.nearest(a, b)[0] == distance(a, b)


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_and_exact_answers(share):
    rng = random.Random(int(share * 10))
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    items = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 70)))) for i in range(60)]
    matcher = decontaminate.Matcher(items, 0.8, 0.98, 5)
    texts, planted = [], []
    for _ in range(5):
        for k, (_, text) in enumerate(items):
            own = text.split()
            body = edited(rng, own, vocabulary, int(share * len(own)))
            before, after = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] for _ in range(2))
            planted.append((len(texts), k))
            texts.append(" ".join(before + body + after))
    found = {(t, i): e for t, i, _, _, e in matcher.match(pa.array(texts))}
    assert sum(p in found for p in planted) / len(planted) >= (1.0 if share < 0.15 else 0.97)
    for (t, i), e in found.items():
        true = distance(items[i][1].split(), texts[t].split())
        assert true <= e <= len(items[i][1].split()) * 0.2


def changed(rng, own, vocabulary, kind):
    words, edits = list(own), len(own) // 5
    if kind == "deleted":
        gone = set(rng.sample(range(len(words)), edits))
        return [w for i, w in enumerate(words) if i not in gone]
    if kind == "replaced":
        for i in rng.sample(range(len(words)), edits):
            words[i] = rng.choice(vocabulary)
    elif kind == "inserted":
        for _ in range(edits):
            words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
    else:
        words = edited(rng, words, vocabulary, edits)
    return words


@pytest.mark.parametrize("size", [20, 25, 30, 35, 40, 60, 80, 100])
def test_recall_by_length_and_kind_of_edit(size):
    rng = random.Random(size)
    vocabulary = [f"w{int(rng.paretovariate(0.3))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(size))) for i in range(100)]
    matcher = decontaminate.Matcher(items, 0.8, 0.98, 5)
    for kind in ("deleted", "replaced", "inserted", "mixed"):
        around = [[f"x{rng.randrange(10_000)}" for _ in range(30)] for _ in range(200)]
        texts = [" ".join([*around[2 * k], *changed(rng, text.split(), vocabulary, kind), *around[2 * k + 1]]) for k, text in items]
        found = {(t, i) for t, i, *_ in matcher.match(pa.array(texts))}
        assert sum((k, k) in found for k in range(100)) >= 97, kind


def test_all_passages_that_do_not_overlap():
    rng = random.Random(4)
    for _ in range(300):
        wanted = [rng.randrange(6) for _ in range(rng.randint(5, 12))]
        body = []
        for _ in range(rng.randint(1, 5)):
            body += [rng.randrange(6) for _ in range(rng.randrange(6))] + edited(rng, wanted, range(6), rng.randrange(3))
        most = len(wanted) // 5
        found = decontaminate.passages(wanted, body, most)
        true = {(a, b): whole(wanted, body[a:b]) for a in range(len(body)) for b in range(a + 1, len(body) + 1)}
        assert [e for *_, e in found] == sorted(e for *_, e in found)
        assert all(true[a, b] == e <= most for a, b, e in found)
        spans = sorted((a, b) for a, b, _ in found)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        taken = []  # plainly: the best run of each end, fewest edits first, where nothing is taken yet
        best = {b: min((true[a, b], b - a) for a in range(b)) for b in range(1, len(body) + 1)}
        for edits, b, size in sorted((e, b, n) for b, (e, n) in best.items() if e <= most):
            if all(b <= x or b - size >= y for x, y in taken):
                taken.append((b - size, b))
        assert [(a, b) for a, b, _ in found] == taken


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, x in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (w != x), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_short_items_and_items_without_id(spark):
    docs = spark.createDataFrame([(1, "Yes it IS yes it is so yes it"), (2, "yesit is"), (None, "Yes it"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "yes it"), (8, "yes it is"), (9, "yes\tit"), (10, None), (11, " ")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits, r.similarity) for r in decontaminate.find_leaks(docs, items).collect()), key=repr)
    twice = [(1, i, a, a + 2, 0, 1.0) for i in (None, 9) for a in (0, 3, 7)]
    assert got == sorted([*twice, (1, 8, 0, 3, 0, 1.0), (1, 8, 3, 6, 0, 1.0), (None, None, 0, 2, 0, 1.0), (None, 9, 0, 2, 0, 1.0)], key=repr)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {2, 4}


def test_same_item_twice_in_a_text(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{item} {item} something else {item.replace('word7 ', '')}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item)], "item_id long, text string")
    got = [(r.item_id, r.start_word, r.end_word, r.edits) for r in decontaminate.find_leaks(docs, items).collect()]
    assert got == [(None, 0, 30, 0), (None, 30, 60, 0), (None, 62, 91, 1)]


@pytest.mark.parametrize("size", [100, 300, 1000])
@pytest.mark.parametrize("deletions", [False, True])
def test_recall_of_long_items(size, deletions):
    rng = random.Random(size)
    vocabulary = [f"w{int(rng.paretovariate(0.3))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(size))) for i in range(20)]
    matcher = decontaminate.Matcher(items, 0.8, 0.98, 5)
    texts = []
    for _, text in items:
        own = text.split()
        gone = set(rng.sample(range(size), size // 5))
        body = [w for i, w in enumerate(own) if i not in gone] if deletions else edited(rng, own, vocabulary, size // 5)
        texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(30)), *body, *(rng.choice(vocabulary) for _ in range(30))]))
    found = {(t, i): e for t, i, _, _, e in matcher.match(pa.array(texts))}
    assert sum((k, k) in found for k in range(20)) >= 19
    assert all(e <= size // 5 for e in found.values())


def test_passages_and_clean_documents(spark):
    item = "Which of these is the only planet that has rings made of ice and dust around it"
    docs = spark.createDataFrame([(1, f"intro words here {item.upper()} and more"), (2, "which of these things is different"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = decontaminate.find_leaks(docs, items).collect()
    assert (row.doc_id, row.item_id, row.start_word, row.end_word, row.edits, row.similarity) == (1, 7, 3, 20, 0, 1.0)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {2, 3}


def test_blocks_of_items_give_the_same(spark):
    items = spark.createDataFrame([(i, f"item number {i} with some more words in it {i}") for i in range(40)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, block_bytes=300))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(40))
