"""The automaton against substring search, and held-out accuracy on the given documents."""

import random

import numpy as np
import pyarrow as pa

from marketspark.llm import langid
from marketspark.llm.common import documents

SF = "/root/testdata/sf0.01"


def greedy(text, learned):
    """Phrases of a text: longest prefixes that occur in some learned passage, or one strange symbol."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and any(text[at : at + k + 1] in p for p in learned):
            k += 1
        n, at = n + 1, at + k
    return n


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(1)
    passages = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    letters = "abcd"
    model = langid.Model(letters, ["x"], [], [2])
    code = {c: i + 1 for i, c in enumerate(letters)}
    seq = [s for p in passages for s in [*(code[c] for c in p), model.width - 1]]
    model.tables.append(langid.automaton(np.array(seq), model.width))
    tests = ["".join(rng.choice("abcd" if rng.random() < 0.2 else "abc") for _ in range(rng.randint(0, 200))) for _ in range(50)]
    sym = np.array([code[c] for t in tests for c in t], dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in tests])])
    assert langid.phrases(sym, first, model)[:, 0].tolist() == [greedy(t, passages) for t in tests]


def test_symbols():
    model = langid.Model("abé", ["x"], [], [])
    sym, first, letters = langid.symbols(pa.array(["A b", None, "1!É", "zß𝔸.", "  "]), model.lookup(), 4)
    assert sym.tolist() == [1, 0, 2, 3, 4, 4, 4, 0] and first.tolist() == [0, 3, 3, 4, 8, 8] and letters.tolist() == [2, 0, 1, 3, 0]


def test_held_out_accuracy(spark):
    docs = documents(spark, SF).withColumn("held_out", langid.held_out())
    found = langid.predict(docs, langid.fit(docs.filter("NOT held_out")))
    assert found.filter("held_out").count() > 150
    assert found.filter("held_out AND lang_pred <> lang").count() == 0
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_all_sampled_rows_teach_from_everywhere():
    texts = [f"{'kopf ' * 100}{chr(97 + i % 26) * 3}{i // 26 * 'x'} " + "rumpf " * 100 for i in range(300)]
    taught = langid.dealt(texts, 40_000, 400)
    assert len(taught) == 300 and 39_000 < sum(map(len, taught)) <= 40_000
    assert sum("kopf" not in p for p in taught) > 100
    assert sum(map(len, langid.dealt([*["ab "] * 200, "c" * 100_000], 40_000, 400))) > 39_000


def test_bodies_behind_a_shared_header_are_told_apart(spark):
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(chars) for _ in range(5)) for _ in range(200)] for lang, chars in (("p", "abcdef"), ("q", "ghijkl"))}
    header = "all rights reserved by the owners of this page " * 12
    rows = [(i, header + " ".join(rng.choices(words[lang], k=150)), lang) for i in range(240) for lang in words]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    bodies = spark.createDataFrame([(" ".join(rng.choices(words[lang], k=50)), lang) for lang in words for _ in range(20)], "text string, lang string")
    told = langid.predict(bodies, model).collect()
    assert all(r.lang_pred == r.lang and r.cross_entropy < 6 for r in told)


def test_many_scripts_and_languages(spark):
    rng = random.Random(6)
    scripts = {"en": (97, 26, 900), "ru": (0x430, 32, 900), "el": (0x3B1, 17, 900), "zh": (0x4E00, 900, 30), "ja": (0x7000, 900, 30), "ko": (0xAC00, 900, 30), "ext": (0x20000, 900, 30)}
    scripts |= {f"l{i:02}": (97, 26, 3) for i in range(65)}
    words = {lang: ["".join(chr(at + rng.randrange(n)) for _ in range(3)) for _ in range(150)] for lang, (at, n, _) in scripts.items()}
    rows = [(i, " ".join(rng.choices(words[lang], k=120)), lang) for lang, (_, _, n) in scripts.items() for i in range(n)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == set(scripts) and model.digits
    new = [(" ".join(rng.choices(words[lang], k=60)), lang) for lang in scripts for _ in range(2)]
    thai = [("".join(chr(0xE01 + rng.randrange(40)) for _ in range(300)), "none") for _ in range(3)]
    told = langid.predict(spark.createDataFrame(new + thai, "text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang and r.cross_entropy < 5 for r in told if r.lang in ("en", "ru", "el", "zh", "ja", "ko", "ext"))
    assert sum(r.lang_pred == r.lang for r in told) >= len(new) - 5
    assert all(r.cross_entropy > 5 for r in told if r.lang == "none")
