import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, long and empty ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "straße", "日本", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    base = say(120).split(" ")
    texts = [None, "", "   \n\t", "one", "two words", "a b c d e"]
    for i in range(40):
        edited = list(base)
        for _ in range(i % 6):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    for i in range(40):
        texts.append(f"{say(rng.randrange(0, 60))}\n{passage}\n{say(rng.randrange(0, 60))}")
    for i in range(30):
        texts.append(say(rng.randrange(1, 80)))
    texts += [texts[50], texts[50], "the " * 300, "A b C d E", say(5000), "line one here\n" * 12, "x\r\ny z q " * 8]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")
