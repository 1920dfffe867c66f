"""Cases in which an operator once did less than its whole job."""


def test_dropout_cuts_every_occurrence_by_itself(spark, monkeypatch):
    from grainworks.llm import pieces

    word, ids = " international", {}
    for text in pieces.encode_texts([(word * 50)[1:]] * 20, 0.3):
        assert pieces.decode_ids(text) == (word * 50)[1:]
        ids[tuple(text)] = text
    assert len(ids) == 20  # equal texts of different documents, where four variants gave at most four
    whole = pieces.model(pieces.model_file())
    spelled = "".join(whole.bytes[i].decode() + "|" for i in next(iter(ids)))
    cuts = {x for x in spelled.replace("| ", "| \0").split(" \0") if x}
    assert len(cuts) > 4  # and inside one document the word is cut in several ways
    texts = [(word * 50)[1:], "naïve 👩‍👩‍👧\t" * 30, "", "x" * 300 + " y", "  "]
    want = pieces.encode_texts(texts, 0.3, first=5)
    monkeypatch.setattr(pieces, "RANGE_BYTES", 64)
    assert pieces.encode_texts(texts, 0.3, first=5) == want and [pieces.decode_ids(x) for x in want] == texts
    assert pieces.encode_texts(texts[1:2], 0.3, first=6) == want[1:2]


def test_kept_merges_change_nothing(monkeypatch):
    """The heap decides every chunk by itself; chunks that share a hash, or that are no longer kept, are cut as it does."""
    import random

    import numpy as np

    from grainworks.llm import pieces

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice(["inter", "nation", "al", "ize", "x", "é", "▁", "th", "e"]) for _ in range(rng.randrange(1, 5))) for _ in range(200)) for _ in range(12)]
    with monkeypatch.context() as m:
        m.setattr(pieces, "LONG_CHUNK", 0)
        want = [pieces.encode_texts(texts, rate, first=3) for rate in (0.0, 0.1, 0.5, 1.0)]
    assert [pieces.encode_texts(texts, rate, first=3) for rate in (0.0, 0.1, 0.5, 1.0)] == want
    for name, value in (("KEPT_CHUNKS", 0), ("RANGE_BYTES", 100), ("span_hashes", lambda data, a, b: (b - a).astype(np.uint64))):
        monkeypatch.setattr(pieces, name, value)
        assert [pieces.encode_texts(texts, rate, first=3) for rate in (0.0, 0.1, 0.5, 1.0)] == want


def test_upper_case_hex_is_a_secret_and_a_known_digest_is_not(spark):
    import hashlib
    import random

    from grainworks.llm.secrets import MASK, redact, scan

    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789ABCDEF") for _ in range(n)) for n in (24, 32, 40, 64) for _ in range(25)]
    keys.append("9f8E7d6C5b4A39281706f5E4d3C2b1A0")
    empty = [hashlib.new(x, b"").hexdigest().upper() for x in ("md5", "sha1", "sha256")]
    quiet = [*empty, "A" * 32, "ABCDEFABCDEFABCDEFABCDEFABCD", "1234567890" * 3]
    rows = spark.createDataFrame(list(enumerate(f"key {k} end" for k in keys + quiet)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in scan(rows).collect()}
    assert [spans[i] for i in range(len(keys))] == [f"entropy:4:{4 + len(k)}" for k in keys]
    out = {r.doc_id: r.text for r in redact(rows).collect()}
    assert all(out[i] == f"key {MASK} end" for i in range(len(keys)))
    assert all("entropy" not in spans[len(keys) + i] for i in range(len(quiet)))


def test_vectors_of_more_than_a_thousand_lengths_keep_their_links(spark):
    from grainworks.llm.embeddings import groups

    rows = [(2 * n + k, [1.0] * (n - 1) + [1.0 + 0.01 * k]) for n in range(2, 1102) for k in range(2)]
    out = groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows) and all(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in out)


def test_every_language_is_learned(spark, monkeypatch):
    from grainworks.llm import language

    assert language.LANGS_IN_FULL == 200
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(10 * i + k, f"{a}{b}q{b}{a} {b}{a}{a} z{a}{b} " * 3, f"{a}{b}") for i, (a, b) in enumerate((x, y) for x in letters[:15] for y in letters[:14]) for k in range(6)]
    names = {r["lang"] for r in language.labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")}
    assert names == {x for _, _, x in rows} and len(names) == 210
