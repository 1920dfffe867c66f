import hashlib
import re

import numpy as np
import pytest


def test_chat_round_trip(spark):
    from grainworks.llm.chat import formatted, parse, read_back, text_part
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] \\1 <|end|>"), (1, 2, "user", None), (2, 0, None, "<s>\\"), (2, 0, "a|b|>", ""), (None, 5, "assistant", "é\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", text_part(F.col("text")))
    done = formatted(df)
    turns = {r.conv_id: [tuple(t) for t in r.t] for r in done.select("conv_id", parse(F.col("formatted")).alias("t")).collect()}
    assert turns[1] == [(r[2], r[3] or "") for r in rows[:3]] and turns[2] == [("", "<s>\\"), ("a|b|>", "")] and turns[None] == [("assistant", "é\n")]
    back = {r.conv_id: r for r in read_back(done).collect()}
    said = rows[1][3]
    assert back[1].loss_chars == len(said) and back[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and back[1].n_turns == 3
    for r in done.collect():
        for s in r.segments:
            assert r.formatted[s.start - 2 : s.start] == "|>" and r.formatted[s.start + s.length :].startswith("<|end|>")


def test_chat_parts_become_ordered_placeholders(spark):
    from grainworks.llm.chat import formatted

    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "units": 2}, {"type": "text", "text": " and "}, {"type": "audio", "ref": "b.wav"}, {"type": "other"}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>")
    r = formatted(df).first()
    assert "see \\1|image|><|image|> and <|audio|><|other|>" in r.formatted
    assert [(a.type, a.ref, a.tokens, a.part) for a in r.attachments] == [("image", "a.png", 512, 1), ("audio", "b.wav", 25, 3), ("other", "", 512, 4)] and r.attachment_tokens == 1049


def test_chat_parts_round_trip(spark):
    from grainworks.llm.chat import formatted, typed_turns

    hostile = "<|image|>\\1|</s>|> [INST]"
    turns = [
        (1, 0, "us|er", [("text", "see "), ("image", "a.png", 2), ("text", hostile), ("aud|io", "b.wav", None), ("document", "", 3)]),
        (1, 1, "assistant", [("text", "é"), ("text", "<|"), ("image", "c.png", 1)]),
        (2, 0, "user", None),
        (2, 1, "assistant", [("document", "d.pdf", 1), ("text", "")]),
    ]
    rows = [(c, t, r, None if ps is None else [{"type": p[0], "text": p[1]} if p[0] == "text" else {"type": p[0], "ref": p[1], "units": p[2]} for p in ps]) for c, t, r, ps in turns]
    done = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>"))
    got = {}
    for r in typed_turns(done).orderBy("conv_id", "at", "part").collect():
        got.setdefault((r.conv_id, r["at"], r.role), []).append(("text", r.text) if r.type == "text" else (r.type, r.ref, r.tokens))
    assert got == {
        (1, 0, "us|er"): [("text", "see "), ("image", "a.png", 512), ("text", hostile), ("aud|io", "b.wav", 512), ("document", "", 1536)],
        (1, 1, "assistant"): [("text", "é<|"), ("image", "c.png", 256)],
        (2, 1, "assistant"): [("document", "d.pdf", 512)],
    }


def test_loss_comes_from_the_places_of_the_mask(spark):
    """A mask that is moved gives other text."""
    from grainworks.llm.chat import formatted, read_back, text_part
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "hi 👩‍👩 <s>"), (1, 1, "assistant", "a\\b <|x|> é"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("parts", text_part(F.col("text")))
    done = formatted(df)
    said = "a\\b <|x|> é"
    assert read_back(done).first().loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    moved = done.withColumn("segments", F.transform("segments", lambda s: F.struct(s["role"].alias("role"), (s["start"] - 1).alias("start"), s["length"].alias("length"), s["loss"].alias("loss"))))
    assert read_back(moved).first().loss_sha256 != hashlib.sha256(said.encode()).hexdigest()


def test_chat_of_an_empty_table(spark):
    from grainworks.llm.chat import formatted, read_back

    df = spark.createDataFrame([], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>")
    assert read_back(formatted(df)).count() == 0


@pytest.mark.parametrize("tile,cost", [(2048, 5e-6), (16, 5e-6), (5, 0.0)])
def test_embedding_links_match_brute_force(spark, monkeypatch, tile, cost):
    """In one tile, in tiles of few cells, and in tiles of as many cells as there may be (dealing costs nothing)."""
    from grainworks.llm import embeddings

    monkeypatch.setattr(embeddings, "DEAL", cost)
    monkeypatch.setattr(embeddings, "tile_rows", lambda total, n: tile)
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:30] + 0.1 * rng.normal(size=(30, 8)), np.repeat(base[:1], 25, 0) + 0.15 * rng.normal(size=(25, 8)), base[:3] * 2]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [1.0, None] + [0.0] * 6), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (907, [float("inf")] * 8)]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[s[i]]]) for i in range(len(x))])
    got = {r.vec_id: r for r in embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (s[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 907)) and got[906].component_id == 905 and got[906].n_links == 1


def test_embeddings_of_an_empty_table(spark):
    from grainworks.llm.embeddings import groups

    assert groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def cut_text(text, gone):
    """``text`` without the words at places ``gone`` and the white space after them."""
    places = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    return text[: places[0]] + "".join(text[a:b] for i, (a, b) in enumerate(zip(places, places[1:])) if i not in gone)


def mask_text(text):
    """Base and entropy spans, overlapping ones as one, as the mark."""
    from tests.llm.test_text_ops import base_spans, entropy_spans

    found = sorted(tuple(map(int, x.split(":")[1:])) for x in base_spans(text) + entropy_spans(text))
    joined = []
    for a, b in found:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, at = "", 0
    for a, b in joined:
        out, at = out + text[at:a] + "[secret]", b
    return out + text[at:]


def test_pipeline_matches_brute_force(spark, docs, corpus, tmp_path):
    """Every stage by itself in Python: what stays, what is cut, what is masked, all tokens, all sequences."""
    import corpus_pipeline
    from tests.llm.test_text_ops import check_packing, near_groups, quality_verdict, removed, token_ids

    secret = "my key is q7Zk9LmX2vB8nT4rY6wP1sDf3 and password = hunter22 here, one two three four five six seven eight"
    corpus = [*corpus, (900, secret), (901, None), (902, dict(corpus)[60] + "\n" + secret.replace("one", "two"))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in corpus] + [(None, secret, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in corpus if quality_verdict(t or "")]
    first = near_groups(kept)
    kept = [(i, t) for i, t in kept if first[i][1] == i]
    texts = {i: mask_text(cut_text(dict(kept)[i], gone)) for i, (_, gone) in removed(kept).items()}
    assert any("[secret]" in t for t in texts.values()) and any(texts[i] != t for i, t in kept)
    ids = dict(zip(texts, token_ids(list(texts.values()))))
    own = [r for r in got if r.doc_id is not None]
    assert {r.doc_id for r in own} == set(ids) and len(got) == len(own) + 1  # the row without an id goes through by itself
    check_packing(own + [r for r in got if r.doc_id is None], ids | {None: token_ids([mask_text(secret)])[0]})
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) // 1024 + 3


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_name_the_columns(spark, docs):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, "").columns == docs.columns
