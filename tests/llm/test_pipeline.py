"""Each stage of the pipeline by itself against brute force, and the stages in a row."""

import os
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from lacuna.llm.queries import KEY, N_BEST, WINDOW, tokenizer

from .test_decontaminate import windows, words
from .test_jaccard_join import tokens
from .test_language import brute as language_of
from .test_surrogates import brute as replaced

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that the operators use themselves.
EXTRA = ("lang_pred", "score", "n_hit", "items", "seg", "i", "h", "id", "row", "worded", "n_entities", "n_replaced", "found", "attempts", "k0", "t", "piece_ids", "decoded")


def documents(spark, rows):
    """Documents of (id, text, lang), with extra columns of clashing names."""
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], KIND).repartition(3)
    return df.withColumns({c: F.lit(c) for c in EXTRA})


def told(df):
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and df.columns[5:] == list(EXTRA)
    got = df.collect()
    assert all(r[c] == c for r in got for c in EXTRA)
    return sorted(((r.doc_id is None, r.doc_id, str(r.text), r.n_chars) for r in got), key=str)


def want(rows):
    return sorted(((i is None, i, str(t), n) for i, t, n in rows), key=str)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    items = [(1, " ".join(f"test{i}" for i in range(14))), (2, "a short item"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_near_duplicates(spark, sf_dir):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        w = [f"word{rng.randrange(300)}" for _ in range(rng.choice([3, 40, 120]))]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "changed"
            rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, rows[5][1]), (302, rows[5][1]), (None, rows[6][1]), (None, "no id at all here"), (None, "no id at all here"), (None, " "), (303, "one id"), (303, "two texts")]
    sets, root = [tokens(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    keep = {}
    for k, (i, t) in enumerate(rows):
        own = (i is None, i or 0, k)
        if not sets[k]:
            keep[k] = own  # linked with nothing
        else:
            keep[-1 - root[k]] = min(keep.get(-1 - root[k], own), own)
    left = [rows[k] for _, _, k in keep.values()]
    got = told(P.near_duplicates(spark, documents(spark, [(i, t, None) for i, t in rows]), sf_dir))
    assert got == want([(i, t, len(t or "")) for i, t in left])


def test_decontaminate(spark, sf_dir):
    items = [" ".join(f"test{i}" for i in range(14)), "a short item"]
    texts = [items[0], "x " + items[0] + " y", " ".join(items[0].split()[:9]), "it is A short, Item!", "a short", None, "", " ".join(items[0].split()[3:13]), "clean text of some words", "clean text of some words"]

    def hit(text):
        w = words(text)
        return any(tuple(w[s : s + len(x)]) == x for item in items for x in windows(item, WINDOW) for s in range(len(w)))

    got = told(P.decontaminate(spark, documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), sf_dir))
    assert got == want([(i, t, len(t or "")) for i, t in enumerate(texts) if not hit(t)]) and len(got) == 6


def test_privacy(spark, sf_dir):
    texts = ["mail a.b@x.de now", "Mrs Anna Smith and Smith", "clean", None, "", "card 4111 1111 1111 1111", "mail a.b@x.de now", *(f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.de" for i in range(80))]
    out, _ = replaced(texts, KEY)
    got = told(P.privacy(spark, documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), sf_dir))
    assert got == want([(i, t, len(t or "")) for i, (t, _) in enumerate(out)])


def test_language(spark, sf_dir, monkeypatch):
    said = {"en": "the and of in to is that", "de": "der die und das ein ist nicht"}
    rows = [(i, " ".join(random.Random(i).choices(said[lang].split(), k=30)), lang) for i, lang in enumerate(list(said) * 60)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !", "de"), (None, "the and of that", None), (503, "die und das", None), (503, "die und das", None)]
    kept, train = [], P.train_languages
    monkeypatch.setattr(P, "train_languages", lambda docs: kept.append(train(docs)) or kept[-1])
    got = told(P.language(spark, documents(spark, rows), sf_dir))
    found = {t: language_of(kept[0], t or "") for t in {t for _, t, _ in rows}}
    assert got == want([(i, t, len(t or "")) for i, t, _ in rows if found[t][0] != "und" and found[t][1] >= P.LEAST_SCORE]) and len(got) == 123


def test_pieces(spark, sf_dir):
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat.", "", None, "日本 x", "a b  c\n\nd", "x" * 3000, "the cat sat."]
    out = P.pieces(spark, documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), sf_dir)
    for r in out.collect():
        assert r.text == texts[r.doc_id] and r.round_trip and (r.piece_ids is None) == (r.text is None)
        if r.text:
            score = lambda ids: sum(model.get_score(i) for i in ids)
            assert r.piece_ids == r.nbest_ids[0] and len(r.nbest_ids) <= N_BEST and r.nbest_scores == sorted(r.nbest_scores, reverse=True)
            plain = [x for x in r.piece_ids if not model.is_byte(x)]
            if len(plain) == len(r.piece_ids) and "  " not in r.text:
                assert abs(score(r.piece_ids) - r.nbest_scores[0]) < 1e-3 * max(1, abs(r.nbest_scores[0]))


def test_empty_table(spark, sf_dir):
    docs = documents(spark, [(1, "a", "en")]).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).collect() == [], name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_all_stages_in_a_row(spark):
    sf = "/root/testdata/sf0.001"
    docs = P.table(spark, sf, "documents")
    out = P.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) == len(set(ids)) < docs.count() and all(r.round_trip for r in out)
