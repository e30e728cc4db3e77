"""Held-out accuracy of the classifier, the pipeline's stages, and the queries against their SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from shopmetrics.llm import catalog, language_id, ngram_join
from tests.llm.test_exact import grams, hits


def test_language_is_learned(ready, small_dir):
    docs = ready.read.parquet(f"{small_dir}/documents.parquet")
    out = catalog.op7_language_id(ready, small_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(docs):
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([("the of and with that", "en"), ("der die und mit das", "de"), ("les des et avec pour", None), (None, "de")] * 5)]
    model = language_id.train(docs(rows))
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 %%% ²"), (4, "the of and"), (5, "die und " * 400_000), (None, "the"), (4, "the of and")]
    out = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(docs(odd), model).collect())
    assert out == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "en"): 2, (5, "de"): 1, (None, "en"): 1})
    kept = language_id.keep_known(docs(odd), model)
    assert kept.columns == docs(odd).columns and kept.count() == 4
    nothing = language_id.train(docs(rows).limit(0))
    assert {r.lang_pred for r in language_id.predict(docs(odd), nothing).collect()} == {"und"}


def test_language_stage_without_languages(ready, docs):
    frame = docs([(1, "clean text", None, "s"), (2, "é", None, "s"), (3, "12 %", None, "s"), (4, None, None, "s"), (5, "", None, "s")])
    out = corpus_pipeline.language(ready, frame, "")
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert language_id.keep_known(frame, language_id.train(frame), languages=["en"]).count() == 0


def test_texts_of_no_known_language_go(ready, small_dir):
    docs = ready.read.parquet(f"{small_dir}/documents.parquet")
    foreign = ["Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес", "敏捷的棕色狐狸跳过了懒狗然后跑进了森林", "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί"]
    clean = docs.where("lang is not null and length(text) > 200").limit(40).collect()
    rows = [(10**9 + k, t) for k, t in enumerate(foreign * 2)] + [(r.doc_id, r.text) for r in clean]
    frame = ready.createDataFrame(rows, "doc_id long, text string")
    for part in (docs, docs.where("lang in ('en', 'de')"), docs.where("lang = 'en'")):  # also with one language, of which every score is 1
        model = language_id.train(part)
        if model.languages:
            kept = {r.doc_id for r in language_id.keep_known(frame, model).collect()}
            own = {r.doc_id for r in clean if r.lang in model.languages}
            assert not {i for i in kept if i >= 10**9} and own <= kept


def test_copies_take_no_place_in_the_sample(docs, monkeypatch):
    rows = [(k, f"the of and with {k}", "en", "s") for k in range(30)] + [(k, f"der die und mit {k}", "de", "s") for k in range(30)]
    rows += [(100 + k, "das ist ein text", "de", "s") for k in range(3000)]
    fitted, fit = [], language_id.fit_ftrl
    monkeypatch.setattr(language_id, "fit_ftrl", lambda rows, n: fitted.extend(rows) or fit(rows, n))
    model = language_id.train(docs(rows), max_per_language=40)
    taken = Counter(model.languages[r[0]] for r in fitted)  # four of five; the others set the temperature
    assert taken["de"] + taken["en"] == 49 and taken["de"] >= 24
    assert model.predict("der die und mit")[0] == "de"


def test_pipeline_stages(ready, small_dir, tmp_path):
    docs = ready.read.parquet(f"{small_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(ready, docs, small_dir).write.parquet(str(tmp_path / name))
        docs = ready.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, (_, d) in seen.items()}
    assert {i for i, t in seen["language_id"][0]} - kept["language_id"] <= {i for i, t in seen["language_id"][0] if not any(map(str.isalpha, t or ""))}
    first: dict = {}
    for i, t in sorted(seen["exact_dedup"][0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    assert kept["exact_dedup"] == set(first.values())
    rows = seen["ngram_join"][0]
    sets = {i: grams(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    name = {i: i for i in sets}
    for _ in range(len(links)):
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
        if not changed:
            break
    assert kept["ngram_join"] == {i for i in sets if name[i] == i}
    items = [(r.item_id, r.text) for r in ready.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    found = hits(seen["decontaminate"][0], items)
    assert kept["decontaminate"] == {k[0] for k in found if not k[-1]}
    assert kept["bpe"] == kept["decontaminate"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(ready, small_dir, name):
    out = catalog.queries()[name](ready, small_dir)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small_dir, t)}.parquet')")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_stage_of_an_empty_table(ready, small_dir):
    docs = ready.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(ready, docs, small_dir).count() == 0
    assert ngram_join.near_groups(docs).count() == 0
