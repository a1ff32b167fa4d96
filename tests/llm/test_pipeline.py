from __future__ import annotations

import random

import pandas as pd
import pytest

import corpus_pipeline
from boardsift.llm import common, jaccard
from boardsift.llm.common import components, stored
from tests.llm.helpers import documents


@pytest.mark.parametrize("plain", [1_000_000, 0])
def test_components(spark, plain, monkeypatch):
    from boardsift.llm import common

    monkeypatch.setattr(common, "PLAIN", plain)
    random.seed(0)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    ids = sorted({x for e in edges for x in e})
    got = dict(components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long")).select("id", "component").collect())
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges.select(edges.a.alias("id")), edges, rounds=2)


def test_stages(spark, tmp_path):
    random.seed(11)
    words = ["".join(random.choice("aeioulmnrst") for _ in range(random.randint(2, 9))) for _ in range(2000)]

    def prose(n):
        return " ".join(random.choice(words) for _ in range(n)) + "."

    item, passage = prose(15), prose(60)
    rows = [(i, prose(120)) for i in range(120)] + [(200 + i, "$$$ ||| !!! " * 30 + str(i)) for i in range(60)]
    rows += [(300, rows[0][1] + " tail"), (301, prose(80) + " " + passage + " " + prose(50)), (302, prose(70) + " " + passage), (303, prose(60) + " " + item + " " + prose(60)), (304, None), (305, "")]
    docs = documents(spark, rows)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": [r[0] for r in rows[:180]], "quality": [int(r[0] < 200) for r in rows[:180]], "toxic": 0}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    after, d = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        d = stored(stage(spark, d, str(tmp_path)), name)
        after[name] = {r.doc_id: r for r in d.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == list(corpus_pipeline.COLUMNS)
    assert not any(200 <= i < 260 for i in after["quality"]) and set(range(120)) <= set(after["quality"])
    assert 300 not in after["near_duplicates"] and 0 in after["near_duplicates"]
    assert passage not in after["repeated_text"][301].text and passage not in after["repeated_text"][302].text
    assert after["repeated_text"][5].text == rows[5][1]
    assert 303 not in after["decontamination"] and set(range(120)) <= set(after["decontamination"])
    run = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (r.n_tokens, r.decoded) for i, r in run.items()} == {i: (r.n_tokens, r.decoded) for i, r in after["tokens"].items()}


def odd_corpus():
    """Near copies, repeated rows, passages, leaks, null and empty values, a long text."""
    random.seed(21)
    words = ["".join(random.choice("aeioulmnrsté") for _ in range(random.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(random.choice(words) for _ in range(n))

    item, passage, base = prose(14), prose(60), prose(90)
    cut = base.split()
    rows = [(i, prose(random.randint(1, 60))) for i in range(20)]
    rows += [(30, base), (31, base + " tail"), (32, " ".join(cut[:40] + ["changed"] + cut[41:])), (None, base + " x"), (33, base)]
    rows += [(40, prose(50) + " " + passage + " " + prose(30)), (41, prose(20) + " " + passage), (42, prose(30) + " " + item + " " + prose(20)), (43, item)]
    rows += [(50, None), (51, ""), (52, " "), (None, None), (50, None), (53, prose(6000)), (60, "twice"), (60, "twice"), (61, prose(40)), (61, prose(41))]
    return rows, item


def plain(rows):
    return sorted(((r.doc_id, r.text or "") for r in rows), key=str)


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from boardsift.llm import quality, tokens
    from tests.llm.helpers import clashing
    from tests.llm.test_text_operators import brute_cut, brute_hits, brute_links

    rows, item = odd_corpus()
    pd.DataFrame({"item_id": [1, 2], "text": [item, None]}).to_parquet(tmp_path / "benchmark.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(20)]
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    docs, stages = clashing(documents(spark, rows)).repartition(4), dict(corpus_pipeline.STAGES)
    kept = stored(stages["quality"](spark, docs, str(tmp_path)), "q").collect()
    score = {(r.doc_id, r.key): r.score for r in quality.score_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    keys = [((r.doc_id, r.text or ""), (r.doc_id, r.key)) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as key").collect()]
    assert plain(kept) == sorted((row for row, k in keys if score[k] >= quality.THRESHOLD), key=str)

    got = plain(stored(stages["near_duplicates"](spark, docs, ""), "n").collect())
    units = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    root = brute_links([(k, t) for k, (_, t) in enumerate(units)], 5, 80)
    assert got == sorted(((i, t or "") for k, (i, t) in enumerate(units) if root[k] == k), key=str)

    got = plain(stored(stages["repeated_text"](spark, docs, ""), "r").collect())
    left = [((i, k.decode("utf-8", "ignore")), n) for (i, _), (n, _, k) in zip(rows, brute_cut([t for _, t in rows]), strict=True)]
    assert got == sorted((row for row, n in left if n == 0 or row[1]), key=str)

    got = plain(stored(stages["decontamination"](spark, docs, str(tmp_path)), "d").collect())
    hit = {k for k, (i, t) in enumerate(rows) if brute_hits([(i, t)], [(1, item)])[0][2]}
    assert hit and got == sorted(((i, t or "") for k, (i, t) in enumerate(rows) if k not in hit), key=str)

    library = Tokenizer.from_file(tokens.tokenizer_file("word_bpe_49k.json"))
    out = stages["tokens"](spark, docs, "").collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded) for r in out), key=str) == sorted(((i, len(x), library.decode(x, skip_special_tokens=False)) for i, x in want), key=str)


def test_stages_of_nothing(spark, tmp_path):
    pd.DataFrame({"item_id": [1], "text": ["one two three"]}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(tmp_path / "labels.parquet")
    empty = documents(spark, [])
    empty.toPandas().astype({"doc_id": "int64", "n_chars": "int64"}).to_parquet(tmp_path / "documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark):
    random.seed(12)
    words = ["".join(random.choice("aeioulmnrst") for _ in range(random.randint(2, 9))) for _ in range(2000)]
    a, b, c, d, e, f, g = (" ".join(random.choice(words) for _ in range(80)) for _ in range(7))
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d + " tail"), (4, d), (4, d), (5, e), (5, f), (None, g), (None, g + " tail"), (6, None), (6, None), (7, "")]
    kept = stored(corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), ""), "kept")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [x for x in got if x[1] not in (g, g + " tail")] == sorted([(1, a), (2, b), (None, c), (3, d + " tail"), (5, e), (5, f), (6, None), (7, "")], key=str)
    assert len(got) == 9
    left = {r.text for r in corpus_pipeline.repeated_text_stage(spark, kept, "").collect()}
    assert {a, b, c, d + " tail", e, f} <= left and left & {g, g + " tail"}


def test_near_duplicates_in_rounds_leave_no_sets_behind(spark, monkeypatch, tmp_path):
    """Parts and regions that travel in rounds give the same groups; what the join writes on its way goes with it."""
    words = [f"w{i}" for i in range(60)]
    rows = [(10 * g + i, " ".join([f"g{g}", *words[g : g + 30], f"x{i}"])) for g in range(20) for i in range(2)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = sorted(r.doc_id for r in stored(stage(spark, docs, ""), "n").collect())
    monkeypatch.setattr(jaccard, "ROUND_ROWS", 0)
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert sorted(r.doc_id for r in stored(stage(spark, docs, ""), "n").collect()) == once
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} <= {"several", "rows", "dropped", "copied", "n"}
