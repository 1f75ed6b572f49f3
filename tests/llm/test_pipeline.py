"""The pipeline against its stages written out plainly."""
import random
import re

from test_jaccard import brute

import corpus_pipeline as C
from quarry.llm import decontaminate, pieces, pii, toxicity
from quarry.llm.common import NULL_ID

WORDS = [f"{a}{b}{c}" for a in ("gar", "hou", "riv", "let", "win") for b in ("den", "se", "er", "ter", "dow") for c in ("", "s", "ing", "ed")]


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(14)) for k in range(4)] + [(9, "just seven words make up this item"), (10, None)]
    rows = [(d, text(rng.randrange(30, 60))) for d in range(160)]
    rows += [(200 + k, rows[k][1] + " end") for k in range(10)] + [(220 + k, rows[k][1].upper()) for k in range(5)]  # near copies
    rows += [(300 + k, text(20) + " " + t + " " + text(5)) for k, t in enumerate(t for _, t in items[:4])]  # contaminated
    rows += [(310, "x " + items[4][1] + " y"), (320, text(25) + " write to a.b@example.org or +49 170 1234567")]
    rows += [(d, t + " vilest scum") for d, t in ((d, text(40)) for d in range(400, 440))]  # toxic
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1]), (None, text(30))]
    labels = [(d, 1) for d in range(400, 440)] + [(d, 0) for d in range(160)]
    return rows, labels, items


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def plain_clean(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    phrases = set()
    for _, t in items:
        w = words(t)
        phrases |= {tuple(w[k:k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
    held = lambda w: any(tuple(w[k:k + n]) in phrases for n in {len(p) for p in phrases} for k in range(len(w) - n + 1))
    return [(d, t) for d, t in rows if not held(words(t))]


def stage_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_and_the_whole_run_equal_plain_versions(spark, tmp_path):
    rows, labels, items = corpus()
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], fields).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    at = spark.read.parquet(f"{sf}/documents.parquet")

    kept = C.drop_toxic(spark, at, sf)
    scored = {(r.doc_id, r.text): r.score for r in toxicity.score(at, toxicity.fit(at, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    want = [(d, t) for d, t in rows if scored[d, t] < 0.3]
    assert kept.columns == docs.columns and stage_rows(kept) == sorted(want, key=str)
    assert not {d for d, _ in want} & set(range(400, 440)) and set(range(160)) <= {d for d, _ in want}

    kept = C.drop_near_copies(spark, kept, sf)
    numbered = brute([(k, t) for k, (_, t) in enumerate(want)], 5, 8, 10)
    group = {k: c for k, _, c in numbered}
    best = {}
    for k, (d, t) in enumerate(want):
        key = (NULL_ID if d is None else d, t or "")
        best[group[k]] = min(best.get(group[k], key), key)
    got = stage_rows(kept)
    worded = [x for x in got if (x[1] or "").split()]
    assert kept.columns == docs.columns and len(got) - len(worded) == sum(not (t or "").split() for _, t in want)
    assert sorted(NULL_ID if d is None else d for d, _ in worded) == sorted(k for k, t in best.values() if t.split())

    clean = C.drop_contaminated(spark, kept, sf)
    want = plain_clean(got, items)
    assert clean.columns == docs.columns and stage_rows(clean) == sorted(want, key=str)
    assert not {d for d, _ in want} & {300, 301, 302, 303, 310}
    assert stage_rows(decontaminate.keep_clean(clean.limit(0), spark.read.parquet(f"{sf}/benchmark.parquet"))) == []

    masked = C.mask_personal_data(spark, clean, sf)
    anchors = pii._automaton()
    want = sorted(((d, None if t is None else pii.masked(t, pii.spans_of(t, anchors))) for d, t in want), key=str)
    assert masked.columns == docs.columns and stage_rows(masked) == want
    assert any("[EMAIL]" in (t or "") and "[PHONE]" in t for _, t in want)
    assert all(r.n_chars == len(r.text or "") for r in masked.collect())

    with open(pieces.MODEL_PATH, "rb") as f:
        segment = pieces.Segmenter(pieces.Vocabulary(f.read()), 4)
    whole = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert len(whole) == len(want) == C.run(spark, sf).count()
    for (d, t), (found, same) in zip(want, segment.paths([t or "" for _, t in want])):
        assert whole[d].round_trip and same and whole[d].n_pieces == len(found[0][1]) and whole[d].n_best == len(found)


def test_empty_tables(spark, tmp_path):
    for name, fields in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], fields).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
