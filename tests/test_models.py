"""Scoring in order of length, and the evaluation of the supervised scorer in order of time."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tonemill import cli
from tonemill.operators import nli
from tonemill.plans import evaluation, scoring

D = dt.date


def test_batches_hold_like_lengths():
    assert nli.batches_within([], 10) == [] and nli.batches_within([50], 10) == [(0, 1)]
    assert nli.batches_within([1, 2, 3, 5, 5, 9, 20], 10) == [(0, 3), (3, 5), (5, 6), (6, 7)]
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.randrange(1, 60) for _ in range(rng.randrange(40)))
        found = nli.batches_within(lengths, 100)
        assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and (not lengths or (found[0][0], found[-1][1]) == (0, len(lengths)))
        assert all((b - a) * lengths[b - 1] <= 100 or b - a == 1 for a, b in found)


def test_length_order_saves_padding_and_changes_no_label(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["rates", "rose", "fell", "x"]) for _ in range(rng.choice([3, 5, 8, 40, 90])))) for i in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "id int, sentence string").repartition(4)
    padded = {k: spark.sparkContext.accumulator(0) for k in ("as it comes", "by length")}

    def load(name):
        def make():
            def run(premises, hypotheses):
                words = [len(p.split()) for p in premises]
                padded[name].add(max(words) * len(words))
                return [float(p.count("rose") - p.count("fell")) * (1 if "tighter" in h else -1 if "easier" in h else 0) + (0.5 if "no signal" in h else 0.0) for p, h in zip(premises, hypotheses)]

            return run

        return make

    plain = {r.id: (r.sentence, r.label) for r in nli.score_sentences(df.orderBy(F.rand(3)).repartition(4), load("as it comes"), batch=16).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = nli.score_by_length(df, load("by length"), budget=16 * 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: (r.sentence, r.label) for r in found} == plain and len(found) == len(rows)
    real = 3 * sum(len((s or "").split()) for _, s in rows)
    assert real <= padded["by length"].value < 1.05 * real + 3 * 90 * 4 and padded["by length"].value <= padded["as it comes"].value
    assert nli.score_by_length(df.limit(0), load("by length")).count() == 0


def sentences(seed, n, leak=False):
    rng = random.Random(seed)
    words = {"hawkish": ["rose", "strong", "higher"], "dovish": ["fell", "weak", "lower"], "neutral": ["met", "said", "noted"]}
    rows = []
    for i in range(n):
        label = rng.choice(list(words))
        said = rng.choice(["prices", "output", "members"]) + " " + (rng.choice(["alpha", "beta"]) if leak else rng.choice(words[label])) + f" w{rng.randrange(9)}"
        rows.append((f"v{i:03d}", f"d{i}", str(D(2001, 1, 1) + dt.timedelta(days=i)), said, label if i % 17 else None, None))
    return rows


def test_folds_learn_from_the_past_alone(spark, tmp_path):
    schema = "id string, doc_id string, release_date string, sentence string, label string, note string"
    df = spark.createDataFrame(sentences(5, 240), schema)
    found = evaluation.expanding_folds(df, 3, slots=1 << 10).collect()
    assert [r.fold for r in found] == [1, 2, 3] and all(a.first_day < b.first_day and a.n_train < b.n_train for a, b in zip(found, found[1:], strict=False))
    assert sum(r.n for r in found) + found[0].n_train == df.where("label IS NOT NULL").count() and all(r.macro_f1 > 0.8 for r in found)
    # Words that tell the label from some day on: the fold that begins there can't know them, the later ones do.
    start = found[1].first_day
    told = {"hawkish": "zeta", "dovish": "theta", "neutral": "iota"}
    leak = [(i, d, day, s + (f" {told[lab]}" if lab and dt.date.fromisoformat(day) >= start else ""), lab, n) for i, d, day, s, lab, n in sentences(6, 240, leak=True)]
    scores = {r.fold: r.macro_f1 for r in evaluation.expanding_folds(spark.createDataFrame(leak, schema), 3, slots=1 << 10).collect()}
    assert scores[2] < 0.6 < 0.8 < scores[3]
    assert evaluation.expanding_folds(df.limit(0), 3).count() == 0


def test_command_line_reaches_added_scorers(spark, tmp_path, monkeypatch):
    (tmp_path / "own_scorers.py").write_text("from pyspark.sql import functions as F\nfrom tonemill.plans import scoring\nif 'always' not in scoring.scorer_names():\n    scoring.register_scorer('always', lambda: lambda s: s.withColumn('label', F.lit('hawkish')))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    df = spark.createDataFrame(sentences(7, 60), "id string, doc_id string, release_date string, sentence string, label string, note string").where("label IS NOT NULL")
    df.write.json(str(tmp_path / "labelled"))
    cli.main(["--data", str(tmp_path), "score", "--validate", str(tmp_path / "labelled"), "--scorers", "own_scorers", "--candidates", "lexicon", "always", "supervised", "--folds", "2"])
    metrics = json.loads((tmp_path / "validation_metrics.json").read_text())
    folds = json.loads((tmp_path / "supervised_folds.json").read_text())["folds"]
    assert set(metrics["candidates"]) == {"lexicon", "always"} and [f["fold"] for f in folds] == [1, 2] and "always" in scoring.scorer_names()
