"""Tone, metrics, reports, samples, models, plans, streaming, sinks."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonemill import queries as registered
from tonemill import streaming
from tonemill.operators import metrics, nli, report, sampling, tone
from tonemill.plans import ingest, scoring
from tonemill.sources import pages as store

D = dt.date
DOCS = [
    ("a", "statement", D(2001, 1, 1), True, "Inflation rose very sharply. Growth is strong now."),
    ("b", "statement", D(2001, 2, 1), False, "Activity weakened a lot."),
    ("c", "statement", D(2001, 3, 1), True, "Too short."),
    ("d", "statement", D(2001, 4, 1), True, "Demand declined further. The meeting was on Tuesday."),
    ("e", "statement", D(2001, 5, 1), True, "Prices rose again today."),
    ("f", "minutes", D(2001, 5, 1), True, None),
]
SCHEMA = "doc_id string, doc_type string, release_date date, scheduled boolean, clean_text string"


def test_document_scores_and_changes(spark):
    scored, sentences = scoring.score_documents(spark.createDataFrame(DOCS, SCHEMA), "statement")
    out = {r.doc_id: (r.n_sentences, r.n_hawkish, r.n_dovish, r.score, r.tone_change) for r in scored.collect()}
    assert out == {"a": (2, 2, 0, 1.0, None), "b": (1, 0, 1, -1.0, None), "c": (0, 0, 0, None, None), "d": (2, 0, 1, -0.5, None), "e": (1, 1, 0, 1.0, 1.5)}
    assert [(r.doc_id, r.i, r.label) for r in sentences.orderBy("doc_id", "i").collect()][:2] == [("a", 0, "hawkish"), ("a", 1, "hawkish")]
    since, _ = scoring.score_documents(spark.createDataFrame(DOCS, SCHEMA), "statement", D(2001, 4, 1))
    assert since.count() == 2


def test_model_scorer_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def model(premises, hypotheses):
            assert len(premises) == len(hypotheses) <= 48
            return [float(("up" in p) and "tighter" in h) - float("no signal" in h) * ("up" in p) for p, h in zip(premises, hypotheses)]

        return model

    docs = spark.createDataFrame([(f"d{i}", "statement", D(2001, 1, 1 + i), True, "It goes up now. It goes down now.") for i in range(6)], SCHEMA)
    run = scoring.scorer("stub", lambda name: load)
    first, sentences = scoring.score_with_model(spark, docs, "statement", run, str(tmp_path / "partial"), batch=2)
    assert {(r.n_sentences, r.n_hawkish) for r in first.collect()} == {(2, 2)} and sentences.count() == 12  # ties go to the first label
    broken = lambda df: (_ for _ in ()).throw(AssertionError("scored again"))
    again, _ = scoring.score_with_model(spark, docs, "statement", broken, str(tmp_path / "partial"), batch=2)
    assert again.count() == 6


def test_a_resumed_run_is_as_one_run_whatever_changed(spark, tmp_path):
    seen = []

    def run(df):
        rows = df.collect()
        seen.append({r.doc_id for r in rows})
        return df.withColumn("label", F.when(F.col("sentence").contains("up"), "hawkish").otherwise("dovish"))

    def table(texts):
        return spark.createDataFrame([(k, "statement", D(2001, 1, 1 + i), True, t) for i, (k, t) in enumerate(sorted(texts.items()))], SCHEMA)

    texts = {f"d{i}": f"It goes up {i} now. It goes down now." for i in range(6)} | {"none": "", "null": None}
    partial = str(tmp_path / "partial")
    scoring.score_with_model(spark, table(texts), "statement", run, partial, batch=3)
    # A batch that was not written to its end counts for nothing.
    (tmp_path / "partial" / "batch-broken").mkdir()
    spark.createDataFrame([("d9", 1, 0, "It goes up.", "hawkish")], scoring.PARTIAL).write.mode("overwrite").parquet(str(tmp_path / "partial" / "batch-broken"))
    (tmp_path / "partial" / "batch-broken" / "_SUCCESS").unlink()
    texts = {k: t for k, t in texts.items() if k not in ("d0", "d1")} | {"d2": "All is up and up.", "d7": "New one is up.", "d8": "New one goes down. And up it goes.", "d9": "It goes down."}
    seen.clear()
    scored, sentences = scoring.score_with_model(spark, table(texts), "statement", run, partial, batch=2)
    got, words = sorted(map(tuple, scored.collect())), sorted(map(tuple, sentences.collect()))
    assert set().union(*seen) == {"d2", "d7", "d8", "d9"}
    once, each = scoring.score_with_model(spark, table(texts), "statement", run, str(tmp_path / "other"), batch=100)
    assert got == sorted(map(tuple, once.collect())) and words == sorted(map(tuple, each.collect()))
    scoring.forget(spark, partial)
    assert not (tmp_path / "partial").exists() and scoring.scored_so_far(spark, partial).count() == 0


def test_scorers_can_be_added(spark):
    scoring.register_scorer("shout", lambda: lambda df: df.withColumn("label", F.when(F.col("sentence").endswith("!"), "hawkish").otherwise("neutral")))
    df = spark.createDataFrame([(1, "Up!"), (2, "Down.")], "id int, sentence string")
    assert "shout" in scoring.scorer_names() and [r.label for r in scoring.scorer("shout")(df).orderBy("id").collect()] == ["hawkish", "neutral"]
    with pytest.raises(ValueError):
        scoring.register_scorer("lexicon", lambda: None)


def test_supervised_scorer_learns_its_labels(spark):
    from tonemill.operators import supervised

    rows = [(f"{a} {b} {c}", label) for label, bs in (("hawkish", ("rose", "climbed")), ("dovish", ("fell", "slipped")), ("neutral", ("stayed", "remained"))) for a in ("Inflation", "Output", "Demand") for b in bs for c in ("again", "today", "this year")]
    train, held = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    model = supervised.train(spark.createDataFrame([*train, ("no label", None)], "sentence string, label string"), slots=256)
    out = supervised.scorer(model)(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(held)] + [(99, None)], "i int, sentence string"))
    got = {r.i: r.label for r in out.collect()}
    assert out.columns == ["i", "sentence", "label"] and [got[i] for i in range(len(held))] == [label for _, label in held] and got[99] in ("hawkish", "dovish", "neutral")


def test_missing_marks_without_a_byte_are_known(spark, tmp_path):
    (tmp_path / "a.htm").write_text("<p>x")
    (tmp_path / "b.htm.404").touch()
    (tmp_path / "c.htm.404").write_text("gone")
    assert sorted((r.key, r.html) for r in store.read_pages(spark, str(tmp_path)).collect()) == [("a.htm", "<p>x"), ("b.htm", None), ("c.htm", None)]
    urls = spark.createDataFrame([("/a.htm",), ("/b.htm",), ("/d.htm",)], "u string")
    assert tuple(store.fetch_counts(urls, store.read_pages(spark, str(tmp_path)), "u").first()) == (1, 1, 1)


def test_unreadable_meetings_fail_or_are_listed(spark):
    page = '<div class="panel"><h5>Jan x Meeting - 2001</h5></div><div class="panel"><h5>March 5 Meeting - 2001</h5></div>'
    calendars = spark.createDataFrame([(0, 2001, "/c", "archive", page)], "ord int, year int, url string, kind string, html string")
    with pytest.raises(Exception, match="unreadable meeting dates: Jan x Meeting"):
        ingest.load_meetings(calendars, D(2001, 12, 31)).collect()
    assert [r.label for r in ingest.load_meetings(calendars, D(2001, 12, 31), strict=False).collect()] == ["March 5 Meeting - 2001"]
    assert [tuple(r) for r in ingest.unreadable_meetings(calendars).collect()] == [("/c", "Jan x Meeting - 2001", 2001)]


def test_summaries_of_validation_and_checks(spark, tmp_path):
    from tonemill.sources import files

    rows = [("1", "hawkish", "Inflation rose."), ("2", "dovish", "Activity is weak."), ("3", "neutral", "Rates were increased.")]
    gold = spark.createDataFrame(rows, "id string, label string, sentence string")
    found = scoring.validation_summary(scoring.validate(gold, {"lexicon": scoring.scorer("lexicon")}), ["lexicon"])
    assert found["candidates"]["lexicon"]["confusion_gold_by_pred"]["neutral"] == {"hawkish": 1, "dovish": 0, "neutral": 0} and "primary" not in found
    assert found["majority_class_accuracy"] == pytest.approx(1 / 3)
    files.write_text(spark, str(tmp_path / "x.json"), "{}\n")
    assert (tmp_path / "x.json").read_text() == "{}\n" and files.names(spark, str(tmp_path), ".json") == ["x.json"]


def test_softmax_and_entailment(spark):
    row = spark.createDataFrame([([2.0, 1.0, 2.0],)], "l array<double>").select(nli.softmax(F.col("l")).alias("p")).withColumn("label", nli.argmax_label(F.col("p"))).first()
    e = [math.exp(x - 2) for x in (2, 1, 2)]
    assert row.p == pytest.approx([x / sum(e) for x in e]) and row.label == "hawkish"
    assert nli.entailment_index({0: "Neutral", "1": "ENTAILMENT"}) == 1
    with pytest.raises(ValueError):
        nli.entailment_index({0: "x"})


def test_metrics(spark):
    pairs = spark.createDataFrame([("hawkish", "hawkish"), ("dovish", "hawkish"), ("neutral", "neutral"), ("dovish", "dovish")], "gold string, pred string")
    counts = metrics.confusion(pairs)
    assert counts.count() == 9 and counts.agg(F.sum("n")).first()[0] == 4
    m = metrics.agreement(counts).first()
    assert m.accuracy == 0.75 and m.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 1) / 3) and m.kappa == pytest.approx((0.75 - 0.3125) / 0.6875)
    assert metrics.majority_share(pairs).first()[0] == 0.5
    same = metrics.agreement(metrics.confusion(spark.createDataFrame([("dovish", "dovish")], "gold string, pred string"))).first()
    assert (same.kappa, same.macro_f1) == (0.0, pytest.approx(1 / 3))
    with pytest.raises(PySparkException):
        metrics.confusion(spark.createDataFrame([("odd", "dovish")], "gold string, pred string")).collect()


@pytest.mark.parametrize(("scores", "want"), [((0.70, 0.71, 0.72), "lexicon"), ((0.60, 0.71, 0.72), "zs-base"), ((0.6, 0.6, 0.72), "zs-large"), ((0.70, 0.71), None)])
def test_choice(spark, scores, want):
    df = spark.createDataFrame(list(zip(metrics.CANDIDATES, scores)), "scorer string, macro_f1 double")
    assert metrics.choose(df).first()[0] == want


def test_reports(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (None, 9.0), (3.0, 5.9)], "a double, b double")
    assert df.agg(report.correlation("a", "b").alias("c")).first().c == pytest.approx(3.9 / math.sqrt(2 * 7.62))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(report.correlation("a", "b").alias("c")).first().c is None
    first = report.keep_first(spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "k string, o int, v string"), ["k"], ["o"]).first()
    assert first.v == "early" and first.asDict().keys() == {"k", "o", "v"}


def test_changes_span_gaps(spark):
    rows = [("s", i, c, v) for i, (c, v) in enumerate([(None, 1.0), (0.1, 2.0), (None, 9.0), (0.3, 5.0)])]
    out = report.changes_after_filter(spark.createDataFrame(rows, "s string, d int, tone_change double, lexicon double"), ["s"], date_col="d", id_col="d").collect()
    assert [(r.d, r.lexicon_change) for r in out] == [(3, 3.0)]


def test_samples_and_orders(spark):
    docs = spark.createDataFrame([(f"d{i}", D(2001, 1, 1) + dt.timedelta(i), [f"s{i}a", f"s{i}b"]) for i in range(20)], "doc_id string, release_date date, s array<string>")
    a, b = (sampling.sentence_sample(docs.repartition(n), F.col("s"), 5).collect() for n in (1, 7))
    assert a == b and [r.id for r in a] == [f"v{i:03d}" for i in range(1, 6)] and len({r.doc_id for r in a}) == 5
    with pytest.raises(ValueError):
        sampling.exact_sample(docs, 21)
    row = spark.createDataFrame([(["ccc", "a", "bb", "d"],)], "t array<string>").select("t", sampling.length_order(F.col("t")).alias("o")).withColumn("back", sampling.restore_order(F.transform("o", lambda i: F.get("t", i)), F.col("o"))).first()
    assert row.o == [1, 3, 2, 0] and row.back == row.t


ARCHIVE = """<div class="panel"><h5>January 30-31 Meeting - 2001</h5><a href="/fomc/20010131default.htm">Statement</a><a href="/fomc/minutes/20010131.htm">Minutes</a> (Released February 20, 2001)</div>
<div class="panel"><h5>March 2 (unscheduled) Meeting - 2001</h5><a href="/boarddocs/press/general/2001/20010302/">Statement</a></div>"""
STATEMENT = "<body><p>January 31, 2001<p>For immediate release<p>The Committee decided to raise the rate today.<p>Inflation rose again and stays elevated here.</body>"
MINUTES = "<body><p>Present: Able<p>The information reviewed at this meeting showed that activity grew at a solid pace again.<p>the statement below to be released at 2:15 p.m. was approved by all of them.</body>"
PRESS = '<div id="article"><p>Minutes of the Federal Open Market Committee<p>For release at 2:00 p.m. EST</div>'


def test_ingest_end_to_end(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for name, body in {
        "monetarypolicy_fomchistorical2001.htm": ARCHIVE, "fomc_20010131default.htm": STATEMENT, "fomc_minutes_20010131.htm": MINUTES,
        "newsevents_pressreleases_monetary20010220a.htm": "<p>Other news", "newsevents_pressreleases_monetary20010220b.htm": PRESS, "boarddocs_press_general_2001_20010302.404": "gone",
    }.items():
        (folder / name).write_text(body, encoding="utf-8")
    pages = store.read_pages(spark, str(folder))
    calendars = store.look_up(store.calendar_urls(spark, 2001, 2001), pages, "url", "html")
    meetings = ingest.load_meetings(calendars, D(2001, 12, 31))
    assert [(r.label, r.event_type, r.meeting_end) for r in meetings.collect()] == [("January 30-31 Meeting - 2001", "scheduled", D(2001, 1, 31)), ("March 2 (unscheduled) Meeting - 2001", "unscheduled", D(2001, 3, 2))]
    documents, stripped = ingest.build_documents(meetings, pages)
    st, mn = sorted(documents.collect(), key=lambda r: r.doc_type, reverse=True)
    assert (st.doc_id, st.release_date_check, st.release_time_et, st.time_source, st.n_words) == ("statement_2001-01-31_scheduled", "ok", 855, "minutes", 15)
    assert (mn.doc_id, mn.release_time_et, mn.time_source, mn.release_date) == ("minutes_2001-01-31_scheduled", 840, "minutes_press_release", D(2001, 2, 20))
    assert mn.time_note == " [/newsevents/pressreleases/monetary20010220b.htm]" and mn.release_datetime == dt.datetime(2001, 2, 20, 19, 0)
    assert {r.rule for r in stripped.collect()} == {"header", "header_attendance"}
    for table in ingest.summarise(meetings, documents, stripped).values():
        table.collect()
    counts = store.fetch_counts(meetings.where("statement_url IS NOT NULL").select("statement_url"), pages, "statement_url").first()
    assert tuple(counts) == (1, 1, 0)
    tone_rows, _ = scoring.score_documents(documents, "statement")
    by_decision, both, series = scoring.check_tone(documents, tone_rows, tone_rows)
    assert [tuple(r) for r in by_decision.collect()] == [("raise", 1, 1.0)] and tuple(both.first()) == (None, None) and series.count() == 1


def test_validation_and_sinks(spark, tmp_path):
    rows = [("v001", "d1", "2001-01-01", 'Inflation, "so to say", rose again.', "hawkish", None), ("v002", "d2", "2001-01-02", "Activity is weak now.", "neutral", None)]
    labelled = spark.createDataFrame(rows, store.SENTENCES)
    wide, results, majority, primary = scoring.validate(labelled, {"lexicon": scoring.scorer("lexicon")})
    store.write_predictions(wide, str(tmp_path / "p"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "p")).orderBy("id").collect()
    assert [(r.gold, r.pred_lexicon) for r in back] == [("hawkish", "hawkish"), ("neutral", "dovish")] and back[0].sentence == rows[0][3]
    assert results.first().accuracy == 0.5 and majority.first()[0] == 0.5 and primary.first()[0] is None
    store.write_sentences(labelled, str(tmp_path / "s"))
    assert store.read_sentences(spark, str(tmp_path / "s")).count() == 2 and '"note":null' in spark.read.text(str(tmp_path / "s")).first()[0]
    with pytest.raises(PySparkException):
        store.write_sentences(labelled, str(tmp_path / "s"))
    assert store.as_json(results).count() == 1


def test_stream_scores_each_file_once(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    docs = spark.createDataFrame(DOCS, SCHEMA)
    for part in ("a", "b"):
        docs.where(F.col("doc_id") == part).write.mode("append").parquet(landing)
        streaming.score_new(streaming.read_documents(spark, landing, docs.schema), out, mark).awaitTermination()
    assert sorted((r.doc_id, r.score) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", -1.0)]


def test_holm_and_returns(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert sorted((r.p, round(r.p_holm, 6)) for r in scoring.holm(p).collect()) == [(0.01, 0.03), (0.03, 0.06), (0.04, 0.06)]
    prices = spark.createDataFrame([("x", i, float(2**i)) for i in range(4)], "asset string, day int, close double")
    assert scoring.event_returns(prices, (0, 1)).where("day = 1").first().ret_1 == pytest.approx(2 * math.log(2))


@pytest.mark.parametrize("name", ["doc_tone", "confusion_matrix", "minutes_rules", "page_keys", "date_spans", "latch_state"])
def test_registered_queries_agree_with_sql(spark, name):
    import duckdb

    from tonemill.oracle import ORACLE_SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "orders", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = registered.QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    key = lambda r: repr([round(v, 6) if isinstance(v, float) else v for v in r])
    at = [want.columns.index(c) for c in order]
    assert sorted(key([r[c] for c in order]) for r in found.collect()) == sorted(key([r[i] for i in at]) for r in want.fetchall())


def test_study(spark):
    import numpy as np

    from tonemill.plans import study

    days = spark.createDataFrame([(D(2001, 1, d),) for d in (1, 2, 3, 8, 9)], "day date")
    events = spark.createDataFrame([("a", D(2001, 1, 2)), ("b", D(2001, 1, 4)), ("c", D(2001, 2, 1))], "doc_id string, release_date date")
    assert {r.doc_id: r.trading_day for r in study.align_to_days(events, days).collect()} == {"a": D(2001, 1, 2), "b": D(2001, 1, 8), "c": None}
    assert [r.day for r in study.placebo_days(days, study.align_to_days(events, days), 9).orderBy("day").collect()] == [D(2001, 1, d) for d in (1, 3, 9)]

    rng = np.random.default_rng(1)
    x = np.c_[np.ones(80), rng.normal(size=(80, 2))]
    y = x @ [0.5, 2.0, -1.0] + rng.normal(size=80) * (1 + abs(x[:, 1]))
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((_, a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    se = np.sqrt(np.diag(inv @ (x.T * e**2 @ x) @ inv * 80 / 77))
    out = study.ols_hc1(df, "y", ["a", "b"])
    assert [r["coef"] for r in out] == pytest.approx(list(beta)) and [r["se"] for r in out] == pytest.approx(list(se))
    slopes = study.bootstrap_slopes(df, "y", "a", "id", 50)
    assert slopes.count() == 50 and abs(slopes.agg(F.avg("slope")).first()[0] - np.polyfit(x[:, 1], y, 1)[0]) < 0.3
