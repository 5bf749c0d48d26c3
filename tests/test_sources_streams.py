"""The page source, the look-up by roles, counts made while writing, and tone changes on a stream."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonemill import queries as registered
from tonemill.functions import clean
from tonemill.operators import report, tone
from tonemill.plans import ingest
from tonemill.sources import page_source, pages
from tonemill.streaming import changes

D = dt.date


def folder_of(path, files):
    path.mkdir(exist_ok=True)
    for name, body in files.items():
        (path / name).write_bytes(body)
    return str(path)


FILES = {"a.htm": "plain".encode(), "b_1.htm": "“é” – ok".encode(), "c.htm": b"old \x93quoted\x94 \x81 \xe9", "gone.404": b"", "late.404": b"seen", "empty.htm": b"", "_hidden": b"x", ".dot": b"x", "big.htm": "<p>ü".encode() * 400_000}


def test_page_source_equals_read_pages(spark, tmp_path):
    path = folder_of(tmp_path / "pages", FILES)
    page_source.register(spark)
    want = sorted(map(tuple, pages.read_pages(spark, path).collect()))
    for options in ({}, {"partitionBytes": "1"}):
        read = spark.read.format("pages").options(**options).load(path)
        assert sorted(map(tuple, read.collect())) == want and len(want) == 6
    assert read.rdd.getNumPartitions() == 6
    assert spark.read.format("pages").load(f"file://{path}").count() == 6
    empty = folder_of(tmp_path / "none", {})
    assert spark.read.format("pages").load(empty).count() == 0


def test_page_source_reads_only_asked_keys(spark, tmp_path):
    path = folder_of(tmp_path / "pages", FILES)
    page_source.register(spark)
    read = spark.read.format("pages").load(path)
    asked = read.where(F.col("key").isin("a.htm", "gone", "nowhere"))
    assert {(r.key, r.html) for r in asked.collect()} == {("a.htm", "plain"), ("gone", None)}
    # The other pages are not even opened.
    for name in FILES:
        if name not in ("a.htm", "gone.404") and not name.startswith(("_", ".")):
            os.chmod(f"{path}/{name}", 0)
            os.rename(f"{path}/{name}", f"{path}/.{name}")
            os.mkdir(f"{path}/{name}")
    assert asked.count() == 2 and read.where("key = 'a.htm' AND html LIKE '%lai%'").count() == 1 and read.where("key = 'b_1.htm'").count() == 0
    reader = page_source.PageReader({"path": path})
    left = list(reader.pushFilters([page_source.EqualTo(("key",), "a.htm"), page_source.EqualTo(("html",), "plain"), page_source.In(("key",), ("a.htm", "late"))]))
    assert [f.attribute for f in left] == [("html",)] and reader.keys == {"a.htm"} and [p.names for p in reader.partitions()] == [["a.htm"]]


def test_page_stream_reads_each_page_once(spark, tmp_path):
    page_source.register(spark)
    path, out, mark = folder_of(tmp_path / "pages", {"a.htm": b"1", "b.404": b""}), str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        spark.readStream.format("pages").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)

    assert run() == [("a.htm", "1"), ("b", None)]
    assert run() == [("a.htm", "1"), ("b", None)]
    folder_of(tmp_path / "pages", {"c.htm": b"3"})
    assert run() == [("a.htm", "1"), ("b", None), ("c.htm", "3")]


def test_roles_are_looked_up_in_one_join(spark):
    store = spark.createDataFrame([("x_a", "A"), ("x_b", "B"), ("x_gone", None), ("x_c", "C")], "key string, html string")
    rows = spark.createDataFrame([(1, None, "/x/a", ["/x/b", "/x/gone", "/x/c"]), (1, "t", None, None), (2, "t", "/x/none", ["/x/c", None, "/x/b"]), (3, "t", "/x/a", [])], "id int, tag string, one string, many array<string>")
    found = pages.look_up_roles(rows, ["id", "tag"], {"single": F.array("one"), "row": F.col("many")}, store)
    got = {(r.id, r.tag): ([x.page for x in r.single], [(x.k, x.url, x.page) for x in r.row]) for r in found.collect()}
    assert got == {(1, None): (["A"], [(0, "/x/b", "B"), (2, "/x/c", "C")]), (1, "t"): ([], []), (2, "t"): ([], [(0, "/x/c", "C"), (2, "/x/b", "B")]), (3, "t"): (["A"], [])}
    assert found.columns == ["id", "tag", "one", "many", "single", "row"]
    assert pages.look_up_roles(rows.limit(0), ["id", "tag"], {"single": F.array("one")}, store).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def meetings_and_pages(spark):
    meetings = spark.createDataFrame(
        [(D(2001, 1, 30), D(2001, 1, 31), "scheduled", True, "January", "/s/1", "/m/1", D(2001, 2, 20)), (D(2001, 3, 2), D(2001, 3, 2), "unscheduled", False, "March", "/s/2", None, None), (D(2001, 5, 2), D(2001, 5, 2), "scheduled", True, "May", None, "/m/3", D(2001, 6, 1))],
        "meeting_start date, meeting_end date, event_type string, scheduled boolean, label string, statement_url string, minutes_url string, minutes_release_date date",
    )
    statement = "<body><p>January 31, 2001<p>For immediate release<p>The Committee decided to raise the rate today.<p>Inflation rose again and stays elevated here.<p>Short line</body>"
    minutes = "<body><p>Present: Able<p>The information reviewed at this meeting showed that activity grew at a solid pace again.<p>Too short to keep</body>"
    made = [("s_1", statement), ("s_2", statement), ("m_1", minutes), ("m_3", minutes), ("newsevents_pressreleases_monetary20010220a.htm", "<p>Minutes of the Federal Open Market Committee<p>For release at 2:00 p.m. EST")]
    return meetings, spark.createDataFrame([*made, *((f"other{i}", "<p>Other page") for i in range(20))], "key string, html string")


def test_ingest_joins_and_cleans_each_page_once(spark):
    meetings, store = meetings_and_pages(spark)
    documents, stripped = ingest.build_documents(meetings, store)
    for df in documents, stripped:
        plan = _plan(df)
        assert plan.count("Join Inner") == 1, plan  # the page table is joined once, for all roles
        assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line and "stripped" in line)
    assert {r.doc_id: r.time_source for r in documents.collect()} == {"statement_2001-01-31_scheduled": "unverified", "statement_2001-01-31_unscheduled": "unverified", "minutes_2001-01-31_scheduled": "minutes_press_release", "minutes_2001-05-02_scheduled": "unverified"}


def test_rule_queries_clean_once(spark):
    for name, fold in (("minutes_rules", 1), ("printed_minutes_rules", 1)):
        plan = _plan(registered.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("aggregate(") == fold, name
    for name in ("statement_rules", "announcement_rules", "minutes_rules", "printed_minutes_rules"):
        plan = _plan(registered.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not any("Filter" in line and "size(" in line for line in plan.splitlines()), name


def test_counts_are_made_while_writing(spark, tmp_path):
    meetings, store = meetings_and_pages(spark)
    at = str(tmp_path)
    counts = ingest.store_documents(meetings, store, f"{at}/documents", f"{at}/stripped")
    documents, stripped = spark.read.parquet(f"{at}/documents"), spark.read.parquet(f"{at}/stripped")
    built, log = ingest.build_documents(meetings, store)
    assert sorted(map(repr, documents.collect())) == sorted(map(repr, built.collect())) and sorted(map(repr, stripped.collect())) == sorted(map(repr, log.collect()))
    audit = {(r["rule"], r["n"], r["chars"]) for r in counts["stripped"]}
    assert audit == {tuple(r) for r in report.rule_audit(stripped).collect()} and len(audit) >= 3
    assert (counts["documents"], counts["statement"], counts["minutes"], counts["words"]) == (4, 2, 2, documents.agg(F.sum("n_words")).first()[0])
    assert counts["sentences"] == sum(len(r.s) for r in documents.select(registered.text.scoring_sentences(F.col("clean_text")).alias("s")).collect()) and not os.path.exists(f"{at}/documents.cleaned")
    seen = Observation()
    empty = spark.createDataFrame([], "log array<struct<rule:string,text:string>>")
    empty.observe(seen, *report.rule_counts(F.col("log"), clean.RULES)).collect()
    assert report.audit_of(seen.get, clean.RULES) == []


# Tone changes on a stream


def change_rows(seed, n=60):
    rng = random.Random(seed)
    days = [D(2020, 1, 1) + dt.timedelta(days=rng.randrange(300)) for _ in range(n)]
    return [(f"d{i:03d}", rng.choice(["statement", "minutes", None]), day, rng.random() < 0.8, rng.choice([None, 0.25, -0.5, 1.0, 0.0])) for i, day in enumerate(sorted(days))]


SCORED = "doc_id string, doc_type string, release_date date, scheduled boolean, score double"


def test_streamed_changes_equal_the_batch(spark, tmp_path):
    """Three drops, in each some documents that belong into the one before; the run is started anew for each, so its state comes from the checkpoint."""
    rows = change_rows(3)
    rng = random.Random(4)
    # A document comes at most 29 days after its date, as the days of others go: within the delay of 30.
    arrival = sorted(rows, key=lambda r: (r[2] + dt.timedelta(days=rng.randrange(30)), r[0]))
    third = len(rows) // 3
    drops = [arrival[:third], arrival[third : 2 * third], arrival[2 * third :]]
    closing = [(None, kind, D(2030, 1, 1), True, None) for kind in ("statement", "minutes", None)]
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    published = []
    for drop in [*drops, closing]:
        spark.createDataFrame(drop, SCORED).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCORED).parquet(landing)
        changes.change_stream(stream, ["doc_type"], "30 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        published.append(spark.read.parquet(out).count())
    assert 0 < published[0] < published[1] < published[2] < published[3] == len(rows)
    assert max(drops[0], key=lambda r: r[2])[2] > min(drops[1], key=lambda r: r[2])[2]  # some did come late
    batch = tone.tone_change(spark.createDataFrame(rows, SCORED), ["doc_type"])
    want = {r.doc_id: r.tone_change for r in batch.collect()}
    got = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert {k: r.tone_change for k, r in got.items()} == want and not any(r.late for r in got.values())
    assert {(r.doc_id, r.doc_type, r.release_date, r.scheduled, r.score) for r in got.values()} == set(rows)


def test_what_comes_too_late_is_published_without_a_change():
    empty = (None, None, None, None, [], [], [])
    day = 86_400_000_000
    state, out = changes.publish(empty, [(10 * day, "a", 1.0), (20 * day, "b", 3.0), (50 * day, "c", 4.0)], 30 * day)
    assert out == [("a", 10 * day, 1.0, None, False), ("b", 20 * day, 3.0, 2.0, False)] and state[4:] == ([50 * day], ["c"], [4.0])
    state, out = changes.publish(state, [(15 * day, "x", 9.0), (None, "y", 9.0), (20 * day, "b2", 5.0), (30 * day, "e", 6.0)], 30 * day)
    assert out == [("x", 15 * day, 9.0, None, True), ("y", None, 9.0, None, True), ("b2", 20 * day, 5.0, 2.0, False)] and state[5] == ["e", "c"]
    state, out = changes.publish(state, [(500 * day, None, None)], 30 * day)
    assert out == [("e", 30 * day, 6.0, 1.0, False), ("c", 50 * day, 4.0, -2.0, False)] and state[4:] == ([], [], [])
    assert changes.publish(state, [], 30 * day) == (state, [])


def test_state_holds_one_delay_of_documents():
    state, day = (None, None, None, None, [], [], []), 86_400_000_000
    for k in range(2000):
        state, _ = changes.publish(state, [(k * day, f"d{k:05d}", math.sin(k))], 30 * day)
        assert len(state[4]) <= 31


@pytest.mark.parametrize("name", ["pages_by_role", "streamed_changes", "press_releases", "announcement_rules"])
def test_registered_queries_agree_with_sql(spark, name):
    import duckdb

    from tonemill.oracle import ORACLE_SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, want = registered.QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    key = lambda r: repr([round(v, 6) if isinstance(v, float) else v for v in r])
    at = [want.columns.index(c) for c in order]
    assert sorted(key([r[c] for c in order]) for r in found.collect()) == sorted(key([r[i] for i in at]) for r in want.fetchall())
