"""Cleaning rules with their log, and HTML."""

from pyspark.sql import functions as F

from tonemill.functions import clean
from tonemill.functions.html import archive_entries, html_to_paragraphs, links, parse, recent_entries

SITE = "www.example.gov"


def _clean(spark, make, paras):
    row = spark.createDataFrame([(paras,)], "ps array<string>").select(make(F.col("ps")).alias("c")).first().c
    return row.kept, [tuple(x) for x in row.stripped]


def test_statement(spark):
    paras = ["Press Release", "For immediate release", "The economy grows at a moderate pace now.", "Voting for the action were: A; B.", "For media inquiries call 202-452-1234.", "Share",
             "In taking the action the Board approved requests submitted by the Boards of Directors of two Banks. Inflation stays low and stable.", "2010 Monetary policy", "Home"]
    kept, log = _clean(spark, clean.clean_statement, paras)
    assert kept == ["The economy grows at a moderate pace now.", "Inflation stays low and stable."]
    assert [r for r, _ in log] == ["header", "header", "footer", "footer", "voting", "media_contact", "fragment", "discount_approval"]


def test_statement_without_start_and_empty(spark):
    assert _clean(spark, clean.clean_statement, ["One two three four five six."]) == (["One two three four five six."], [])
    assert _clean(spark, clean.clean_statement, []) == ([], [])


def test_minutes(spark):
    paras = ["Present: Ms. Able, Chair", "Mr. Baker, Mr. Charlie, Ms. Delta;", "The Committee discussed a special topic at length before the usual reports were given to it.",
             "The information reviewed at this meeting suggested that activity was growing at a moderate pace.", '"Quoted text opens here and goes on', "still inside the quotation for a while now and longer", 'and now it ends."',
             "Voting for this action: Messrs. Able", "Ms. Able and Mr. Baker", "The discussion then went on for quite some time among all of the members.", "Short one.", "A heading of nine words with no stop here",
             "It was agreed that the next meeting would be held soon.", "Signed"]
    kept, log = _clean(spark, clean.clean_minutes, paras)
    assert kept == [paras[2], paras[3], paras[9]]
    assert [r for r, _ in log] == ["tail", "tail", "header_attendance", "header_attendance", *["quoted_statement_or_directive"] * 3, "voting", "voting", "fragment", "heading"]


def test_minutes_without_anchor(spark):
    kept, log = _clean(spark, clean.clean_minutes, ["a b c d e f g h i j k l m n o p."])
    assert kept and log == [("warning", "no start anchor found")]


def test_latches_against_the_recurrence(spark):
    from itertools import product

    words = {"o": '"opens', "c": 'closes"', "v": "Voting for it", "n": "Able Baker", "x": "other words"}
    runs = ["".join(p) for p in product("ocvnx", repeat=4)]
    df = spark.createDataFrame([(r, [words[k] for k in r]) for r in runs], "r string, ps array<string>")
    for row in df.select("r", clean.latches(F.col("ps")).alias("s")).collect():
        quote = vote = False
        for k, s in zip(row.r, row.s):
            quoted = quote or k == "o"
            if quoted:
                quote = k != "c"
                voting = False
            else:
                voting = k == "v" or (k == "n" and vote)
                vote = voting
            assert (s.quoted, s.voting) == (quoted, voting), row.r


def test_short_ways_find_what_the_patterns_find(evaluate):
    from tonemill.functions import text

    # A text that each alternative finds, and near misses.
    found = ["authorize", "Directive", "a directive", "Rules of x", "Rule Regarding", "advice of the election", "advices of the election", "were elected.", "reelected", "foreign currency", "Chair shall", "Chairman shall go", "a\nb:", "end:", "end: ", "", "Federal Reserve Bank of A;",
             "Federal Reserve Bank of St. Louis;", "Governors;", "Governors", "accounts at foreign", "accounts at home", "he shall", *clean.ORGANISATIONAL_PARTS, "foreign central banks", "Permitted Foreign Securities", "disorderly market conditions"]
    assert evaluate(clean.organisational, found) == evaluate(lambda c: c.rlike(clean.MINUTES_ORGANISATIONAL), found)
    spaced = ["a.", "a. ", "a.\u00a0\n", "a .b", " ", "", "a”", "a” \u2003", "a.x ", "“"]
    assert evaluate(lambda c: text.ends_with_any(c, [".", "”"]), spaced) == [t.rstrip().endswith((".", "”")) for t in spaced]
    assert evaluate(text.collapse, ["a  b", " a\tb ", "a\u00a0b", "a b", "\u2003", "a \n b  c d"]) == ["a b", "a b", "a b", "a b", "", "a b c d"]
    for n in (1, 2, 8):
        texts = [" " * k + sep.join("w" * k) for k in range(10) for sep in (" ", "\u00a0\n", "\t")]
        assert evaluate(lambda c, n=n: clean._has_words(c, n), [None, *texts]) == [False, *[len(t.split()) >= n for t in texts]]


def test_counts_of_rows_sum_to_the_rules(spark):
    from tonemill.operators import report

    df = spark.createDataFrame([([("a", "xx"), ("b", None), ("a", "y")],), ([],), ([("b", "zzz")],)], "log array<struct<rule:string,text:string>>")
    made = df.withColumn("counts", report.row_counts(F.col("log"), ("a", "b", "c"))).agg(*report.summed_counts("counts", ("a", "b", "c"))).first().asDict()
    assert made == df.agg(*report.rule_counts(F.col("log"), ("a", "b", "c"))).first().asDict()
    assert report.audit_of(made, ("a", "b", "c")) == [{"rule": "a", "n": 2, "chars": 3}, {"rule": "b", "n": 2, "chars": 3}]


def test_paragraphs():
    old = "<html><body><p>First line\nwraps here <p>Second<br>third<script>x()</script><!-- no --><span>&amp; more</span></body></html>"
    assert html_to_paragraphs(old) == ["First line wraps here", "Second", "third& more"]
    new = '<body><nav>menu</nav><div id="article"><h3>Title</h3>text <span><p>in</span>out</div><footer>f</footer></body>'
    assert html_to_paragraphs(new) == ["Title", "text", "in", "out"]
    assert html_to_paragraphs(new, prefer_article=False) == ["menu", "Title", "text", "in", "out", "f"]
    assert html_to_paragraphs(None) == html_to_paragraphs("") == []
    assert html_to_paragraphs("plain  text") == ["plain text"]


def test_open_references():
    page = "<body><p>a&amp</p><p>b &amp;amp &copy; &copy2 &AMP; &#38 &#38;</p><p>x &notit; & y &&amp;</p>"
    assert html_to_paragraphs(page) == ["a&", "b &amp © ©2 & & &", "x ¬it; & y &&"]
    assert html_to_paragraphs(page, open_references=False) == ["a&amp", "b &amp © &copy2 & &#38 &", "x &notit; & y &&"]


def test_the_query_leaves_open_references(spark, tmp_path):
    from tonemill import queries

    spark.createDataFrame([(1, "<body><p>and&amp</p> A &amp; B</body>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [(r.i, r.paragraph) for r in queries.html_paragraphs(spark, str(tmp_path)).orderBy("i").collect()] == [(0, "and&amp"), (1, "A & B")]


def test_links_and_calendars():
    page = f'<a href="https://{SITE}/x.htm"> A <b>b</b></a><a>none</a>'
    assert links(parse(page), SITE) == [("/x.htm", "A b"), ("", "none")]
    archive = '<div class="panel p"><div class="panel-heading"><h5>January 30-31 Meeting - 2001</h5></div><a href="/fomc/20010131default.htm">Statement</a></div><h5>Other</h5>'
    found = archive_entries(archive, SITE)
    assert [(e["label"], e["links"]) for e in found] == [("January 30-31 Meeting - 2001", [("/fomc/20010131default.htm", "Statement")])]
    recent = '<div class="panel"><h4>2025 FOMC Meetings</h4><div class="row fomc-meeting"><div class="fomc-meeting__month">Apr/May</div><div class="fomc-meeting__date">30-1</div><a href="/m.htm">x</a></div><div class="fomc-meeting">broken</div></div>'
    assert [(e["year"], e["month"], e["dates"], e["label"]) for e in recent_entries(recent, SITE)] == [(2025, "Apr/May", "30-1", "Apr/May 30-1")]


def test_functions_in_sql(spark):
    from tonemill.functions import dates, html, sql

    sql.register(spark)
    sql.register(spark)  # again: replaced
    labels = ["March 2 (unscheduled) Meeting", "Cancelled", "notation vote of May", "Conference Call", None, "January 30-31 Meeting"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string")
    want = df.select("i", dates.classify_event(F.col("v")).alias("k"), dates.month_number(F.col("v")).alias("m"), dates.date_in_url(F.concat(F.lit("/a/2001013"), "i")).alias("d"))
    assert spark.sql("SELECT i, event_kind(v) AS k, month_number(v) AS m, url_day('/a/2001013' || i) AS d FROM {df}", df=df).collect() == want.collect()
    page = '<div class="panel"><h5>January 30-31 Meeting - 2001</h5><a href="/fomc/a.htm">Statement</a></div><p>One<p>Two'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    found = spark.sql("SELECT id, e.* FROM {pages}, LATERAL calendar_entries(html, 'archive', 'x.gov') AS e", pages=pages).collect()
    entry = html.archive_entries(page, "x.gov")[0]
    assert [(r.id, r.at, r.label, [tuple(x) for x in r.links], r.text) for r in found] == [(1, 0, entry["label"], entry["links"], entry["text"])]
    said = spark.sql("SELECT id, p.paragraph FROM {pages}, LATERAL page_paragraphs(html) AS p ORDER BY p.i", pages=pages).collect()
    assert [r.paragraph for r in said if r.id == 1] == list(html.html_to_paragraphs(page, True))
