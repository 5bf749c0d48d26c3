"""DuckDB SQL for the registered queries, written apart from the Spark code.

The built-in vocabulary, the abbreviations and, for ``statement_rules`` and ``minutes_rules``, the rules' patterns are fixed values that
the Spark code states; the SQL takes them from there. Queries that print their own pages (announcements, minutes, calendars,
press releases) are held against rows that SQL makes without any pattern.
"""

from __future__ import annotations

from .functions.lexicon import ACCOMMODATION, COMPOUNDS, DIRECTIONS, PHRASES, REMOVING_ACCOMMODATION, SUBJECTS
from .functions.text import CLEANING_ABBREVIATIONS, SCORING_ABBREVIATIONS

# DuckDB's \s is ASCII; the tables hold no other white space but what is listed here.
_WS = r"[\s\x{00A0}\x{2028}\x{2029}\x{0085}\x{000B}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}]+"
_MARK = "chr(8291)"


def _protected(expr: str) -> str:
    for a in SCORING_ABBREVIATIONS:
        expr = f"replace({expr}, '{a}', replace('{a}', '.', {_MARK}))"
    return expr


def _collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_WS}', ' ', 'g'))"


def _decoded(expr: str) -> str:
    for entity, sign in (("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        expr = f"replace({expr}, '{entity}', {sign})"
    return expr


_SENTENCES = f"""
paras AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), 1) AS k FROM documents),
cut AS (SELECT doc_id, k, string_split(regexp_replace({_protected(_collapsed('p'))}, '([.!?])["'')\\]]?\\s+(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM paras),
flat AS (SELECT doc_id, k, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM cut),
sent AS (SELECT doc_id, k, j, trim(replace(s, {_MARK}, '.')) AS sentence FROM flat),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i, sentence FROM sent WHERE len(regexp_split_to_array(sentence, '{_WS}')) >= 3)"""


def _values(signs: dict[str, int], x: str) -> str:
    by = {v: ", ".join(f"'{w}'" for w, s in signs.items() if s == v) for v in set(signs.values())}
    return "CASE " + " ".join(f"WHEN {x} IN ({ws}) THEN {v}" for v, ws in sorted(by.items())) + " ELSE 0 END"


def _score(sentence: str, lex: dict) -> str:
    """SQL of a sentence's signed count; tokens are made anew in each use, which DuckDB shares."""
    t = f"regexp_extract_all(lower({sentence}), '[a-z]+')"
    near = _values(lex["directions"], "y")
    off = f"({t}[k] IN ({', '.join(repr(w) for w in lex['guarded'])}) AND k > 1 AND {t}[k - 1] IN ({', '.join(repr(w) for w in lex['compounds'])}))" if lex["guarded"] else "false"
    body = f"CASE WHEN {off} THEN 0 ELSE ({_values(lex['subjects'], f'{t}[k]')}) * sign(coalesce(list_sum(list_transform(list_concat({t}[greatest(1, k - 4):k - 1], {t}[k + 1:k + 4]), lambda y: {near})), 0)) END"
    parts = [f"coalesce(list_sum(list_transform(range(1, len({t}) + 1), lambda k: {body})), 0)"]
    parts += [f"CASE WHEN regexp_matches(lower({sentence}), '{p}') THEN {v} ELSE 0 END" for p, v in lex["phrases"]]
    if lex["removing"]:
        parts.append(f"CASE WHEN regexp_matches(lower({sentence}), '{lex['removing']}') THEN 1 WHEN regexp_matches(lower({sentence}), '{lex['accommodating']}') THEN -1 ELSE 0 END")
    return " + ".join(parts)


_CORPUS = {
    "subjects": {"the": 1, "of": 1, "and": -1, "la": 1, "de": -1, "der": 1, "und": -1, "el": 1},
    "directions": {"to": 1, "in": -1, "is": 1, "a": -1, "que": 1, "en": -1, "von": 1, "zu": -1, "le": 1, "les": -1},
    "phrases": [(r"\bfor\b", 1), (r"\bwith\b", -1)], "removing": None, "accommodating": None, "guarded": ["of"], "compounds": ["that"],
}
_OTHER = {"subjects": {"the": 1, "of": 1, "de": 1}, "directions": {"to": 1, "in": -1, "en": -1, "la": 1}, "phrases": [], "removing": None, "accommodating": None, "guarded": [], "compounds": []}
_BUILT_IN = {
    "subjects": SUBJECTS, "directions": DIRECTIONS, "phrases": PHRASES,
    "removing": REMOVING_ACCOMMODATION, "accommodating": ACCOMMODATION, "guarded": ["rate", "rates"], "compounds": COMPOUNDS,
}


def _tone(lex: dict, name: str) -> str:
    return f"""{name}_v AS (SELECT doc_id, {_score('sentence', lex)} AS v FROM kept),
{name} AS (SELECT d.doc_id, d.source, count(v)::INT AS n_sentences, (count(*) FILTER (WHERE v > 0))::INT AS n_hawkish, (count(*) FILTER (WHERE v < 0))::INT AS n_dovish,
    CASE WHEN count(v) > 0 THEN (count(*) FILTER (WHERE v > 0) - count(*) FILTER (WHERE v < 0))::DOUBLE / count(v) END AS score
    FROM documents d LEFT JOIN {name}_v ON {name}_v.doc_id = d.doc_id GROUP BY d.doc_id, d.source)"""


_TONE = f"WITH {_SENTENCES}, {_tone(_CORPUS, 'tone')}"
_PAIRS = f"""{_TONE}, pairs AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'hawkish' WHEN quality = 1 THEN 'dovish' ELSE 'neutral' END AS gold,
    CASE WHEN score > 0.02 THEN 'hawkish' WHEN score < -0.02 THEN 'dovish' ELSE 'neutral' END AS pred FROM labels JOIN tone USING (doc_id)),
lab AS (SELECT unnest(['hawkish', 'dovish', 'neutral']) AS l)"""
_CHANGES = f"""{_TONE}, flagged AS (SELECT tone.*, quality = 1 AS scheduled FROM tone LEFT JOIN labels USING (doc_id)),
sched AS (SELECT doc_id, score - lag(score) OVER (PARTITION BY source ORDER BY doc_id) AS tone_change FROM flagged WHERE scheduled)"""

_ABBR = "|".join(a.replace(".", r"\.") for a in CLEANING_ABBREVIATIONS)


def _regex(pattern: str) -> str:
    """A Java pattern of this package for RE2, as a quoted string."""
    for flags in ("(?iuU)", "(?iU)", "(?i)"):
        if pattern.startswith(flags):
            pattern = "(?i)" + pattern[len(flags):]
    return "'" + pattern.removeprefix("(?U)").replace("'", "''") + "'"


def _rules() -> tuple[str, str]:
    from .functions import clean as c

    hit = lambda pattern: f"regexp_matches(p, {_regex(pattern)})"
    n = f"len(list_filter(regexp_split_to_array(p, '{_WS}'), lambda x: x <> ''))"
    lines = r"""ln AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
line AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM ln)"""
    statement = f"""WITH {lines},
a AS (SELECT *, min(CASE WHEN {hit(c.STATEMENT_START)} THEN i END) OVER (PARTITION BY doc_id) AS st FROM line),
b AS (SELECT *, min(CASE WHEN i > coalesce(st, 0) AND {hit(c.STATEMENT_FOOTER)} THEN i END) OVER (PARTITION BY doc_id) AS en FROM a),
r AS (SELECT p, CASE WHEN i <= coalesce(st, 0) THEN 'header' WHEN i >= en THEN 'footer' WHEN {hit(c.VOTING)} OR {hit(c.DISSENT_ONLY)} OR {hit(c.VOTE_PREFACE)} THEN 'voting'
    WHEN {hit(c.MEDIA)} THEN 'media_contact' WHEN {hit(c.LINK_LINE)} OR {n} < 5 THEN 'fragment' END AS rule FROM b)
SELECT rule, count(*) AS n, sum(length(p))::BIGINT AS chars FROM r WHERE rule IS NOT NULL GROUP BY rule"""
    bare = r"regexp_replace(p, '\s+$', '')"
    ends = lambda marks: "(" + " OR ".join(f"ends_with({bare}, '{m.replace(chr(39), chr(39) * 2)}')" for m in marks) + ")"
    opens = "(" + " OR ".join(f"starts_with(p, '{m}')" for m in c.OPEN_QUOTES) + ")"
    ws = r"regexp_extract_all(p, '[A-Za-z][\p{L}\p{N}\p{M}_''\-]*')"
    small = ", ".join(f"'{w}'" for w in c.LOWER_IN_NAMES)
    names = f"(len({ws}) > 0 AND len(list_filter({ws}, lambda w: NOT (regexp_matches(w, '^[A-Z]') OR w IN ({small})))) = 0)"
    share = f"len(list_filter({ws}, lambda w: regexp_matches(w, '^[A-Z]'))) / greatest(len({ws}), 1)"
    minutes = f"""WITH {lines},
a AS (SELECT *, min(CASE WHEN {hit(c.MINUTES_START)} THEN i END) OVER (PARTITION BY doc_id) AS st FROM line),
b AS (SELECT *, min(CASE WHEN i >= coalesce(st, 1) AND {hit(c.MINUTES_END)} THEN i END) OVER (PARTITION BY doc_id) AS en FROM a),
q AS (SELECT *, {opens} OR coalesce(last_value(CASE WHEN {ends(c.CLOSE_QUOTES)} THEN false WHEN {opens} THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS quoted
      FROM b WHERE en IS NULL OR i < en),
v AS (SELECT *, NOT quoted AND ({hit(c.VOTING)} OR ({names} AND coalesce(last_value(CASE WHEN quoted THEN NULL WHEN {hit(c.VOTING)} THEN true WHEN {names} THEN NULL ELSE false END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))) AS voting FROM q),
r AS (SELECT p, CASE WHEN quoted THEN 'quoted_statement_or_directive' WHEN voting THEN 'voting' WHEN i < st AND ({share} > 0.35 OR {ends([';', ','])}) THEN 'header_attendance'
    WHEN i < st AND ({hit(c.MINUTES_ORGANISATIONAL)} OR {hit(c.ENUMERATED)} OR regexp_matches(p, '^\\p{{Ll}}')) THEN 'header_organisational' WHEN {hit(c.LONGER_RUN_GOALS)} THEN 'longer_run_goals_statement'
    WHEN {hit(c.NAVIGATION)} THEN 'navigation' WHEN {hit(c.MINUTES_PROCEDURAL)} THEN 'procedural' WHEN {hit(c.MEDIA)} THEN 'media_contact' WHEN {n} < 8 THEN 'fragment'
    WHEN {n} < 15 AND NOT {ends(c.SENTENCE_ENDS)} THEN 'heading' END AS rule FROM v
    UNION ALL SELECT p, 'tail' FROM b WHERE i >= en UNION ALL SELECT 'no start anchor found', 'warning' FROM ln WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE st IS NOT NULL))
SELECT rule, count(*) AS n, sum(length(p))::BIGINT AS chars FROM r WHERE rule IS NOT NULL GROUP BY rule"""
    return statement, minutes


_STATEMENT, _MINUTES = _rules()


def _lines(*lines: tuple[str, str, str, str]) -> str:
    """SQL of printed paragraphs: whether each is there, what it must be ('kept' or the rule that takes it), its text as logged, what is kept of it."""
    rows = ", ".join(f"struct_pack(i := {i}, c := {c}, rule := {rule}, p := {p}, kept := {kept})" for i, (c, rule, p, kept) in enumerate(lines))
    return f"WITH l AS (SELECT o_orderkey, unnest([{rows}]) AS x FROM (SELECT *, o_orderkey AS k FROM orders)), lines AS (SELECT o_orderkey, x.i AS i, x.c AS c, x.rule AS rule, x.p AS p, x.kept AS kept FROM l)"


_ANNOUNCEMENTS = _lines(
    ("k % 9 <> 0", "'header'", "'Menu of the site for customer ' || o_custkey", "NULL"),
    ("k % 9 <> 0", "'header'", "'For release at 2:00 p.m. EST'", "NULL"),
    ("k % 2 = 0", "'voting'", "'The Federal Open Market Committee approved the following statement for release by a 12 – 0 vote:'", "NULL"),
    ("true", "'kept'", "''", "'Economic activity on ' || o_orderdate::DATE || ' expanded at a solid pace. Inflation remains elevated.'"),
    ("k % 3 = 0", "'discount_approval'", "'In taking the action, the Board approved requests submitted by the Boards of Directors of ' || o_orderpriority || '.'", "'The outlook is balanced. Risks remain.'"),
    ("k % 6 = 1", "'discount_approval'", "'The Board approved a request submitted by the Board of Directors of one bank.'", "NULL"),
    ("true", "'voting'", "'Voting for the action were: Able; Baker; and ' || o_orderpriority || '.'", "NULL"),
    ("k % 5 = 0", "'voting'", "'Jane Q. Able dissented because she preferred to wait.'", "NULL"),
    ("k % 4 = 0", "'media_contact'", "'For media inquiries, please call 202-452-2955.'", "NULL"),
    ("k % 7 = 0", "'fragment'", "'Projection Materials'", "NULL"),
    ("true", "'fragment'", "'Short line ' || k", "NULL"),
    ("k % 8 <> 3", "'footer'", "'2024 Monetary policy releases'", "NULL"),
    ("true", "CASE WHEN k % 8 <> 3 THEN 'footer' ELSE 'kept' END", "'Line at the end by ' || o_orderpriority", "CASE WHEN k % 8 = 3 THEN 'Line at the end by ' || o_orderpriority END"),
)
_HAS = "CASE WHEN k % 11 <> 0 THEN '{0}' ELSE '{1}' END"
_PRINTED = _lines(
    ("true", _HAS.format("header_attendance", "procedural"), "'Present:'", "NULL"),
    ("true", _HAS.format("header_attendance", "heading"), "'Jerome Able, Chair; Joan Baker, Vice Chair; Michael Court; ' || o_orderpriority", "NULL"),
    ("true", _HAS.format("header_organisational", "kept"), "'The Manager shall clear with the Subcommittee any operation that is not routine in character.'", "NULL"),
    ("k % 3 = 0", _HAS.format("header_organisational", "heading"), "'(b) lending of securities held by the account on a day'", "NULL"),
    ("true", "'longer_run_goals_statement'", "'The maximum level of employment is a broad goal that is not directly measurable by anyone.'", "NULL"),
    ("k % 2 = 0", "'kept'", "'Participants discussed the balance sheet of ' || o_orderdate::DATE || ' at length, and many noted that runoff could end earlier than expected.'", "NULL"),
    ("k % 11 <> 0", "'kept'", "'The manager turned first to a review of domestic market developments over the period.'", "NULL"),
    ("true", "'heading'", "'Staff outlook for the period ahead of us all'", "NULL"),
    ("true", "'fragment'", "'Too short to keep'", "NULL"),
    ("k % 4 = 1", "'quoted_statement_or_directive'", "'“The Committee decided today to raise its target.'", "NULL"),
    ("k % 4 = 1", "'quoted_statement_or_directive'", "'It judges that the risks are balanced.”'", "NULL"),
    ("true", "'voting'", "'Votes for this action:'", "NULL"),
    ("true", "'voting'", "'Messrs. Able, Baker, and Court.'", "NULL"),
    ("k % 5 = 0", "'voting'", "'Votes against this action:'", "NULL"),
    ("k % 5 = 0", "'voting'", "'None.'", "NULL"),
    ("k % 7 = 0", "'navigation'", "'Skip to the main content of this page now'", "NULL"),
    ("true", "'procedural'", "'By unanimous vote, the minutes of the last meeting were approved by all members.'", "NULL"),
    ("k % 6 = 0", "'media_contact'", "'Media inquiries about this document should go to the office that made it.'", "NULL"),
    ("true", "'kept'", "'Participants noted that inflation pressures had increased somewhat over the period, as customer ' || o_custkey || ' said.'", "NULL"),
    ("k % 13 <> 0", "'tail'", "'It was agreed that the next meeting of the Committee would be held on Tuesday.'", "NULL"),
    ("k % 13 <> 0", "'tail'", "'The meeting adjourned at 1:15 p.m.'", "NULL"),
    ("k % 11 = 0", "'warning'", "'no start anchor found'", "NULL"),
)

# The vocabulary that ``vocabulary_labels`` expects, stated here on its own (fixed values): words of more and of less, and phrases with their sign
# (``firming`` is a phrase besides).
_SAID_SUBJECTS = {
    1: "inflation prices price wages costs pressures rate rates target activity growth economy expansion spending investment output production employment jobs job hiring demand labor conditions recovery sales housing utilization",
    -1: "unemployment slack underutilization losses strains",
}
_SAID_DIRECTIONS = {
    1: "increase increased increases increasing raise raised raising rise rising rose higher high elevated strong stronger solid robust firm firmed firming accelerate accelerated accelerating improve improved improving improvement "
    "strengthen strengthened expand expanded expanding picked upward heightened tight tighter",
    -1: "decrease decreased decline declined declining lower lowered low reduce reduced reduction cut weak weaker weakened soft softened slow slowed slowing slower subdued muted depressed below contained eased easing diminished diminish "
    "moderated sluggish downward fall fell falling",
}
_SAID_TAILS = (
    ("calm", "0"), ("firming", "1"), ("tightening", "1"), ("a restrictive stance", "1"), ("reducing the monthly pace of its purchases", "1"), ("normalization", "1"), ("an inflation risk", "1"), ("a wish to ease the stance", "-1"),
    ("securities purchases", "-1"), ("purchasing additional agency paper", "-1"), ("exceptionally low levels", "-1"), ("an extended period", "-1"), ("considerable time", "-1"), ("a patient approach", "-1"), ("downside risks", "-1"),
    ("removal of policy accommodation", "1"), ("an accommodative stance", "-1"),
)


def _stated(signs: dict[int, str]) -> str:
    return "VALUES " + ", ".join(f"('{w}', {v})" for v, words in signs.items() for w in words.split())


ORACLE_SQL: dict[str, str] = {
    "doc_tone": f"{_TONE} SELECT * FROM tone",
    "default_lexicon_labels": f"""WITH s AS (SELECT ['Inflation', 'The unemployment rate', 'Economic activity', 'The target rate', 'Labor market slack'][o_orderkey % 5 + 1] AS subject,
        ['has increased', 'declined somewhat', 'remained stable', 'is elevated'][o_custkey % 4 + 1] AS verb,
        ['in recent months', 'and policy accommodation is patient', 'with further firming'][year(o_orderdate) % 3 + 1] AS tail, count(*) AS n FROM orders GROUP BY ALL),
        v AS (SELECT subject, n, subject || ' ' || verb || ' ' || tail AS sentence FROM s), w AS (SELECT subject, n, {_score('sentence', _BUILT_IN)} AS v FROM v)
        SELECT subject, CASE WHEN v > 0 THEN 'hawkish' WHEN v < 0 THEN 'dovish' ELSE 'neutral' END AS label, sum(n)::BIGINT AS n FROM w GROUP BY 1, 2""",
    "resumed_scores": f"""{_TONE}, {_tone(_OTHER, 'other')} SELECT o.doc_id, o.n_sentences, round(o.score, 9) AS score, false AS made FROM other o WHERE o.doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT t.doc_id, t.n_sentences, round(t.score, 9), true FROM tone t WHERE t.doc_id NOT IN (SELECT doc_id FROM labels)""",
    "announcement_rules": f"{_ANNOUNCEMENTS} SELECT rule, count(*) AS n, sum(length(p))::BIGINT AS chars FROM lines WHERE c AND rule <> 'kept' GROUP BY rule",
    "announcements_cleaned": f"""{_ANNOUNCEMENTS} SELECT o_orderkey, coalesce(string_agg(kept, chr(10) || chr(10) ORDER BY i) FILTER (WHERE c AND kept IS NOT NULL), '') AS clean_text,
        (count(*) FILTER (WHERE c AND rule <> 'kept'))::INT AS n_stripped FROM lines GROUP BY o_orderkey""",
    "printed_minutes_rules": f"{_PRINTED} SELECT rule, count(*) AS n, sum(length(p))::BIGINT AS chars FROM lines WHERE c AND rule <> 'kept' GROUP BY rule",
    "printed_minutes_cleaned": f"""{_PRINTED} SELECT o_orderkey, md5(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE c AND rule = 'kept'), '')) AS clean_md5,
        (count(*) FILTER (WHERE c AND rule = 'kept'))::INT AS n_kept FROM lines GROUP BY o_orderkey""",
    "calendar_meetings": """WITH o AS (SELECT DISTINCT year(o_orderdate)::INT AS y, month(o_orderdate) AS m FROM orders), a AS (SELECT y, m, monthname(make_date(y, m, 1)) AS name, CASE WHEN m % 5 = 0 THEN 'unscheduled' WHEN m = 6 THEN 'conference_call' ELSE 'scheduled' END AS kind FROM o),
        r AS (SELECT 2021 + n_nationkey // 12 AS y, n_nationkey % 12 + 1 AS m, n_regionkey + 10 AS d FROM nation)
        SELECT y AS year, name || CASE kind WHEN 'unscheduled' THEN ' 26 (unscheduled) Meeting - ' WHEN 'conference_call' THEN ' 26 Conference Call - ' ELSE ' 25-26 Meeting - ' END || y AS label,
            make_date(y, m, CASE WHEN kind = 'scheduled' THEN 25 ELSE 26 END) AS meeting_start, make_date(y, m, 26) AS meeting_end, kind AS event_type, kind = 'scheduled' AS scheduled,
            '/fomc/' || strftime(make_date(y, m, 26), '%Y%m%d') || 'default.htm' AS statement_url, '/fomc/minutes/' || strftime(make_date(y, m, 26), '%Y%m%d') || '.htm' AS minutes_url,
            (make_date(y, m, 26) + 21)::DATE AS minutes_release_date, '/a/' || y AS source_page FROM a
        UNION ALL SELECT y, monthname(make_date(y, m, 1)) || ' ' || d || '-' || (d + 1) || '*', make_date(y, m, d), make_date(y, m, d + 1), 'scheduled', true,
            '/newsevents/pressreleases/monetary' || strftime(make_date(y, m, d + 1), '%Y%m%d') || 'a.htm', NULL, NULL, '/current' FROM r WHERE make_date(y, m, d + 1) <= DATE '2022-10-01'""",
    "calendar_in_sql": """WITH o AS (SELECT DISTINCT year(o_orderdate)::INT AS y, month(o_orderdate) AS m FROM orders), a AS (SELECT y, m, unnest(CASE WHEN m = 3 THEN [1, 2] ELSE [1] END) AS twice, monthname(make_date(y, m, 1)) AS name FROM o),
        r AS (SELECT 2021 + n_nationkey // 12 AS y, n_nationkey % 12 + 1 AS m, n_regionkey + 10 AS d FROM nation)
        SELECT '/a/' || y AS source_page, (row_number() OVER (PARTITION BY y ORDER BY m, twice) - 1)::INT AS at, name || CASE WHEN m % 5 = 0 THEN ' 26 (unscheduled) Meeting - ' WHEN m = 6 THEN ' 26 Conference Call - ' ELSE ' 25-26 Meeting - ' END || y AS label,
            CASE WHEN m % 5 = 0 THEN 'unscheduled' WHEN m = 6 THEN 'conference_call' ELSE 'scheduled' END AS event_type, m::INT AS month, 2 AS n_links FROM a
        UNION ALL SELECT '/current', (row_number() OVER (ORDER BY y, m) - 1)::INT, monthname(make_date(y, m, 1)) || ' ' || d || '-' || (d + 1) || '*', 'scheduled', m::INT, 1 FROM r""",
    "press_releases": """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), l AS (SELECT day, CASE WHEN month(day) % 2 = 0 THEN least(dayofyear(day) % 6, 2) ELSE dayofyear(day) % 6 END AS n FROM d),
        h AS (SELECT day, CASE WHEN day(day) % 4 < n THEN day(day) % 4 WHEN n = 5 THEN 4 END AS k FROM l)
        SELECT day AS release_day, '/newsevents/pressreleases/monetary' || strftime(day, '%Y%m%d') || substr('abcde', k + 1, 1) || '.htm' AS press_url, CASE WHEN k IS NOT NULL THEN 840 END AS minutes_after_midnight,
            CASE WHEN k IS NULL THEN 'unverified' ELSE 'minutes_press_release' END AS source, CASE WHEN k IS NULL THEN 'no minutes press release found' ELSE '' END AS note FROM h""",
    "ambiguous_times": """WITH t AS (SELECT n_nationkey, n_regionkey AS r, (n_nationkey % 11 + 13) * 60 + 15 AS told, n_nationkey % 11 + 13 AS h FROM nation)
        SELECT n_nationkey, CASE WHEN r IN (1, 3) THEN told::INT END AS minutes_after_midnight, CASE WHEN r IN (1, 3) THEN 'minutes' ELSE 'unverified' END AS source,
            CASE r WHEN 0 THEN 'no time found' WHEN 1 THEN '' WHEN 3 THEN '' ELSE 'ambiguous times in minutes: 08:30:00,' || h || ':15:00' END AS note FROM t""",
    "exact_sample_facts": "SELECT 150 AS n, 150 AS n_docs, 'v001' AS first_id, 'v150' AS last_id, 150 AS n_own, 150 AS n_again",
    "tone_change_by_source": f"{_CHANGES} SELECT f.doc_id, source, scheduled, round(score, 9) AS score, round(tone_change, 9) AS tone_change FROM flagged f LEFT JOIN sched USING (doc_id)",
    "change_correlation": f"""{_CHANGES}, {_tone(_OTHER, 'other')},
        j AS (SELECT f.doc_id, f.source, f.score, s.tone_change, other.score AS lexicon FROM flagged f JOIN sched s USING (doc_id) JOIN other USING (doc_id)),
        m AS (SELECT source, tone_change, lexicon - lag(lexicon) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM j WHERE tone_change IS NOT NULL),
        lv AS (SELECT source, count(*) AS n, round(CASE WHEN stddev_pop(score) FILTER (WHERE lexicon IS NOT NULL) > 0 AND stddev_pop(lexicon) FILTER (WHERE score IS NOT NULL) > 0 THEN corr(score, lexicon) END, 6) AS level FROM j GROUP BY source),
        ch AS (SELECT source, count(*) AS n_changes, round(CASE WHEN stddev_pop(tone_change) > 0 AND stddev_pop(c) > 0 THEN corr(tone_change, c) END, 6) AS change FROM m WHERE c IS NOT NULL GROUP BY source)
        SELECT lv.source, n, level, n_changes, change FROM lv LEFT JOIN ch USING (source)""",
    "sentences_long": f"WITH {_SENTENCES} SELECT doc_id, i::INT AS i, sentence FROM kept",
    "clean_split": f"""WITH t AS (SELECT doc_id, {_collapsed("coalesce(text, '')")} AS t FROM documents),
        u AS (SELECT doc_id, regexp_replace(t, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({_ABBR})\\.', '\\1\\2' || chr(1), 'g') AS t FROM t),
        v AS (SELECT doc_id, regexp_replace(t, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({_ABBR})\\.', '\\1\\2' || chr(1), 'g') AS t FROM u),
        w AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([A-Z])\\.(\\s+[A-Z])', '\\1\\2' || chr(1) || '\\3', 'g'), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([A-Z])\\.(\\s+[A-Z])', '\\1\\2' || chr(1) || '\\3', 'g') AS t FROM v),
        x AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]["”’'')\\]]?)\\s+(["“(\\[]?[A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '') AS s FROM w)
        SELECT doc_id, len(s)::INT AS n, coalesce(list_sum(list_transform(s, lambda p: length(p))), 0)::INT AS chars FROM x""",
    "confusion_matrix": f"{_PAIRS} SELECT a.l AS gold, b.l AS pred, count(pairs.gold) AS n FROM lab a CROSS JOIN lab b LEFT JOIN pairs ON gold = a.l AND pred = b.l GROUP BY 1, 2",
    "agreement_metrics": f"""{_PAIRS}, per AS (SELECT l, count(*) FILTER (WHERE gold = l AND pred = l) AS tp, count(*) FILTER (WHERE gold = l) AS g, count(*) FILTER (WHERE pred = l) AS p, count(*) AS n FROM lab CROSS JOIN pairs GROUP BY l),
        s AS (SELECT max(n) AS n, sum(tp) / max(n) AS po, sum((g / n) * (p / n)) AS pe, avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (g + p) END) AS f FROM per)
        SELECT n, round(po, 9) AS accuracy, round(f, 9) AS macro_f1, round(CASE WHEN pe = 1 THEN 0 ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM s""",
    "majority_class": f"{_PAIRS} SELECT round(max(n) / sum(n), 9) AS majority_class_accuracy FROM (SELECT gold, count(*) AS n FROM pairs GROUP BY gold)",
    "choose_scorer": """WITH n AS (SELECT n_regionkey, n_nationkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) % 3 + 1 AS k FROM nation),
        s AS (SELECT n_regionkey, k, (60 + max(n_nationkey % 7 * 2)) / 100 AS f FROM n WHERE NOT (n_regionkey = 4 AND k = 2) GROUP BY ALL), t AS (SELECT *, max(f) OVER (PARTITION BY n_regionkey) AS best FROM s)
        SELECT n_regionkey::INT AS n_regionkey, CASE WHEN count(*) = 3 THEN ['lexicon', 'zs-base', 'zs-large'][min(k) FILTER (WHERE f >= best - 0.03)] END AS "primary" FROM t GROUP BY n_regionkey""",
    "crosstab_year_kind": "SELECT year(o_orderdate)::INT AS year, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{k}' AND {'' if not u else 'NOT '}o_totalprice > 100000) AS {k}{u}" for k in "FOP" for u in ("", "_unsched")) + " FROM orders GROUP BY 1",
    "group_null_keys": "SELECT lang, quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "statement_rules": _STATEMENT,
    "minutes_rules": _MINUTES,
    "latch_state": """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN role = 'user' AND length(text) % 3 = 0 THEN 'o' WHEN role = 'assistant' AND length(text) % 2 = 0 THEN 'c'
        WHEN length(text) % 5 = 0 THEN 'v' WHEN length(text) % 7 = 0 THEN 'x' ELSE 'n' END AS k FROM conversations),
        q AS (SELECT *, k = 'o' OR coalesce(last_value(CASE k WHEN 'c' THEN false WHEN 'o' THEN true END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS quoted FROM a)
        SELECT conv_id, i::INT AS i, quoted, NOT quoted AND (k = 'v' OR (k = 'n' AND coalesce(last_value(CASE WHEN quoted OR k = 'n' THEN NULL ELSE k = 'v' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))) AS voting FROM q""",
    "keep_first_event": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "page_keys": """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages), k AS (SELECT page_id, rest, trim(regexp_replace(rest, '[?#].*$', ''), '/') AS path FROM p)
        SELECT page_id, CASE WHEN path = '' THEN 'index' ELSE regexp_replace(replace(path, '/', '_'), '[^A-Za-z0-9._-]', '_', 'g') END AS cache_key,
        CASE WHEN rest = '' THEN 'https://www.federalreserve.gov' ELSE 'https://www.federalreserve.gov' || rest END AS absolute FROM k""",
    "page_lookup": """WITH u AS (SELECT page_id, 'as it is' AS asked, url FROM pages UNION ALL SELECT page_id, 'changed', url || '-gone' FROM pages),
        k AS (SELECT page_id, asked, trim(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/') AS path FROM u),
        c AS (SELECT page_id, asked, CASE WHEN path = '' THEN 'index' ELSE regexp_replace(replace(path, '/', '_'), '[^A-Za-z0-9._-]', '_', 'g') END AS key FROM k),
        h AS (SELECT key, min(html) AS html FROM c JOIN pages USING (page_id) WHERE asked = 'as it is' GROUP BY key)
        SELECT page_id, asked, md5(html) AS found_md5 FROM c LEFT JOIN h USING (key)""",
    "pages_by_role": """WITH k AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/') AS path, trim(regexp_replace(regexp_replace(url || '-gone', '^https?://[^/]*', ''), '[?#].*$', ''), '/') AS other, html FROM pages),
        c AS (SELECT page_id, html, CASE WHEN path = '' THEN 'index' ELSE regexp_replace(replace(path, '/', '_'), '[^A-Za-z0-9._-]', '_', 'g') END AS key,
              CASE WHEN other = '' THEN 'index' ELSE regexp_replace(replace(other, '/', '_'), '[^A-Za-z0-9._-]', '_', 'g') END AS gone FROM k),
        h AS (SELECT key, md5(min(html)) AS m FROM c GROUP BY key)
        SELECT page_id, a.m AS own_md5, b.m AS changed_md5, 2 + (b.m IS NOT NULL)::INT AS n_tried, CASE WHEN b.m IS NULL THEN 1 ELSE 3 END AS n_before_gap FROM c JOIN h a ON a.key = c.key LEFT JOIN h b ON b.key = c.gone""",
    "streamed_changes": """WITH p AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change, max(ts) OVER (PARTITION BY user_id) AS latest FROM events WHERE event_type = 'purchase')
        SELECT event_id, user_id, true AS scheduled, round(change, 6) AS tone_change, false AS late FROM p WHERE ts <= latest - INTERVAL 12 HOURS
        UNION ALL SELECT event_id, user_id, false, NULL, false FROM events WHERE event_type <> 'purchase' OR event_type IS NULL""",
    "decoded_bodies": r"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g') || '“' END) AS digest FROM documents",
    # The pages of the tables hold these elements and entities alone.
    "html_paragraphs": rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<!--.*?-->', '', 'gs') AS h FROM pages),
        t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '</?(p|li|ul|div|h1|br)( [^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS ps FROM b),
        c AS (SELECT page_id, list_filter(list_transform(ps, lambda p: {_collapsed(_decoded('p'))}), lambda p: p <> '') AS ps FROM t)
        SELECT page_id, unnest(range(len(ps)))::INT AS i, unnest(ps) AS paragraph FROM c""",
    "page_links": rf"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS ls FROM pages),
        l AS (SELECT page_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS l FROM a)
        SELECT page_id, i, regexp_replace(trim({_decoded("regexp_extract(l, 'href=\"([^\"]*)', 1)")}), '^https?://example[.]com', '') AS href, {_collapsed(_decoded("regexp_extract(l, '>([^<]*)<', 1)"))} AS link_text FROM l""",
    "softmax_labels": """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE * 8) AS l FROM embeddings), s AS (SELECT vec_id, l, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS t FROM e)
        SELECT vec_id, ['hawkish', 'dovish', 'neutral'][list_position(l, list_max(l))] AS label, round(1 / t, 6) AS top FROM s""",
    "hypothesis_pairs": """SELECT h.k AS hypothesis_label, h.v AS hypothesis, count(*) AS n FROM conversations, (VALUES ('hawkish', 'This text signals tighter monetary policy, rising inflation, or a strengthening economy.'),
        ('dovish', 'This text signals easier monetary policy, falling inflation, or a weakening economy.'), ('neutral', 'This text gives no signal about the direction of monetary policy or the economy.')) AS h(k, v) GROUP BY 1, 2""",
    "resume_anti": "SELECT lang, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "union_distinct": "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)",
    "date_spans": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + 1)::DATE AS e FROM orders)
        SELECT o_orderkey, d AS first_day, CASE WHEN month(d) = month(e) AND o_orderkey % 2 = 0 THEN e WHEN month(d) <> month(e) AND year(d) = year(e) THEN e ELSE d END AS last_day,
        CASE WHEN month(d) = month(e) AND o_orderkey % 2 <> 0 THEN 'unscheduled' ELSE 'scheduled' END AS kind FROM o""",
    "dates_in_text": "SELECT o_orderkey, o_orderdate::DATE AS page_day, o_orderdate::DATE AS released, o_orderdate::DATE AS url_day FROM orders",
    "release_times": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (hour(ts) * 60 + minute(ts))::INT END AS minutes_after_midnight,
        CASE event_id % 3 WHEN 0 THEN 'statement_page' WHEN 1 THEN 'minutes' ELSE 'unverified' END AS source FROM events""",
    "decisions": "SELECT ['raise', 'lower', 'hold', 'unclear'][o_orderkey % 4 + 1] AS decision, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "length_orders": "SELECT conv_id, string_agg(i::VARCHAR, ',' ORDER BY n, i) AS by_length, true AS restored FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations) GROUP BY conv_id",
    "score_by_lang": f"{_TONE} SELECT lang, count(*) AS n, round(avg(score), 6) AS mean_score, min(d.doc_id) AS first_id, max(d.doc_id) AS last_id FROM documents d JOIN tone USING (doc_id) GROUP BY lang",
    "word_counts": f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::INT AS n_words FROM documents",
    "holm_adjusted": """WITH a AS (SELECT n_nationkey, n_regionkey, (n_nationkey + 1) / 500 AS p, count(*) OVER (PARTITION BY n_regionkey) AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
        SELECT n_nationkey, round(max(least(1, p * (m - k + 1))) OVER (PARTITION BY n_regionkey ORDER BY p ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM a""",
    "tone_change_overall": f"""{_CHANGES}, c AS (SELECT doc_id, score - lag(score) OVER (ORDER BY doc_id) AS change FROM flagged WHERE scheduled)
        SELECT f.doc_id, scheduled, round(score, 9) AS score, round(change, 9) AS tone_change FROM flagged f LEFT JOIN c USING (doc_id)""",
    "days_aligned": """WITH d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_quantity >= 49), o AS (SELECT o_orderkey, o_orderdate::DATE AS at FROM orders)
        SELECT o_orderkey, day AS trading_day FROM o ASOF LEFT JOIN d ON d.day >= o.at""",
    "holm_overall": """WITH p AS (SELECT p_partkey, (p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END) / 100000 AS p FROM part), a AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, p_partkey) AS k FROM p)
        SELECT p_partkey, round(max(least(1, p * (m - k + 1))) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM a""",
    "grouped_regressions": """WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 10000 AS y, l_quantity / 10 AS u, l_discount * 10 AS v FROM lineitem),
        m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM r GROUP BY ALL),
        c AS (SELECT l_returnflag, l_linestatus, n, my, mu, mv, y - my AS y, u - mu AS u, v - mv AS v FROM r JOIN m USING (l_returnflag, l_linestatus)),
        s AS (SELECT l_returnflag, l_linestatus, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * y) AS uy, sum(v * y) AS vy FROM c GROUP BY ALL),
        b AS (SELECT *, uu * vv - uv * uv AS det, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS bu, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS bv FROM s),
        q AS (SELECT l_returnflag, l_linestatus, any_value(n) AS n, any_value(my - bu * mu - bv * mv) AS b0, any_value(bu) AS bu, any_value(bv) AS bv, any_value(vv / det) AS iuu, any_value(-uv / det) AS iuv, any_value(uu / det) AS ivv,
              sum(pow(y - bu * u - bv * v, 2) * u * u) AS quu, sum(pow(y - bu * u - bv * v, 2) * u * v) AS quv, sum(pow(y - bu * u - bv * v, 2) * v * v) AS qvv FROM c JOIN b USING (l_returnflag, l_linestatus) GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, t.term, round(t.coef, 6) AS coef, round(t.se, 6) AS se, n, false AS collinear FROM (SELECT l_returnflag, l_linestatus, n, unnest([{'term': 'const', 'coef': b0, 'se': NULL},
            {'term': 'quantity', 'coef': bu, 'se': sqrt((iuu * iuu * quu + 2 * iuu * iuv * quv + iuv * iuv * qvv) * n / (n - 3))}, {'term': 'discount', 'coef': bv, 'se': sqrt((iuv * iuv * quu + 2 * iuv * ivv * quv + ivv * ivv * qvv) * n / (n - 3))}]) AS t FROM q)""",
    "placebo_distribution": """WITH d AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) / 100000 AS y FROM orders GROUP BY 1), no AS (SELECT *, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS m FROM d),
        e AS (SELECT event_id, value / 100 AS x, (DATE '1995-01-01' + (event_id % 700)::INT)::DATE AS day FROM events WHERE event_type = 'purchase'), u AS (SELECT event_id, x, y, m FROM e JOIN no USING (day) WHERE x IS NOT NULL),
        a AS (SELECT count(*) AS n, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS slope FROM u),
        w AS (SELECT r, x, ('0x' || substr(md5('3:' || event_id || ':' || r), 1, 8))::BIGINT % m + 1 AS k FROM (SELECT *, unnest(range(1, 51)) AS r FROM u)),
        p AS (SELECT r, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS s FROM w JOIN no USING (k) GROUP BY r)
        SELECT any_value(n) AS n, round(any_value(slope), 6) AS slope, round((count(*) FILTER (WHERE abs(s) >= abs(slope)) + 1) / (count(*) + 1), 6) AS p_value, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM p, a""",
    "rejected_entries": """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
        SELECT k AS o_orderkey, 'month' AS "column", 'unknown month: Smarch' AS reason FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'span', 'unreadable dates: Smarch ' || day(d) FROM o WHERE k % 5 = 0
        UNION ALL SELECT k, 'url_day', 'no such day: 20240231' FROM o WHERE k % 7 = 0 UNION ALL SELECT k, 'time', 'no such minute: ' || (k % 12 + 1) || ':' || (k % 70) FROM o WHERE k % 70 > 59
        UNION ALL SELECT k, 'none', concat_ws(' ', month(d), d, (k % 12 + 1) % 12 * 60 + 720 + k % 70, d, d) FROM o WHERE k % 5 > 0 AND k % 7 > 0 AND k % 70 <= 59""",
    "vocabulary_labels": f"""WITH s AS (SELECT row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS ns, w, v FROM ({_stated(_SAID_SUBJECTS)}) AS t(w, v)), d AS (SELECT row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS nd, w, v FROM ({_stated(_SAID_DIRECTIONS)}) AS t(w, v)),
        p AS (SELECT unnest({[list(t) for t in _SAID_TAILS]}) AS t), q AS (SELECT row_number() OVER () - 1 AS i, t[1] AS w, t[2]::INT AS v FROM p),
        k AS (SELECT o_orderkey % (SELECT any_value(ns) FROM s) AS a, o_orderkey // (SELECT any_value(ns) FROM s) % (SELECT any_value(nd) FROM d) AS b, o_custkey % (SELECT count(*) FROM q) AS c FROM orders)
        SELECT s.w AS subject, d.w AS direction, q.w AS tail, CASE sign(s.v * d.v + q.v + (d.w = 'firming' AND q.w <> 'firming')::INT) WHEN 1 THEN 'hawkish' WHEN -1 THEN 'dovish' ELSE 'neutral' END AS label, count(*) AS n FROM k JOIN s ON s.i = a JOIN d ON d.i = b JOIN q ON q.i = c GROUP BY ALL""",
    "sinks_read_back": """SELECT doc_id, lang AS label, lang AS gold, NULL::VARCHAR AS note, md5(text) AS lines_md5, md5(coalesce(text, '')) AS csv_md5, md5(text) AS table_md5 FROM documents WHERE doc_id IS NOT NULL""",
    "event_returns": "SELECT user_id AS asset, event_id AS day, " + ", ".join(f"round(ln(lead(abs(value) + 1, {h}) OVER w / lag(abs(value) + 1) OVER w), 6) AS ret_{h}" for h in (0, 1, 5)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
}
ORACLE_SQL["counted_rules"] = ORACLE_SQL["printed_minutes_rules"]
