"""Boilerplate removal by rules, with a log of what each rule took.

A page is an array of paragraphs. Everything stays within its row: anchors are array positions, the two latches (inside a
quoted block, after a voting line) are a fold over the paragraphs, rules are an ordered chain of which the first that
applies counts. The outcome is (kept: paragraphs, stripped: array of rule and text in log order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CLEANING_MARK, cleaning_sentences, collapse, ends_with_any, let, starts_with_any, word_count

# The rules' patterns and marks.
VOTING = r"(?iuU)^(Voting|Votes?\s+(for|against)|Absent and not voting)\b"
DISSENT_ONLY = r"(?U)^[A-Z][\w.'\- ]{2,60}\s(dissented|voted against)\b"
VOTE_PREFACE = r"(?iuU)approved the following statement for release by a [\d\s–—-]+ vote:?$"
MEDIA = r"(?U)(For media inquiries|Media [Ii]nquiries|Media Contacts?:|202-452-\d{4})"
DISCOUNT_APPROVAL = r"(?iuU)requests?\s+submitted by the Boards? of Directors"
STATEMENT_START = r"(?iuU)^(For (immediate )?release\b|For use at\b)"
STATEMENT_FOOTER = (
    r"(?U)^(\d{4} Monetary policy|Last [Uu]pdate|Home\b|\[?Return to top|Back to Top"
    r"|Implementation Note|Related Information|Board of Governors of the Federal Reserve System$)"
)
LINK_LINE = r"^(Share|PDF|HTML|Attachment.*|Press Conference|Projection Materials)$"
MINUTES_END = r"^It was agreed that the next meeting"
MINUTES_PROCEDURAL = (
    r"(?iuU)^(By unanimous vote|The agenda for this meeting|Secretary'?s note|The elected members"
    r"|A (joint )?meeting of the Federal Open Market Committee (and the Board of Governors .*?)?was held"
    r"|Present:|Attended\b|Return to (text|top)|Footnotes?$|\d+\.\s+Attended)"
)
MINUTES_START = (
    r"(?U)^(Developments in Financial Markets"
    r"|The (SOMA |System Open Market Account |Deputy )?[Mm]anager (of the System Open Market Account )?"
    r"(\(SOMA\) |for Foreign Operations )?(also |first )?(reported|discussed|noted|summarized|reviewed|turned)"
    r"|The information reviewed (at|for) (this|the \w+) meeting"
    r"|Staff Review of the Economic Situation"
    r"|The information (received|available) (since|at the time of) the)"
)
MINUTES_ORGANISATIONAL = (
    r"(?U)(authoriz|[Dd]irective|Procedural Instructions|Program for Security|Rules? (of|Regarding)"
    r"|advices? of the election|\belected\b|officers of the Committee|selected to serve"
    r"|Manager shall|pursuant to|swap|foreign currenc|reaffirm|amend|ratif|attended"
    r"|Division of|Governors;|notation vote|Federal Reserve Bank of [A-Z][\w. ]+;"
    r"|paragraph|Selected Bank|Permitted Foreign Securities|Eligible Securities|System balances"
    r"|Subcommittee|foreign monetary authorities|Chair(man)? shall|service fee|continuing rules"
    r"|instruments in question|Federal agency issues|foreign central banks|United States Treasury"
    r"|such operation|disorderly market conditions|accounts at foreign|:$)"
)
#: What each match of MINUTES_ORGANISATIONAL holds, where that is longer than a letter: texts that are searched as bytes, which most paragraphs end.
ORGANISATIONAL_PARTS = (
    "authoriz", "irective", "Procedural Instructions", "Program for Security", "Rule", "advice", "elected", "officers of the Committee", "Manager shall", "pursuant to", "swap", "foreign ", "reaffirm", "amend", "ratif",
    "attended", "Division of", "Governors;", "notation vote", "Federal Reserve Bank of ", "paragraph", "Selected Bank", "Permitted Foreign", "Eligible Securities", "System balances", "Subcommittee", "shall",
    "service fee", "continuing rules", "instruments in question", "Federal agency issues", "United States Treasury", "such operation", "disorderly market", "accounts at ",
)
ENUMERATED = r"(?U)^\(?([a-z]|[ivx]+|[A-Z]|\d{1,2})[.)]\s"
LONGER_RUN_GOALS = (
    r"^(The Federal Open Market Committee \(FOMC\) is firmly committed"
    r"|Inflation, employment, and long-term interest rates fluctuate"
    r"|The inflation rate over the longer run is (primarily )?determined"
    r"|The maximum level of employment is"
    r"|Monetary policy actions tend to influence economic activity"
    r"|In setting monetary policy, the Committee seeks"
    r"|The Committee's policy decisions reflect its longer-run goals"
    r"|The Committee intends to review these principles"
    r"|The Committee's employment and inflation objectives are generally complementary"
    r"|The Committee judges that longer-term inflation expectations that are well anchored"
    r"|The Committee sets forth its principles regarding)"
)
NAVIGATION = r"(?iuU)^(skip to|Menu$|Search$|Home\s*\|)"
OPEN_QUOTES, CLOSE_QUOTES = ["“", '"', "‘‘", "``"], ["”", '"', "''"]
SENTENCE_ENDS = [".", ":", "?", "”", '"']
LOWER_IN_NAMES = ["and", "of", "the", "van", "der", "de", "la"]
NAME_WORD = r"(?U)[A-Za-z][\w'\-]*"
#: The names under which rules are logged.
RULES = (
    "header", "footer", "voting", "media_contact", "fragment", "discount_approval", "warning", "tail", "quoted_statement_or_directive", "header_attendance", "header_organisational",
    "longer_run_goals_statement", "navigation", "procedural", "heading",
)
STATEMENT_FEWEST, MINUTES_FEWEST, HEADING_FEWEST, CAPITALISED_MOST = 5, 8, 15, 0.35


def _name_words(p: Column) -> Column:
    return F.regexp_extract_all(p, F.lit(NAME_WORD), F.lit(0))


def is_name_list(p: Column) -> Column:
    """Whether all words are capitalised or small words of names, and there is one."""
    return let(_name_words(p), lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}") | w.isin(LOWER_IN_NAMES)))


def capitalised_share(p: Column) -> Column:
    """Share of the words that are capitalised, 0 without words."""
    return let(_name_words(p), lambda ws: F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}"))) / F.greatest(F.size(ws), F.lit(1)))


def strip_sentences(p: Column, pattern: str) -> Column:
    """(text, gone): the paragraph without the sentences that match, and those. Only a paragraph that matches is split."""
    cut = let(cleaning_sentences(p), lambda ss: F.struct(F.array_join(F.filter(ss, lambda s: ~s.rlike(pattern)), " ").alias("text"), F.filter(ss, lambda s: s.rlike(pattern)).alias("gone")))
    whole = lambda t: F.struct(F.replace(t, F.lit(CLEANING_MARK), F.lit(".")).alias("text"), F.array().cast("array<string>").alias("gone"))
    return let(collapse(p), lambda t: F.when(t.rlike(pattern), cut).otherwise(whole(t)))


def organisational(p: Column) -> Column:
    """Whether MINUTES_ORGANISATIONAL is found; a paragraph without any of its parts isn't searched for the whole pattern."""
    some = F.lit(False)
    for part in ORGANISATIONAL_PARTS:
        some = some | p.contains(part)
    return p.rlike(r":$") | some & p.rlike(MINUTES_ORGANISATIONAL)


def _has_words(p: Column, n: int) -> Column:
    """Whether there are ``n`` words or more; reads no further than the last of them."""
    return F.coalesce(p, F.lit("")).rlike(rf"(?U)^\s*+(?:\S++\s++){{{n - 1}}}\S")


def _is_media(p: Column) -> Column:
    return (p.contains("edia ") | p.contains("202-452-")) & p.rlike(MEDIA)


def first_index(paragraphs: Column, cond) -> Column:
    """0-based index of the first paragraph that meets ``cond``; null without one."""
    return F.nullif(F.array_position(F.transform(paragraphs, cond), True).cast("int"), F.lit(0)) - 1


def _log(rule, text) -> Column:
    return F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), text.alias("text"))


def clean_statement(paragraphs: Column) -> Column:
    """(kept, stripped) of a statement's paragraphs."""

    def within(args):
        ps, start = args["ps"], F.coalesce(args["start"] + 1, F.lit(0))
        body = F.slice(ps, start + 1, F.size(ps))

        def cut(body):
            end = F.coalesce(first_index(body, lambda p: p.rlike(STATEMENT_FOOTER)), F.size(body))

            def judge(p):
                rule = F.when(p.rlike(VOTING) | p.rlike(DISSENT_ONLY) | p.rlike(VOTE_PREFACE), "voting").when(p.rlike(MEDIA), "media_contact").when(p.rlike(LINK_LINE) | (word_count(p) < STATEMENT_FEWEST), "fragment")
                rest = strip_sentences(p, DISCOUNT_APPROVAL)
                none = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("gone"))
                return F.struct(p.alias("p"), rule.alias("rule"), F.when(rule.isNull(), rest).otherwise(none).alias("rest"))

            def gather(judged):
                kept = F.filter(F.transform(judged, lambda j: j["rest"]["text"]), lambda t: t != "")
                lines = F.flatten(F.transform(judged, lambda j: F.when(j["rule"].isNotNull(), F.array(_log(j["rule"], j["p"]))).otherwise(F.transform(j["rest"]["gone"], lambda s: _log("discount_approval", s)))))
                head = F.transform(F.slice(ps, 1, start), lambda p: _log("header", p))
                foot = F.transform(F.slice(body, end + 1, F.size(body)), lambda p: _log("footer", p))
                return F.struct(kept.alias("kept"), F.concat(head, foot, lines).alias("stripped"))

            return let(F.transform(F.slice(body, 1, end), judge), gather)

        return let(body, cut)

    return let(F.struct(paragraphs.alias("ps"), first_index(paragraphs, lambda p: p.rlike(STATEMENT_START)).alias("start")), within)


def latches(paragraphs: Column) -> Column:
    """For each paragraph (quoted, voting): whether it is within a quoted block, or a voting line or its list of names."""

    def step(acc, p):
        def state(now):
            quoted, voting = now["quoted"], now["voting"]
            return F.struct((quoted & ~ends_with_any(p, CLOSE_QUOTES)).alias("q"), F.when(quoted, acc["v"]).otherwise(voting).alias("v"), F.array_append(acc["out"], now).alias("out"))

        # Each sign is looked for once.
        judged = lambda quoted: F.struct(quoted.alias("quoted"), (~quoted & (p.rlike(VOTING) | acc["v"] & is_name_list(p))).alias("voting"))
        return let(let(acc["q"] | starts_with_any(p, OPEN_QUOTES), judged), state)

    zero = F.struct(F.lit(False).alias("q"), F.lit(False).alias("v"), F.array().cast("array<struct<quoted:boolean,voting:boolean>>").alias("out"))
    return F.aggregate(paragraphs, zero, step, lambda acc: acc["out"])


def clean_minutes(paragraphs: Column) -> Column:
    """(kept, stripped) of the paragraphs of minutes."""

    def within(args):
        ps = args["ps"]
        start = F.coalesce(args["start"], F.lit(0))
        end = F.coalesce(F.nullif(F.array_position(F.transform(ps, lambda p, i: (i >= start) & p.rlike(MINUTES_END)), True).cast("int"), F.lit(0)) - 1, F.size(ps))

        def body(ps_end):
            body, end = ps_end["body"], ps_end["end"]

            def judge(p, i, state):
                early = i < start
                return (
                    F.when(state["quoted"], "quoted_statement_or_directive").when(state["voting"], "voting")
                    .when(early & ((capitalised_share(p) > CAPITALISED_MOST) | ends_with_any(p, [";", ","])), "header_attendance")
                    .when(early & (organisational(p) | p.rlike(ENUMERATED) | p.rlike(r"^\p{Ll}")), "header_organisational")
                    .when(p.rlike(LONGER_RUN_GOALS), "longer_run_goals_statement").when(p.rlike(NAVIGATION), "navigation").when(p.rlike(MINUTES_PROCEDURAL), "procedural")
                    .when(_is_media(p), "media_contact").when(~_has_words(p, MINUTES_FEWEST), "fragment").when(~_has_words(p, HEADING_FEWEST) & ~ends_with_any(p, SENTENCE_ENDS), "heading")
                )

            def gather(states):
                judged = F.transform(body, lambda p, i: F.struct(p.alias("p"), judge(p, i, F.get(states, i)).alias("rule")))

                def parts(judged):
                    kept = F.transform(F.filter(judged, lambda j: j["rule"].isNull()), lambda j: j["p"])
                    lines = F.transform(F.filter(judged, lambda j: j["rule"].isNotNull()), lambda j: _log(j["rule"], j["p"]))
                    warn = F.when(args["start"].isNull(), F.array(_log("warning", F.lit("no start anchor found")))).otherwise(F.array().cast("array<struct<rule:string,text:string>>"))
                    tail = F.transform(F.slice(ps, end + 1, F.size(ps)), lambda p: _log("tail", p))
                    return F.struct(kept.alias("kept"), F.concat(warn, tail, lines).alias("stripped"))

                return let(judged, parts)

            return let(latches(body), gather)

        return let(F.struct(F.slice(ps, 1, end).alias("body"), end.alias("end")), body)

    return let(F.struct(paragraphs.alias("ps"), first_index(paragraphs, lambda p: p.rlike(MINUTES_START)).alias("start")), within)
