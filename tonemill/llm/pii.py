"""Operator 9 (native): personal data by candidates and boosted trees.

Base spans come from fixed patterns (e-mail, IP, card, phone) with their checks. Generators of high recall propose overlapping
spans whatever marks a base pattern would ask for: runs and groups of digits of any length, e-mail addresses whose signs are
spelled out or bracketed, IPv6 and bracketed IPv4 addresses. Boosted trees score them by format and context bins alone
(grouping, separators, lengths, the words before in four languages, the characters beside): a candidate that meets a base
span of its kind is a known positive, and the marks that decide the base patterns (a plus sign, the at sign) are no
features, so what has the format and context of known data is found without them.

Other candidates are unlabelled, not negative: the lower quartile of known positives' scores in held-out texts estimates which
share of positives is known, and with it how many positives a bin holds, so many unmarked numbers don't hide each other. Each kind's
threshold is calibrated to a precision on held-out texts (one in HELD_OUT, by hash). For cards the check digit settles it: one that
fails is a negative and is never added. Of overlapping candidates the likeliest stays, and none that meets a base span
is added. Training needs one grouped count over all rows (a table bounded by the bins); text never leaves the JVM. Without
``models`` they are trained on the table itself; ``train`` and ``boosting.to_json`` keep them, so that spans don't depend on
the other documents of a run.

Positions: a pattern's matches and the pieces between them (split) give offsets and contexts, row by row; a match that overlaps others
is found among them by binary search. Repeats are possessive. A text's work is in proportion to its length and, times a logarithm, to
its candidates, however long it is or many they are.

Defined cases: null and empty texts have no spans; repeated rows are scanned alike; without positives or other candidates a
kind adds no spans; of overlapping candidates with equal scores the first, then the longest stays; other columns pass through,
and on a clash the added column gets a trailing underscore.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, calibrate, fit, labelled_share
from .common import free_name, settle

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.85
FEATURES = ["digits", "separators", "style", "head", "tail", "context", "edges"]

# The base patterns, with possessive repeats; a run begins where the run before it doesn't go on.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Generators of candidates: digits, e-mail addresses, IP addresses.
RUNS = r"(?<![0-9])\(?[0-9]++(?:[().\x20-]++[0-9]++)*+"
GROUPS = r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])"
_AT, _DOT = r"(?:@|\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20)", r"(?:\.|\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
MAILS = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
HOSTS = r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]++){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]))"
_V6 = "[0-9A-Fa-f]{1,4}"
#: Strictly written addresses, brackets undone.
VALID_HOST = rf"^(?:{_OCTET}(?:\.{_OCTET}){{3}}|(?:{_V6}:){{7}}{_V6}|(?=(?:[^:]*:){{2,7}}[^:]*$)(?:{_V6}(?::{_V6}){{0,5}})?::(?:{_V6}(?::{_V6}){{0,5}})?)$"
KNOWN_ENDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|ch|at|eu|us|mx|ar"

# Words before a candidate, in English, German, French and Spanish.
PHONE_WORDS = "phone|telephone|tel|call|fax|mobile|cell|dial|telefon|handy|rufnummer|anrufen|téléphone|tél|portable|appelez|teléfono|móvil|celular|llame"
CARD_WORDS = "card|visa|mastercard|amex|credit|debit|account|iban|karte|kreditkarte|konto|carte|compte|tarjeta|cuenta"
OTHER_WORDS = "id|no|nr|order|invoice|page|date|year|code|ref|isbn|version|bestellung|rechnung|seite|datum|jahr|commande|facture|année|pedido|factura|página|fecha|año"
MAIL_WORDS = "mail|email|e-mail|contact|write|kontakt|schreiben|courriel|écrire|contacto|correo"
HOST_WORDS = "ip|address|host|server|adresse|serveur|dirección|servidor"

#: Known positives of these kinds are a share of all; one text in HELD_OUT is for thresholds alone.
PARTLY_KNOWN, HELD_OUT = ("email", "ip", "phone"), 4
#: The source of what each generator (runs, groups, mails, hosts) proposes, and the source that proposes a kind.
GENERATORS = (0, 0, 1, 2)
SOURCE = {"email": 1, "ip": 2, "card": 0, "phone": 0}

#: Characters before a candidate that are its context.
BEFORE = 24


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column, first: Column) -> Column:
    return F.aggregate(values, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` and, for each name of ``patterns`` (pattern, and which rows can have a match), an array of (s, e, t, left, after) of the pattern's leftmost
    non-overlapping matches in the column ``text``: code points, end exclusive; the BEFORE characters before and the one after.

    All of it comes from the pieces between matches: the text is not cut anew for each. Where a match starts is a sum of lengths. A fold
    that appends copies what it has at each step, so sums are made in stretches of about the root of their number: of each stretch, then
    over the stretches, then within them. Each step is a column, which keeps the expressions small.
    """
    kept, t = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{text}`")
    both, width, parts, at = ({n: f"{n}\x00{k}" for n in patterns} for k in ("both", "width", "parts", "at"))
    none = F.array().cast("array<struct<p:string,t:string>>")

    def pieces(pattern: str) -> Column:
        return F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(p.alias("p"), h.alias("t")))

    df = df.select(*kept, *[F.when(guard, pieces(pattern)).otherwise(none).alias(both[n]) for n, (pattern, guard) in patterns.items()])
    held = [F.col(both[n]) for n in patterns]
    df = df.select(*kept, *held, *[F.greatest(F.ceil(F.sqrt(F.size(c))).cast("int"), F.lit(1)).alias(width[n]) for n, c in zip(patterns, held)])

    def stretches(n: str) -> Column:
        count, size = F.col(width[n]), F.col(both[n])
        lengths = F.transform(size, lambda b: F.char_length(b["p"]) + F.coalesce(F.char_length(b["t"]), F.lit(0)))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(lengths, k * count + 1, count)).alias(parts[n])

    df = df.select(*kept, *held, *[stretches(n) for n in patterns])

    def starts(n: str) -> Column:
        begin = _sums(F.transform(parts[n], lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(F.col(parts[n]), F.slice(begin, 1, F.size(parts[n])), lambda v, first: F.slice(_sums(v, first), 1, F.size(v)))).alias(at[n])

    df = df.select(*kept, *held, *[starts(n) for n in patterns])

    def placed(n: str) -> Column:
        pairs, begin = F.col(both[n]), F.col(at[n])

        def one(b, i):
            # A match and the piece before it have two characters at least, but for a first piece.
            earlier = F.when(F.char_length(b["p"]) < BEFORE, F.array_join(F.transform(F.slice(pairs, F.greatest(i - BEFORE // 2, F.lit(0)) + 1, F.least(i, F.lit(BEFORE // 2))), lambda x: F.concat(x["p"], x["t"])), ""))
            start = F.get(begin, i) + F.char_length(b["p"])
            after = F.concat_ws("", F.get(pairs, i + 1)["p"], F.get(pairs, i + 1)["t"])
            return F.struct(start.alias("s"), (start + F.char_length(b["t"])).alias("e"), b["t"].alias("t"), F.right(F.concat_ws("", earlier, b["p"]), F.lit(BEFORE)).alias("left"), F.left(after, F.lit(1)).alias("after"))

        return F.transform(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), one)

    return df.select(*kept, *[placed(n).alias(n) for n in patterns])


def _below(spans: Column, field: str, limit: Column) -> Column:
    """How many of the spans, which ascend in ``field``, lie below ``limit`` there: a binary search."""

    def step(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(spans, middle)[field] < limit
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~less, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda acc: acc["low"])


#: Up to this many spans are compared one by one.
FEW = 8


def _overlapping(spans: Column, m: Column) -> Column:
    """Those of the spans that may overlap ``m``; the spans ascend and don't overlap each other, so they stand together."""
    first = _below(spans, "e", m["s"] + 1)
    return F.when(F.size(spans) <= FEW, spans).otherwise(_let(first, lambda at: F.slice(spans, at + 1, F.greatest(_below(spans, "s", m["e"]) - at, F.lit(0)))))


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    n = F.length(digits)
    digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def base_patterns(text: Column) -> dict[str, tuple[str, Column]]:
    """The base patterns, and which texts can have a match."""
    return {
        "email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), "phone": (PHONE, text.contains("+")),
    }


def checked(kind: str, found: Column) -> Column:
    """The matches of a base pattern that pass the kind's check."""
    if kind == "ip":
        return F.filter(found, lambda m: m["t"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return F.filter(F.filter(found, lambda m: F.length(_digits(m["t"])).between(16, 19)), lambda m: luhn(_digits(m["t"])))
    return F.filter(found, lambda m: F.length(_digits(m["t"])).between(8, 15)) if kind == "phone" else found


def _said(left: Column, words: str) -> Column:
    return left.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")


def _bins(m: Column, generator: int) -> Column:
    """The binned features of a candidate; their meaning differs by source."""
    t, s, e, source = m["t"], m["s"], m["e"], GENERATORS[generator]
    left, before, after = F.lower(m["left"]), F.right(m["left"], F.lit(1)), m["after"]
    edges = F.when(before.rlike("[A-Za-z0-9]"), 1).otherwise(0) + F.when(after.rlike("[A-Za-z0-9]"), 2).otherwise(0)
    least = lambda c, most: F.least(c, F.lit(most))
    if source == 0:
        group = lambda pattern: least(F.length(F.regexp_extract(t, pattern, 1)), 6)
        values = [
            least(F.length(_digits(t)), 20),
            least(F.length(F.regexp_replace(t, "[0-9]", "")), 5),
            F.when(t.rlike("^[0-9]+$"), 0).when(t.contains("("), 4).when(t.rlike("^[0-9 ]+$"), 1).when(t.rlike("^[0-9-]+$"), 2).otherwise(3),
            group("^\\(?([0-9]+)"),
            group("([0-9]+)$"),
            F.when(_said(left, PHONE_WORDS), 1).when(_said(left, CARD_WORDS), 2).when(_said(left, OTHER_WORDS), 3).otherwise(0),
            edges,
        ]
        luhn_ok = F.when(F.length(_digits(t)).between(13, 19), luhn(_digits(t))).otherwise(False)
    elif source == 1:
        plain = F.regexp_replace(F.regexp_replace(t, _AT, "@"), _DOT, ".")
        end = F.regexp_extract(plain, r"\.([A-Za-z0-9-]+)$", 1)
        local = F.regexp_extract(plain, "^([^@]+)@", 1)
        bare = F.when(t.rlike(r"\x20(?:at|AT)\x20"), F.when(t.rlike(r"\x20(?:dot|DOT)\x20"), 0).otherwise(1)).otherwise(0)
        values = [
            F.when(F.length(local) == 1, 1).when(F.length(local) <= 30, 2).otherwise(3),
            least(F.length(F.regexp_replace(plain, "[^.]", "")), 5),
            bare,
            F.when(F.lower(end).rlike(f"^(?:{KNOWN_ENDS})$"), 1).when(end.rlike("^[A-Za-z]{2,}$"), 2).otherwise(0),
            F.lit(0),
            F.when(_said(left, MAIL_WORDS), 1).otherwise(0),
            F.lit(0),
        ]
        luhn_ok = F.lit(False)
    else:
        plain = F.regexp_replace(t, r"\[\.\]|\(\.\)|\[dot\]", ".")
        values = [F.lit(0), F.lit(0), F.when(plain.rlike(VALID_HOST), 1).otherwise(0), F.lit(0), F.lit(0), F.when(_said(left, HOST_WORDS), 1).when(_said(left, OTHER_WORDS), 3).otherwise(0), edges]
        luhn_ok = F.lit(False)
    return F.struct(F.lit(source).alias("source"), F.lit(generator).alias("generator"), s.alias("s"), e.alias("e"), *[v.cast("int").alias(f) for v, f in zip(values, FEATURES)], luhn_ok.alias("luhn"))


def _meets(spans: Column, m: Column) -> Column:
    return F.exists(_overlapping(spans, m), lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))


def candidates(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, then base spans (email, ip, card, phone: arrays of s, e), candidates (cand: array of m with source, s, e, bins and luhn, and whether it meets a base span of each kind) and whether the text is held out."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    found = df.select(*kept, text.alias("\x00t"))
    t = F.col("\x00t")
    patterns = {f"\x00{k}": v for k, v in base_patterns(t).items()}
    lists = ("\x00runs", "\x00groups", "\x00mails", "\x00hosts")
    digits = t.rlike(r"[0-9][0-9().\x20-]{5}")
    patterns |= {
        "\x00runs": (RUNS, digits), "\x00groups": (GROUPS, digits),
        "\x00mails": (MAILS, t.contains("@") | t.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]|\x20at\x20[^\x20]+\x20dot\x20")),
        "\x00hosts": (HOSTS, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:\[\.\]|\(\.\)|\[dot\])[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")),
    }
    found = with_matches(found, "\x00t", patterns)
    own = {f"\x00{k}": checked(k, F.col(f"\x00{k}")) for k in KINDS} | {"\x00runs": F.filter("\x00runs", lambda m: F.length(m["t"]) >= 7)}
    found = found.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in found.columns])
    # A group that is a whole run is there already.
    found = found.withColumn("\x00groups", F.filter("\x00groups", lambda m: ~F.exists(_overlapping(F.col("\x00runs"), m), lambda r: (r["s"] == m["s"]) & (r["e"] == m["e"]))))

    def binned(generator: int) -> Column:
        return F.transform(lists[generator], lambda m: _bins(m, generator))

    found = found.withColumn("\x00all", F.concat(*[binned(k) for k in range(len(lists))]))
    marks = lambda k: F.transform(f"\x00{k}", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))
    found = found.select(*kept, *[marks(k).alias(f"\x00{k}") for k in KINDS], F.col("\x00all").alias("\x00cand"), (F.pmod(F.xxhash64("\x00t"), F.lit(HELD_OUT)) == 0).alias("\x00held"))
    return found.withColumn("\x00cand", F.transform("\x00cand", lambda m: F.struct(m.alias("m"), *[_meets(F.col(f"\x00{k}"), m).alias(k) for k in KINDS])))


def train(found: DataFrame, precision: float = PRECISION) -> dict[str, Boosted]:
    """One calibrated model per kind, from the counts of all candidates by bins."""
    rows = found.select(F.explode("\x00cand").alias("c"), F.col("\x00held").alias("held"))
    counts = rows.groupBy("held", F.col("c.m.source").alias("source"), *[F.col(f"c.m.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), *[F.count_if(f"c.{k}").alias(k) for k in KINDS])
    table = sorted(tuple(r) for r in counts.collect())  # bounded by the product of the bins
    data = np.array(table, dtype=np.float64).reshape(-1, 2 + len(FEATURES) + 1 + len(KINDS))
    models = {}
    for k, kind in enumerate(KINDS):
        own = data[data[:, 1] == SOURCE[kind]]
        seen, held = own[own[:, 0] == 0], own[own[:, 0] == 1]
        if not len(held):  # few texts: what is there serves both
            held = seen
        parts = [(d[:, 2 : 2 + len(FEATURES)], d[:, 2 + len(FEATURES)], d[:, 3 + len(FEATURES) + k]) for d in (seen, held)]
        (x, n, pos), (hx, hn, hpos) = parts
        models[kind] = fit(FEATURES, x, pos, n - pos)
        known = labelled_share(models[kind], hx, hpos) if kind in PARTLY_KNOWN else 1.0
        calibrate(models[kind], hx, hpos, hn - hpos, precision, known)
    return models


def select_spans(models: dict[str, Boosted]) -> Column:
    """Array of (k, s, e, kind, base, score) by kind as listed, then start, from the columns of ``candidates``."""
    rank = {k: i for i, k in enumerate(KINDS)}

    def make(kind, m, base, score):
        return F.struct(F.lit(rank[kind]).alias("k"), m["s"].alias("s"), m["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), score.alias("score"))

    def option(kind, m):
        # In order of liking: score, then start, length and kind.
        ranked = lambda v: F.struct((-v).alias("least"), m["s"].alias("s"), (-m["e"]).alias("least_e"), F.lit(rank[kind]).alias("k"), m["generator"].alias("generator"), make(kind, m, False, v).alias("x"))
        score = models[kind].column(lambda f: m[f])
        return F.when((m["source"] == SOURCE[kind]) & (m["luhn"] if kind == "card" else F.lit(True)), _let(score, lambda v: F.when(F.round(v, 9) >= models[kind].threshold, ranked(v))))

    def fixed(kind):
        return F.transform(f"\x00{kind}", lambda m: make(kind, m, True, F.lit(1.0)))

    base = F.concat(*[fixed(k) for k in KINDS])
    able = [kind for kind, model in models.items() if model.trees and model.threshold <= 1]
    if not able:
        return F.array_sort(base)
    # Each free candidate's best kind; what a generator proposes ascends and doesn't overlap itself.
    free = F.filter("\x00cand", lambda c: ~(c["email"] | c["ip"] | c["card"] | c["phone"]))
    rated = F.filter(F.transform(free, lambda c: F.array_min(F.array(*[option(kind, c["m"]) for kind in able]))), lambda x: x.isNotNull())
    liking = lambda x: F.struct(x["least"], x["s"], x["least_e"], x["k"])

    def best(rated):
        def proposed(g):
            return F.transform(F.filter(rated, lambda x: x["generator"] == g), lambda x: F.struct(x["x"]["s"].alias("s"), x["x"]["e"].alias("e"), liking(x).alias("liking")))

        lists = F.struct(*[proposed(g).alias(f"l{g}") for g in range(len(GENERATORS))])

        def unbeaten(held):
            def beaten(b):
                spans = [F.exists(_overlapping(held[f"l{g}"], b["x"]), lambda a: (a["s"] < b["x"]["e"]) & (b["x"]["s"] < a["e"]) & (a["liking"] < liking(b))) for g in range(len(GENERATORS))]
                return functools.reduce(lambda x, y: x | y, spans)

            return F.array_sort(F.concat(base, F.transform(F.filter(rated, lambda b: ~beaten(b)), lambda b: b["x"])))

        return _let(lists, unbeaten)

    return _let(rated, best)


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii_spans", keep: list[str] | None = None, models: dict[str, Boosted] | None = None) -> DataFrame:
    """``keep`` (all columns) and ``out_col``: array of (k, s, e, kind, base, score). Without ``models`` they are trained on ``df`` itself."""
    keep = list(df.columns) if keep is None else keep
    found = candidates(df, text_col, keep)
    if models is None:
        found = settle(found, "pii-candidates")
        models = train(found)
    return found.select(*[F.col(f"`{c}`") for c in keep], select_spans(models).alias(free_name(df, out_col, keep)))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[PII]", models: dict[str, Boosted] | None = None) -> DataFrame:
    """Replace every found span of ``text_col`` by ``mark`` (overlapping spans as one); null texts stay null."""
    spans = free_name(df, "spans")
    found = find_pii(df, text_col, spans, None, models)
    text = F.col(f"`{text_col}`")
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["e"])))
    done = F.aggregate(
        in_order,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))),
    )
    return found.withColumn(text_col, F.when(text.isNotNull(), done)).drop(spans)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest_columns(df: DataFrame, spans_col: str = "pii_spans", text_id: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    base = F.filter(spans_col, lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select(
        text_id, *[count(k) for k in KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col(spans_col)).alias("spans"),
        F.size(spans_col).cast("long").alias("n_spans"), (F.size(spans_col) > 0).alias("has_pii"),
    )
