"""Operators 11, 12, 13: whole queries against brute force, kernels against plain readings, and defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tonemill.llm import codes, fertility, fim, queries

SF = "/root/testdata/sf0.001"
PIECES, RANKS = public_tokenizers.path(queries.PIECES), public_tokenizers.path(queries.BPE_RANKS)
VOCABULARIES = (PIECES, RANKS, public_tokenizers.PATTERN)
LONG = "ab" * 60_000 + " " + "1" * 50_000 + "\n" + " x.\n" * 20_000 + "the same five words again " * 20_000
EDGE = [(1, None, "k"), (2, "", "k"), (3, "  \n\t", "k"), (4, LONG, "k"), (None, "null id", "k"), (6, "same text here", "k"), (6, "same text here", "k"), (7, "other text,\nsame id", "k"), (7, "differs", None), (8, "x <P> y\nz", "k")]


def edge(spark, *clash):
    names = ["doc_id", "text", "lang", *clash]
    return spark.createDataFrame([(*r, *(["c"] * len(clash))) for r in EDGE], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# Operator 11


def base_rules(text):
    """The contract's base rules, read plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_base_counts_on_odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "a", "a b a b a b a b", "\x1c\x85　 x", "é|ß\r\n\né|ß", "w " * 5000, LONG, " ".join(str(i % 700) for i in range(9000))]
    texts += ["".join(rng.choice("ab  \n\t#é<") for _ in range(rng.randrange(300))) for _ in range(300)]
    # Above 2^62 / 7,000^5 windows are renumbered on the way.
    texts.append(" ".join([str(i) for i in range(9000)] + [str(i) for i in range(100, 110)] + [str(rng.randrange(9000)) for _ in range(9000)]))
    for t in texts:
        assert fertility.base_counts(t.encode(), t.encode().split()) == base_rules(t), t[:80]


def fertility_by_hand(text):
    sp, ranks = fertility_by_hand.models
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return None
    pieces = Counter(i for w in words for i in sp.encode(w))
    n, chars = sum(pieces.values()), sum(map(len, words))
    entropy = -sum(c / n * math.log2(c / n) for c in pieces.values())
    return n, chars / n, sum(c for i, c in pieces.items() if sp.is_byte(i) or sp.is_unknown(i)) / n, entropy, chars / sum(len(ranks.encode_ordinary(" " + w)) for w in words)


@pytest.fixture(scope="module", autouse=True)
def models():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    fertility_by_hand.models = sentencepiece.SentencePieceProcessor(model_file=PIECES), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def verdicts(rows, fence, least):
    """Bands and verdicts of {key: (text, lang)}, one text after the other."""
    names = list(fertility.MEASURES)
    read, seen = {}, set()
    for key, (text, lang) in rows.items():
        base, measures = base_rules(text or ""), fertility_by_hand(text or "")
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        scripts = Counter(s for s in (fertility.script(w) for w in (text or "").split()) if s)
        script = min(scripts, key=lambda s: (-scripts[s], s)) if scripts else None
        read[key] = base, measures, failed, lang or None, script
    levels = {}
    for key, (_base, measures, failed, lang, script) in read.items():
        if failed or (lang, rows[key][0]) in seen:
            continue
        seen.add((lang, rows[key][0]))
        size = int(math.log2(measures[0]))
        for level in ("lang", lang), ("script", script), ("all", ""):
            if level[1] is not None:
                levels.setdefault((level, size), []).append(measures[1:])
    out = {}
    for key, (base, measures, failed, lang, script) in read.items():
        outside = []
        if measures:
            size = int(math.log2(measures[0]))
            group = next((levels[(lv, size)] for lv in (("lang", lang), ("script", script), ("all", "")) if lv[1] is not None and len(levels.get((lv, size), ())) >= least), None)
            for k, name in enumerate(names if group else ()):
                width, fewest, by_size = fertility.MEASURES[name]
                bins = sorted(math.floor(m[k] / width) for m in group)
                q1, q3 = (bins[math.ceil(len(bins) * q / 4) - 1] for q in (1, 3))
                spread = max((q3 - q1) * width, fewest, by_size / math.sqrt(2.0**size))
                if not q1 * width - fence * spread <= measures[1 + k] <= (q3 + 1) * width + fence * spread:
                    outside.append(name)
        out[key] = (*base, failed, not failed and not outside, ",".join(outside))
    return out


@pytest.mark.parametrize(("fence", "least"), [(fertility.FENCE, fertility.LEAST), (0.3, 8)])
def test_quality_rules_against_brute_force(spark, texts, fence, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = fertility.digest_columns(fertility.judge(docs, *VOCABULARIES, keep=["doc_id"], fence=fence, least=least)).collect()
    want = verdicts(texts, fence, least)
    assert len(found) == len(texts) and {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.rejected_by) for r in found} == want
    if least < fertility.LEAST:
        assert any(r.rejected_by for r in found)
    for r in found:
        by_hand = fertility_by_hand(texts[r.doc_id][0] or "")
        assert by_hand is None or (r.n_pieces == by_hand[0] and np.allclose([r.chars_per_piece, r.fallback_share, r.entropy, r.chars_per_byte_token], by_hand[1:], atol=1e-6))


def test_quality_rules_bands_by_language_and_script(spark):
    """Gibberish of one language's letters goes, plain texts of every language stay; a rare language is judged by its script; copies of one text don't close a band."""
    rng = random.Random(9)
    words = {"en": "the house of many small rooms stands near our old river and its bridge where people walk every morning".split(), "xx": "das Haus mit vielen kleinen Zimmern steht nahe dem alten Fluss und seiner Brücke wo Leute jeden Morgen gehen".split()}
    rows = [(i, " ".join(rng.choice(words["en"]) for _ in range(rng.randrange(130, 250))), "en") for i in range(200)]
    rows += [(300 + i, " ".join(rng.choice(words["xx"]) for _ in range(90)), "xx") for i in range(5)]
    rows += [(400 + i, f"{rows[0][1]} {rng.choice(words['en'])}", "en") for i in range(300)]
    rows += [(900 + i, " ".join("".join(rng.choice("qxzjkvw") for _ in range(5)) for _ in range(50)), "en") for i in range(5)]
    rows += [(950, " ".join(chr(0x16A0 + rng.randrange(60)) * 3 for _ in range(40)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in fertility.judge(df, *VOCABULARIES).collect()}
    assert all(found[i].kept for i in [*range(200), *range(400, 700)])
    assert not any(found[i].kept for i in range(900, 905)) and "chars_per_piece" in found[900].rejected_by
    assert found[950].script == "RUNIC" and found[950].fallback_share > 0.8 and found[950].kept  # too few of its size to judge by
    assert all(found[i].script == "LATIN" for i in range(300, 305)) and not any("fallback_share" in found[i].rejected_by for i in range(300, 305))


def test_quality_rules_defined_cases(spark):
    df = edge(spark, "n_words", "Kept", "digest")
    out = fertility.judge(df, *VOCABULARIES)
    rows = out.collect()
    assert len(rows) == len(EDGE) and {"doc_id", "n_words", "n_words_", "Kept", "kept_", "digest"} <= set(out.columns) and "text" not in out.columns
    by_id = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3, 4)}
    assert all(by_id[i]["n_words_"] == 0 and by_id[i].base_failed and by_id[i].chars_per_piece is None and not by_id[i]["kept_"] for i in (1, 2, 3))
    assert [by_id[4][c] for c in ("n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == list(base_rules(LONG))
    assert fertility.judge(df.limit(0), *VOCABULARIES).count() == 0


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(fertility, "MEMO_WORDS", 20)
    v = fertility.Vocabularies(*VOCABULARIES)
    rng = random.Random(3)
    for _ in range(50):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 2, 70]))) for _ in range(15)]
        fresh = fertility.Vocabularies(*VOCABULARIES) if rng.random() < 0.1 else None
        got = v.measures(words, sum(map(len, words)))
        assert fresh is None or got == fresh.measures(words, sum(map(len, words)))
        assert sum(len(w) > fertility.MEMO_BYTES for w in v.memo) <= 15 and len(v.memo) <= 35


def test_each_distinct_word_of_a_text_is_measured_once(monkeypatch):
    v = fertility.Vocabularies(*VOCABULARIES)
    words = [w.encode() for w in "der Hund läuft über der Straße der Stadt 42 мир , мир".split()]
    got, asked = v.measures(words, 40), []
    monkeypatch.setattr(fertility, "script", lambda w: asked.append(w) or "")
    monkeypatch.setattr(v, "bytes", None)  # nothing is tokenised again
    assert v.measures(words * 3, 120)[3:] == pytest.approx(got[3:]) and asked == []
    number = v.numbered(words)
    assert len(number[0]) == 9 and sorted(number[2].tolist()) == [1] * 7 + [2, 3] and fertility.repeated_numbers(number[1], 9, 1) == 5


# Operator 12


def cut_by_hand(doc_id, text):
    """The contract's transformation, read plainly: (n, form, prefix, middle, output)."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_marks_of_every_byte(monkeypatch):
    rng = random.Random(2)
    for stretch in (7, 1 << 20):
        monkeypatch.setattr(fim, "STRETCH", stretch)
        for _ in range(300):
            docs = ["".join(rng.choice("<PSM>\nañ🙂<><") for _ in range(rng.randrange(30))).encode() for _ in range(8)]
            ends = np.cumsum([0] + [len(d) for d in docs])
            got = fim.automaton(fim.SENTINELS).marks(np.frombuffer(b"".join(docs), dtype=np.uint8), ends[:-1][ends[1:] > ends[:-1]])
            for d, a, b in zip(docs, ends, ends[1:], strict=False):
                want = [(byte & 0xC0 != 0x80) * fim.CHARACTER | (k == 0 or d[k - 1] == 10) * fim.UNIT | d[: k + 1].endswith((b"<P>", b"<S>", b"<M>")) * fim.SENTINEL for k, byte in enumerate(d)]
                assert got[a:b].tolist() == want
            starts = [k for k, w in enumerate(want) if w & fim.UNIT]
            assert [fim.unit_begin(got[a:b], k) for k in range(len(starts) + 1)] == [*starts, len(d)]


def test_fill_in_middle_defined_cases_and_odd_texts(spark):
    rng = random.Random(8)
    odd = [(100 + i, "".join(rng.choice("ab\n\né🙂<P>S \r") for _ in range(rng.randrange(60))), "k") for i in range(400)]
    df = edge(spark, "fim_text", "Fim_form").unionByName(spark.createDataFrame([(*r, "c", "c") for r in odd], "doc_id long, text string, lang string, fim_text string, Fim_form string"))
    out = fim.fill_in_middle(df)
    assert {"fim_text", "fim_text_", "Fim_form", "fim_form_", "lang"} <= set(out.columns)
    rows = out.withColumn("back", fim.restore(F.col("fim_text_"), F.col("fim_form_"))).collect()
    assert len(rows) == len(EDGE) + len(odd)
    for r in rows:
        assert (r.n_units, r["fim_form_"], r.prefix_chars, r.middle_chars, r["fim_text_"]) == cut_by_hand(r.doc_id, r.text or "") and r.back == (r.text or "")
    assert {r["fim_form_"] for r in rows} == {"plain", "psm", "spm"} and fim.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_rates_and_sentinels(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb <P>\nc") for i in range(400)], "doc_id long, text string")
    own = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    out = fim.fill_in_middle(df, seed="s", rate=50, spm_rate=0, sentinels=own)
    forms = Counter(r.fim_form for r in out.collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260
    assert out.where(fim.restore(F.col("fim_text"), F.col("fim_form"), own) != F.col("text")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)


# Operator 13


def compress_by_hand(rows, rounds=2):
    """The contract's codes by plain loops over whole numbers: {row number: (code, error)} and the codebooks' digest."""
    ints = [[math.floor(256 * x) for x in v] for _, v in rows]
    dim = len(ints[0])
    cut = [(k * dim // 16, (k + 1) * dim // 16) for k in range(16)]
    first = [v for _, v in sorted(dict(sorted(((i, v) for (i, _), v in zip(rows, ints, strict=True)), reverse=True)).items())][:64]
    books = [[v[s:e] for v in first] for s, e in cut]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, (s, e) in enumerate(cut):
            groups = {}
            for v in ints:
                groups.setdefault(nearest(v[s:e], books[p])[0], []).append(v[s:e])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for v in ints:
        found = [nearest(v[s:e], b) for (s, e), b in zip(cut, books, strict=True)]
        out.append(("".join(f"{i:02x}" for i, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()


def test_nearest_entry_through_cells():
    rng = np.random.default_rng(4)
    for dim, spread, n in ((4, 200, 64), (4, 2, 64), (1, 5, 10), (7, 10**6, 64), (3, codes.LIMIT, 64), (2, 0, 1), (5, 1, 64)):
        x = rng.integers(-spread, spread + 1, (500, dim))
        entries = np.vstack([x[: n // 2], rng.integers(-spread // 3, spread // 3 + 1, (n - n // 2, dim))])
        entry, far = codes.Approximations(entries).nearest(np.vstack([x, 3 * x]))
        every = ((np.vstack([x, 3 * x])[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_codes_defined_cases(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], i % 3 or None) for i in range(150)]
    rows += [(3, rows[3][1], 0), (None, rows[5][1], 1)]
    other = [(500 + i, [float(rng.randrange(-3, 4)) for _ in range(5)], 7) for i in range(20)]
    bad = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 1)]
    extreme = [(950, [1e38, -1e38] * 24, None), (951, [], 2)]
    df = spark.createDataFrame([(*r, "c") for r in rows + other + bad + extreme], "vec_id long, embedding array<double>, label int, codes string")
    found = codes.compress(df).collect()
    assert len(found) == len(rows) + len(other) + 2
    for part in (rows, other):
        want, digest = compress_by_hand([(1e9 if i is None else i, v) for i, v, _ in part])
        ids = {r[0] for r in part}
        got = sorted((r for r in found if r.codebooks_sha256 == digest), key=lambda r: (r.vec_id is None, r.vec_id or 0))
        assert len(got) == len(part) and {r.vec_id for r in got} == ids
        assert Counter((r.vec_id, bytes(r.codes).hex(), r.error) for r in got) == Counter((p[0], *w) for p, w in zip(part, want, strict=True))
    of_label = Counter()
    for r in found:
        of_label[r.label] += r.error
    assert all(r.label_error == of_label[r.label] for r in found)
    assert codes.compress(df.limit(0)).count() == 0


def test_codes_with_labels_too_many_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, [math.sin(i * k) for k in range(16)], 0 if i < 300 else i) for i in range(900)], "vec_id long, embedding array<double>, label int")
    want = {r.vec_id: r for r in codes.compress(df).collect()}
    monkeypatch.setattr(codes, "small", lambda frame: frame)
    monkeypatch.setattr(codes, "HOT_SHARE", 10)
    assert {r.vec_id: r for r in codes.compress(df).collect()} == want
