"""Rules, secrets and licences against plain Python."""

import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from catalens.llm import license_scan, quality_rules, secret_scan
from llm_rows import CLASHING

ODD = [
    (1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (None, "a b c"), (4, "x" * 40000),
    (5, "same line here\nsame line here\n\nsame line here"), (6, "Und " * 3000),
    (7, " ".join(f"w{i % 11}" for i in range(200))), (8, "# * $ % & | < >"), (9, "é b c"),
]


def _table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], CLASHING)


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    marks = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(inside)


def test_rule_counts(spark):
    got = quality_rules.apply_rules(_table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        want = _counts(r.text)
        assert (r["_n_words"], r.word_chars, r.n_symbols,
                r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["_kept"] and r.base_failed)


def test_rule_order_changes_no_verdict(spark):
    prose = "The weather was mild and the harbour stayed quiet until the evening boats came in again. "
    rows = [(i, prose * 2 + x) for i, x in enumerate(["", "!!! " * 40, "### " * 60, "WORD " * 80, "1234 " * 90])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = []
    for rules in (quality_rules.RULES, tuple(reversed(quality_rules.RULES))):
        verdicts.append(
            docs.select("doc_id", quality_rules.first_rejection(F.col("text"), rules).isNull()).collect()
        )
    assert sorted(verdicts[0]) == sorted(verdicts[1])
    assert quality_rules.apply_rules(docs, max_repeat_percent=100).filter("kept").count() == 1


def test_cheap_and_strict_rules_first():
    rule = lambda n: quality_rules.Rule(n, lambda t: t == "")
    measured = [
        quality_rules.Measured(rule("slow"), 2.0, 0.5), quality_rules.Measured(rule("none"), 0.1, 0.0),
        quality_rules.Measured(rule("best"), 0.5, 0.4),
    ]
    assert [r.name for r in quality_rules.order_rules(measured)] == ["best", "slow", "none"]


def test_rules_on_an_empty_table(spark):
    assert quality_rules.apply_rules(_table(spark, []).filter("false")).count() == 0


FORMS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def _spans(text):
    base = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, form, group, least) in enumerate(FORMS)
        for m in form.finditer(text)
        if len(m.group(group)) >= least
    ]
    flagged = [f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in secret_scan.ALLOWED]
    added = []
    for c in secret_scan.CLASSES:
        for m in re.finditer(c.run, text):
            if not re.search(c.needs, m.group()):
                continue
            # A window that meets an allow-listed part is never hot.
            s = re.sub("|".join(flagged), lambda x: " " * len(x.group()), m.group())
            found = []
            for i in range(len(s) - c.window + 1):
                if " " in s[i : i + c.window]:
                    continue
                shares = [n / c.window for n in Counter(s[i : i + c.window]).values()]
                if -sum(p * math.log2(p) for p in shares) >= c.bits:
                    if found and found[-1][1] >= i:
                        found[-1][1] = i + c.window
                    else:
                        found.append([i, i + c.window])
            added += [(m.start() + a, secret_scan.KINDS.index(c.kind), m.start() + b, c.kind) for a, b in found]
    within = lambda a, b: b[0] <= a[0] and a[2] <= b[2]
    added = [a for a in added if not any(within(a, b) for b in base)]
    added = [a for a in added if not any(o[1] < a[1] and within(a, o) for o in added)]
    return sorted(base), sorted(base + added)


def _secret_texts():
    rng = random.Random(1)
    wide = string.ascii_letters + string.digits + "+/_-"
    starts = ["é token: ", "password=", "x", "AKIA", "AKIAAKIA", "secret='", "APIKEY:", "secret:token:", " "]
    sets = [wide, "0123456789abcdef", "AB12", "0123456789ABCDEF", "ab"]
    rows = [
        (i, " ".join(
            rng.choice(starts) + "".join(rng.choice(rng.choice(sets[:1] * 3 + sets)) for _ in range(rng.choice([3, 6, 19, 25, 40, 80])))
            for _ in range(rng.choice([1, 4]))
        ))
        for i in range(80)
    ]
    rows += [
        (100, "550e8400-e29b-41d4-a716-446655440000"), (101, "aB3" * 9 + "example" + "xY7qLmZp0RtUvWkJ2n"),
        (102, " " + "".join(rng.choice(wide) for _ in range(700))),
        (103, "".join(rng.choice("0123456789ABCDEF") for _ in range(64))),
        # An allow-listed part within a hot run: what stands before and behind it stays a secret.
        (104, "".join(rng.choice(wide) for _ in range(60)) + "example" + "".join(rng.choice(wide) for _ in range(60))),
        # Spans that cover a base span in half: slashes and dashes end neither.
        (105, "".join(rng.choice(wide[:62]) for _ in range(30)) + "+token=" + "".join(rng.choice(wide[:62]) for _ in range(30))),
        (106, "f0e1d2c3b4a5968778695a4b3c2d1e0f" + "Zq9/Xk3+Wv7-Jt5_Rp1Lm" * 2),
        (107, "AKIA" + "".join(rng.choice("ABCDEFGHIJ") for _ in range(17)) + "q8Zx3Kv9Tj5Wp1Rm7Lc2Yb4"),
    ]
    return rows + ODD


def test_secret_spans(spark):
    rows = secret_scan.scan_secrets(_table(spark, _secret_texts())).select(
        "text", secret_scan.span_text(F.col("base_spans")).alias("b"),
        secret_scan.span_text(F.col("all_spans")).alias("a"),
        secret_scan.redact(F.col("text"), F.col("all_spans"), "~").alias("clean"),
    ).collect()
    named = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    added = 0
    for r in rows:
        base, every = _spans(r.text or "")
        assert (r.b, r.a) == (named(base), named(every))
        added += len(every) - len(base)
        out, at = "", 0
        for s, _, e, _ in every:
            if e > at:
                out, at = (out + r.text[at:s] + "~" if s >= at else out), e
        assert r.clean == (None if r.text is None else out + r.text[at:])
    assert added > 20
    spans = {r.text: r.a for r in rows}
    around = [a for t, a in spans.items() if t and "example" in t and len(t) == 127]
    assert around and all(x.count("entropy_base64") == 2 for x in around)
    halves = [
        (b, e) for r in rows for b, e in [(_spans(r.text or "")[0], _spans(r.text or "")[1])]
        if any(x[0] < y[0] < x[2] or x[0] < y[2] < x[2] for x in e if x[3].startswith("entropy") for y in b)
    ]
    assert halves
    assert "550e8400" in next(r.clean for r in rows if r.text and r.text.startswith("550e"))


def _planted(n):
    """Strings of each class, by name and length, with the share of them that must be found."""
    rng = random.Random(7)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    sets = [
        ("base36", low + dig, [(20, 0.9), (24, 0.95), (32, 0.95)]), ("base32", up + "234567", [(20, 0.9), (32, 0.95)]),
        ("letters", low + up, [(20, 0.8), (32, 0.95)]), ("small", low, [(20, 0.8), (32, 0.95)]),
        ("mixed", low + up + dig, [(20, 0.9), (22, 0.9), (32, 0.95)]), ("hex", dig + "ABCDEF", [(24, 0.95), (31, 0.95)]),
    ]
    return [
        (f"{name}{size}", "".join(rng.choice(a) for _ in range(size)), share)
        for name, a, sizes in sets for size, share in sizes for _ in range(n)
    ]


def test_every_kind_of_token_is_found(spark):
    planted = _planted(100)
    rows = [(f"See the notes ({s}) for the harbour.", kind, share) for kind, s, share in planted]
    docs = spark.createDataFrame(rows, "text string, planted string, share double").repartition(8)
    clean = secret_scan.redact(F.col("text"), F.col("all_spans"), "~")
    gone = (F.size("all_spans") > 0).cast("int")
    whole = (clean == "See the notes (~) for the harbour.").cast("int")
    got = secret_scan.scan_secrets(docs).groupBy("planted").agg(
        F.avg(gone).alias("found"), F.max("share").alias("share"), F.sum(whole).alias("whole")).collect()
    for r in got:
        assert r.found >= r.share and r.whole > 0, r


def test_words_and_allowed_parts_are_no_secrets(spark):
    rng = random.Random(8)
    random_part = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    words = [
        "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaften", "internationalization",
        "createXmlRequestObjectFactory", "MAXIMUM_NUMBER_OF_CONNECTIONS", "counterrevolutionaries",
        "docs/guides/getting-started-with-the-harbour", "entwicklungswerkzeug", "ELECTROENCEPHALOGRAPHICALLY",
        "abcdefghijklmnopqrstuvwxyz", "550e8400-e29b-41d4-a716-446655440000",
        "sha512-" + random_part, "incomprehensibilities2024", "antidisestablishmentarianism",
    ]
    rows = [(i, f"the {w} of it") for i, w in enumerate(words)] + [(100, f"the example{random_part} of it")]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(
        spark.createDataFrame(rows, "doc_id int, text string")
    ).select("doc_id", secret_scan.span_text(F.col("all_spans")).alias("spans")).collect()}
    assert not any(found[i] for i in range(len(words))), found
    # All but the allow-listed word itself.
    assert found[100].endswith(":11:51")


def test_secrets_in_an_empty_table(spark):
    assert secret_scan.scan_secrets(_table(spark, []).filter("false")).count() == 0


def _phrases(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        parts = phrase.split()
        found = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_licence_phrases(spark):
    rows = ODD + [
        (20, "mit license MIT-License mit"), (21, "Apache License " * 2000), (22, "GENERAL public\nlicense"),
        (23, "Ému MIT License"), (24, "smit license"),
    ]
    for r in license_scan.scan_licences(_table(spark, rows)).collect():
        assert (r["_n_words"], r.n_base, r.first_word, r.last_word, list(r.base_labels)) == _phrases(r.text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_licence_templates(spark):
    filler = " boats came in again until the evening "
    rows = [(i, filler * 3 + t.text + " " + filler) for i, t in enumerate(license_scan.TEMPLATES)]
    rows += [(100 + i, filler * (i + 1)) for i in range(20)]
    # All words of a notice, but neither in place nor as its key phrase.
    rows.append((200, " ".join(reversed("Licensed under CC BY-NC 4.0".split())) + " " + filler))
    found = {r.doc_id: r for r in license_scan.scan_licences(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(license_scan.TEMPLATES):
        assert t.label in found[i].labels and found[i].score > 0.9, t
    assert all(not found[i].labels and found[i].score == 0 for i in [*range(100, 120), 200])


def _notices(words, idf, top_words=8, threshold=0.6):
    """Labels and greatest score by trying every relative position of every template."""
    line = f" {' '.join(words)} "
    labels, score = {label for phrase, label in license_scan.BASE if f" {phrase} " in line}, 0.0
    for t in license_scan.TEMPLATES:
        own = license_scan._words(t.text)
        rare = sorted(set(own), key=lambda w: (-idf[w], w))[:top_words]
        best = max(
            sum(idf[w] for w in rare if any(x == w and 0 <= at + p < len(words) and words[at + p] == w
                                            for p, x in enumerate(own)))
            for at in range(-len(own), len(words))
        ) / sum(idf[w] for w in rare)
        if best >= threshold and any(f" {key} " in line for key in t.keys):
            labels.add(t.label)
            score = max(score, best)
    return labels, score


def test_several_notices_in_one_file(spark):
    texts = [t.text for t in license_scan.TEMPLATES]
    filler = " boats came in again until the evening "
    rng = random.Random(5)
    rows = [(0, " ".join(texts)), (1, filler.join(texts)), (2, " ".join(reversed(texts)))]
    rows += [(10 + i, filler.join(rng.sample(texts, rng.choice([2, 3, 4, 6])))) for i in range(30)]
    rows += [(100 + i, filler * (i + 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = {w: max(v, 1e-3) for w, v in license_scan.measure_idf(docs, license_scan.TEMPLATES).items()}
    for r in license_scan.scan_licences(docs).collect():
        labels, score = _notices(license_scan._words(r.text), idf)
        assert set(r.labels) == labels, r.doc_id
        # A base phrase alone scores the threshold.
        assert math.isclose(r.score, min(max(score, 0.6 * (r.n_base > 0)), 1.0), abs_tol=1e-9)
        if r.doc_id < 3:
            assert labels >= {t.label for t in license_scan.TEMPLATES}


def test_licences_in_an_empty_table(spark):
    assert license_scan.scan_licences(_table(spark, []).filter("false")).count() == 0
