"""License scan, source divergence and spelling variants against brute force, on small and odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from girderframe.llm import common, decontamination, divergence, licenses, mixing, ngram_join, pii, quality_model, spelling, toxicity

SMALL = "/root/testdata/sf0.001"
#: Extra columns whose names are used inside.
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, `words` string, `places` int, `term` string, `n` int, `word` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", 1, "y", 2, "z") for i, t, lang, s in rows], DOCUMENT)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def odd_documents(seed=5):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "gammas", "delta", "deltas", "Straße", "strasse", "éte", "été", "KKelvin", "x9y", "日本語", "a"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(0, None, None, None), (1, "", "", ""), (2, " \t\n.,;", "en", None), (3, "one", "xx", "lonely"), (4, text(4000), "en", "a"), (5, text(4000), "en", "b")]
    rows += [(10 + k, text(30), ["en", "de", None][k % 3], ["a", "b", "", "Ä"][k % 4]) for k in range(60)]
    return rows + rows[6:9] + [(None, text(20), "en", "a"), (None, text(20), "en", "a")]


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def sql_rows(df, sql):
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(r[k] for k in order) for r in result.fetchall())


# --- licences ------------------------------------------------------------------------------


NOTICES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. MIT license",
    "Licensed under CC BY-NC 4.0.",
    "licensed under the APACHE LICENSE; Version 2.0 (the same)",
    "gnu general publik license, cc-by, mitt",
    "Permission is hereby granted, entirely free of charge, to any person obtaining a copy of this software and its associated documentation files",
    "redistribution and use in binary forms are permitted",
    "version 3 GNU\nGeneral\tPublic_License",
    "cc by cc by cc by",
]


def licensed_documents():
    rng = random.Random(1)
    words = ["the", "of", "software", "license", "public", "gnu", "version", "free", "permission", "Zeile", "été", "x"]
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "...", None, None)]
    for k, notice in enumerate(NOTICES * 2):
        around = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40]))) for _ in range(2)]
        rows.append((10 + k, f"{around[0]} {notice} {around[1]}", "en", "a"))
    rows += [(50 + k, " ".join(rng.choice(words) for _ in range(200)), "en", "b") for k in range(20)]
    rows += [(80, " ".join(rng.choice(words) for _ in range(20_000)) + " MIT License", "en", "b"), (None, "mit license", "en", "c"), (None, "mit license", "en", "c")]
    return rows + rows[3:5]


def base_places(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(found), sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split())


def test_license_places_equal_brute_force(spark):
    documents = licensed_documents()
    got = licenses.license_digest(licenses.scan_licenses(frame(spark, documents))).collect()
    want = Counter()
    for doc_id, text, *_ in documents:
        n, places = base_places(text)
        want[(doc_id, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    labels = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in got}
    assert labels[10] == {"gpl", "gpl-3.0"} and labels[11] == {"mit"} and labels[12] == {"cc-by", "cc-by-nc"} and labels[13] == {"apache", "apache-2.0"}
    assert labels[14] == {"cc-by"} and labels[15] == {"mit"} and labels[16] == set() and labels[18] == {"cc-by"}
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


def test_license_scan_equals_its_sql(spark):
    """The SQL tries every template at every place; the index must lose none of them."""
    documents = frame(spark, licensed_documents())
    assert rows_of(licenses.license_digest(licenses.scan_licenses(documents))) == sql_rows(documents, licenses.QUERIES["op11_license_scan"].sql)


def test_license_index_keeps_every_possible_match():
    rng = random.Random(2)
    for _ in range(300):
        words = [f"w{k}" for k in range(rng.randint(1, 9))]
        weight = {w: rng.randint(1, 50) for w in words}
        template = licenses.Template("x", " ".join(words), (), percent=rng.choice([50, 80, 100]))
        chosen = set(licenses.indexed_positions(template, weight))
        total = sum(weight.values())
        missing = sum(weight[w] for k, w in enumerate(words) if k not in chosen)
        assert missing * 100 < template.percent * total


def test_licenses_of_an_empty_table(spark):
    assert licenses.license_digest(licenses.scan_licenses(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(frame(spark, []), [licenses.Template("x", "a " * 6000, ())])


# --- divergence ----------------------------------------------------------------------------


def audit_of(rows, least):
    docs = [(lower("".join(c if c.isascii() else c for c in t or "")), lang or "", s or "") for _, t, lang, s in rows]
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        sources = {d[2] for d in docs if d[1] == lang}
        together = Counter()
        for s in sources:
            together.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(together)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < 10]
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [divergence.BLOCK_BYTES, 2_000])
def test_divergence_equals_brute_force(spark, monkeypatch, block_bytes):
    """Also with blocks of a few terms, so that many runs are merged."""
    documents = odd_documents()
    got = divergence.audit(frame(spark, documents), 10, 10, block_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == audit_of(documents, 10)


def test_divergence_in_small_steps(spark, monkeypatch):
    """Long texts in parts, pairs in small steps and sums handed on early give the same rows."""
    monkeypatch.setattr(common, "LONG_TEXT", 500)
    monkeypatch.setattr(divergence, "STEP_PAIRS", 3)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 2)
    documents = odd_documents()
    assert Counter(map(tuple, divergence.audit(frame(spark, documents)).collect())) == audit_of(documents, 10)


def test_divergence_without_kept_terms_or_rows(spark):
    rows = [(1, "a b", "en", "x"), (2, None, "en", None), (3, "c", "de", "y")]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()))
    assert got == [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    n, words, terms = 9 * 10**17, 10**18 + 12345, 10**9 + 7
    row = spark.createDataFrame([(n, words, terms)], "n long, words long, terms long").select(divergence.share(F.col("n"), F.col("words"), F.col("terms")).cast("long")).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (words + 2 * terms)


# --- spelling ------------------------------------------------------------------------------


def spelling_of(rows, letters=6, uses=5, ratio=5):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= uses}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in words.items():
        found = sorted((-words[x], x) for x in words if near(w, x))
        form = found[0][1] if found and -found[0][0] >= ratio * n else None
        out[w] = [form, None, n, len(found), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return Counter((w, *r) for w, r in out.items())


def variants(seed):
    rng = random.Random(seed)
    letters = "abéx"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(12)] + ["aaaaaaaa", "a" * 40, "b" + "a" * 40, "abababababab"]
    words = []
    for word in base:
        uses = rng.choice([200, 30, 6])
        words += [word] * uses
        for _ in range(6):
            at, what = rng.randrange(len(word)), rng.choice("dir")
            changed = word[:at] + ("" if what == "d" else rng.choice(letters) + ("" if what == "r" else word[at])) + word[at + 1 :]
            words += [changed] * rng.choice([1, 5, 25])
    rng.shuffle(words)
    rows = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[k * 40 : k * 40 + 40]), "en", "a") for k in range(len(words) // 40 + 1)]
    return rows + [(None, "one two aaaaaaaa", None, None), (9999, None, "en", "a"), (9998, "", "en", "a"), (9997, "123 ×÷ ÀÿÀÿÀÿ", "en", "a")] + rows[:2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spelling_equals_brute_force(spark, seed):
    documents = variants(seed)
    got = spelling.spelling_groups(frame(spark, documents))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == spelling_of(documents)


def test_spelling_of_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "LONG_TEXT", 100)
    monkeypatch.setattr(spelling, "HELD_BYTES", 200)
    documents = variants(4)
    assert Counter(map(tuple, spelling.spelling_groups(frame(spark, documents)).collect())) == spelling_of(documents)


def test_forms_chain_to_a_root(spark):
    """Each form is five times as common as its variant; the root is the end of the chain."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(6 * 6**k))
    rows = {r["word"]: r for r in spelling.spelling_groups(frame(spark, [(1, text, "en", "a")])).collect()}
    want = spelling_of([(1, text, "en", "a")])
    assert Counter(tuple(r) for r in rows.values()) == want
    assert rows["aaaaaa"]["root"] == "aaabbb" and rows["aaaaaa"]["form"] == "aaaaab"


def test_neighbours_equal_brute_force_on_a_dense_vocabulary(spark):
    """All words of six letters over two, so every node branches."""
    words = [format(k, "06b").replace("0", "a").replace("1", "b") for k in range(64)] + [format(k, "07b").replace("0", "a").replace("1", "b") for k in range(0, 128, 3)]
    got = {tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_groups(frame(spark, [])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None, None, None), (2, "once only", "en", "a")])).count() == 0


def test_weights_follow_all_documents(spark):
    documents = frame(spark, [(k, "the mit" if k % 2 else "the the", "en", "a") for k in range(10)])
    weight = licenses.weights(documents, [licenses.Template("x", "the mit license", ())])
    assert weight == {"the": 1, "mit": 1 + math.floor(1000 * math.log(11 / 6)), "license": 1 + math.floor(1000 * math.log(11))}


# --- earlier operators ---------------------------------------------------------------------


def test_toxicity_of_pairs_that_tell_nothing_alone(spark):
    """Toxic is what holds exactly one of two terms: neither term's frequency differs between the labels."""
    rng = random.Random(8)
    calm = [f"word{k}" for k in range(60)]
    rows, marks = [], []
    for k in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(calm) for _ in range(15)] + ["northerners"] * a + ["despise"] * b
        rng.shuffle(text)
        rows.append((k, " ".join(text), "en", "a"))
        marks.append((k, int(a != b)))
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).filter("held_out").collect()
    truth = dict(marks)
    assert len(got) > 400 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_free_expectation_maximisation_learns_accuracies():
    """Independent labellers that call 1 to 10 % of the good documents bad: share and accuracies within 0.03."""
    rng = np.random.default_rng(3)
    wrong, right, n = np.array([0.01, 0.03, 0.05, 0.08, 0.10]), np.array([0.7, 0.8, 0.75, 0.9, 0.65]), 40_000
    good = rng.random(n) < 0.85
    votes = np.where(rng.random((n, 5)) < np.where(good[:, None], wrong, right), quality_model.BAD, quality_model.GOOD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_model.expectation_maximisation(patterns, counts.astype(float), rounds=500, assumed=None)
    assert abs(model.prior - 0.85) < 0.03
    assert np.abs(model.chances[:, quality_model.GOOD, quality_model.BAD] - wrong).max() < 0.03
    assert np.abs(model.chances[:, quality_model.BAD, quality_model.BAD] - right).max() < 0.03


def test_columns_with_inner_names_stay(spark):
    """Callers' columns called like inner ones come back as they were."""
    texts = ["Mail anna@example.org or call (030) 123 4567 now please all of you", "two words", None, "", "x y z " * 30]
    names = ["_found", "_again", "_times", "_below", "_source", "_leaked", "_kept", "_FOUND_"]
    rows = [(k, t, "en", "ab"[k % 2], *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    benchmark = spark.createDataFrame([(1, "x y z " * 30)], "item_id long, text string")
    results = [pii.replace_entities(documents), mixing.with_repeats(documents), ngram_join.one_of_each(documents), decontamination.without_leaks(documents, benchmark)]
    for out in results:
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    assert {r["doc_id"] for r in results[3].collect()} == {0, 1, 2, 3}


def test_leaks_do_not_depend_on_the_number_of_passes(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 60))) + "? Answer: " + " ".join(word() for _ in range(3))) for k in range(60)]
    rows = [(k, " ".join(word() for _ in range(200)) + " " + items[k % 60][1] + " " + " ".join(word() for _ in range(150)), "en", "a") for k in range(40)]
    documents, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.leaks(documents, benchmark).collect()))
    assert {(r[0], r[1]) for r in whole} >= {(k, k % 60) for k in range(40)}
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 2_000)
    monkeypatch.setattr(decontamination, "PASSAGE_BLOCKS", 8)
    parts = sorted(map(tuple, decontamination.leaks(documents, benchmark).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and np.allclose([r[3:] for r in parts], [r[3:] for r in whole])


@pytest.mark.parametrize("ordered", [1, 65_536])
def test_join_order_has_no_influence(spark, monkeypatch, ordered):
    """Known frequencies change the pairs looked at, never the classes."""
    rng = random.Random(13)
    base = [" ".join(rng.choice(["a", "b", "c", "d"]) + str(rng.randint(0, 4)) for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(60):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "z" + str(rng.randint(0, 3))
        rows.append((k, " ".join(words), "en", "a"))
    monkeypatch.setattr(ngram_join, "ORDERED", ordered)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(spark, rows + rows[:5])).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {k: (len(sets[k]), label[k]) for k in sets}


def test_entities_of_long_and_empty_texts(spark):
    long_text = "call (030) 123 4567 " * 5_000
    out = pii.replace_entities(frame(spark, [(1, long_text, "en", "a"), (2, "", "en", "a"), (3, None, "en", "a")])).collect()
    assert {r["doc_id"]: r["n_replaced"] for r in out} == {1: 5_000, 2: 0, 3: 0}
    assert pii.replace_entities(frame(spark, [])).agg(F.count("*")).first()[0] == 0
