"""Toxicity, licences, top-k search, BPE, n-gram join and HTML text against brute force, public libraries and held-out rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from folioscan.llm import bpe, html_extract, html_labels, license_scan, ngram_join, toxicity, voronoi_knn
from folioscan.llm.components import components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, _score string, _gone string, _s int, slot string, id string"

SF = "/root/testdata/sf0.001"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 1, "k", 1, "x", "w", 2, "y", "z") for i, t in enumerate(texts)], SCHEMA)


# toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde", max_size=12))
def test_automaton_accepts_what_is_near(token):
    lexicon = toxicity.Lexicon({"abcde": False, "abc": False, "edcbaedcb": False, "deadbea": True})
    near = set()
    for term, stem in lexicon.terms.items():
        heads = {token[:n] for n in range(len(token) + 1)} if stem else {token}
        if min(edit_distance(h, term) for h in heads) <= lexicon.edits(term):
            near.add(term)
    found = lexicon.match(token)
    assert (found is not None) == bool(near) and (found is None or found[0] in near)


def corpus(n=600):
    rng = random.Random(3)
    clean = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchling", "snotgobbler", "zorkwit" + rng.choice(clean)]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    return texts, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = corpus()
    docs, known = documents(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    rows = toxicity.with_score(docs, model, out_col="s").withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [r for r in rows if r["h"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([(r["s"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held]) > 0.98
    assert len({r["s"] for r in rows if r["doc_id"] >= len(texts)}) == 1 and len(rows) == len(texts) + 2
    assert model.score("you wretchlng") >= 0.5 > model.score('he said "wretchling" once')
    assert toxicity.drop_toxic(docs, known).columns == docs.columns


@pytest.mark.parametrize("quotes", [1, 40])
def test_toxic_term_that_clean_documents_quote_keeps_its_misspellings(spark, quotes):
    texts, labels = corpus()
    for i in range(quotes):
        texts[4 * i + 1] = f'he said "wretchling" {texts[4 * i + 1]}'
        texts[4 * i + 2] += " " + ("wretching", "wrestling", "wretchlings")[i % 3]
    for i in range(0, 160, 4):
        texts[i] = "you " + "wretchling".replace("wre"[i // 4 % 3], "bcdfghjkmnpqvxz"[i // 12], 1) + " " + texts[i].replace("wretchling", "").replace("snotgobbler", "")
    model = toxicity.fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexicon.match("yretchling") == ("wretchling", 1) and model.score("you yretchling") >= 0.5
    assert model.lexicon.match("wretching") is None and max(model.score('he said "wretchling" once'), model.score("he was wretching")) < 0.5


def test_toxicity_query(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, texts = toxicity.fit(docs, labels), {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op1_toxicity(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]])) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_lexicon_takes_all_that_stands_out(spark):
    """Whatever the partitions, and without a bound on its terms."""
    texts, labels = corpus()
    more = [a + b + "word" for a in "bcdfghjk" for b in "aeiou"]
    for i in range(0, len(texts), 4):
        texts[i] += " " + " ".join(more)
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = [toxicity.fit(docs.repartition(n), known).lexicon for n in (1, 7)]
    assert one[0].terms == one[1].terms and all(one[0].match(w) for w in more)


def test_automaton_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    lexicon = toxicity.Lexicon({"wretchling": False, "snotgobbler": False})
    rng = random.Random(1)
    for _ in range(300):
        lexicon.match("".join(rng.choice("wretchlingso") for _ in range(rng.randint(1, 12))))
    assert sum(map(len, lexicon._sets)) <= 50 + max(map(len, lexicon._sets)) and lexicon.match("wretchlng") == ("wretchling", 1)


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a", None])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["s"] < 0.5 for r in toxicity.with_score(docs, model, out_col="s").collect()} == {True}
    assert toxicity.with_score(documents(spark, []), model, out_col="s").count() == 0


# licences


def test_license_scan_is_brute_force_without_pruning(spark):
    rng = random.Random(1)
    texts = [None, "", "plain words", "x\nLicensed under the Apache License, Version 2.0.\ny", "Licenced under  the MIT licence", "a\n" * 2000]
    for _, t in license_scan.TEMPLATES:
        words = t.split()
        for drop in (0, 1, 3):
            texts.append("Intro text.\n" + " ".join(w for i, w in enumerate(words) if drop == 0 or i % 10 >= drop) + "\nOutro")
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        texts.append("\n".join(lines))
        rng.shuffle(words)
        texts.append(" ".join(words))
    rows = {r["doc_id"]: r["matches"] for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for i, t in enumerate(texts):
        segments = [*(t or "").split("\n"), t or ""]
        want = {}
        for s in segments:
            b = license_scan.bigrams(license_scan.words(s))
            scored = [(license_scan.dice(b, k), name) for (name, k), named in zip(scanner.known, scanner.naming, strict=True) if named <= b]
            best = min(((-d, name) for d, name in scored), default=(0, None))
            if -best[0] >= license_scan.THRESHOLD:
                want[best[1]] = max(want.get(best[1], 0), -best[0])
        got = defaultdict(float)
        for m in rows[i]:
            got[m["license"]] = max(got[m["license"]], m["dice"])
        assert want.keys() <= got.keys() and all(got[k] >= v - 1e-12 for k, v in want.items()), t
    assert [(m["license"], m["first_line"]) for m in rows[3]] == [("Apache-2.0", 1)] and rows[4][0]["license"] == "MIT"


def test_licenses_inside_of_lines_and_wrapped_within_prose():
    scan = license_scan.Scanner(license_scan.TEMPLATES).scan
    text = dict(zip(("apache", "mit", "gpl"), (next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 200) for name in ("Apache-2.0", "MIT", "GPL-3.0")), strict=True))
    wrapped = {k: [" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9)] for k, t in text.items()}
    prose = "This is one of the texts that can be read by the people in the town, and for the most part it is due to the weather."
    named = lambda t: {m[1] for m in scan(t)}
    assert named("Copyright (c) 2024 Foo Inc. Licensed under the MIT License.") == {"MIT"}
    assert named("Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0.") == {"Apache-2.0"}
    assert named(f"{prose} It is licensed under the GNU Lesser General Public License, version 3. {prose}") == {"LGPL-3.0"}
    for key, name in (("apache", "Apache-2.0"), ("mit", "MIT"), ("gpl", "GPL-3.0")):
        assert named(f"{prose} {text[key]} {prose}") == {name}
        found = [m for m in scan("\n".join([prose, *wrapped[key], "", prose, prose])) if m[3] - m[2] > 2]
        assert [(m[1], m[2], m[3]) for m in found] == [(name, 1, 1 + len(wrapped[key]))] and found[0][0] > 0.99
    both = scan("\n".join([prose, *wrapped["mit"], prose, *wrapped["mit"], prose]))
    assert [m[1] for m in both] == ["MIT", "MIT"] and both[0][3] <= both[1][2]
    assert scan("\n".join([prose] * 300)) == []


def test_windows_are_brute_force():
    """The best window of each licence, by comparing every window of words with every template."""
    rng, few = random.Random(4), [t for t in license_scan.TEMPLATES if len(t[1].split()) < 12]
    rng.shuffle(few)
    for _ in range(25):
        chosen = [*rng.sample(few, 6), ("X", "a b c a b d e"), ("Y", "b c d b c f")]
        scanner = license_scan.Scanner(chosen)
        w = []
        for _ in range(4):
            part = license_scan.words(rng.choice(chosen)[1])
            w += [x for x in part if rng.random() > 0.1] + [rng.choice("abcde") for _ in range(rng.randint(0, 6))]
        best = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                seen = license_scan.bigrams(w[i:j])
                for (name, b), named in zip(scanner.known, scanner.naming, strict=True):
                    if named <= seen:
                        best[name] = max(best[name], license_scan.dice(seen, b))
        found = scanner.windows(w)
        top = max(best.values(), default=0)
        assert (max((m[0] for m in found), default=0) == pytest.approx(top)) if top >= license_scan.THRESHOLD else not found
        assert all(m[0] <= best[m[1]] + 1e-12 for m in found)


def test_sibling_licenses_are_told_apart():
    """Every notice that is made by rule, alone and within prose, names its licence and no other."""
    scan = license_scan.Scanner(license_scan.TEMPLATES).scan
    names = lambda t: {m[1] for m in scan(t)}
    for name, text in license_scan._notices():
        assert names(text) == names(f"Some words before it. {text} And some words behind it.") == {name}, text
    for text, name in {
        "This project is licensed under the Apache License 2.0.": "Apache-2.0", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0", "SPDX-License-Identifier: MIT": "MIT", "Licensed under the GPL v3.": "GPL-3.0",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "released under the Apache License, Version 2.0": "Apache-2.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY 3.0": "CC-BY-3.0", "# SPDX-License-Identifier: MIT-0": "MIT-0",
    }.items():
        assert names(text) == {name}, text
    for text in ("Licensed under the Foo License.", "This project is licensed under the Foo License.", "Licensed under CC BY 9.0.", "Licensed under the Apache License, Version 9.1."):
        assert names(text) == set(), (text, names(text))


def test_license_query(spark):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in license_scan.op3_license_scan(spark, "/root/testdata/sf0.001").collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        found = sorted((-m[0], m[1], m[2]) for m in scanner.scan(text))
        best = (found[0][1], round(-found[0][0], 6), found[0][2]) if found else (None, None, None)
        assert (rows[i]["n_matches"], rows[i]["license"], rows[i]["dice"], rows[i]["line"]) == (len(found), *best)


def test_files_of_long_licenses_are_told_by_their_heads():
    scan = license_scan.Scanner(license_scan.TEMPLATES).scan
    filler = "\n".join("Each such term shall be read with what was said before it about parties and their rights." for _ in range(40))
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "ISC", "Zlib", "BSL-1.0", "Unlicense"):
        for text in (t for n, t in license_scan.TEMPLATES if n == name and len(t) > 120):
            w = text.split()
            assert {m[1] for m in scan("\n".join([*(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)), filler]))} == {name}, text


def test_bsd_licenses_are_told_apart():
    scan = license_scan.Scanner(license_scan.TEMPLATES).scan
    names = lambda t: {m[1] for m in scan(t)}
    head, source, binary, people, end = (getattr(license_scan, f"_BSD{x}") for x in ("", "_SOURCE", "_BINARY", "_NAMES", "_END"))
    assert names("\n".join(["Copyright 2020, A. B.", head, source, binary, end, "main()"])) == {"BSD-2-Clause"}
    assert names("\n".join(["Copyright 2020, A. B.", head, source, binary, people.replace("the copyright holder", "Foo Inc."), end, "main()"])) == {"BSD-3-Clause"}
    assert names(f"x\n{head}\ny") == {"BSD-2-Clause OR BSD-3-Clause"}


# top-k


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, cell string, pack int")


@pytest.mark.parametrize("kind", ["clusters", "copies", "odd"])
def test_topk_is_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(voronoi_knn, "PACK", 50)
    monkeypatch.setattr(voronoi_knn, "BATCH", 7)
    rng = np.random.default_rng(0)
    if kind == "clusters":
        x = (rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] + 0.05 * rng.normal(size=(300, 8))).tolist()
    elif kind == "copies":
        x = [[0.5, 0.25]] * 200 + rng.normal(size=(100, 2)).tolist()
    else:
        x = [None, [], [1.0, None], [float("nan")], [float("inf"), 1.0], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0], [-1.0, 0.3]]
    rows = list(enumerate(x))
    ok = {i: np.floor(64 * np.array(np.float32(v), dtype=float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    width = max(map(len, ok.values()))
    ok = {i: np.pad(v, (0, width - len(v))) for i, v in ok.items()}
    ids = [*ok, max(ok), max(ok), 5, 10]  # repeated rows, and ids with the vectors of others
    whole = [*ok.values(), ok[max(ok)], ok[max(ok)], ok[max(ok)], ok[max(ok)]]
    want = []
    for n, (q, x_) in enumerate(zip(ids, whole, strict=True)):
        if q % 5 == 0:
            scored = sorted((-int(x_ @ v), i) for m, (i, v) in enumerate(zip(ids, whole, strict=True)) if m != n)[:6]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    last = dict(rows)[max(ok)]
    df = vectors(spark, [*rows, (max(ok), last), (max(ok), last), (5, last), (10, last), (None, [1.0])])
    assert sorted(tuple(r) for r in voronoi_knn.knn_join(df, F.col("vec_id") % 5 == 0, 6).collect()) == sorted(want)


def test_only_rows_that_are_asked_for_are_copied(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "BATCH", 10)
    data = spark.createDataFrame([(i, [1.0], i % 4) for i in range(40)], "id long, v array<double>, pack long")
    asked = spark.createDataFrame([(100 + i, [1.0], 0, 0.0) for i in range(35)] + [(200, [1.0], 2, 0.0)], "id long, v array<double>, pack long, least double")
    copied, dealt = voronoi_knn.copies(data, asked)
    rows = copied.collect()
    assert {p: sum(r["pack"] == p for r in rows) for p in range(4)} == {0: 40, 1: 0, 2: 10, 3: 0}
    assert dealt.count() == 36 and {(r["pack"], r["batch"]) for r in dealt.collect()} <= {(r["pack"], r["batch"]) for r in rows}


def test_topk_of_nothing(spark):
    assert voronoi_knn.knn_join(vectors(spark, []), F.col("vec_id") > 0, 3).count() == 0


def test_cells_that_are_passed_over_hold_none_of_the_best():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 3))[rng.integers(0, 9, 500)] + 0.02 * rng.normal(size=(500, 3))
    pivots = x[:20]
    cell, far = voronoi_knn._nearest(x, pivots)
    count, radius = np.bincount(cell, minlength=20), np.array([far[cell == c].max(initial=0) for c in range(20)])
    want = voronoi_knn.needed(x, pivots, radius, count, 5)
    top = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert want[np.arange(500)[:, None], cell[top]].all() and want.mean() < 0.7
    least = np.sort(x @ x.T, axis=1)[:, -5]
    closer = voronoi_knn.needed(x, pivots, radius, count, 5, least)
    assert closer[np.arange(500)[:, None], cell[top]].all() and closer.mean() < 0.8 * want.mean()


# BPE


@pytest.fixture(scope="module")
def coders():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    with open(public.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.default_bpe(), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(coders):
    own, _ = coders
    assert sorted(own.hash.ids) == list(range(len(own.tokens)))
    assert all(own.hash[t] == i for i, t in enumerate(own.tokens))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_is_the_librarys(coders, text):
    own, theirs = coders
    ids = own.encode(text)
    assert ids == theirs.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_of_every_space_and_long_runs(coders):
    own, theirs = coders
    for c in [*range(0x20, 0x100), 0x1C, 0x1D, 0x85, 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF, 9, 10, 11, 12, 13]:
        for text in (f"a{chr(c)}b", f"{chr(c)}{chr(c)}x {chr(c)}"):
            assert own.encode(text) == theirs.encode_ordinary(text), hex(c)
    long = "x" * 9000 + "ab" * 3000 + " " * 500
    assert own.encode(long) == theirs.encode_ordinary(long)


def test_bpe_query(spark, coders):
    _, theirs = coders
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op7_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_tables(spark, coders):
    own, theirs = coders
    texts = ["a b", None, "", "a b", "<|endoftext|> é\n\n 漢字"]
    docs = documents(spark, texts)
    for r in bpe.encode_batches(docs, own, "doc_id", "text").collect():
        t = texts[r["doc_id"]] or ""
        assert r["token_ids"] == theirs.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    both = bpe.decode(bpe.encode(docs, own), own)
    assert both.columns == [*docs.columns, "token_ids", "decoded"]
    assert [bytes(r["decoded"]).decode() for r in both.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert bpe.encode_batches(documents(spark, []), own, "doc_id", "text").count() == 0


def test_bpe_decodes_lists_at_once(coders):
    own, _ = coders
    for texts in ([], [""], ["", "a b", "", "漢字 \U0001f600", "x" * 500, ""]):
        ids = [own.encode(t) for t in texts]
        ends = np.cumsum([0, *map(len, ids)])
        found = own.decode_lists(np.array(sum(ids, []), dtype=np.int32), ends)
        assert found.to_pylist() == [own.decode(x) for x in ids] == [t.encode() for t in texts]


# n-gram join


def brute_components(texts, words, num, den):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def families(seed, n=30, copies=12):
    """Families of near copies by few and many edits, a line that all share, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    line, passage = [word() for _ in range(9)], [word() for _ in range(60)]
    texts = []
    for f in range(n):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 100, 300]))]
        base += passage if f % 3 == 0 else []
        for _ in range(rng.choice([1, 2, copies])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, len(w) // 40, len(w) // 15])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(line + w if f % 2 else w))
    return texts


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_ngram_join_is_brute_force(spark, words, num, den):
    texts = [*families(words), None, "", " \n\t", "one", "One", "two words", "a b c d", "A  b\nc\td", "a b c d e", "é É", "É é", *["hot copy of one text " * 4] * 30]
    docs = documents(spark, texts)
    rows = ngram_join.join_near(docs, words=words, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, words, num, den)
    kept = ngram_join.drop_near(docs, words=words, num=num, den=den)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(texts, words, num, den).items() if c == i}


def test_ngram_join_of_a_chain_of_near_copies(spark):
    """Each text is near the next and far from most: the pairs that the stream has not seen must follow."""
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join([*(f"x{j}" for j in range(3 * i)), *base[3 * i :]]) for i in range(60)]
    random.Random(5).shuffle(texts)
    rows = ngram_join.join_near(documents(spark, texts), words=4, num=85, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, 4, 85, 100)


def test_ngram_join_of_families_beyond_a_cell(spark, monkeypatch):
    """Cells of 8 nodes: large families go by stars, and what large keys leave open by blocks."""
    monkeypatch.setattr(ngram_join, "CELL", 8)
    rng, texts = random.Random(9), families(9, n=6, copies=40)
    base = [f"c{i}" for i in range(120)]
    for step in range(70):  # a chain whose ends are far from one another, and copies that differ in a word
        texts.append(" ".join([*(f"y{j}" for j in range(step)), *base[step:]]))
        texts.append(" ".join(w if rng.random() > 0.01 else "z" + str(rng.randrange(999)) for w in base))
    rng.shuffle(texts)
    rows = ngram_join.join_near(documents(spark, texts), words=4, num=85, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, 4, 85, 100)


def test_blocks_meet_unless_they_are_of_one_root(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 5)
    members = [(1, n, 100 if n < 40 else 200 if n < 60 else n) for n in range(75)] + [(2, n, 7) for n in range(30)] + [(3, 1, 1), (3, 2, 2)]
    cells = defaultdict(set)
    for r in ngram_join.blocks(spark.createDataFrame(members, "pivot long, node long, root long")).collect():
        cells[r["p"], r["i"], r["j"]].add((r["node"], r["root"]))
    met = {(p, a[0], b[0]) for (p, _, _), c in cells.items() for a in c for b in c if a[1] != b[1]}
    assert met == {(p, a, b) for p, a, x in members for q, b, y in members if p == q and x != y}
    assert not any(p == 2 for p, _, _ in cells)


def test_sets_of_one_digest_stay_apart(spark):
    known = spark.createDataFrame([(1, 3, 8, 5), (2, 3, 8, 6), (3, 3, 8, 5), (4, 0, 8, 7), (5, 2, 9, 1)], "_id long, n long, node long, check long")
    got = {r["_id"]: r["node"] for r in ngram_join._apart(known).collect()}
    assert got == {1: 8, 2: 8 ^ 6, 3: 8, 4: 8, 5: 9}


def test_ngram_join_of_sets_of_one_digest(spark, monkeypatch):
    """Keys are made again for nodes that are told apart."""
    texts = ["a b c d e f", "p q r s t u v w x", "a b c d e f", "k l m n o", "K l m n o"]
    first, second = (ngram_join.Shingles(4).of(t).tolist() for t in texts[:2])
    name, digest = ngram_join.digest(np.array(first, dtype=np.uint64))[0], ngram_join.digest
    monkeypatch.setattr(ngram_join, "digest", lambda s: (name if s.tolist() == second else digest(s)[0], digest(s)[1]))
    rows = ngram_join.join_near(documents(spark, texts), words=4, num=85, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {0: (3, 0), 1: (6, 1), 2: (3, 0), 3: (2, 3), 4: (2, 3)}


def test_keys_are_stored_nowhere(spark, monkeypatch):
    """Keys are most of what the join makes: they are shuffled, and what is stored of a text is some numbers."""
    stored, materialise = [], ngram_join.materialise

    def kept(df, name, **options):
        stored.append((name, materialise(df, name, **options)))
        return stored[-1][1]

    monkeypatch.setattr(ngram_join, "materialise", kept)
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(50)]
    assert ngram_join.join_near(documents(spark, texts), words=4, num=85, den=100).count() == 50
    assert stored and not [name for name, df in stored if any(kind.startswith("array") for _, kind in df.dtypes)]
    assert sum(df.count() for _, df in stored) <= 5 * len(texts)


def test_few_other_ids_pass_the_filter_of_ids(spark, monkeypatch):
    """Two ids to a slot, as of two million nodes: the slots are full, and yet texts of others stay where they are."""
    monkeypatch.setattr(ngram_join, "SLOTS", 1000)
    docs, ids = spark.range(-5000, 50_000).withColumn("text", F.lit("t")), spark.range(0, 4000, 2).withColumnRenamed("id", "doc")
    passed = {r["id"] for r in ngram_join._in_slots(docs, "id", ids, "left_semi").collect()}
    assert passed >= set(range(0, 4000, 2)) and len(passed) <= 2000 + 0.01 * 53_000
    assert {r["id"] for r in ngram_join._in_slots(docs, "id", ids, "left_anti").collect()} == set(range(-5000, 50_000)) - passed
    nulls = spark.createDataFrame([(None,), (1,)], "doc long")
    assert {r["id"] for r in ngram_join._in_slots(spark.createDataFrame([(None, "t"), (1, "t")], "id long, text string"), "id", nulls, "left_semi").collect()} == {None, 1}


def test_ngram_join_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "z y x w v u", None], [None, 5, 5, None])
    rows = sorted((r["n_shingles"], str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.join_near(docs, words=4, num=85, den=100).collect())
    assert rows == [(0, "None", "None"), (3, "5", "5"), (3, "5", "5"), (3, "None", "5")]
    assert ngram_join.join_near(documents(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60))
def test_partners_share_enough_keys(common, left, right):
    rng = np.random.default_rng(common * 10_000 + left * 100 + right)
    pool = np.unique(rng.integers(0, 2**63, common + left + right, dtype=np.uint64))
    a, b = np.sort(pool[: common + left]), np.sort(np.concatenate([pool[:common], pool[common + left :]]))
    if not len(a) or not len(b) or 100 * common < 85 * len(pool):
        return
    keys = lambda s: {x: need for k, need in ngram_join.signatures(s, 85, 100) for x in k.tolist()}
    ka, kb = keys(a), keys(b)
    shared = ka.keys() & kb.keys()
    assert shared and len(shared) >= min(min(ka[x], kb[x]) for x in shared)
    by_band = [len(np.intersect1d(k, l)) >= max(x, y) for k, x in ngram_join.signatures(a, 85, 100) for l, y in ngram_join.signatures(b, 85, 100)]
    assert any(by_band)
    assert ngram_join._plausible(np.array([len(a)]), np.array([len(b)]), np.array([ngram_join.parity(a)], dtype=np.uint64), np.array([ngram_join.parity(b)], dtype=np.uint64), 85, 100)[0]


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(50)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {x: x for link in links for x in link}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    alone = {x for x in root if not any(x in link and link[0] != link[1] for link in links)}
    assert got.keys() == root.keys() - alone and len({(r, root[x]) for x, r in got.items()}) == len(set(got.values())) == len({root[x] for x in got})


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
<body class="layout sidebar-left"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies and so on, please agree to this.</div><!-- an <article> of comments -->
{body}
<aside class="related"><h3>Related</h3><p>Some other article that you may like to read today.</p></aside>
<form><label>Name</label><input><textarea><p>none</p></textarea></form><footer><p>&copy; 2024 all rights reserved by us</p></footer></body></html>"""
ARTICLE = """<{tag}><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b>word  with
 spaces &lt;tag&gt; &#233;&eacute;.<p>Second para<br>graph.<div class="advert">Buy things now</div><ul><li>one item</li><li>two items</li></ul><noscript>no</noscript>
<section class="comments"><p>A reader wrote this comment.</p></section></{tag}>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"'])
def test_main_text(tag):
    page = PAGE.format(body=ARTICLE.replace("</{tag}>", f"</{tag.split()[0]}>").format(tag=tag))
    assert html_extract.main_text(page) == "The title & more\nFirst boldword with spaces <tag> éé.\nSecond para graph.\none item\ntwo items"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h3>Sub</h3><p>see <a href=x>the link</a> here</p><dl><dt>t</dt><dd>d</dd></dl></article>", "Sub\nsee the link here\nt\nd"),
        ('<div class="content has-sidebar"><p>Words of the body.</p></div><div class="sidebar">side</div>', "Words of the body."),
        ('<article class="post with-sidebar"><p hidden>no</p><p>yes</p></article>', "yes"),
        ('<article><header><h1>Head</h1></header><p>x y</p><article class="comment-body"><p>z</p></article><footer>in cats</footer></article>', "Head\nx y"),
        ("<article><p>Euler wrote <math><mi>e</mi><mo>=</mo><mn>2</mn></math> and <svg><text>drew</text></svg> it.</p></article>", "Euler wrote e=2 and drew it."),
        ('<article><p>Before.</p><p class="notice-period">The notice period is one month.</p><p class="advert">Buy</p></article>', "Before.\nThe notice period is one month."),
        (f'<div class="content"><p>{"word " * 80}</p></div><ol><article class="comment"><p>a reader said so</p></article></ol>', "word " * 79 + "word"),
        (f'<div class=xq><ul>{"<li><a href=/>go on</a></li>" * 6}</ul></div><div class=zzk><p>{"plain text here " * 30}</p></div>', "plain text here " * 29 + "plain text here"),
        ('<body class=home><header class="site-header">Site</header><div class="entry-content"><p>Text one.</p></div><div id="comments"><p>Nice text, thanks.</p></div></body>', "Text one."),
    ],
)
def test_main_text_by_names(page, text):
    assert html_extract.main_text(page) == text


SAY = "some words that say what there is to say about it, "  # eleven words


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p>{SAY * 2}one</p></article><div class="content"><p>{SAY * 3}two</p></div>', [SAY * 2 + "one", SAY * 3 + "two"]),
        (f"<html><body><nav><a href=/>Home</a></nav><article><p>{SAY * 2}one</p></article><p>{SAY * 3}two</p><footer>foot</footer></body></html>", [SAY * 2 + "one", SAY * 3 + "two"]),
        (f"<article><p>{SAY * 2}one</p></article><p>{SAY * 3}two</p>", [SAY * 2 + "one", SAY * 3 + "two"]),
        (f'<article><p class="more">{SAY * 4}more</p><p class="tags">{SAY * 2}tags</p><p class="advert">Buy</p><p>BBB</p></article>', [SAY * 4 + "more", SAY * 2 + "tags", "BBB"]),
        ("<body><p>Hello world.</p></body>", ["Hello world."]),
        ("plain text", ["plain text"]),
        ("<div>" * 100_000 + "word", ["word"]),
        (f"<article><p>{SAY * 3}one</p></article><p>Copyright 2020</p>", [SAY * 3 + "one"]),
        (f'<div class="content"><p>{SAY * 6}one</p></div><section class="comments"><article><p>{SAY}first</p></article><article><p>{SAY}second</p></article></section>', [SAY * 6 + "one"]),
        (f'<div class="content"><p>{SAY * 6}one</p></div>' + f"<div>{'<article><h3><a href=/>Card of another</a></h3><p>what it says in short</p></article>' * 3}</div>", [SAY * 6 + "one"]),
        (f'<div class="layout-sidebar"><article><p>{SAY * 6}one</p></article><div class="related"><article><a href=/>Another</a></article></div></div>', [SAY * 6 + "one"]),
        (f'<form class="aspnet"><article><p>{SAY * 3}one</p></article></form>', [SAY * 3 + "one"]),
        ("<nav><a href=/>Home</a></nav><ul><li><a href=/x>a list</a></li><li><a href=/y>of links</a></li></ul>", []),
    ],
)
def test_main_text_beside_articles(page, text):
    """Layouts written by hand, apart from those that the weights are learned from."""
    assert html_extract.main_text(page) == "\n".join(t.strip() for t in text)


def test_tables_pages_are_their_articles():
    """The pages of the table, all of one layout, by a reading that knows nothing but it."""
    import html

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        found = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", found[1]) if found else []
        text = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        assert html_extract.main_text(page) == "\n".join(t for t in text if t)


def test_main_text_of_labelled_pages_that_were_held_out():
    pages = html_labels.labelled_pages(seed=2, n=60)
    assert html_labels.labelled_pages(*html_extract.PAGES)[:60] != pages
    assert html_extract.page_score(pages) > 0.98


def test_main_text_of_the_query(spark):
    rows = html_extract.op9_html_text(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages) and all((r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], html_extract.main_text(pages[r["page_id"]]["html"]), len(r["text"])) for r in rows)


def test_main_text_of_odd_pages(spark):
    pages = [None, "", "   ", "<nav><a>Home</a></nav><footer>foot</footer>", "<article><p>cut off in the midd", "<article><p>cut in a tag <a hre", "<article>" + "<p>para of text</p>" * 3000 + "</article>", "<article>" + "<div>" * 3000 + "deep text", "<p>a < b and <3</p>" * 2]
    df = spark.createDataFrame([(i, "u", p, "text", 1) for i, p in enumerate(pages)], "page_id long, url string, html string, block string, n_chars long")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(4)] == [""] * 4
    assert got[4] == "cut off in the midd" and got[5] == "cut in a tag" and got[6] == "\n".join(["para of text"] * 3000) and got[7] == "deep text"
    assert got[8] == "a < b and <3\na < b and <3"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_closing_tags_match_at_any_depth():
    deep = "<article>" + "<span>" * 2500 + "<div>body text<aside><div>an aside</div>still aside</aside>more text</div></article><aside>outside words</aside>"
    assert html_extract.main_text(deep) == "body text\nmore text"
    assert html_extract.main_text("<article>" + "<i>" * 100_000 + "x y</article>" + "<p>z</p>") == "x y"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5).map(float), max_size=30))
def test_best_region_is_the_best(scores):
    start, end = html_extract.best_region(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert sum(scores[start:end]) == max([0.0, *sums])
