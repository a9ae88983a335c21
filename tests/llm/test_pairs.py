"""Spelling variants, hard negatives and nearest neighbours against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscan.llm import block_neighbours, hard_negatives, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    rows = []
    form = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows.append((w, form[w], n, len(near), counts[form[w]] if form[w] else None))

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, f, root(w), n, near, fn) for w, f, n, near, fn in rows), key=str)


def words_of(spark, counts, extra=()):
    return spark.createDataFrame([*counts.items(), *extra], "word string, n long")


def variants(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_variants_by_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("aabcdeéßÀÿ") for _ in range(rng.randint(1, 9)))
        for _ in range(8):
            at = rng.randrange(len(w) + 1)
            edits = [w[:at] + rng.choice("abÿ") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("aeÀ") + w[at + 1 :]]
            counts[rng.choice([w, *edits])] = rng.choice([1, 2, 3, 20, 30, 300, 3000, 40000])
    counts.pop("", None)
    assert variants(spelling.group_variants(words_of(spark, counts))) == brute_variants(counts)


def test_variants_cases(spark):
    """Ties go to the smaller word, roots follow several forms, rows of a word add up, nulls take no part."""
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "xabcdefghij": 40000, "aaaaaaa": 1, "aaaaaaab": 10, "aaaaaaac": 10, "lonely": 4}
    got = variants(spelling.group_variants(words_of(spark, counts, [("lonely", 3), (None, 5), ("ghost", None)])))
    assert got == brute_variants(counts | {"lonely": 7})
    assert {r[0]: r[2] for r in got}["abcdefg"] == "xabcdefghij" and {r[0]: r[1] for r in got}["aaaaaaa"] == "aaaaaaab"
    assert variants(spelling.group_variants(words_of(spark, {}, [(None, 1)]))) == []


def test_long_words_that_share_a_half(spark):
    """Of words whose first 300 letters are the same, bands of the mask part most."""
    rng = random.Random(1)
    stems = ["x" * 300 + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    counts = {s: 50 for s in stems} | {s[:-1] + "z": 2 for s in stems}
    assert variants(spelling.group_variants(words_of(spark, counts))) == brute_variants(counts)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé", min_size=2, max_size=9), st.integers(0, 9), st.sampled_from("abcdéÿ"), st.sampled_from(["insert", "delete", "replace"]))
def test_an_edit_leaves_a_band_and_a_half(word, at, letter, kind):
    """What the keys rely on."""
    at = at % (len(word) + (kind == "insert"))
    other = word[:at] + {"insert": letter, "delete": "", "replace": letter}[kind] + word[at + (kind != "insert") :]
    bit = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % (spelling.BITS - 26)
    masks = [0, 0]
    for i, w in enumerate((word, other)):
        for c in w:
            masks[i] ^= 1 << bit(c)
    assert (masks[0] ^ masks[1]).bit_count() <= 2 and any(masks[0] & b == masks[1] & b for b in spelling.BANDS)
    short, long = sorted((word, other), key=len)
    half = len(short) // 2
    assert short[:half] == long[:half] or short[half:] == long[len(long) - (len(short) - half) :]


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_runs_are_counted_and_damaged(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("ABcdeÉ") for _ in range(rng.randint(5, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", "'s", "1", "-x"]) for _ in range(60))) for i in range(40)] + [(None, pool[0] * 2), (None, pool[0] * 2), (7, None), (8, ""), (9, "Ä" * 50_000), (9, "Ä" * 50_000)]
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    assert {r["word"]: r["n"] for r in spelling.count_runs(docs, "doc_id", "text").collect()} == brute_counts(rows)
    assert spelling.count_runs(docs.limit(0), "doc_id", "text").count() == 0


def test_pairs_of_variants_meet_by_their_keys(spark):
    """Pairs come out of one merge join on the key, without a cross join or a distinct of pairs."""
    plan = spelling.near_pairs(words_of(spark, {"abcdefg": 2}))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "HashAggregate" not in plan and "Join" in plan


VECTORS = "vec_id long, embedding array<float>, label int, row long, pack int, score string"


def vector_rows(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.normal(0.05, 0.2, width).astype(np.float32)], int(rng.integers(labels))) for i in range(n)]
    out += [out[3], out[3], (4, out[9][1], 1), (5, out[8][1], 2)]  # repeated rows, repeated ids with other vectors
    out += [(900, out[10][1], 0), (901, out[10][1], 0), (902, out[10][1], 1), (903, out[10][1], 1)]  # ties
    out += [(910, None, 1), (911, [0.1, None] + [0.0] * (width - 2), 1), (912, [math.nan] * width, 1), (913, [math.inf] * width, 2), (None, out[0][1], 1), (20, out[0][1], None), (914, [], 3), (915, [0.5, 0.5], 2), (916, [0.0] * width, 0), (917, [0.0] * width, 1)]
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, "s") for r in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=False))


def brute_negatives(rows, is_anchor, positives=5, negatives=5, low=80):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]
    out = []
    for a, (i, label, v) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(-dot(v, w), j, own == label) for b, (j, own, w) in enumerate(kept) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted((s, j) for s, j, same in scored if not same and -low * p <= -100 * s <= -100 * p)[:negatives]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"rows_a_block": 16, "anchors_a_block": 3, "chunk": 4}, {"rows_a_block": 7, "anchors_a_block": 50, "chunk": 5}])
def test_hard_negatives(spark, sizes):
    rows = vector_rows(120, 11, 3)
    got = hard_negatives.mine(frame_of(spark, rows), F.col("vec_id") % 5 == 0, "vec_id", "label", "embedding", **sizes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_one_label_or_none(spark):
    same = [(i, [0.1 * i, 1.0], 1) for i in range(9)]
    mine = lambda rows, **kw: hard_negatives.mine(frame_of(spark, rows), F.col("vec_id") % 2 == 0, "vec_id", "label", "embedding", **kw).collect()
    assert mine(same) == [] and mine([]) == [] and mine([(1, [1.0], 1)]) == [] and mine([(2, [1.0], 1)]) == []
    hot = same * 20 + [(100 + i, [0.1 * i, 1.0], 50 + i) for i in range(9)]  # one label has most rows, others one each
    assert sorted(map(tuple, mine(hot, rows_a_block=8, anchors_a_block=4))) == brute_negatives(hot, lambda i: i % 2 == 0)


def test_partial_tiles_add_up(spark):
    """A score is the sum of its chunks', whatever the chunks; each is a row of the product's input."""
    rows = spark.createDataFrame([(0, b, 2, 10 * b + r, 10 * b + r, 1, [float(r + c) for c in range(10)]) for b in range(2) for r in range(3)], "pack long, block long, others long, row long, id long, label long, v array<double>")
    seen = []
    for chunk in (1, 3, 10, 64):
        left = hard_negatives._packed(rows.select("pack", "block", "others", "row", "label", "v"), chunk, 10, ["row", "label"])
        right = hard_negatives._packed(rows, chunk, 10, ["row", "id", "label"])
        assert right.count() == 2 * -(-10 // chunk)

        def told(scores, a_about, about):
            import pandas as pd

            a, b = a_about.reshape(2, -1)[0], about[0]
            return pd.DataFrame({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "s": scores.ravel()})

        seen.append(sorted(map(tuple, hard_negatives.score_tiles(left, right, chunk, 10, told, "a long, b long, s long").collect())))
    want = sorted((a["row"], b["row"], dot(a["v"], b["v"])) for a in rows.collect() for b in rows.collect())
    assert all(s == want for s in seen)


def distance(a, b):
    total = 0.0
    for i in range(max(len(a), len(b))):
        d = (a[i] if i < len(a) else 0.0) - (b[i] if i < len(b) else 0.0)
        total += d * d
    return math.sqrt(total)


def brute_nearest(rows, is_query, k):
    kept = [(i, v) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if is_query(i):
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(sorted((distance(v, w), j) for b, (j, w) in enumerate(kept) if b != q)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block_bytes", "fan", "k"), [(4 << 20, 32, 10), (9 * 11 * 16, 2, 10), (9 * 11 * 40, 3, 1), (1, 2, 500)])
def test_nearest(spark, block_bytes, fan, k):
    rows = vector_rows(150, 11, 8)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = block_neighbours.nearest(frame_of(spark, rows), F.col("vec_id") % 5 == 0, k, "vec_id", "embedding", block_bytes, fan)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, lambda i: i % 5 == 0, k)


def test_nearest_of_few_or_none(spark):
    near = lambda rows: sorted(map(tuple, block_neighbours.nearest(frame_of(spark, rows), F.col("vec_id") >= 0, 3, "vec_id", "embedding").collect()))
    assert near([]) == [] and near([(1, [1.0], 1)]) == [] and near([(1, [0.0], 1), (2, [0.0], 1)]) == []
    assert near([(1, [1.0], 1), (2, [4.0], 1)]) == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    copies = [(1, [1.0, 2.0], 1)] * 6  # all the same row: each finds three of the others
    assert near(copies) == sorted([(1, r, 1, 0.0) for r in (1, 2, 3)] * 6)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e18])
def test_bounds_hold(scale):
    """Each distance lies within its bounds, and nearly all pairs are ruled out."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 48)) * scale).astype(np.float32).astype(np.float64)
    x[7] = x[8]
    x[9] *= 1e6
    codes, scales, errors = block_neighbours.encode(x)
    assert codes.dtype == np.int8
    about, give = block_neighbours.code_distances(codes, scales, codes, scales)
    give = give + errors[:, None] + errors[None, :]
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (np.abs(about - exact) <= give).all()
    bound = np.partition(about + give, 10, axis=1)[:, 10]
    assert ((about - give) <= bound[:, None]).mean() < 0.08


def test_products_of_wide_codes_are_exact():
    codes = np.full((2, 5000), 127, dtype=np.int8)
    about, _ = block_neighbours.code_distances(codes, np.ones(2), -codes, np.ones(2))
    assert about[0, 0] == pytest.approx(2 * 127 * math.sqrt(5000), rel=1e-12)


def test_recall_on_the_table(spark):
    """The share of the true neighbours that is found: all."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = defaultdict(set)
    for q, _, i, _ in brute_nearest(rows, lambda i: i % 100 == 0, 10):
        want[q].add(i)
    got = defaultdict(set)
    for r in block_neighbours.op13_nearest(spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got == want
