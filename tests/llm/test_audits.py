"""Filter audit, whitening and licence scan against brute force on rows that hold the odd cases."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from test_llm import SCHEMA, odd_texts, prose

from keyferry.llm import eigen, filter_audit, license_scan, topk, whitening


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- filter audit


def brute_masks(rows):
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        out.append(
            "".join(
                letter
                for letter, fails in zip(
                    "ABCDE",
                    (
                        len(words) < 200,
                        100 * len(set(words)) < 50 * len(words),
                        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                        re.search("[#$%&*|]", text) is not None,
                        earlier,
                    ),
                )
                if fails
            )
        )
    return out


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = brute_masks(rows)
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], m) for r, m in zip(rows, masks) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for n, letter in enumerate(order):
                gone = [d for d in left if letter in d[1]]
                before = len(left)
                left = [d for d in left if letter not in d[1]]
                failing = sum(letter in m for _, m in mine)
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                out[part, order, n + 1] = [
                    before - len(gone),
                    len(gone),
                    failing - len(gone),
                    sum(m == letter for _, m in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, empty):
    rng = random.Random(11)
    texts = odd_texts() + [prose(rng, 250), "$ " + prose(rng, 250), ("Word " * 3 + "a " * 300), prose(rng, 210) + " é\x0b\x0cÉ"]
    langs = ["en", "de", None, "", "en"]
    rows = [(i, t, langs[i % 5], "s", 0, *["x"] * 13) for i, t in enumerate(texts)]
    # repeated rows, an id with two texts, rows without an id
    rows += [rows[0], rows[21], (3, texts[0], "en", *rows[0][3:]), (None, texts[0], "de", *rows[0][3:]), (None, None, "de", *rows[0][3:])]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (5, None, 1), (None, 1, 1), (22, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(docs, marks)
    ours = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in found.collect()}
    assert ours == brute_audit(rows, labels) and found.count() == 600 * 3
    assert filter_audit.audit_filters(empty, marks).count() == 0
    unlabelled = filter_audit.audit_filters(docs, marks.limit(0))
    assert unlabelled.where("good_lost + toxic_lost > 0").count() == 0 and unlabelled.count() == 1800


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "b", "x"), (3, "ab", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"P": lambda text: text.contains("a"), "Q": None}
    found = filter_audit.audit_filters(docs, labels, filters)
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in found.collect()) == [
        ("PQ", 1, 1, 2, 0, 3),
        ("PQ", 2, 1, 0, 1, 1),
        ("QP", 1, 2, 1, 0, 1),
        ("QP", 2, 1, 1, 1, 3),
    ]


# --- whitening


def spectra():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for n in (1, 2, 3, 7, 64):
        a = rng.standard_normal((n, n + 4))
        yield a @ a.T
    for values in ([5] * 10 + [1] * 30, [5, 5 - 1e-11, 5 - 1e-9, 4] + [1] * 36, [7, 3] + [0] * 38, range(40)):
        yield turn @ np.diag(values) @ turn.T
    yield np.eye(9) * 4
    yield np.diag([3.0, 3.0, 1.0, 0.0])


@pytest.mark.parametrize("matrix", list(spectra()))
def test_leading_pairs(matrix):
    values, vectors = eigen.leading_pairs(matrix, 8)
    size = np.abs(matrix).max()
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:8], rtol=0, atol=1e-13 * size * len(matrix))
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * size * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_leading_pairs_without_variance():
    assert eigen.leading_pairs(np.zeros((0, 0)), 8)[0].size == 0
    assert not eigen.leading_pairs(np.zeros((3, 3)), 8)[0].any()


def fixed(vector, width):
    return [math.floor(1024 * c) + 100_000 for c in vector] + [100_000] * (width - len(vector))


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STEP", 300)
    rng = np.random.default_rng(8)
    basis = rng.standard_normal((12, 12)) * 2.0 ** -np.arange(12)[:, None]
    made = [[float(np.float32(x)) for x in rng.standard_normal(12) @ basis] for _ in range(400)]
    rows = [(i, v, "x") for i, v in enumerate(made)]
    # repeated rows, rows without an id, a shorter vector; then rows that are left out
    rows += [rows[0], (None, made[1], "x"), (500, made[2][:5], "x"), (501, [], "x")]
    out = [(600, None, "x"), (601, [1.0, None], "x"), (602, [float("nan")] * 12, "x"), (603, [float("inf")] * 12, "x")]
    table = spark.createDataFrame(rows + out, "vec_id long, embedding array<float>, component string").repartition(5)
    found = whitening.whiten(whitening.whole_vectors(table)).collect()
    x = [fixed(v, 12) for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    share = values[::-1][:8] / values.sum()
    assert len(found) == n * 8 and all(r.n == n and r.identity_error < 1e-9 for r in found)
    ours = {}
    for r in found:
        ours.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    by_row = {i: k for k, (i, _, _) in enumerate(rows)}
    signs = [np.sign(ours[1, dev][c + 1][0][0] * white[1, c]) for dev in [sum((n * v - s) ** 2 for v, s in zip(x[1], sums))] for c in range(8)]
    for (i, deviation), parts in ours.items():
        k = by_row[i]
        assert deviation == sum((n * v - s) ** 2 for v, s in zip(x[k], sums))
        for c in range(8):
            assert {len(p) for p in parts.values()} == {2 if i == 0 else 1}
            for w, e in parts[c + 1]:
                assert w == pytest.approx(signs[c] * white[k, c], abs=1e-8) and e == pytest.approx(share[c], rel=1e-9)


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [0.5, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, []), (None, [])], [(1, None)]):
        assert whitening.whiten(whitening.whole_vectors(spark.createDataFrame(rows, kind))).count() == 0
    # three vectors span two directions
    few = spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (2, [2.0, 1.0, 1.0]), (3, [1.0, 4.0, 0.0])], kind)
    assert whitening.whiten(whitening.whole_vectors(few)).count() == 6
    # entries of any finite size
    large = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])], kind)
    rows = whitening.whiten(whitening.whole_vectors(large)).collect()
    assert {r.vec_id for r in rows if r.deviation is None} == {1, 2} and max(r.identity_error for r in rows) < 1e-4


def test_deviations_are_exact():
    x = np.array([[10**6, 0, 5], [2**40, 7, 7], [3, 1, 2]])
    sums = [int(s) for s in x.sum(0)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, 3, sums) == [e if e < 2**63 else None for e in exact]
    x = np.array([[100_000, 100_003], [100_300, 99_000]])
    n, sums = 10**9, [100_100 * 10**9, 99_900 * 10**9 + 7]
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, n, sums) == [e if e < 2**63 else None for e in exact]


# --- licence scan


def license_texts():
    rng = random.Random(6)
    notice = next(t for t in license_scan.TEMPLATES if t.label == "bsd" and len(t.key) > 6)
    return odd_texts() + [
        "Released UNDER the Mit--License, under\nthe mit license.",
        "under the mit licence; the mit license under",
        "Licensed under the Apache License, Version 2.0. " + prose(rng, 50) + " Apache-License version 2 cc-by-NC 4.0",
        "apache license version",
        "license version 2 apache license version 2",
        "This work is licensed under the GNU General Public License, version 3.",
        " ".join(notice.notice),
        "cc by nc " * 5000,
        "the " * 30_000 + "under the mit license",
        # beyond ASCII: letters of a word, not separators; the Kelvin sign is no k
        "under the mit licenseé underé the mit license under the mit license\x00é under the mit license",
        "spdx license identifier mit K",
        "CC BY-NC",
    ]


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = []
    for t in license_scan.TEMPLATES:
        for i in range(len(words)):
            if words[i : i + len(t.key)] == t.key:
                first = i - len(t.before.split())
                same = sum(0 <= first + j < len(words) and words[first + j] == w for j, w in enumerate(t.notice))
                places.append((i, t.label, t.base, same / len(t.notice)))
    return len(words), sorted(places)


def test_license_scan(spark, empty):
    rows = [(i, t, "en", "s", 0, *["x"] * 13) for i, t in enumerate(license_texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.doc_id: (r.n_words, [tuple(p) for p in r.places]) for r in license_scan.scan_licenses(docs).collect()}
    assert found == {i: brute_licenses(t) for i, t, *_ in rows}
    assert sum(len(p) for _, p in found.values()) > 5000 and found[27][1][0][1] == "bsd"
    doubled = spark.createDataFrame(rows + rows[:3] + [(None, *rows[21][1:])], SCHEMA)
    again = license_scan.scan_licenses(doubled).collect()
    assert len(again) == len(rows) + 4 and [len(r.places) for r in again if r.doc_id is None] == [2]
    assert license_scan.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("rarest", ["the", "license", "mit", "2"])
def test_no_place_is_lost_whatever_word_is_rare(spark, rarest, monkeypatch):
    words = license_scan.license_words(license_scan.TEMPLATES)
    monkeypatch.setattr(license_scan, "word_idf", lambda *_: {w: float(w == rarest) + words.index(w) / 1e4 for w in words})
    texts = license_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        assert [tuple(p) for p in r.places] == brute_licenses(texts[r.doc_id])[1]


def test_license_scan_has_no_python(spark, empty):
    plan = license_scan.scan_licenses(empty)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_idf_counts_documents(spark):
    docs = spark.createDataFrame([(1, "mit mit"), (1, "mit"), (None, "apache"), (2, None)], "doc_id long, text string")
    idf = license_scan.word_idf(docs)
    assert idf["mit"] == pytest.approx(math.log(5 / 3)) and idf["apache"] == pytest.approx(math.log(5 / 2))


# --- top-k by pivots


def test_few_pairs_are_evaluated_in_clusters():
    rng = np.random.default_rng(5)
    centres = np.floor(rng.standard_normal((16, 24)) * 400)
    rows = np.floor(np.repeat(centres, 250, 0) + rng.standard_normal((4000, 24)) * 4)
    ids = rng.permutation(4000)
    chosen = rng.choice(4000, 64, replace=False)
    best = topk._Best(ids[chosen], rows[chosen], 10)
    evaluated = sum(topk._search(best, ids[a : a + 1000], rows[a : a + 1000], centres) for a in range(0, 4000, 1000))
    assert evaluated < 0.25 * 64 * 4000
    for n, q in enumerate(chosen):
        scores = rows @ rows[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        assert best.found[n].tolist() == ids[order].tolist() and best.scores[n].tolist() == scores[order].tolist()


def test_ties_and_few_rows():
    rows = np.array([[1.0, 0.0]] * 5 + [[0.0, 0.0]] * 3)
    best = topk._Best(np.array([3, 99]), np.array([[1.0, 0.0], [0.0, 0.0]]), 4)
    topk._search(best, np.array([7, 3, 5, 1, 2, 0, 4, 6]), rows, rows[:1])
    assert best.found.tolist() == [[1, 2, 5, 7], [0, 1, 2, 3]] and best.scores.tolist() == [[1.0] * 4, [0.0] * 4]
    empty = topk._Best(np.array([3]), np.array([[1.0, 0.0]]), 4)
    topk._search(empty, np.array([3, 8]), rows[:2], np.zeros((0, 0)))
    assert empty.found[0, 0] == 8 and empty.scores[0, 1] == -np.inf
