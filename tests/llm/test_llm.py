"""Every operator against a brute-force version on small rows that hold the odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm import (
    common,
    fingerprints,
    mixing,
    ngram_join,
    piece_codec,
    pieces,
    pii,
    queries,
    repeats,
    secret_scan,
    token_count,
    topk,
    toxicity,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names the operators use inside or return
        *[
            T.StructField(n, T.StringType())
            for n in ("pii", "secrets", "node", "part", "key", "size", "block", "score", "ids", "id", "copies", "row", "low")
        ],
    ]
)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    far = words[:60] + prose(rng, 60).split()
    passage = prose(rng, 30)
    return [
        base,
        base,
        " ".join(near),
        " ".join(far),
        base.upper(),
        None,
        "",
        " \t\n",
        "one two",
        "One  TWO",
        "a" * 700,
        "ab" * 300 + "x" + "ab" * 200,
        prose(rng, 9) + passage + prose(rng, 9),
        prose(rng, 7) + passage,
        "é" * 150 + "日本 🎉" * 40,
        "é" * 150 + "日本 🎉" * 40 + "\x00",
        prose(rng, 20_000),
        "mail a.b@c.de, x@y, a@b.c@d.e@f.gh 1.2.3.4.5.6.7.8 999.1.1.1, card 4111 1111 1111 1111 +49 (30) 123-4567 00001.2.3.4",
        'password: "abcdefghijkl" token=token: abcdefghijklmnop AKIAABCDEFGHIJKLMN0 deadbeefdeadbeef  Secret = = x',
        "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789" + " and" * 20 + ", order 123-45-6789",
        " ".join("token=abcdefghijkl%d" % i for i in range(1500)),
    ]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    sources = ["b", "a", None, "b", "c"]
    made = [(i, t, "en", sources[i % 5], len(t or ""), *["x"] * 13) for i, t in enumerate(texts)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def doubled(spark, rows):
    """Repeated rows and rows without an id."""
    return spark.createDataFrame(rows + rows[:4] + [(None, *rows[0][1:]), (None, *rows[16][1:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def base_pii(text):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in odd) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii(docs, doubled, empty, rows):
    found = by_id(pii.find_pii(docs))
    for i, text, *_ in rows:
        ours = [(s.kind, s.start, s.end) for s in found[i].pii]
        assert [s for s in ours if s[0] in pii.BASE_KINDS] == base_pii(text or "")
    assert [s.kind for s in found[19].pii if s.kind in pii.ADDED_KINDS] == ["iban", "ssn"]
    assert pii.find_pii(doubled).count() == doubled.count() and pii.find_pii(empty).count() == 0
    clean = by_id(pii.redact(docs))
    assert clean[0].text == rows[0][1] and clean[5].text is None
    assert "<EMAIL>" in clean[17].text and "4111" not in clean[17].text and clean[17].n_chars == len(clean[17].text)


@pytest.mark.parametrize("number", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"])
@pytest.mark.parametrize("before", ["", "IBAN ", "AB12 ", "KONTO 7 ", "DE00 1234 "])
@pytest.mark.parametrize("after", ["", ".", " BIC", " EUR", " 5 days", " BIC COBADEFF 100 EUR", " GB82 WEST 1234", " é"])
def test_ibans_between_words(number, before, after):
    start, end = len(before), len(before) + len(number)
    assert pii.ibans(before + number + after) == [(start, end)]
    assert number not in pii.redacted_text(before + number + after)
    assert pii.ibans(before + number[:-1] + after) == [] == pii.ibans(before + number + "x" + after)


def test_ibans_in_a_row():
    first, second = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert pii.ibans(f"{first} {second}") == [(0, len(first)), (len(first) + 1, len(first) + 1 + len(second))]
    loose = "XY" + next(f"{n:02}" for n in range(2, 99) if pii.mod97(f"XY{n:02}12345678901")) + " 1234 5678 901"
    assert pii.ibans(f"to {loose} EUR") == [(3, 3 + len(loose))]
    assert pii.ibans("AB12 " * 50_000) == []


def test_long_words_stay_linear():
    assert pii.emails("x" * 300_000 + "@" + "y" * 1000) == []
    assert pii.ips("1" * 300_000) == [] and pii.cards("1" * 300_000) == []


def base_secrets(text):
    kinds = (
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 18),
        (r"[0-9a-f]+", 0, 16),
    )
    out = []
    for n, (pattern, group, least) in enumerate(kinds):
        out += [(m.start(), n, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(docs, doubled, empty, rows):
    found = by_id(secret_scan.find_secrets(docs))
    for i, text, *_ in rows:
        ours = [tuple(s) for s in found[i].secrets if s.kind_no < 3]
        assert ours == base_secrets(text or "")
    assert len(found[20].secrets) == 1500
    assert secret_scan.find_secrets(doubled).count() == doubled.count()
    assert secret_scan.find_secrets(empty).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("abcd|xyz+") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert secret_scan.trigram_query("[0-9]+ab") == []


def test_secret_scan_has_no_python(docs):
    plan = secret_scan.find_secrets(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_codec_and_counts_match_the_library(docs, doubled, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=token_count_path())
    counted = by_id(token_count.count_tokens(docs, queries.VOCABULARY))
    coded = by_id(piece_codec.encode_decode(docs, queries.VOCABULARY))
    for row in docs.collect():
        ids = library.encode(row.text or "")
        assert coded[row.doc_id].ids == ids and coded[row.doc_id].decoded == library.decode(ids)
        assert counted[row.doc_id].n_tokens == len(ids)
        assert counted[row.doc_id].n_bytes == len((row.text or "").encode())
    assert piece_codec.compare_with_library(doubled, queries.VOCABULARY).count() == 0
    assert piece_codec.encode_decode(empty, queries.VOCABULARY).count() == 0
    rng = random.Random(5)
    vocabulary = pieces.read_vocabulary(queries.VOCABULARY)
    decode = piece_codec.decoder(vocabulary)
    for _ in range(300):
        ids = [rng.randrange(3, 300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randrange(9))]
        assert decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def small_vocabulary(rng):
    """Pieces over few letters, many of equal score; not every letter is a piece."""
    letters = pieces.SPACE + "abcé日"
    made = {"".join(rng.choices(letters[1:], k=rng.randrange(2, 6))) for _ in range(60)}
    made |= {pieces.SPACE + p for p in rng.sample(sorted(made), 20)} | set(letters[:4])
    texts = [None, *range(256), *sorted(made)]
    return pieces.Vocabulary(
        {p: rng.randrange(20) << 32 for p in sorted(made)},
        {p: 257 + n for n, p in enumerate(sorted(made))},
        tuple(range(1, 257)),
        tuple(texts),
        0,
    )


def test_units_encoded_together(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(piece_codec, "UNITS", 50)
    for vocabulary in [pieces.read_vocabulary(queries.VOCABULARY), *(small_vocabulary(rng) for _ in range(8))]:
        drawn = ["".join(rng.choices("aaabbcé日x\n\x00🎉", k=rng.randrange(80))) for _ in range(400)]
        words = [*drawn, *WORDS, *map("".join, zip(WORDS, WORDS[::-1])), pieces.SPACE * 3, "\U0010ffff"]
        units = [pieces.SPACE + w for w in words]
        found = piece_codec.encode_units(units, vocabulary, piece_codec.Agendas(vocabulary))
        for unit, ids in zip(units, found):
            assert np.frombuffer(ids, dtype=np.int32).tolist() == piece_codec.encode_unit(unit, vocabulary)
    assert piece_codec.encode_units([], vocabulary, piece_codec.Agendas(vocabulary)) == []


def test_held_results():
    asked = []

    def make_all(new):
        asked.extend(new)
        return [a.upper() for a in new]

    kept = common.Recent(str.upper, size=2)
    for arguments in ({"a"}, {"a", "b", "c", "d", "e"}, {"x" * 65}, {"x" * 65}, set()):
        assert kept.all_of(arguments, make_all) == {a: a.upper() for a in arguments}
        assert len(kept) <= 2 and len(kept.older) <= 2
    assert asked.count("a") == 1 and asked.count("x" * 65) == 2


def test_texts_are_encoded_once(docs):
    for coded in (
        piece_codec.encode_decode(docs, queries.VOCABULARY),
        corpus_pipeline.encode(docs.sparkSession, docs.drop("ids"), ""),
    ):
        plan = coded._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"pythonUDF\d+", plan)) == {"pythonUDF0"}


def token_count_path():
    from keyferry.llm.common import resolved

    return resolved(queries.VOCABULARY)


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngram_join(spark, docs, doubled, empty, rows):
    rng = random.Random(9)
    more = []
    for size in (5, 8, 40, 90):
        base = prose(rng, size).split()
        for _ in range(12):
            words = base.copy()
            for _ in range(rng.randrange(1 + size // 12)):
                words[rng.randrange(size)] = "w%d" % rng.randrange(9)
            more.append(" ".join(words))
    table = spark.createDataFrame(
        [(r[0], r[1]) for r in rows] + [(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"
    )
    found = by_id(ngram_join.jaccard_components(table))
    sets = {r.doc_id: shingles(r.text) for r in table.collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {
        i: (len(sets[i]), c) for i, c in components(sets).items()
    }
    again = ngram_join.jaccard_components(doubled).collect()
    assert len(again) == doubled.count()
    assert {r.component_id for r in again if r.doc_id is None} == {0, 16}
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("piece", [ngram_join.LINK_PIECE, 3])
def test_ngram_links(spark, doubled, piece, monkeypatch):
    monkeypatch.setattr(ngram_join, "LINK_PIECE", piece)
    rng = random.Random(9)
    more = []
    for size in (8, 60, 90):
        base = prose(rng, size).split()
        for _ in range(14):
            words = base.copy()
            for _ in range(rng.randrange(1 + size // 12)):
                words[rng.randrange(size)] = "changed%d" % rng.randrange(9)
            more.append((1000 + len(more), " ".join(words)))
    more += [more[20], (None, more[20][1]), (None, more[30][1])]
    texts = doubled.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 16")
    docs = texts.unionByName(spark.createDataFrame(more, texts.schema))
    sets = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    expected = [
        (i, len(s), sum(bool(s and t) and 100 * len(s & t) >= 80 * len(s | t) for _, t in sets) - bool(s)) for i, s in sets
    ]
    found = ngram_join.jaccard_components(docs, links=True)
    ours = [(r.doc_id, r.n_shingles, r.n_links) for r in found.collect()]
    assert sorted(ours, key=repr) == sorted(expected, key=repr) and max(n for _, _, n in ours) > 3
    same = ngram_join.jaccard_components(docs).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, found.drop("n_links").collect()))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in (5, 6, 9, 20, 60, 150, 400, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            change = rng.integers(0, size // 9 + 1)
            b = np.unique(np.append(a[change:], rng.integers(0, 1 << 63, rng.integers(0, change + 1), dtype=np.uint64)))
            shared = len(np.intersect1d(a, b))
            if ngram_join.linked(shared, len(a), len(b)) and len(a) != shared:
                assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize("length, crowded", [(100, 50_000), (100, 1), (40, 50_000)])
def test_repeats(docs, empty, rows, length, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    some = [r for r in rows if r[0] != 16]
    found = by_id(repeats.remove_repeats(docs.where("doc_id <> 16"), length))
    expected = brute_repeats([(r[0], r[1]) for r in some], length)
    ours = {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in found.items()}
    assert ours == expected
    assert repeats.remove_repeats(empty, length).count() == 0


def test_repeats_with_repeated_rows(doubled):
    assert repeats.remove_repeats(doubled).count() == doubled.count()


def brute_repeats_of_rows(rows, length):
    """By places: rows of one id are one document, each row without an id is its own and comes last."""
    rows = sorted((i is None, i if i is not None else n, (t or "").encode()) for n, (i, t) in enumerate(rows))
    first, gone = {}, {}
    for late, i, data in rows:
        for p in range(len(data) - length + 1):
            place = (late, i, p)
            if first.setdefault(data[p : p + length], place) != place:
                gone.setdefault((late, i), set()).update(range(p, p + length))
    out = []
    for late, i, data in rows:
        cut = gone.get((late, i), ())
        marks = bytes(p in cut for p in range(len(data)))
        kept = bytes(b for b, g in zip(data, marks) if not g)
        out.append((None if late else i, len(data), sum(marks), len(re.findall(b"\1+", marks)), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [repeats.HELD_BYTES, 1])
def test_repeated_rows_and_null_ids_keep_what_is_new(spark, doubled, held, monkeypatch):
    monkeypatch.setattr(repeats, "HELD_BYTES", held)
    rng = random.Random(5)
    alone, both = prose(rng, 60), prose(rng, 60)
    more = [(900, alone + " " + both), (900, alone + " " + both), (None, "x" + both), (None, prose(rng, 60))]
    more += [(None, more[3][1])] * 2 + [(None, ""), (None, None), (2**63 - 1, both[5:])]
    texts = doubled.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 16")
    docs = texts.unionByName(spark.createDataFrame(more, texts.schema))
    ours = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(ours, key=repr) == brute_repeats_of_rows([tuple(r) for r in docs.collect()], repeats.LENGTH)
    assert [r[2] for r in ours if r[0] == 900] == [0, 0]


def test_fingerprints(docs, doubled, empty, rows):
    found = by_id(fingerprints.compare_edited(docs))
    order = sorted(rows, key=lambda r: -r[0])
    for n, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        row = found[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.edited_fingerprint == fingerprints.written(fingerprints.fingerprints_of([changed])[0])
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert found[0].fingerprint == found[1].fingerprint and found[1].near_next == 1
    assert found[16].near_edited > 0.5 > found[16].near_next
    assert fingerprints.compare_edited(doubled).count() == doubled.count()
    assert fingerprints.compare_edited(empty).count() == 0


def test_mixing(docs, doubled, empty, rows):
    found = by_id(mixing.mix_counts(docs, shards=4))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    by_source = defaultdict(int)
    for i, _, _, source, *_ in rows:
        by_source[source] += size[i]
    order = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    target, free, total = {}, set(order), sum(by_source.values())
    while True:
        rest, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > 3 * by_source[s]]
        for s in over:
            target[s] = 3.0 * by_source[s]
            free.discard(s)
        if not over:
            target |= {s: rest * weight[s] / share for s in free}
            break
    for i, _, _, source, *_ in rows:
        row = found[i]
        assert row["size"] == size[i] and row.source_size == by_source[source]
        assert row.target == pytest.approx(target[source])
        assert len(row.copies) <= 3 and all(0 <= c.shard < 4 for c in row.copies)
    assert {i: r.copies for i, r in by_id(mixing.mix_counts(docs.repartition(5), shards=4)).items()} == {
        i: r.copies for i, r in found.items()
    }
    mixed = mixing.mix(docs, shards=4)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(len(r.copies) for r in found.values())
    assert mixing.mix_counts(doubled).count() == doubled.count()
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_quotas_are_exact(spark):
    quotas = {"a": 1000, "b": 3, "c": 0, "d": 77}
    dealt = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "key string, quota long"), 6, 1)
    sums = {r.key: r.n for r in dealt.groupBy("key").agg(F.sum("quota").alias("n")).collect()}
    shards = [r.n for r in dealt.groupBy("shard").agg(F.sum("quota").alias("n")).collect()]
    assert sums == quotas and len(shards) == 6 and max(shards) - min(shards) <= 1


def test_toxicity_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    judged = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.8 * (counts[1, 1] + counts[1, 0])
    assert counts[0, 0] > 0.97 * (counts[0, 0] + counts[0, 1])


def test_toxicity_odd_cases(spark, docs, doubled, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(doubled, model).where("score BETWEEN 0 AND 1").count() == doubled.count()
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, -0.2, 0.0, 0.3, 1.0]) for _ in range(6)], "x") for i in range(300)]
    rows += [(301, None, "x"), (302, [1.0, None], "x"), (303, [float("nan")] * 6, "x"), (304, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x")]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    ours = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=7, query_block=4, shares=3)
    held = {r.vec_id: r.vector for r in vectors.collect()}
    assert len(held) == 300
    found = defaultdict(list)
    for r in ours.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 20):
        scores = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)[:7]
        assert found[q] == [(n + 1, i, int(-s)) for n, (s, i) in enumerate(scores)]
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) == []


def test_few_links_make_few_files(spark):
    from pathlib import Path

    from keyferry.llm.common import gathered, tasks_for
    from keyferry.llm.components import connected

    assert [tasks_for(n) for n in (0, 1, 4096, 4097)] == [1, 1, 1, 2]
    assert gathered(spark.range(100).repartition(8)).rdd.getNumPartitions() == 1
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("rdd-*"))
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50)], "a long, b long")
    found = {r.id: r.component for r in connected(links).collect()}
    assert found == {i: i // 10 * 10 for i in range(40)}
    parts = [len(list(d.glob("part-*"))) for d in set(folder.glob("rdd-*")) - before]
    # the links as they come, and then one file for each round
    assert len(parts) > 2 and sorted(parts)[:-1] == [1] * (len(parts) - 1)


def test_kept_words_are_bounded():
    from keyferry.llm.common import Recent

    kept = Recent(len)
    assert all(kept[str(n)] == len(str(n)) for n in range(450_000))
    assert len(kept) + len(kept.older) <= 200_000


def test_training_holds_no_features_that_do_not_count(monkeypatch):
    import tracemalloc

    from keyferry.llm import toxicity

    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 1 << 15)
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 4000, 12_000))) for _ in range(400)]
    tracemalloc.start()
    try:
        toxicity.train(texts, np.arange(400) % 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 14 million pairs of a text and a feature, none of which tells the classes apart
    assert peak < 160e6
