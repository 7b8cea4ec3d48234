"""Binary packing, spelling variants and hard negatives against plain versions; long white space in the encoder."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakelens.llm import binary_packing, hard_negatives, ids, packing, quality, secrets, spelling

SCHEMA = "doc_id long, text string, word string, n int, part string, block string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(ids.VOCABULARY)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 300_000 + "x", "a" + " " * 400_000 + "b  c<|endoftext|>" + "\t" * 2_001, "　 " * 1_500 + "9" + "\x1c" * 5_000, "<|endoftext|>" + " " * 2_000 + "<|endoftext|>"])
def test_long_white_space(library, text):
    assert ids.encoder(ids.VOCABULARY)(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_200_000), (2, "short")], "doc_id long, text string")
    got = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 1_200_001, 2: len(ids.encoder(ids.VOCABULARY)("short")) + 1}


def test_binary_packing(spark, library):
    random.seed(3)
    texts = [None, "", "a", "word " * 5000, " ".join(str(random.random()) for _ in range(900)), "end <|endoftext|> start", "word " * 5000]
    rows = [(i, t, "w", 1, "p", "b") for i, t in enumerate(texts)] + [(None, "none", "w", 1, "p", "b"), (4, texts[4], "w", 1, "p", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = binary_packing.binary_pieces(docs)
    got = binary_packing.bucketed(pieces, batch_tokens=4096).collect()
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert r.length == len(r.ids) // 4 == 1 << r.bucket and r.length <= 1024 and r.offset == 0
    for doc_id, text in [(r[0], r[1]) for r in rows]:
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(of[doc_id, len(want)], key=lambda r: r.start)
        copies = sum(x[0] == doc_id for x in rows)
        own = own[::copies]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == want
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        lengths = [r.length for r in own]
        assert lengths == sorted(lengths, reverse=True) and all(n == 1 for x, n in Counter(lengths).items() if x < 1024)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.bucket for r in by_id] == sorted(r.bucket for r in got)
    for (bucket, batch), n in Counter((r.bucket, r.batch_id) for r in got).items():
        last = max(r.batch_id for r in got if r.bucket == bucket)
        assert n << bucket == 4096 or batch == last and n << bucket <= 4096
    assert binary_packing.bucketed(binary_packing.binary_pieces(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        binary_packing.binary_pieces(docs, capacity=1000)


def test_sequences_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    binary_packing.write_sequences(binary_packing.binary_pieces(docs), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.filter("length <> power(2, bucket)").isEmpty() and back.agg(F.sum("length")).first()[0] == sum(len(ids.encoder(ids.VOCABULARY)("word " * i)) + 1 for i in range(40))


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return rows


@pytest.mark.parametrize("block_letters", [40, 700, 1 << 18])
def test_spelling_variants(spark, block_letters):
    random.seed(block_letters)
    words = {}
    for _ in range(60):
        w = "".join(random.choice("abé") for _ in range(random.choice([6, 6, 7, 8, 47, 48, 49, 95, 96, 97, 200])))
        for _ in range(random.randint(1, 5)):
            words[w] = random.choice([5, 6, 30, 31, 200, 5000])
            k = random.randrange(len(w) + 1)
            w = random.choice([w[:k] + random.choice("abÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + random.choice("abé") + w[k + 1 :]])
            w = w if len(w) >= 6 else w + "aaa"
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), block_letters=block_letters)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len(rows) == len(words) and {tuple(r) for r in rows} == plain_variants(words)


def test_words(spark):
    random.seed(1)
    some = ["".join(random.choice("abcdé×÷ÀZQ") for _ in range(random.randint(4, 9))) for _ in range(300)]
    texts = [None, "", "1 2 3", "LANGER" * 30_000, *(" ".join(random.choice(some) + random.choice([" ", ",", "9", "Ā"]) for _ in range(400)) for _ in range(60))]
    rows = [(i, t, "w", 1, "p", "b") for i, t in enumerate(texts)] + [(7, texts[7], "w", 1, "p", "b"), (None, "nobody " * 9, "w", 1, "p", "b")]
    want = Counter()
    dropped = 0
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                dropped += 1
            want[run] += 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert dropped and {tuple(r) for r in spelling.vocabulary(docs).collect()} == {(w, n) for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def plain_negatives(rows):
    best = {}
    for vec_id, x, label in rows:
        if None in (vec_id, x, label) or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = (label, [math.floor(256 * v) for v in x])
        best[vec_id] = min(best.get(vec_id, row), row)
    out = set()
    for a, (label, x) in best.items():
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b) for b, (_, y) in best.items() if b != a and len(x) == len(y))
        for s, p in [(s, b) for s, b in scores if best[b][0] == label][:5]:
            fit = [(t, b) for t, b in scores if best[b][0] != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(a, p, i, b, -s, -t) for i, (t, b) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize(("parts", "turns", "size"), [(40, 3, 12), (5000, 5000, 64), (90, 2, 33)])
def test_hard_negatives(spark, parts, turns, size):
    rng = np.random.default_rng(parts)
    centres = rng.normal(size=(4, size)) * 0.2
    rows = []
    for i in range(700):
        label = int(rng.integers(4)) if i % 3 else 0  # one label holds a third and more
        smooth = np.repeat(rng.normal(size=(size + 3) // 4), 4)[:size] * 0.1
        rows.append((i, [float(v) for v in np.round(centres[label] + smooth + rng.normal(size=size) * 0.05, 2)], int(label)))
    rows += [(500, rows[3][1], 1), (5, rows[3][1], 3), (5, rows[3][1], 3), (700, [0.0] * size, 1), (701, [0.0] * size, 2), (702, [], 1), (800, [], 1), (801, [], 2)]
    rows += [(900, None, 1), (901, rows[1][1], None), (902, [None] + rows[1][1][1:], 1), (903, [float("nan")] * size, 1), (904, [float("inf")] * size, 1), (None, rows[1][1], 1)]
    rows += [(1000, rows[1][1] + [1.0], 1), (1001, rows[2][1] + [1.0], 1), (1002, rows[3][1] + [0.7], 2), (1100, [-v for v in rows[9][1]], 77)]
    table = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, scores string, part double").repartition(3)
    rows = [(i, x if x is None else [None if v is None else float(np.float32(v)) for v in x], y) for i, x, y in rows]
    want = plain_negatives(rows)
    got = hard_negatives.hard_negatives(table, F.expr("vec_id % 100 = 0"), part_rows=parts, anchor_rows=turns)
    found = [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(found) == len(want) > 100 and set(found) == want
    assert hard_negatives.hard_negatives(table.limit(0), F.expr("vec_id % 100 = 0")).count() == 0


def test_bounds_spare_scores():
    """On smooth vectors the summaries rule most rows out, and never a right one."""
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(size=(4000, 8)), 8, axis=1) * 90 + rng.normal(size=(4000, 64)) * 4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([0] * 4000, pa.int32()), pa.array(x.astype(int).tolist(), pa.list_(pa.int32()))], names=["vec_id", "label", "vector"])
    side = hard_negatives._Side(pa.Table.from_batches(list(hard_negatives._summarise(iter([batch])))))
    some = slice(0, 4)

    def still(low, high, open_):
        return open_ & (high >= hard_negatives._kth(np.where(open_, low, -np.inf), 5)[:, None])

    columns, open_, scores = hard_negatives._narrowed(side, some, side, np.ones((4, 4000), bool), still)
    assert len(columns) < 400
    exact = (x[some] @ x.T).astype(int)
    for i in range(4):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(columns[open_[i]].tolist())
        assert (scores[i] == exact[i, columns]).all()


def test_quality_scores_against_plain_ones(spark):
    """op4: the model minimises the pairwise loss, computed plainly, and every score is the plain one of its text."""
    rng = random.Random(6)
    good, bad = [f"w{i}" for i in range(300)], ["zz", "!!", "BUY", "now"]
    texts = [" ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(5, 60))) + ("." if i % 3 else "") for i in range(240)] + [None, "", "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 10 else 1 - int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    order = [r.doc_id for r in docs.filter("doc_id < 240").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    chosen = [i for i in order if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([quality.features(texts[i]) for i in chosen], float), np.array([marks[i] for i in chosen])
    model = quality.fit(x, y)
    mean, scale = x.mean(0), x.std(0) + 1e-6

    def basis(rows):
        z = np.clip((rows - mean) / scale, -6, 6)
        return np.hstack([z, z * z])

    draws = np.random.default_rng(7)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    first, second = draws.choice(better, quality.PAIRS), draws.choice(worse, quality.PAIRS)
    differences = basis(x)[first] - basis(x)[second]
    loss = lambda w: np.log1p(np.exp(-differences @ w)).mean() + 0.5e-3 * w @ w
    least = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) >= least
    at = np.quantile(basis(x) @ model.weights, (y == 0).mean())
    raw = basis(np.array([quality.features(t or "") for t in texts], float)) @ model.weights
    want = 1 / (1 + np.exp(-(raw - at + np.log(0.7 / 0.3))))
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert abs(r.score - want[i]) < 1e-9 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(rows[i].predicted == marks[i] for i in marks) > 0.8 * len(marks)


def test_recall_of_random_strings(spark):
    """op2: the character models find planted random strings that no pattern gives away, and leave ordinary identifiers alone."""
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["get", "user", "account", "request", "handler", "parse", "config", "value", "index", "message", "buffer", "stream", "record"]
    planted, rows = {}, []
    for i in range(300):
        words = [rng.choice(["the", "of", "reading", "service", "returns", "_".join(rng.sample(names, 3)), "".join(w.title() for w in rng.sample(names, 3))]) for _ in range(60)]
        if i % 2:
            planted[i] = "".join(rng.choice(letters) for _ in range(rng.randint(24, 44)))
            words.insert(rng.randint(0, 60), planted[i])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {}
    for r in secrets.scan(docs).collect():
        found[r.doc_id] = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
    hit = sum(any(text[i][a:b] in p or p in text[i][a:b] for a, b in found[i]) for i, p in planted.items())
    false = sum(not any(text[i][a:b] in planted.get(i, "") or planted.get(i, "\0") in text[i][a:b] for a, b in [s]) for i, spans in found.items() for s in spans)
    assert hit >= 0.75 * len(planted) and false <= 3, (hit, len(planted), false)  # 122 of 150 and none when this was written


def test_quality_learns_from_every_labelled_row(spark):
    """op4: with many labels the threshold is the exact quantile over all training rows, and nothing depends on partitions."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["good words here.", "fine", "BUY", "!!", "now 7"][: 3 + (i % 3 == 0) * 2]) for _ in range(rng.randint(3, 12))) + f" {i}" for i in range(28_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 0, 1) as quality")
    first, second = ({r.doc_id: r.score for r in quality.score(docs.repartition(n), labels).collect()} for n in (3, 5))
    assert first == second
    trained = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    at = sum(i % 3 == 0 for i in trained) / len(trained) * (len(trained) - 1)
    scores = sorted(first[i] for i in trained)
    assert len(trained) > 20_000 and scores[int(at)] <= 0.7 + 1e-12 and scores[int(at) + 1] >= 0.7 - 1e-12


def test_quality_blocks_hold_all_pairs(spark, monkeypatch):
    """op4: in one block the gradient over all pairs vanishes; a rare label's rows meet every block's."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    good = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), int(g)) for i, (r, g) in enumerate(zip(x, good, strict=True))], "doc_id long, " + ", ".join(f"{f} double" for f in quality.FEATURES) + ", quality int")
    monkeypatch.setattr(quality, "BLOCK_ROWS", 1000)
    model = quality.fit_blocks(rows, int(good.sum()), int((1 - good).sum()), 400)
    b = quality._basis((x - model.mean) / model.scale)
    s = b @ model.weights
    p = 1 / (1 + np.exp(s[good == 1][:, None] - s[good == 0]))
    gradient = (p.sum(1) @ b[good == 1] - p.sum(0) @ b[good == 0]) / p.size - 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-5
    assert abs(model.at - np.quantile(s, (good == 0).mean())) < 1e-9
    few = rows.withColumn("quality", F.when(F.col("doc_id") < 2, 0).otherwise(1))
    monkeypatch.setattr(quality, "BLOCK_ROWS", 20)
    assert np.abs(quality.fit_blocks(few, 398, 2, 400).weights).max() > 0
