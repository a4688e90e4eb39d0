"""The numbered operators on small tables against brute force, with nulls, blanks, long texts, ties and odd columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import decontaminate, hilbert, lines, neardup, neighbours, packing, quality, suffixes, tokens, unigram
from threadloom.llm.components import components
from threadloom.llm.textbytes import chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside under the same names.
EXTRA = ("doc", "key", "row", "word", "at", "class")


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_vocabulary(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, ties and a long text."""
    long = " ".join(f"word{i}" for i in range(20_000))
    texts = [None, "", "   ", "\n\n", "one", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", long, long + " end", "▁ é 日本 🙂\tx"]
    texts += [texts[5]] * 3 + ["x" * 5000]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "src0", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], rows[1]], DOCS)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# -- 1 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["embeddings"])
def test_nearest_recall(spark, sf_dir, name):
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    got = defaultdict(list)
    for r in neighbours.op1_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    hits = 0
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        rows = got[int(ids[q])]
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r.score - v[q] @ v[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in rows)
        hits += len({r.vec_id for r in rows} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / (20 * len(queries)) >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [2.0, 1.0]), (8, [1.0, None]), (9, [1.0]), (10, []), (40, [0.0, -3.0]), (3, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("point", F.lit("clash")).withColumn("key", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(7, 2.0), (3, 1.0), (20, 1.0), (40, 0.0)]
    assert got[40] == [(0, 0.0), (3, 0.0), (20, 0.0), (7, -3.0)]
    assert neighbours.nearest(v.limit(0), v.limit(0)).count() == 0
    sets = neighbours.probe_order(4, 40)
    assert sets[0] == () and len(set(sets)) == len(sets) and all(2 * 4 - 1 - j not in s for s in sets for j in s)


def test_nearest_cuts_ties_by_id(spark):
    """Many different vectors with one score: the smaller ids stay, whatever the blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(-900, 900, (400, 2)))]
    rows.append((1000, [5.0, 0.0, 0.0]))
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = neighbours.Hashing(3, k=1, width=1000.0, tables=2, probes=2)
    got = [(r.vec_id, r.score) for r in neighbours.nearest(v, v.where("vec_id = 1000"), hashing=wide).orderBy("rank").collect()]
    assert got == [(i, 5.0) for i in range(20)]


# -- 2 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    names = [f"c{i}" for i in range(n)]
    cells = spark.createDataFrame(list(itertools.product(range(2**bits), repeat=n)), names)
    rows = sorted((r.h, *[r[c] for c in names]) for r in hilbert.with_hilbert_index(cells, names, bits, "h").collect())
    assert [r[0] for r in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in itertools.pairwise(rows))


def _check_shards(rows, shards=16):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(spark, sf_dir, docs):
    rows = hilbert.op2_hilbert_shards(spark, sf_dir).collect()
    texts = _texts(docs)
    assert len(rows) == len(texts)
    _check_shards(rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)


def test_shards_odd(odd, none, tmp_path):
    placed = hilbert.hilbert_shards(odd, "doc_id", ["source", "lang", "n_chars"], shards=4)
    rows = placed.collect()
    assert len(rows) == odd.count()
    _check_shards(rows, 4)
    assert hilbert.hilbert_shards(none, "doc_id", ["source", "n_chars"]).count() == 0
    unique = odd.dropDuplicates(["doc_id"])
    hilbert.write_shards(unique, hilbert.hilbert_shards(unique.select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], 4), "doc_id", str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("shard=*"))) == 4


# -- 3 -----------------------------------------------------------------------------------------------------------------


def _bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def _classes(texts):
    bags = {i: _bag(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            where[s].append(i)
    for a, b in {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}:
        low = sum((bags[a] & bags[b]).values())
        if 5 * low >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - low):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r["class"] for r in neardup.near_duplicates(docs).collect()}
    assert got == _classes(_texts(docs))


def test_near_duplicates_in_families(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, number = {}, 0
    for family in range(4):
        base = [word() for _ in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            texts[number] = " ".join(own)
            number += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r["class"] for r in neardup.near_duplicates(df).collect()} == _classes(texts)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_elements_are_counted_before_they_meet(monkeypatch, most):
    monkeypatch.setattr(neardup, "COUNTED", most)
    lists = [[1, 2, 3], [], [2, 3, 4], [3, 9], []]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13, 14]), pa.array(lists, pa.list_(pa.int64()))], ["doc", "elements"])
    rows = [r for b in neardup._counted([batch]) for r in b.to_pylist()]
    total, first = {}, {}
    for r in rows:
        total[r["e"]] = total.get(r["e"], 0) + r["c"]
        first[r["e"]] = min(r["doc"], first.get(r["e"], 99))
    assert total == {1: 1, 2: 2, 3: 3, 4: 1, 9: 1} and first == {1: 10, 2: 10, 3: 10, 4: 12, 9: 13}
    assert most < 8 or len(rows) == 5


def test_slots_of_near_copies_are_counted_without_a_row_for_each_element(spark):
    lists = [(i, [-5, 3, 1 << 60, i + 100]) for i in range(300)]
    counts = neardup._slot_counts(spark.createDataFrame(lists, "doc long, elements array<long>").coalesce(1))
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    shift = 64 - neardup.SLOT_BITS
    want = Counter((e & (1 << 64) - 1) >> shift for _, es in lists for e in es)
    assert {r.slot: r.n for r in counts.collect()} == want


def test_near_duplicates_odd(odd, none):
    got = {r.doc_id: r["class"] for r in neardup.near_duplicates(odd).collect()}
    assert got == _classes(_texts(odd))
    assert got[6] == got[7] == 6 and got[9] == 5
    assert neardup.near_duplicates(none).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a, b = np.repeat(np.arange(40), 1 + np.arange(40) % 7), np.repeat(np.arange(10, 50), 1 + np.arange(40) % 5)
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    seen = []
    for _ in range(60):
        name = rng.integers(1, 2**63, 50).astype(np.uint64)
        rows = [(name[i], r, c) for r, bag in enumerate((ca, cb)) for i, c in bag.items()]
        h, r, c = (np.array(x) for x in zip(*rows, strict=True))
        sig = neardup.bag_min_hash(h.astype(np.uint64), r, c, 2)
        seen.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(seen) - true) < 4 * np.sqrt(true * (1 - true) / (60 * neardup.REGISTERS))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------------


def _repeats(texts, n=50):
    first = {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = {}
    for i, t in texts.items():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k + 1 : k + n + 1] = True
        edges = np.diff(gone.astype(int))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)).hexdigest())
    return out


def _removed(df):
    rows = suffixes.remove_repeats(df).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    return {r.id: tuple(r)[1:] for r in rows}


def test_repeats_of_small_alphabet(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 300))) for _ in range(12)]
    texts = {i: "".join(b[rng.randint(0, 40) :][: rng.randint(10, 200)] for b in rng.sample(base, 4)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "a" * 300, 103: "a" * 120 + "b", 104: "é" * 60, 105: "é" * 70, 106: "a" * 49, 107: "a" * 50}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _removed(df) == _repeats(texts)


@pytest.mark.parametrize("slices", [1, 3])
def test_repeats_in_slices(spark, monkeypatch, slices):
    monkeypatch.setattr(suffixes, "SLICES", slices)
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(200)) for _ in range(6)]
    texts = {i: "".join(b[rng.randint(0, 90) :][: rng.randint(40, 110)] for b in rng.sample(base, 3)) for i in range(30)}
    assert _removed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == _repeats(texts)


def test_repeats_of_documents(docs, odd, none):
    assert _removed(docs.where("doc_id < 80")) == _repeats(_texts(docs.where("doc_id < 80")))
    assert _removed(odd) == _repeats(_texts(odd))
    assert suffixes.remove_repeats(none).count() == 0


def test_repeats_store_only_what_is_shared(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SKETCH_BITS", 3, raising=False)  # a sketch of fixed size is full over a large table
    rng, rows, cut = random.Random(7), [], suffixes.cut

    def counted(df):
        stored = cut(df)
        rows.append(stored.count())
        return stored

    monkeypatch.setattr(suffixes, "cut", counted)
    texts = {i: "".join(rng.choice("abcdefgh") for _ in range(2000)) for i in range(40)}
    texts[30] = texts[30][:700] + texts[5][300:420] + texts[30][700:]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _removed(df) == _repeats(texts)
    assert 0 < max(rows) < 200  # 40 texts hold some 5,800 samples


def test_repeats_of_many_documents_at_once(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, head = letters(150), letters(90)
    texts = {i: letters(40) + line + (letters(60) + head if i % 3 else "") + letters(70) for i in range(-20, 60)}
    texts |= {100: texts[3], 101: texts[3], 102: line, 103: texts[59]}
    assert _removed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == _repeats(texts)


# -- 5 -----------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, sf_dir, docs):
    plain = lambda s: " ".join(re.findall(r"\w+", (s or "").lower()))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in _texts(docs).items() for p in [plain(t)] for k, q in items.items() if q and q in p}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, sf_dir).collect()}
    assert got == want


def test_changed_slots(spark, odd, none):
    item = "So Tom had 12 apples and gave Anna 3.5 kg of them before he met Tom in London in 1999."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "7 8 9 10 11 12 13 14")], "item_id long, text string")
    texts = {
        1: "Yes. So Bob had 7 apples and gave Carla 22 kg of them before he met Bob in Paris in 2001. More.",
        2: "Yes. So Bob had 7 apples and gave Carla 22 kg of them before he met Zed in Paris in 2001. More.",  # one name for two
        3: item, 4: "Tom had apples.", 5: None, 6: "7 8 9 10 11 12 13 14",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("slots", F.lit("clash"))
    assert {(r.id, r.item) for r in decontaminate.find_items(df, items, verbatim=False).collect()} == {(1, 1), (3, 1)}
    assert {(r.id, r.item) for r in decontaminate.find_items(df, items).collect()} == {(1, 1), (3, 1), (6, 4)}
    assert decontaminate.find_items(odd, items).count() == 0
    assert decontaminate.find_items(none, items).count() == 0
    assert decontaminate.find_items(df, items.limit(0)).count() == 0


def test_short_items_in_longer_texts(spark, tmp_path):
    items = {1: "What is the capital of France?", 2: "Which river crosses the old town of Basel", 3: "photosynthesis", 4: "Where did Tom buy 12 apples?"}
    before, after = "Some words that come before it without a mark ", " and several more words that follow behind it."
    texts = {i: before + t + after for i, t in items.items()} | {
        5: before + "What is the capital of Spain?" + after,
        6: before + "Where did Bob buy 7 apples?" + after,
        7: before + "so Paris is the capital of France" + after,
        8: before + "which river crosses the new town of Basel" + after,
        9: items[1],
        10: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 4), (9, 1)}
    assert {(r.id, r.item) for r in decontaminate.find_items(df, tests, verbatim=False).collect()} == want
    df.write.parquet(str(tmp_path / "documents.parquet"))
    tests.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()} == want
    kept = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {7, 8, 10}


def test_items_of_placeholders(spark, docs, tmp_path):
    items = {
        1: "7 8 9 10 11 12 13 14",
        2: "so the Great War And Peace Of Old Russia Was Read By Every Man In Town",
        3: "Die Katze und der Hund vom Nachbarn Meier fressen Fisch Brot Wurst Butter Käse Eier",
        4: "Add 3 5 8 13 21 34 55 89 144 233 377 610 987 1597 and then say slowly what comes next in that list",
        5: "12 7",
    }
    texts = {i: "Some words before it " + t + " and several more words behind it." for i, t in items.items()} | {
        6: items[1],
        7: "7 8 9 10 11 12 13 15",
        8: "so the Small Cat And Mouse Of New Prussia Was Seen By Each Woman In Court",
        9: "Some words. Add 4 6 9 14 22 35 56 90 145 234 378 611 988 1598 and then say slowly what comes next in that list",
        10: "12 8",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(i, i) for i in items} | {(6, 1), (9, 4)}
    found = decontaminate.find_items(df, tests).collect()
    assert {(r.id, r.item) for r in found} == want
    assert all(0.5 <= r.coverage <= 1 for r in found)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    tests.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()} == {7, 8, 10}


# -- 6, 9 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference(vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(tokens.VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, unigram.derived_scores(vocabulary), strict=True):
        piece.score = float(score)
    processor = sentencepiece.SentencePieceProcessor()
    processor.LoadFromSerializedProto(model.SerializeToString())
    return processor


def test_tokens_are_the_library_s(docs, odd, vocabulary, reference):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    coded = both.select("text", tokens.token_count("text", vocabulary).alias("n"), tokens.encode("text", vocabulary).alias("ids"))
    for r in coded.withColumn("back", tokens.decode("ids", vocabulary)).collect():
        want = reference.encode(r.text or "")
        assert list(r.ids) == want and r.n == len(want)
        assert r.back == (r.text or "").replace("▁", " ")


def _model(pieces, **normalizer):
    """A model of unigram type: (piece, score, kind) besides the unknown piece and two control pieces."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *pieces]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = any(kind == 6 for _, _, kind in pieces)
    model.normalizer_spec.name = "identity"
    for name, value in normalizer.items():
        setattr(model.normalizer_spec, name, value)
    return model.SerializeToString()


def _both(model, texts):
    """For each text: ids and count of ours, ids of the library."""
    vocabulary = unigram.parse_vocabulary(model)
    processor = sentencepiece.SentencePieceProcessor()
    processor.LoadFromSerializedProto(model)
    engine = unigram.Engine(vocabulary)
    with_ids, counting = unigram.Cache(engine, True), unigram.Cache(engine, False)
    for a, b, data, offs in chunks(pa.array(texts)):
        ids, bounds = unigram.encode_rows(with_ids, data, offs)
        counts = unigram.count_rows(counting, data, offs)
        for i in range(b - a):
            yield texts[a + i], ids[bounds[i] : bounds[i + 1]].tolist(), int(counts[i]), processor.encode(texts[a + i])


_SCORED = [("a", -1.01, 1), ("b", -1.01, 1), ("ab", -2.03, 1), ("▁", -1.5, 1), ("▁a", -2.4, 1), ("ba", -1.9, 1), ("é", -3.3, 1), ("a▁b", -1.7, 1)]
_BYTES = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
_ODD_TEXTS = ["ab", "", " ", "   ", "a   b", "  ab  ba ", "aééb", "xxayy", "日本 日本", "x y", "a\nb\n", "ab ▁ b▁", "▁", "aбвb b", "UVaUVUV b", "ab" * 50]


@pytest.mark.parametrize("spare", [[], _BYTES], ids=["unknown", "bytes"])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("one_space", [True, False])
def test_tokens_of_files_of_unigram_type(spare, dummy, one_space):
    model = _model([*_SCORED, ("UV", 0.0, 4), ("q", 0.0, 5), *spare], add_dummy_prefix=dummy, remove_extra_whitespaces=one_space)
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("aabb  éxUVq日\n"), rng.integers(1, 40))) for _ in range(300)]
    for text, ids, count, want in _both(model, [*_ODD_TEXTS, *made]):
        assert (ids, count) == (want, len(want)), text


def test_tokens_at_random_scores():
    rng = np.random.default_rng(6)
    words = {"".join(rng.choice(list("abcd▁"), rng.integers(2, 5))) for _ in range(120)} | set("abcd▁")
    model = _model([(w, float(-rng.uniform(1, 12)), 1) for w in sorted(words)], remove_extra_whitespaces=False)
    texts = ["".join(rng.choice(list("abcd "), rng.integers(1, 60))) for _ in range(400)]
    for text, ids, count, want in _both(model, texts):
        assert (ids, count) == (want, len(want)), text


def test_unsupported_normalisers_are_refused():
    for settings in ({"precompiled_charsmap": b"x"}, {"escape_whitespaces": False}):
        with pytest.raises(ValueError, match="not supported"):
            unigram.parse_vocabulary(_model(_SCORED, **settings))


def test_tokens_of_nothing(spark, none, vocabulary):
    assert none.select(tokens.token_count("text", vocabulary), tokens.encode("text", vocabulary)).count() == 0
    ids = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in ids.select(tokens.decode("ids", vocabulary)).collect()] == [None, ""]


# -- 7 -----------------------------------------------------------------------------------------------------------------


def _plain_packing(sizes, capacity):
    free = []
    for size in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= size]
        if fits:
            f, i = min(fits)
            free[i] = f - size
        else:
            free.append(capacity - size)
    return sorted(free)


def test_counts_pack_like_pieces():
    rng = random.Random(2)
    for capacity in (1, 7, 16, 50):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        counts = Counter(sizes)
        rules = packing.best_fit_decreasing(counts, capacity)
        used = defaultdict(list)
        for size, n in counts.items():
            own = rules[rules[:, 0] == size]
            for rank in range(n):
                _, lo, row, each, offset, _ = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                used[row + (rank - lo) // each].append((offset + (rank - lo) % each * size, size))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + s == b for (a, s), (b, _) in itertools.pairwise(spans))
        assert sorted(capacity - sum(s for _, s in spans) for spans in used.values()) == _plain_packing(sizes, capacity)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_keeps_all(docs, odd, none, vocabulary, capacity):
    both = docs.select("doc_id", "text").union(odd.dropDuplicates(["doc_id"]).select(F.col("doc_id") + 10_000, "text"))
    want = {r[0]: r[1] for r in both.select("doc_id", tokens.encode("text", vocabulary)).collect()}
    got, rows = defaultdict(dict), packing.pack(both, vocabulary, capacity=capacity).collect()
    for r in rows:
        ids, positions, cu = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4"), r.cu_seqlens
        assert len(ids) == capacity and cu[0] == 0 and cu[-1] <= capacity and not ids[cu[-1] :].any()
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            got[doc][piece] = ids[cu[k] : cu[k + 1]].tolist()
            assert positions[cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in got.items()} == {d: list(v) for d, v in want.items() if v}
    sizes = [len(x) for p in got.values() for x in p.values()]
    assert sorted(capacity - r.cu_seqlens[-1] for r in rows) == _plain_packing(sizes, capacity)
    assert sorted(r["row"] for r in rows) == list(range(len(rows)))
    assert packing.pack(none, vocabulary).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------


def test_quality_on_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.op8_quality(spark, sf_dir).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_quality_odd(odd, none, docs):
    model = quality.fit(docs)
    got = {r.doc_id: r.s for r in odd.select("doc_id", quality.quality_score("text", model).alias("s")).collect()}
    assert got[0] == got[1] == got[2] == got[3] == 0.0 and all(0 <= s <= 1 for s in got.values())
    assert got[5] == got[9]
    empty = quality.fit(none)
    assert none.select(quality.quality_score("text", empty)).count() == 0


def test_labellers_agree_with_the_model():
    rng = np.random.default_rng(4)
    k = len(quality.HEURISTICS)
    good = rng.random(4000) < 0.8
    right = rng.random((4000, k)) < 0.9
    v = np.where(right == good[:, None], 2, 1)
    patterns, inverse, counts = np.unique(quality.pattern_of(v), return_inverse=True, return_counts=True)
    posterior = quality.fit_labellers(patterns, counts.astype(float))
    told = np.array([posterior[p] for p in patterns])[inverse]
    assert ((told > 0.5) == good).mean() > 0.97


# -- 10 ----------------------------------------------------------------------------------------------------------------


def _gone(texts):
    rows = [(i, k, line) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n")) if texts[i] is not None]
    sets = [frozenset(w for w in line.split(" ") if w) if line.count(" ") >= 4 else None for _, _, line in rows]
    where, out = defaultdict(list), set()
    for n, s in enumerate(sets):
        if s is None:
            continue
        near = {m for w in s for m in where[w]}
        if any(rows[m][2] == rows[n][2] or (s and 9 * len(s & sets[m]) >= 4 * (len(s) + len(sets[m]))) for m in near) or (not s and any(rows[m][2] == rows[n][2] for m in range(n))):
            out.add(rows[n][:2])
        for w in s:
            where[w].append(n)
    return out


def test_line_dedup(docs, odd, none):
    got = {tuple(r) for r in lines.repeated_lines(docs, few=5).collect()}
    assert got == _gone(_texts(docs))
    assert {tuple(r) for r in lines.repeated_lines(odd, few=5).collect()} == _gone(_texts(odd))
    assert lines.repeated_lines(none).count() == 0 and lines.repeated_lines(none, few=5).count() == 0


def test_line_dedup_in_families(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(120)]
    base = [rng.sample(pool, rng.randint(5, 25)) for _ in range(6)]
    texts = {}
    for i in range(60):
        own = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(pool)
            own.append(" ".join(line))
        texts[i] = "\n".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    removed = lines.repeated_lines(df, few=5)
    want = _gone(texts)
    assert {tuple(r) for r in removed.collect()} == want
    kept = _texts(lines.remove_lines(df, removed))
    for i, t in texts.items():
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in want]
        assert kept.get(i) == ("\n".join(left) if left else None)


def _gone_of_any_length(texts):
    rows = [(i, k, line, frozenset(line.split(" ")) - {""}) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n")) if line.strip()]
    alike = lambda a, b: a[2] == b[2] or 5 * len(a[3] & b[3]) >= 4 * len(a[3] | b[3])
    return {row[:2] for n, row in enumerate(rows) if any(alike(row, before) for before in rows[:n])}


def test_line_dedup_of_short_lines(spark, docs, odd, none, tmp_path):
    rng = random.Random(9)
    short = ["All rights reserved.", "一二三四五六七八", "a\tb\tc\td\te\tf", "x", "b a", "a b", "a  b", "a a b", "p q r s", "p q r s t", "p q r u", "p q r", "", " ", "\t", "      "]
    texts = {i: "\n".join(" ".join(rng.choices("abcdef", k=rng.randint(1, 6))) if rng.random() < 0.3 else rng.choice(short) for _ in range(5)) for i in range(60)} | {100: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    removed = lines.repeated_lines(df)
    want = _gone_of_any_length(texts)
    assert {tuple(r) for r in removed.collect()} == want
    assert not {(i, k) for i, k in want if not texts[i].split("\n")[k].strip()}
    some = docs.where("doc_id < 60")
    assert {tuple(r) for r in lines.repeated_lines(some).collect()} == _gone_of_any_length(_texts(some))
    assert {tuple(r) for r in lines.repeated_lines(odd).collect()} == _gone_of_any_length(_texts(odd))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, int(k)) for r in lines.op10_line_dedup(spark, str(tmp_path)).collect() for k in r.removed_lines.split(",") if k}
    assert got == want
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df.withColumn("n_chars", F.lit(0)), "").collect()}
    assert sum(t.split("\n").count("All rights reserved.") for t in left.values() if t) == 1


def test_near_duplicates_in_a_crowd(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(200)], {}
    edits = [word() for _ in range(6)]
    for number in range(80):
        own = list(base)
        for _ in range(rng.choice([2, 4, 5])):
            own[rng.randrange(len(own))] = rng.choice(edits) if rng.random() < 0.5 else word()
        texts[number] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _classes(texts)
    assert 10 < len(set(want.values())) < 80
    assert {r.doc_id: r["class"] for r in neardup.near_duplicates(df).collect()} == want


def test_sample_is_bounded_for_any_ids(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words that are all the same here").alias("text"))
    model = quality.fit(df, sample=50)
    assert set(model.posteriors) and np.isfinite(model.weights).all()
