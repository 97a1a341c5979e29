import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
from millrace.llm import quality, toxicity
from millrace.llm.common import shared_dir, table

SF = "/root/testdata/sf0.01"


#: Only 6 toxic rows of sf0.01 are held out, 97 of sf0.1.
LARGER = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    rows = scored.filter("held_out").join(table(spark, LARGER, "labels"), "doc_id").filter(f"{label} is not null").select("score", "predicted", label).collect()
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def auc(score, y):
    better = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    return better + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()


@pytest.mark.parametrize("module, label, folds, fold, at, least", [(quality, "quality", 4, 2, 0.7, 0.97), (toxicity, "toxic", 5, 0, 0.5, 0.95)])
def test_held_out_accuracy(spark, odd, none, module, label, folds, fold, at, least):
    documents, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = module.fit(documents, labels)
    scored = module.score(documents, model).cache()
    assert scored.count() == documents.count()
    for r in scored.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    score, predicted, y = held_out(spark, scored, label)
    assert auc(score, y) >= least and (predicted == y).mean() >= 0.96 and predicted[y == 1].mean() >= 0.8
    rows = module.score(odd, model, keep=odd.columns, names=("__h", "__s", "__p")).collect()
    assert len(rows) == odd.count() and all(0 <= r["__s"] <= 1 for r in rows)
    assert module.score(none, model).collect() == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_usable_labels(spark, odd, none, module):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for documents in (odd, none):
        model = module.fit(documents, labels)
        assert module.score(documents, model).count() == documents.count()


def test_labels_of_the_held_out_fold_are_never_read(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(documents, labels), quality.fit(documents, turned)
    assert np.allclose(a.weights, b.weights) and a.cut == b.cut


def test_only_near_copies_of_one_label_are_left_out(spark):
    words = [f"w{i}" for i in range(40)]
    sets = [("same", 1, words), ("again", 1, words), ("near", 1, [*words, "more"]), ("ordinary", 0, words)]
    sets += [(f"u{i}", i % 2, ["the", *(f"x{i}_{k}" for k in range(3))]) for i in range(60)]  # a common word, otherwise unrelated
    rows = spark.createDataFrame([(i, n, y, sorted(w)) for i, (n, y, w) in enumerate(sets)], "id long, name string, y int, words array<string>")
    kept = {r["id"] for r in toxicity.apart(rows.drop("name")).collect()}
    assert kept - {2} == {0, 3, *range(4, 64)}
    pairs = [[f"{i}_{k}" for k in range(200)] for i in range(20)]  # near copies share several hashes by chance: most such pairs do
    rows = [(2 * i + j, 1, sorted([*p, *([f"{i}_more"] * j)])) for i, p in enumerate(pairs) for j in (0, 1)]
    assert 20 <= toxicity.apart(spark.createDataFrame(rows, "id long, y int, words array<string>")).count() <= 24


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"] for r in docs.collect()}
        assert now < ids
        ids = now
        assert stage(spark, none, SF).collect() == []
        assert stage(spark, odd, SF).columns == odd.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline_*"))
    assert {r["doc_id"] for r in __spark_entry__.queries()["pipeline"](spark, SF).collect()} == ids
    assert len(set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline_*")) - before) == 1  # what the last stage reads
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).collect() == []


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []


def plain_score(model, text):
    """The toxicity of a text, step by step and without any memory."""
    settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    pack = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings) for d in (model.ordinary, model.toxic)]
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    difference = sorted(len(pack[0].compress(w)) - len(pack[1].compress(w)) for w in (toxicity.BEFORE + b" " + x.encode() + b" " + toxicity.AFTER for x in words))
    x = np.zeros(toxicity.N_FEATURES)
    if words:
        over = [sum(d >= t for d in difference) for t in toxicity.THRESHOLDS]
        x[:] = [difference[-1], sum(difference[-3:]) / len(difference[-3:]), *(np.log(1 + n) for n in over), *((n / len(words)) ** 0.5 for n in over)]
    z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.spread, model.weights)) + model.weights[-1]
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_toxicity_is_that_of_brute_force(spark, odd):
    documents = table(spark, SF, "documents")
    model = toxicity.fit(documents, table(spark, SF, "labels"))
    some = documents.filter("doc_id % 25 = 0").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = some.collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(float(plain_score(model, r["text"])), 9)) for r in texts)
    got = toxicity.score(some, model).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 9)) for r in got) == want
    assert model.toxic.endswith(toxicity.MARKS) and len(model.toxic) == len(model.ordinary)
    empty = model.score(np.zeros((1, toxicity.N_FEATURES)))[0]
    assert {r["score"] for r in toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, " 12 !")], "doc_id long, text string"), model).collect()} == {empty}


def plain_features(text):
    """Features of quality of a text, by counting."""
    raw = (text or "").encode()
    if not raw:
        return [1.0] + [0.0] * 21
    kinds = {k: 0 for k in "ULDBNSXRMW"}
    for b in raw:
        c = chr(b)
        kinds["W" if b >= 128 else "U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else "N" if c == "\n" else "B" if c.isspace() else "S" if c in ".,;:" else "X" if c in "!?" else "R" if c in "|<>{}[]=_*#~^\\/@" else "M"] += 1
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    stops = len(re.findall(rb"\. ", raw)) + len(re.findall(rb"\.\n", raw)) + raw.endswith(b".")
    short = [w for w in words if len(w) <= 3]
    threes = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    log = np.log
    return [0.0, *((kinds[k] / len(raw)) ** 0.5 for k in "ULDBNSXRMW"), log(1 + n), log(len(raw) / n), log(1 + n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), min(1, log(1 + len(set(words))) / log(1 + n)),
            log(1 + n / (1 + stops)), kinds["U"] / max(1, kinds["U"] + kinds["L"]), len(short) / n, len(set(short)) / max(1, len(short)), 1 - len(threes) / max(1, len(words) - 2), log(max([len(w) for w in words], default=1))]


def test_quality_is_that_of_brute_force(spark, odd):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(documents, labels)
    joined = {r["doc_id"]: r for r in documents.join(labels.filter("quality is not null"), "doc_id").collect()}
    learnt = [r for i, r in sorted(joined.items()) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([plain_features(r["text"]) for r in learnt]), np.array([r["quality"] for r in learnt])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    assert np.allclose(mean, model.mean) and np.allclose(spread, model.spread)
    # the weights are where the slope of the pairs' logistic loss, with its ridge, is nought: checked on the same pairs, one by one
    pick = np.random.default_rng(7)
    z, good, poor = (x - mean) / spread, np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better, worse = z[pick.choice(good, quality.PAIRS)], z[pick.choice(poor, quality.PAIRS)]
    lost = 1 / (1 + np.exp((better - worse) @ model.weights))  # chance given to the wrong order
    assert np.abs(-((better - worse) * lost[:, None]).mean(axis=0) + 1e-3 * model.weights).max() < 1e-6
    strengths = sorted(z @ model.weights)
    some = documents.filter("doc_id % 25 = 0").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(some, model, keep=["doc_id", "text"]).collect()}
    for (_, text), score in got.items():
        s = (((np.array(plain_features(text)) - model.mean) / model.spread) * model.weights).sum()
        q = model.quantile(np.array([s]))[0]
        want = 0.7 * q / model.cut if q < model.cut else 0.7 + 0.3 * (q - model.cut) / (1 - model.cut)
        assert abs(score - want) < 1e-6
        if strengths[0] < s < strengths[-1]:
            weaker = np.searchsorted(strengths, s) / len(strengths)
            assert abs((q - 0.05) / 0.9 - weaker) < 0.02


@pytest.mark.parametrize("module", [quality, toxicity])
def test_names_that_clash_and_ids_that_repeat(spark, module):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = module.fit(documents, labels)
    again = documents.unionByName(documents.filter("doc_id % 2 = 0").withColumn("text", F.reverse("text")))
    assert np.allclose(module.fit(again, labels).weights, module.fit(again.repartition(7), labels).weights)
    inside = ["kept", "text", "held_out", "predicted", "__text", "__score", "__predicted", "a.b"]
    wide = documents.limit(20).select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(inside) if c != "text"))
    rows = module.score(wide, model, keep=wide.columns, names=("h", "s", "p"))
    assert rows.columns == [*wide.columns, "h", "s", "p"] and rows.select(*(f"`{c}`" for c in wide.columns)).exceptAll(wide).count() == 0
    assert module.score(spark.createDataFrame([(1, "very long words " * 200_000)], "doc_id long, text string"), model).count() == 1
