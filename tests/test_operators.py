"""Hand-made cases and properties of the operators on labels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.functions import codecs, scoring
from inkstone.operators import alignment, sampling
from inkstone.sources import samples


def one(spark, schema, row, *columns):
    return list(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize("gt, pred, ned", [("sitting", "kitten", 1 - 3 / 7), ("abc", "abc", 1), ("", "", 0), ("abc", "", 0), ("اب", "ا", 0.5)])
def test_similarity(spark, gt, pred, ned):
    assert one(spark, "g string, p string", (gt, pred), scoring.normalized_similarity(F.col("g"), F.col("p"))) == [pytest.approx(ned)]


@pytest.mark.parametrize("ids, text, last", [([0, 3, 3, 0, 3, 5, 5, 0], "cce", [2, 4, 6]), ([0, 0], "", []), ([], "", [])])
def test_decode(spark, ids, text, last):
    assert one(spark, "i array<int>", (ids,), codecs.ctc_decode(F.col("i"), "abcde"), codecs.last_of_runs(F.col("i"))) == [text, last]


def test_encode_and_decode(spark):
    row = one(spark, "s string", ("cabx",), codecs.ctc_encode(F.col("s"), "abc", 6), codecs.attention_encode(F.col("s"), "abc", 6), codecs.attention_encode(F.lit("cab"), "abc", 4))
    assert row == [[3, 1, 2, 0, 0, 0], [0] * 8, [0, 4, 2, 3, 1, 0]]


@pytest.mark.parametrize("text, pruned", [("abc[s]xx", "abc"), ("abc", "ab"), ("", ""), ("[s]", "")])
def test_prune(spark, text, pruned):
    assert one(spark, "s string", (text,), codecs.prune(F.col("s"))) == [pruned]


def test_vocabulary_filters(spark):
    rows = spark.createDataFrame([("ab]",), ("",), ("a€",)], "s string").select(codecs.known(F.col("s"), "ab]-_"), codecs.strip_unknown(F.col("s"), "ab]-_")).collect()
    assert [tuple(r) for r in rows] == [(True, "ab]"), (True, ""), (False, "a")]
    odd = "^-]&&[a\\\U0001f600\n"
    rows = spark.createDataFrame([(odd,), ("b\n^",), ("\U0001f601-",), (None,)], "s string").select(codecs.known(F.col("s"), odd), codecs.strip_unknown(F.col("s"), odd), codecs.ids(F.col("s"), odd)).collect()
    assert [tuple(r) for r in rows] == [(True, odd, [1, 2, 3, 4, 4, 6, 7, 8, 9, 10]), (False, "\n^", [0, 10, 1]), (False, "-", [0, 2]), (None, None, None)]
    assert one(spark, "s string", ("a\n",), codecs.known(F.col("s"), ""), codecs.strip_unknown(F.col("s"), "")) == [False, ""]


def test_vectors(spark):
    x = F.col("x")
    row = one(spark, "x array<float>, e array<double>", ([1.0, 3.0, 3.0], []), scoring.argmax(x), scoring.min_max(x), scoring.cumulative_product(F.col("e")), scoring.one_hot(F.lit(1), 3), scoring.edge_pad(x, 5))
    assert row == [1, [0, 1, 1], 0.0, [0, 1, 0], [1, 3, 3, 3, 3]]


@pytest.mark.parametrize("w, h, out", [(100, 50, 64), (1000, 20, 400), (33, 32, 33)])
def test_width(spark, w, h, out):
    assert one(spark, "w int, h int", (w, h), scoring.resized_width(F.col("w"), F.col("h"), 32, 400)) == [out]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab\U0001f600", max_size=90), st.text("ab\U0001f600", max_size=90))
def test_distance(a, b):
    assert scoring.distance(a, b) == distance(a, b)


def test_distances_of_columns(spark):
    rows = [("abc", None), (None, None), ("", ""), ("", "abc"), ("ab\U0001f600", "b\U0001f600"), ("n" * 5000 + "x", "x" + "n" * 4000)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(scoring.edit_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 0, 3, 1, 1001]


@settings(max_examples=300, deadline=None)
@given(st.text("abc\U0001f600", max_size=12), st.data())
def test_plain_distance(a, data):
    b = "".join(data.draw(st.sampled_from((c, c, c, "", "a", c + "b"))) for c in a)
    assert scoring.plain_distance(a, b) in (None, distance(a, b))
    assert scoring.distance(a, b) == scoring.bit_distance(a, b) == distance(a, b)


def test_distance_of_long_lines_takes_linear_time(monkeypatch):
    monkeypatch.setattr(scoring, "bit_distance", None)
    text = "the even number seven is not the end, " * 20_000
    assert scoring.distance(text, text.replace("e", "a")) == text.count("e")
    assert scoring.distance(text.replace("n", ""), text) == scoring.distance(text, text.replace("n", "")) == text.count("n")


@settings(max_examples=200, deadline=None)
@given(st.text("ab_ ", max_size=8), st.text("ab_ ", max_size=8))
def test_alignment(a, b):
    got = alignment.align(a, b)
    assert "".join(g for g, _ in got if g is not None) == a and "".join(p for _, p in got if p is not None) == b
    assert sum(g != p for g, p in got) == distance(a, b)


def full_table(a, b):
    cost = [[distance(a[:i], b[:j]) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and (a[i - 1] == b[j - 1] or cost[i][j] == cost[i - 1][j - 1] + 1):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


@settings(max_examples=100, deadline=None)
@given(st.text("ab_ ", max_size=12), st.text("ab_ ", max_size=12), st.booleans())
def test_alignment_is_that_of_the_full_table(a, b, kept):
    was = alignment.KEPT
    alignment.KEPT = was if kept else 0
    try:
        assert alignment.align(a, b) == full_table(a, b)
    finally:
        alignment.KEPT = was


def test_alignment_of_a_very_long_line():
    text = "the even number seven is not the end, " * 800
    for pred in (text.replace("e", "a"), text[1:], text.replace("n", "")):
        got = alignment.align(text, pred)
        assert "".join(g for g, _ in got if g) == text and "".join(p for _, p in got if p) == pred
        assert sum(g != p for g, p in got) == max(text.count("e") if "e" not in pred else 0, len(text) - len(pred))


def test_queries_read_every_line(spark):
    from inkstone.plans import catalog

    from .conftest import SMALL

    lines = catalog.table(spark, SMALL, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    want, chars = lines.agg(F.count(F.lit(1)), F.sum(F.char_length("line"))).first()
    for name in ("normalized_edit_distance", "attn_prune", "strip_oov", "flat_encode"):
        assert catalog.QUERIES[name](spark, SMALL).count() == want
    assert catalog.QUERIES["eval_summary"](spark, SMALL).agg(F.sum("n"), F.sum("chars")).first() == (want, chars)
    blanks = lines.agg(F.sum(F.char_length(F.replace("line", F.lit(" "), F.lit(""))))).first()[0]
    assert catalog.QUERIES["char_alignment"](spark, SMALL).filter("ch is not null").agg(F.sum("total")).first()[0] == blanks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab_é", min_size=1, max_size=14), st.text("ab_é", min_size=1, max_size=14)), min_size=1, max_size=5))
def test_alignment_side_by_side(pairs):
    import numpy as np

    width = max(4, *(distance(a, b) for a, b in pairs))
    steps = alignment.align_many(*([np.array([ord(c) for c in x], np.int32) for x in side] for side in zip(*pairs, strict=True)), width)
    got = [[] for _ in pairs]
    for step in steps:
        for k, g, p in step.T:
            got[k].append((chr(g) if g >= 0 else None, chr(p) if p >= 0 else None))
    assert [x[::-1] for x in got] == [alignment.align(*x) for x in pairs]


def test_char_report_is_that_of_single_alignments(spark, monkeypatch):
    from collections import Counter

    texts = [("the seven even 😀", "tha savan avan 😀"), ("the seven even 😀", "he seven even"), ("ab", "ab"), ("", "x"), ("y", ""), ("n" * 300, "n" * 280), ("abcdef" * 60, "abdef" * 60)] * 2
    want = Counter()
    for g, p in texts:
        for a, b in alignment.align(g.replace(" ", ""), p.replace(" ", "")):
            want[a] += 1
            want[a, "right"] += a == b
    for cells in (1 << 23, 64):
        monkeypatch.setattr(alignment, "CELLS", cells)
        got = alignment.char_report(spark.createDataFrame(texts, "g string, p string"), F.col("g"), F.col("p")).collect()
        assert {r["ch"]: (r["total"], r["correct"]) for r in got} == {c: (want[c], want[c, "right"]) for c in want if not isinstance(c, tuple)}
    kept = alignment.checked(spark.createDataFrame([("a", 2, 0.0), ("b", 0, None), ("c", 1, 50.0)], "ch string, total int, accuracy double"), "ab")
    assert [r["ch"] for r in kept.collect()] == ["a"] and alignment.checked(kept, "ab", drop_zero=True).collect() == []


def test_counts_of_long_lines_need_no_table(monkeypatch):
    import pyarrow as pa

    for name in ("align", "align_many"):
        monkeypatch.setattr(alignment, name, None)
    monkeypatch.setattr(scoring, "bit_distance", None)
    monkeypatch.setattr(alignment, "HELD", 1000)
    text = "theevennumbersevenisnotthe\U0001f600end," * 20_000
    batch = pa.RecordBatch.from_pydict({"gt": [text] * 4, "pred": [text, text.replace("e", "a"), text[1:], text.replace("n", "")], "n": [1, 2, 3, 4]})
    got = {(r["g"], r["p"]): r["n"] for out in alignment.count_pairs(iter([batch])) for r in out.to_pylist()}
    want = {(c, c): 10 * text.count(c) for c in set(text) - set("ten")}
    want |= {("t", "t"): 10 * text.count("t") - 3, ("t", None): 3, ("e", "e"): 8 * text.count("e"), ("e", "a"): 2 * text.count("e"), ("n", "n"): 6 * text.count("n"), ("n", None): 4 * text.count("n")}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc\U0001f600", max_size=14), st.data(), st.integers(1, 3)), max_size=5))
def test_counts_are_those_of_single_alignments(drawn):
    from collections import Counter

    import pyarrow as pa

    rows = [(a, "".join(data.draw(st.sampled_from((c, c, c, "", "a", c + "b"))) for c in a), n) for a, data, n in drawn]
    want = Counter()
    for a, b, n in rows:
        for x in alignment.align(a, b):
            want[x] += n
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([],) * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], ["gt", "pred", "n"])
    assert {(r["g"], r["p"]): r["n"] for out in alignment.count_pairs(iter([batch])) for r in out.to_pylist()} == want


def test_char_report(spark):
    pairs = spark.createDataFrame([("a b", "ab"), ("abb", "ac"), ("a", None)], "g string, p string")
    vocab = spark.createDataFrame([("a",), ("b",), ("z",)], "ch string")
    got = {r["ch"]: (r["total"], r["correct"]) for r in alignment.char_report(pairs, F.col("g"), F.col("p"), vocab).collect()}
    assert got == {"a": (2, 2), "b": (3, 1), "z": (0, 0)}


def test_char_counts(spark):
    rows = spark.createDataFrame([("a😀a",), (None,), ("",), ("b a\n",), ("z" * 300_000,)], "line string").repartition(3)
    assert {r["ch"]: r["total"] for r in alignment.char_counts(rows, "line").collect()} == {"a": 3, "😀": 1, "b": 1, " ": 1, "\n": 1, "z": 300_000}
    assert alignment.char_counts(rows.limit(0), "line").collect() == []


def test_numbering(spark):
    rows = spark.createDataFrame([(i * 7, "s0" if i % 3 else None) for i in range(50)] + [(10**15, None)], "id long, source string")
    assert sorted(r["idx"] for r in sampling.dense_index(rows, "id", ranges=7).collect()) == list(range(1, 52))
    assert [r["idx"] for r in sampling.dense_index(rows.withColumn("k", F.format_string("%020d", "id")), "k", ranges=5).orderBy("id").collect()] == list(range(1, 52))
    assert sampling.dense_index(rows.filter("id < 0"), "id").collect() == []
    assert sampling.batch_quota(10, 0.25) == 2 and sampling.batch_quota(10, 0.01) == 1 and sampling.total_quota(10, {"a": 0.25, "b": 0.75}) == 10
    kept = sampling.prefix_fraction(rows, "source", "id", 0.5).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"s0": 16, None: 9}


def test_one_far_key_does_not_gather_the_rest(spark):
    rows = spark.range(10_001).select(F.when(F.col("id") == 10_000, F.lit(10**15)).otherwise(F.col("id")).alias("id"))
    sizes = [r["count"] for r in rows.repartitionByRange(8, "id").groupBy(F.spark_partition_id()).count().collect()]
    got = sampling.dense_index(rows, "id", ranges=8)
    assert max(sizes) < 2500 and got.agg(F.max("idx"), F.countDistinct("idx")).first() == (10_001, 10_001)


def test_null_values_add_nothing(spark):
    rows = spark.createDataFrame([(1, 2), (2, None), (3, 4)], "k int, v int")
    for ranges in (1, 3):
        assert [r["t"] for r in sampling.running_total(rows, "k", F.col("v"), "t", ranges=ranges).orderBy("k").collect()] == [2, 2, 6]


def test_batches_restart(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(3)] + [(i, "b") for i in range(10, 30)], "id int, s string")
    got = sampling.balanced_batches(rows, "s", "id", 4, {"a": 0.5, "b": 0.5}, batches=4).orderBy("batch_id", "s", "id").collect()
    by = {}
    for r in got:
        by.setdefault((r["batch_id"], r["s"]), []).append(r["id"])
    assert all(len(x) == 2 for x in by.values()) and len(by) == 8 and sorted(x for k in range(4) for x in by[k, "a"]) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert [r["n"] for r in sampling.mini_batches(rows, "id", 10).groupBy("batch_id").agg(F.count("id").alias("n")).orderBy("batch_id").collect()] == [10, 10, 3]
    numbered = sampling.dense_index(rows, "id")
    assert [r["draw"] for r in sampling.draws(numbered, "idx", 40).orderBy("draw").collect()] == list(range(1, 41))


def test_strict_labels_and_flat_codec(spark):
    one_row = spark.createDataFrame([("cab",)], "s string")
    assert one_row.select(codecs.strict(F.col("s"), "abc", 3)).first()[0] == "cab"
    for alphabet, length in (("ab", 3), ("abc", 2)):
        with pytest.raises(Exception, match="label"):
            one_row.select(codecs.strict(F.col("s"), alphabet, length)).collect()
    row = one(spark, "i array<int>", ([1, 0, 1, 2, 2, 3, 3],), codecs.flat_decode(F.col("i"), F.lit(2), F.lit(3), "abc"), codecs.attention_decode(F.col("i"), "ab"))
    assert row == ["ab", "[s][GO][s]aabb"]
    assert one(spark, "v array<double>, s string", ([1.0, 2.0, 3.0], "ab[s]"), codecs.prune_values(F.col("v"), F.col("s")), codecs.prune_values(F.col("v"), F.lit("abc"))) == [[1.0, 2.0], [1.0, 2.0]]
    assert one(spark, "x array<double>", ([0.25, 1.0],), scoring.uncentred(scoring.centred(F.col("x")))) == [[0.25, 1.0]]


def test_evaluation(spark):
    from inkstone.operators import evaluation

    hot = lambda k: [9.0 if i == k else 0.0 for i in range(4)]
    logits = spark.createDataFrame([(1, t, hot(k)) for t, k in enumerate((0, 3, 3, 0, 3, 1))] + [(2, t, hot(k)) for t, k in enumerate((2, 3, 1, 2))] + [(3, 0, hot(2))], "sample_id long, t int, logit array<double>")
    truth = spark.createDataFrame([(1, "cca"), (2, "ab"), (4, "x")], "sample_id long, label string")
    got = {r["sample_id"]: r for r in evaluation.evaluate(logits, truth, "abc").collect()}
    assert set(got) == {1, 2} and (got[1]["pred"], got[1]["exact"], got[1]["ned"]) == ("cca", True, 1) and 0.99 < got[1]["confidence"] < 1
    got = {r["sample_id"]: r["pred"] for r in evaluation.evaluate(logits, truth, "ab", "attention").collect()}
    assert got[2] == "ab" and evaluation.summary(evaluation.evaluate(logits, truth, "abc")).first()["n"] == 2


def test_lookup_substitution_and_collate(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", b"x"), (2, "bb", None), (3, "c", b"y")], "idx long, label string, image binary")
    at = spark.createDataFrame([(2,)], "position long")
    assert [r["label"] for r in samples.lookup(rows, at, F.char_length("label") < 2).collect()] == ["c"]
    got = samples.substituted(rows, F.col("image").isNotNull()).orderBy("idx").collect()
    assert [(r["label"], r["substituted"]) for r in got] == [("a", False), ("[dummy_label]", True), ("c", False)]
    pixels = spark.createDataFrame([(1, "a", [1, 2], 0), (2, "b", [3], 0), (3, "c", None, 0)], "idx long, label string, pixels array<int>, b int")
    assert [(r["labels"], r["pixels"]) for r in samples.collate(pixels, "b").collect()] == [(["a", "b"], [[1, 2], [3, 3]])]
    for name in ("x/train", "x/test", "y"):
        samples.write_samples(rows, f"{tmp_path}/{name}")
    assert samples.leaf_tables(spark, str(tmp_path)).count() == 9 and samples.leaf_tables(spark, str(tmp_path), ("train", "/y")).count() == 6
    samples.export_labels(rows, f"{tmp_path}/out")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["image-000000001\ta", "image-000000002\tbb", "image-000000003\tc"]


def test_histogram(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert [(r["bin"], r["n"]) for r in alignment.histogram(rows, "v", 5).orderBy("bin").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_running_best(spark):
    rows = spark.createDataFrame([(i, "k", v) for i, v in enumerate((0.2, 0.2, 0.5, 0.4, 0.6))], "epoch int, k string, v double")
    assert sorted(r["epoch"] for r in sampling.running_best(rows, "k", ["epoch"], "v", F.floor(F.col("epoch") / 2)).collect()) == [0, 2, 4]


def test_ingest(spark, tmp_path):
    (tmp_path / "gt.tsv").write_text("a.png\tlab\n\nbad line\nb.png\tx\ty\nc.png\t\nmissing.png\tz\n")
    for name in ("a.png", "c.png"):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "img" / name).write_bytes(name.encode())
    truth = samples.ground_truth(spark, str(tmp_path / "gt.tsv"))
    assert sorted((r["image_path"], r["label"]) for r in truth.collect()) == [("a.png", "lab"), ("c.png", ""), ("missing.png", "z")]
    lines = spark.read.text(str(tmp_path / "gt.tsv")).select(F.monotonically_increasing_id().alias("line"), "value")
    files, images = samples.image_files(spark, str(tmp_path / "img")), spark.createDataFrame([(f"{tmp_path}/img/a.png",)], "path string")
    kept, rejects = samples.ingest(lines, files, str(tmp_path / "img"), images)
    assert [(r["idx"], r["image_path"]) for r in kept.collect()] == [(1, "a.png")]
    assert sorted((r["value"], r["reason"]) for r in rejects.collect()) == [("", "not two fields"), ("b.png\tx\ty", "not two fields"), ("bad line", "not two fields"), ("c.png\t", "no image"), ("missing.png\tz", "no file")]
    found, rejects = samples.with_images(truth, samples.image_files(spark, str(tmp_path / "img")), str(tmp_path / "img"))
    assert [r["image_path"] for r in rejects.collect()] == ["missing.png"]
    numbered = sampling.dense_index(found.withColumn("n", F.ascii("image_path")), "n")
    samples.write_samples(numbered, str(tmp_path / "store"))
    store = samples.read_samples(spark, str(tmp_path / "store"))
    keys = {r["key"]: bytes(r["value"]) for r in samples.key_values(store).collect()}
    assert keys == {"image-000000001": b"a.png", "label-000000001": b"lab", "image-000000002": b"c.png", "label-000000002": b"", "num-samples": b"2"}


def test_vocabulary_and_report(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\n]\n_\n")
    assert [tuple(r) for r in samples.vocabulary_file(spark, str(tmp_path / "v.txt")).collect()] == [("a", 1), ("]", 2), ("_", 3), (" ", 4)]
    report = spark.createDataFrame([("a", 50.0), ("b", 100.0)], "ch string, accuracy double")
    samples.write_report(report, str(tmp_path / "report"))
    assert [tuple(r) for r in samples.read_report(spark, str(tmp_path / "report")).collect()] == [("b", 100.0), ("a", 50.0)]


def test_pruning(spark):
    from inkstone.plans import catalog

    from .conftest import SMALL

    plan = catalog.QUERIES["dense_index"](spark, SMALL)._jdf.queryExecution().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0] and "CartesianProduct" not in plan
